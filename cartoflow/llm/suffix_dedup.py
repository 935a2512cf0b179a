"""Removal of repeated byte strings by distributed difference-cover suffix sorting.

Every byte that a ``WIDTH``-byte string covers which also starts anywhere else is removed.
Windows (the WIDTH-byte strings) are dealt to classes by content: a window's class is the hash
of its anchor, the ``ANCHOR``-byte string of least hash inside it (the leftmost of equals),
which depends on the window's own bytes only.  Equal windows are in one class at one offset
from the anchor, so classes can be handled apart:

1. An anchor's block is all windows whose anchor it is: consecutive ones.  Blocks are counted by content;
   a block that occurs twice is repeated as a whole and one copy of it stays as a reference.
2. Blocks that occur once, in classes that hold other blocks too, are undecided.  Their
   classes (undecided blocks and references) are packed into strings and suffix-sorted by the
   difference-cover algorithm: sampled triples, names, recursion, merge; neighbours that share
   WIDTH bytes, compared in full, are repeated windows.
3. A class of more than ``MOST_BLOCKS`` different blocks would not fit one task's string.  Its
   windows are compared by an aggregate over their hashes instead, an exact way for the rest.

Texts travel twice: to meet their anchors' verdicts, and, for documents that hold undecided
blocks, to meet the sorted result.

Defined results: null text counts as empty; matches never cross documents; rows with equal
ids and texts count as two occurrences; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoflow.llm import textcore
from cartoflow.llm.common import staged, text_or_empty
from cartoflow.llm.suffix_array import repeated_prefixes, suffix_array
from cartoflow.runtime import ship

WIDTH = 400
ANCHOR = 150
#: Bytes of one string that is suffix-sorted, and blocks of a class that are sorted.
STRING_BYTES, MOST_BLOCKS = 1_900_000, 2500
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
_KEY = "key"


def anchors(flat: np.ndarray, offsets: np.ndarray, width: int, size: int):
    """Blocks of all documents in a byte block.

    Returns the document, the anchor hash, the first and last window start, and the content
    hash of each block; positions are within ``flat``.
    """
    none = np.zeros(0, np.int64)
    reach = width - size + 1  # places of an anchor in a window
    hashes = textcore.rolling_hashes(flat, size)
    if not len(hashes):
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    lengths = np.diff(offsets)
    doc_of = np.repeat(np.arange(len(lengths)), lengths)
    hashes[doc_of[: len(hashes)] != doc_of[size - 1 : size - 1 + len(hashes)]] = _NEVER
    least = textcore.sliding(hashes, reach, np.minimum)
    if not len(least):
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    edge = np.zeros(reach - 1, np.uint64)
    best = textcore.sliding(np.concatenate([edge, least, edge]), reach, np.maximum)
    at = np.flatnonzero((best[: len(hashes)] == hashes) & (hashes != _NEVER))
    starts = np.flatnonzero(np.arange(len(least)) + width <= offsets[doc_of[: len(least)] + 1])
    if not len(starts):
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    # runs of window starts with one least hash; where it occurs twice the leftmost one in the window counts
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (np.diff(starts) > 1) | (least[starts[1:]] != least[starts[:-1]]) | (doc_of[starts[1:]] != doc_of[starts[:-1]])
    lo, hi = starts[fresh], starts[np.append(np.flatnonzero(fresh)[1:], len(starts)) - 1]
    done = []
    while len(lo):
        j = np.searchsorted(at, lo)
        while (wrong := hashes[at[j]] != least[lo]).any():
            j[wrong] += 1
        end = np.minimum(hi, at[j])
        done.append((lo, end, at[j]))
        more = end < hi
        lo, hi = end[more] + 1, hi[more]
    lo, hi, at = (np.concatenate(x) for x in zip(*done, strict=True))
    doc = doc_of[lo]
    content = textcore.span_hashes(flat, lo, hi + width, lower=False)
    content = textcore.combine(content, (at - lo).astype(np.uint64), (hi - lo).astype(np.uint64))
    return doc, hashes[at], lo, hi, content


def _long(x):
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _byte_blocks(batches):
    for batch in batches:
        flat, offsets = textcore.column_bytes(batch.column("text"))
        for a, b in textcore.blocks(offsets):
            yield batch.slice(a, b - a), flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(lo)) - 1
    return lo[new], hi[last]


def _cut(text: bytes, lo: np.ndarray, hi: np.ndarray) -> dict:
    """What is left of a text, and what was removed."""
    lo, hi = _spans(lo, hi)
    kept, at = hashlib.sha256(), 0
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        kept.update(text[at:a])
        at = b
    kept.update(text[at:])
    return {"n_bytes": len(text), "n_removed": int((hi - lo).sum()), "n_spans": len(lo), "kept_sha256": kept.hexdigest()}


def _sorted_class_strings(width):
    """Consecutive classes are packed into strings and sorted; out go the repeated starts of undecided blocks."""

    def solve(held):
        parts, starts, base = [], [], 1
        for blob, row in held:
            parts.append(blob)
            starts.append(base)
            base += len(blob) + 1
        symbols = np.zeros(base, np.int64)
        raw = np.zeros(base + 8, np.uint8)
        valid = np.zeros(base, bool)
        for blob, at in zip(parts, starts, strict=True):
            values = np.frombuffer(blob, np.uint8)
            symbols[at : at + len(values)] = values
            symbols[at : at + len(values)] += 2
            raw[at : at + len(values)] = values
            valid[at : at + len(values) - width + 1] = True
        symbols[symbols == 0] = 1
        order = suffix_array(symbols)
        order = order[valid[order]]
        marked = np.zeros(base, bool)
        marked[order[repeated_prefixes(raw, order, width)]] = True
        out = []
        for (blob, row), at in zip(held, starts, strict=True):
            if row[2]:
                hits = np.flatnonzero(marked[at : at + len(blob) - width + 1])
                if len(hits):
                    edge = np.flatnonzero(np.diff(hits) > 1)
                    first, last = hits[np.append(0, edge + 1)], hits[np.append(edge, len(hits) - 1)]
                    out.append((np.full(len(first), row[0]), row[1] + first, row[1] + last))
        if out:
            yield pa.RecordBatch.from_arrays([_long(np.concatenate(x)) for x in zip(*out, strict=True)], names=[_KEY, "lo", "hi"])

    def run(batches):
        held, group, size, last = [], [], 0, None
        grouped = 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for cls, key, lo, undecided, blob in zip(*columns, strict=True):
                if cls != last and group:
                    if size + grouped > STRING_BYTES and held:
                        yield from solve(held)
                        held, size = [], 0
                    held, size = held + group, size + grouped
                    group, grouped = [], 0
                last = cls
                group.append((blob, (key, lo, undecided)))
                grouped += len(blob) + 1
        if size + grouped > STRING_BYTES and held:
            yield from solve(held)
            held = []
        if held or group:
            yield from solve(held + group)

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, size: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("string").alias("text"))
    keyed = rows.withColumn(_KEY, F.xxhash64("doc_id", "text"))

    def find(batches):
        for part, flat, offsets in _byte_blocks(batches):
            doc, name, lo, hi, content = anchors(flat, offsets, width, size)
            key = part.column(_KEY).to_numpy()
            yield pa.RecordBatch.from_arrays([_long(name), _long(content), pa.array(key[doc]), _long(lo - offsets[doc]), pa.array((hi - lo).astype(np.int32))], names=["cls", "content", _KEY, "lo", "more"])

    found = keyed.where(F.octet_length("text") >= width).select(_KEY, "text").mapInArrow(find, f"cls long, content long, {_KEY} long, lo long, more int")

    # 1. count blocks by content; classes with one occurrence go
    counted = found.groupBy("cls", "content").agg(F.count("*").alias("n"), F.min(F.struct(_KEY, "lo")).alias("example"))
    counted = staged(counted, "blocks")
    per_class = counted.groupBy("cls").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("single")).where(F.col("all") > 1)
    verdicts = staged(counted.join(per_class, "cls").select("cls", "content", (F.col("n") > 1).alias("repeated"), "example", "kinds", (F.col("single") > 0).alias("open")), "verdicts")
    told = found.join(verdicts, ["cls", "content"])
    mine = (F.col("example")[_KEY] == F.col(_KEY)) & (F.col("example")["lo"] == F.col("lo"))
    wanted = F.col("repeated") | F.col("open")
    told = told.where(wanted).select(_KEY, F.struct("lo", "more", "repeated", (F.col("open") & mine & (F.col("kinds") > 1)).alias("ship"), (F.col("kinds") > MOST_BLOCKS).alias("wide"), "cls").alias("b"))
    told = told.groupBy(_KEY).agg(F.collect_set("b").alias("found"))

    # the texts meet their verdicts; finished documents, open documents and the blocks of open classes
    def meet(batches):
        for batch in batches:
            made = {k: [] for k in ("kind", "doc_id", _KEY, "cls", "lo", "hi", "open", "bytes", "n_bytes", "n_removed", "n_spans", "kept_sha256")}

            def add(made=made, **row):
                for k, column in made.items():
                    column.append(row.get(k))

            sent: set = set()
            for doc_id, key, text, given in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = (text.as_py() or "").encode("utf-8", "replace")
                given = given.as_py() or []
                lo = np.array([b["lo"] for b in given if b["repeated"]], np.int64)
                hi = np.array([b["lo"] + b["more"] + width for b in given if b["repeated"]], np.int64)
                undecided = any(b["ship"] and not b["repeated"] for b in given)
                if undecided:
                    lo, hi = _spans(lo, hi)
                    add(kind=1, doc_id=doc_id.as_py(), key=key.as_py(), bytes=data, lo=lo.tolist(), hi=hi.tolist())
                else:
                    add(kind=0, doc_id=doc_id.as_py(), **_cut(data, lo, hi))
                for b in given:
                    if b["ship"] and (key.as_py(), b["lo"]) not in sent:
                        sent.add((key.as_py(), b["lo"]))
                        add(kind=3 if b["wide"] else 2, key=key.as_py(), cls=b["cls"], lo=[b["lo"]], hi=[], open=not b["repeated"], bytes=data[b["lo"] : b["lo"] + b["more"] + width])
            yield pa.RecordBatch.from_pydict(made, schema=_MET)

    met = keyed.join(told, _KEY, "left").select("doc_id", _KEY, "text", "found").mapInArrow(meet, _MET_DDL)
    met = staged(met, "met")

    # 2. suffix-sort open classes
    blocks = met.where("kind = 2").select("cls", _KEY, F.col("lo")[0].alias("lo"), "open", "bytes")
    dealt = blocks.repartition("cls").sortWithinPartitions("cls", _KEY, "lo")
    hits = dealt.mapInArrow(_sorted_class_strings(width), f"{_KEY} long, lo long, hi long")

    # 3. classes too wide for one string: windows by hash
    def windows(batches):
        for batch in batches:
            for key, cls, lo, undecided, blob in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                values = textcore.rolling_hashes(np.frombuffer(blob, np.uint8), width)
                n = len(values)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([cls] * n, pa.int64()), _long(lo + np.arange(n)), pa.array([undecided] * n), _long(values)], names=[_KEY, "cls", "lo", "open", "w"])

    wide = met.where("kind = 3").select(_KEY, "cls", F.col("lo")[0].alias("lo"), "open", "bytes").mapInArrow(windows, f"{_KEY} long, cls long, lo long, open boolean, w long")
    twice = wide.groupBy("cls", "w").agg(F.count("*").alias("n")).where("n > 1").select("cls", "w")
    wide_hits = wide.where("open").join(twice, ["cls", "w"], "left_semi").select(_KEY, "lo", F.col("lo").alias("hi"))

    starts = hits.unionByName(wide_hits).groupBy(_KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))

    def finish(batches):
        for batch in batches:
            out = []
            for doc_id, data, lo, hi, got in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                got = got or []
                lo = np.array([*lo, *(g["lo"] for g in got)], np.int64)
                hi = np.array([*hi, *(g["hi"] + width for g in got)], np.int64)
                out.append({"doc_id": doc_id, **_cut(data, lo, hi)})
            yield pa.RecordBatch.from_pylist(out, schema=_RESULT)

    waiting = met.where("kind = 1").select("doc_id", _KEY, "bytes", "lo", "hi").join(starts, _KEY, "left")
    finished = waiting.select("doc_id", "bytes", "lo", "hi", "starts").mapInArrow(finish, _RESULT_DDL)
    return met.where("kind = 0").select(*_RESULT.names).unionByName(finished)


_RESULT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_MET_DDL = f"kind int, doc_id long, {_KEY} long, cls long, lo array<long>, hi array<long>, open boolean, bytes binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_MET = pa.schema(
    [
        ("kind", pa.int32()),
        ("doc_id", pa.int64()),
        (_KEY, pa.int64()),
        ("cls", pa.int64()),
        ("lo", pa.list_(pa.int64())),
        ("hi", pa.list_(pa.int64())),
        ("open", pa.bool_()),
        ("bytes", pa.binary()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
    ]
)
