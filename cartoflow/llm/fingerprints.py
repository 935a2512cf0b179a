"""Document fingerprints by locally consistent parsing.

A sequence is parsed by deterministic coin tossing: maximal runs collapse, each symbol is
compared with the one before it (lowest differing bit and its value), and repeating that
leaves labels below eight in which neighbours differ.  Local maxima start phrases, a phrase's
name is a hash of its symbols, and the names are the next level's sequence.  Cuts depend on a
few neighbours only, so equal substrings share all interior names whatever their offset.  The
fingerprint is the sample of the ``KEEP`` smallest names of level ``LEVELS``; the likeness of
two fingerprints is the share of the smallest names of their union that both hold (an
estimate of the Jaccard likeness of the phrase sets).

Rows are dealt by sampled ranges of the id and sorted, so that each document meets the next
one; only the first and last row of a partition are handed across partitions.

Defined results: null text counts as empty; documents are ordered by descending id, nulls
last, equal ids by text; a single document is its own next; equal texts, empty ones included,
have equal fingerprints and likeness 1; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoflow.llm.common import shuffle_partitions, staged, text_or_empty
from cartoflow.llm.textcore import BLOCK_BYTES, lean, mix
from cartoflow.runtime import ship

LEVELS = 3
KEEP = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing: twice the lowest differing bit's place, plus the symbol's bit there."""
    before = np.empty_like(labels)
    before[1:] = labels[:-1]
    before[first] = labels[first] ^ labels.dtype.type(1)  # a sequence's first symbol differs from a made-up neighbour in bit 0
    apart = labels ^ before
    one = labels.dtype.type(1)
    place = np.bitwise_count((apart & (~apart + one)) - one).astype(np.uint8)
    bit = ((labels >> place.astype(labels.dtype)) & one).astype(np.uint8)
    return (place << np.uint8(1)) | bit


def _level(symbols: np.ndarray, names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of the next level and where each sequence starts; ``starts`` has one entry per sequence."""
    n = len(symbols)
    first = np.zeros(n, bool)
    first[starts] = True
    keep = first.copy()
    keep[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(keep)
    runs = np.diff(np.append(at, n)).astype(np.uint64)
    symbols, names, first = symbols[at], mix(names[at] + runs * _ODD), first[at]
    n = len(symbols)
    heads = np.flatnonzero(first)
    labels = symbols
    for _ in range(3 if symbols.dtype == np.uint8 else 4):
        labels = _toss(labels, heads)
    peak = np.zeros(n, bool)
    peak[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    peak[np.minimum(heads + 1, n - 1)] = False  # no peak is judged by a neighbour of another sequence
    tails = np.append(heads[1:], n) - 1
    peak[tails] = False
    peak[heads] = True
    cuts = np.flatnonzero(peak)
    lengths = np.diff(np.append(cuts, n))
    inside = np.arange(n, dtype=np.uint64) - np.repeat(cuts, lengths).astype(np.uint64)
    named = mix(np.add.reduceat(mix(names + (inside + np.uint64(1)) * _ODD), cuts) + lengths.astype(np.uint64))
    return named, np.searchsorted(cuts, heads)


def sketches(texts: list[bytes]) -> list[np.ndarray]:
    """The smallest names of each text, ascending."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_BYTES):
            size += len(texts[end])
            end += 1
        out += _sketch_block(texts[at:end])
        at = end
    return out


def _sketch_block(texts: list[bytes]) -> list[np.ndarray]:
    filled = [k for k, t in enumerate(texts) if t]
    out = [np.zeros(0, np.uint32)] * len(texts)
    if not filled:
        return out
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(texts[k]) for k in filled])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    symbols, names = flat, flat.astype(np.uint64)
    for _ in range(LEVELS):
        names, starts = _level(symbols, names, starts)
        symbols = names
    ends = np.append(starts[1:], len(names))
    small = (mix(names) >> np.uint64(32)).astype(np.uint32)
    owner = np.repeat(np.arange(len(starts), dtype=np.uint64), ends - starts)
    ordered = np.unique((owner << np.uint64(32)) | small.astype(np.uint64))
    edges = np.searchsorted(ordered, np.arange(len(starts) + 1, dtype=np.uint64) << np.uint64(32))
    for i, k in enumerate(filled):
        out[k] = (ordered[edges[i] : min(edges[i + 1], edges[i] + KEEP)] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:KEEP]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).mean())


def spelled(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = [x.split()[0] for x in _DDL.split(", ")]


def _compare(ids: list, texts: list[str], following: list[str]) -> dict:
    """Result columns of documents and the texts that follow them (the next text of one is mostly the next one's own)."""
    edited = []
    for text, after in zip(texts, following, strict=True):
        half = len(text) // 2
        edited.append((text[: len(text) - half] + after[:half]).encode("utf-8", "replace"))
    own = sketches([x.encode("utf-8", "replace") for x in texts])
    tail = sketches([following[-1].encode("utf-8", "replace")]) if texts else []
    after = own[1:] + tail
    changed = sketches(edited)
    return {
        "doc_id": ids,
        "n_chars": [len(x) for x in texts],
        "edited_sha256": [hashlib.sha256(x).hexdigest() for x in edited],
        "fingerprint": [spelled(x) for x in own],
        "edited_fingerprint": [spelled(x) for x in changed],
        "near_edited": [likeness(a, b) for a, b in zip(own, changed, strict=True)],
        "near_next": [likeness(a, b) for a, b in zip(own, after, strict=True)],
    }


_ROWS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(x, pa.string()) for x in _FIELDS[2:5]], ("near_edited", pa.float64()), ("near_next", pa.float64())])
_EDGES = pa.schema([*_ROWS, ("pid", pa.int32()), ("head", pa.string()), ("tail", pa.string())])


def _within(batches):
    """Documents whose next one is in the same partition; the first and last text go out as edge rows."""
    pid = TaskContext.get().partitionId()
    head = held = None
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for at in range(0, len(ids), 512):
            some_ids, some = ids[at : at + 512], [x.as_py() for x in texts.slice(at, 512)]
            head = some[0] if head is None else head
            if held is not None:
                some_ids, some = [held[0], *some_ids], [held[1], *some]
            held = (some_ids[-1], some[-1])
            if len(some) > 1:
                made = _compare(some_ids[:-1], some[:-1], some[1:])
                n = len(some) - 1
                yield pa.RecordBatch.from_pydict(made | {"pid": [pid] * n, "head": [None] * n, "tail": [None] * n}, schema=_EDGES)
    if held is not None:
        yield pa.RecordBatch.from_pylist([{"doc_id": held[0], "pid": pid, "head": head, "tail": held[1]}], schema=_EDGES)


def _across(batches):
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_pydict(_compare([row["doc_id"]], [row["tail"]], [row["head"]]), schema=_ROWS)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    ship(spark)
    order = F.col("doc_id").desc_nulls_last()
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("string").alias("text"))
    dealt = rows.repartitionByRange(shuffle_partitions(spark), order).sortWithinPartitions(order, "text")
    made = staged(dealt.mapInArrow(lean(_within), _DDL + ", pid int, head string, tail string"), "phrases")
    edges = made.where("tail is not null")
    # one number per partition that has rows
    pids = sorted(r["pid"] for r in edges.select("pid").collect())
    pairs = spark.createDataFrame([(p, pids[(k + 1) % len(pids)]) for k, p in enumerate(pids)], "pid int, next_pid int")
    heads = edges.select(F.col("pid").alias("next_pid"), "head")
    last = edges.select("doc_id", "pid", "tail").join(pairs, "pid").join(heads, "next_pid").select("doc_id", "tail", "head")
    return made.where("tail is null").select(*_FIELDS).unionByName(last.mapInArrow(lean(_across), _DDL))
