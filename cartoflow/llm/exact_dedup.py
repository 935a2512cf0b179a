"""Exact deduplication by a distributed content sort.

Rows are dealt by sampled range splitters over (content prefix, content digest, id), each
partition is sorted externally, and neighbours are compared in full.  The id is part of the
splitter key, so one huge group of copies spreads over many partitions; a group that crosses
a partition edge is put together again from one head and one tail row per partition.

Defined results: null text counts as empty; a null id sorts after all others (a group of
only null ids keeps a row with keep_id null); of rows equal in text and id exactly one is
kept; an empty table gives an empty result; further columns are ignored by the digest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartoflow.llm.common import SPACE_RUN, shuffle_partitions, staged, text_or_empty
from cartoflow.llm.textcore import lean
from cartoflow.runtime import ship

_EDGE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_sha256", pa.string()),
        ("pid", pa.int32()),
        ("run", pa.int64()),
        ("run_min", pa.int64()),
        ("run_n", pa.int64()),
        ("first", pa.bool_()),
        ("head", pa.string()),
        ("tail", pa.string()),
    ]
)
_EDGE_DDL = "doc_id long, text_sha256 string, pid int, run long, run_min long, run_n long, first boolean, head string, tail string"
#: Bytes of content in the splitter key; the digest that follows it settles longer common prefixes.
PREFIX = 32


def normalised(column) -> "F.Column":
    """White-space runs become one space (single spaces are left alone, which saves most replacements)."""
    return F.regexp_replace(column, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _runs(batches):
    """Neighbouring full comparisons within one sorted partition.

    Holds 60 bytes a row (ids, digests, run numbers), never the texts.
    """
    ids, digests, fresh = [], [], []
    head = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("norm").cast(pa.large_string())
        same = np.zeros(batch.num_rows, bool)
        same[1:] = pc.equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)
        first = text[0].as_py()
        same[0] = last is not None and last == first
        head = first if head is None else head
        last = text[-1].as_py()
        ids.append(batch.column("doc_id"))
        digests.append(batch.column("sha"))
        fresh.append(~same)
    if not ids:
        return
    pid = TaskContext.get().partitionId()
    new = np.concatenate(fresh)
    run = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    size = np.bincount(run)
    ids = pa.chunked_array(ids).combine_chunks()
    run_min = ids.take(pa.array(starts))
    n = len(run)
    blank = pa.nulls(n, pa.string())
    yield pa.RecordBatch.from_arrays(
        [ids, pa.chunked_array(digests).combine_chunks(), pa.array(np.full(n, pid, np.int32)), pa.array(run), run_min.take(pa.array(run)), pa.array(size[run]), pa.array(new), blank, blank],
        schema=_EDGE,
    )
    final = int(run[-1])
    edges = [(0, head, last if final == 0 else None)] + ([(final, None, last)] if final else [])
    yield pa.RecordBatch.from_pylist(
        [{"pid": pid, "run": r, "run_min": run_min[r].as_py(), "run_n": int(size[r]), "head": h, "tail": t} for r, h, t in edges],
        schema=_EDGE,
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    norm = normalised(text_or_empty())
    keyed = docs.select(F.col("doc_id").cast("long"), norm.alias("norm")).withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256)).withColumn("prefix", F.substring("norm", 1, PREFIX))
    order = ["prefix", "sha", F.col("doc_id").asc_nulls_last()]
    dealt = keyed.repartitionByRange(shuffle_partitions(docs.sparkSession), *order)
    ordered = dealt.sortWithinPartitions("prefix", "sha", "norm", F.col("doc_id").asc_nulls_last())
    runs = staged(ordered.select("doc_id", "sha", "norm").mapInArrow(lean(_runs), _EDGE_DDL), "content_runs")

    # Two rows a partition: a run goes on from the edge before it when the full texts are equal.
    edges = runs.where("head is not null or tail is not null")
    w = Window.orderBy("pid", "run")
    goes_on = F.coalesce((F.col("head") == F.lag("tail").over(w)) & (F.lag("pid").over(w) < F.col("pid")), F.lit(False))
    chained = edges.withColumn("go", goes_on).select("pid", "run", "run_min", "run_n", "go").withColumn("chain", F.sum(F.when(F.col("go"), 0).otherwise(1)).over(w))
    whole = Window.partitionBy("chain")
    groups = chained.select("pid", "run", F.min("run_min").over(whole).alias("chain_min"), F.sum("run_n").over(whole).alias("chain_n"), (~F.col("go")).alias("leads"))
    rows = runs.where("text_sha256 is not null")
    # groups has at most two rows of numbers a partition, whatever the rows hold
    return rows.join(F.broadcast(groups), ["pid", "run"], "left").select(
        "doc_id",
        F.when(F.col("leads").isNull(), F.col("run_min")).otherwise(F.col("chain_min")).alias("keep_id"),
        F.coalesce("chain_n", "run_n").alias("group_size"),
        (F.col("first") & F.coalesce("leads", F.lit(True))).alias("kept"),
        "text_sha256",
    )


ORACLE = f"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE_RUN}', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, sha256(t) AS text_sha256, min(doc_id) OVER (PARTITION BY t) AS keep_id,
             count(*) OVER (PARTITION BY t) AS group_size,
             row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept FROM n)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g
"""
