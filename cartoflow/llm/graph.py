"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoflow.llm.common import staged
from cartoflow.llm.textcore import lean
from cartoflow.runtime import ship

#: Edges (two numbers each) up to which one task finds the components of what the rounds have left.
MOST_ALONE = 1_000_000


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges ``a``, ``b``, ascending, and the smallest node it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _alone(batches):
    held = [[c.to_numpy() for c in batch.columns] for batch in batches]
    if held:
        node, root = smallest_reached(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (long columns a, b) and the smallest node it reaches.

    Alternating large-star and small-star rounds; each round is two aggregates and two joins
    on the edges that are left, and is written to the shared folder.  The number of rounds
    grows with the logarithm of the longest path.  Once at most ``MOST_ALONE`` edges are left
    one task ends it.
    """
    ship(edges.sparkSession)

    def finished(df):
        return staged(df.where("a <> b").select("a", "b").repartition(1).mapInArrow(lean(_alone), "node long, root long"), "components")

    def mark(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    bound = edges.count()
    if bound <= MOST_ALONE:
        return finished(edges)
    state = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", bound)
    seen = mark(state)
    while True:
        if seen[0] <= MOST_ALONE:
            return finished(state)
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(state.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        state = staged(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "edges", 2 * seen[0])
        now = mark(state)
        if now == seen:
            break
        seen = now
    roots = state.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
