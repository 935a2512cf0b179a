"""Set operations on graphs and maps, and recovery of missing graph parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def without_types(factors: DataFrame, *types: str) -> DataFrame:
    return factors.where(~F.col("type").isin(*types))


def upsert(base: DataFrame, fresh: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return union(base.join(fresh, list(keys), "left_anti"), fresh)


def relax(factors: DataFrame, lo: int, hi: int, scale: float) -> DataFrame:
    """Factors with a key in [lo, hi] get their sigma multiplied."""
    near = F.col("i").between(lo, hi) | F.col("j").between(lo, hi)
    return factors.withColumn("sigma", F.when(near, F.col("sigma") * scale).otherwise(F.col("sigma"))).withColumn("relaxed", near)


def undo(factors: DataFrame) -> DataFrame:
    """Without the last batch."""
    return factors.join(F.broadcast(factors.agg(F.max("batch_id").alias("batch_id"))), "batch_id", "left_anti")


def append_session(base: DataFrame, other: DataFrame, key: str, session: str) -> DataFrame:
    """Rows of another session with keys moved past the base's and the next session id (one-row aggregate, broadcast)."""
    offset = base.agg((F.max(key) + 1).alias("__k"), (F.max(session) + 1).alias("__s"))
    moved = other.crossJoin(F.broadcast(offset)).withColumn(key, F.col(key) + F.col("__k")).withColumn(session, F.col("__s")).drop("__k", "__s")
    return union(base, moved)


def live_lines(lines: DataFrame, factors: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edge lines whose factor still exists, and new ones."""
    return union(lines.join(factors.select("factor_id"), "factor_id", "left_semi"), fresh)


def missing_links(nodes: DataFrame, edges: DataFrame, by: str = "session") -> DataFrame:
    """Consecutive nodes without an edge between them."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy("id")
    expected = nodes.select(by, F.col("id").alias("i"), F.lead("id").over(w).alias("j")).where("j is not null")
    return expected.join(edges.select("i", "j"), ["i", "j"], "left_anti")


def missing_values(expected: DataFrame, values: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return expected.join(values, list(keys), "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("i").alias("id")).unionByName(edges.select(F.col("j").alias("id")))
    return both.groupBy("id").agg(F.count("*").alias("degree"))


def connected(edges: DataFrame, checkpoint_every: int = 3) -> DataFrame:
    """(id, root): the smallest node each node reaches, by label propagation with pointer jumping.

    Each round is two equi-joins; the lineage is cut by a checkpoint in the session's folder.
    """
    spark = edges.sparkSession
    _checkpoint_folder(spark)
    both = edges.select(F.col("i").alias("a"), F.col("j").alias("b")).unionByName(edges.select(F.col("j").alias("a"), F.col("i").alias("b"))).distinct().checkpoint()
    label = both.select(F.col("a").alias("id")).distinct().withColumn("root", F.col("id")).checkpoint()
    while True:
        seen = both.join(label, both.b == label.id).groupBy("a").agg(F.min("root").alias("m"))
        stepped = label.join(seen, label.id == seen.a).select("id", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = stepped.select(F.col("id").alias("k"), F.col("root").alias("far"))
        jumped = stepped.join(jump, stepped.root == jump.k).select("id", "old", F.least("root", "far").alias("root")).checkpoint()
        changed = jumped.where("root <> old").limit(1).count()
        label = jumped.select("id", "root")
        if not changed:
            return label


def _checkpoint_folder(spark) -> None:
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and context._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="cartoflow-"))
    elif context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
