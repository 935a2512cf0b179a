"""Spatial and temporal joins built from equi-joins, so that none becomes a nested loop.

Range joins give every row of the smaller-reach side its neighbouring grid cells and join on
the cell; as-of joins run as one union and one window pass, linear in the rows of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_XYZ = ("x", "y", "z")


def _cells(names, size):
    return {f"__c{n}": F.floor(F.col(n) / size) for n in names}


def _spread(df: DataFrame, names, size, window: int = 1) -> DataFrame:
    """Every row once for each cell of its window."""
    steps = F.array(*[F.lit(k) for k in range(-window, window + 1)])
    out = df.withColumns(_cells(names, size))
    for n in names:
        out = out.withColumn(f"__d{n}", F.explode(steps)).withColumn(f"__c{n}", F.col(f"__c{n}") + F.col(f"__d{n}")).drop(f"__d{n}")
    return out


def range_join(left: DataFrame, right: DataFrame, radius: float, keys: tuple[str, ...] = (), names=_XYZ, window: int = 1, strict: bool = False) -> DataFrame:
    """Pairs within ``radius``: left columns as they are, right ones with the prefix r_, and d2.

    The cell is as wide as the radius, so the window of one cell each way is complete.
    """
    size = radius / window
    far = right.withColumns(_cells(names, size))
    far = far.select(*[F.col(c) if c.startswith("__c") else F.col(c).alias("r_" + c) for c in far.columns])
    near = _spread(left, names, size, window)
    on = [F.col(f"n.__c{n}") == F.col(f"f.__c{n}") for n in names] + [F.col(f"n.{k}") == F.col(f"f.r_{k}") for k in keys]
    joined = near.alias("n").join(far.alias("f"), on)
    d2 = sum(((F.col(n) - F.col("r_" + n)) ** 2 for n in names), F.lit(0.0))
    limit = d2 < radius * radius if strict else d2 <= radius * radius
    return joined.where(limit).withColumn("d2", d2).select(*[F.col(f"n.{c}") for c in left.columns], *[F.col("r_" + c) for c in right.columns], "d2")


def _counted(points: DataFrame, radius: float, columns: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    from cartoflow.operators import blocks

    cloud = blocks.finite(points, keys)
    sent = blocks.strips(cloud, blocks.large_groups(cloud, keys, radius), keys, radius)
    needed = (*keys, *_XYZ)
    carried = [F.when(F.col("__own"), F.col(c)).alias(c) for c in columns if c not in needed]
    return _blocked(sent.select(*carried, *needed, "__strip", "__own"), keys, blocks.counted(radius, list(columns)), f"{_schema(cloud, columns)}, neighbours long")


def radius_count(points: DataFrame, radius: float, ids: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Neighbours of each point within ``radius``, itself included; counted in strips, without making pairs."""
    return _counted(points.select(*ids, *keys, *_XYZ), radius, (*ids, *keys), keys)


def surroundings(points: DataFrame, others: DataFrame, radius: float, ids: tuple[str, ...], value: str | None = None, least: bool = False) -> DataFrame:
    """Per point (ids) the number n of ``others`` within ``radius``, the total of their ``value`` and, with ``least``, the least d2 (inf: none); in strips, without making pairs."""
    from cartoflow.operators import blocks

    asking = points.select(*ids, *_XYZ, F.lit(0).cast("long").alias("__n"), F.lit(0.0).alias("__value"), F.lit(True).alias("__asks"))
    kinds = dict(asking.dtypes)
    empty = [F.lit(None).cast(kinds[i]).alias(i) for i in ids]
    # equal places are one row
    given = others.groupBy(*_XYZ).agg(F.count("*").alias("__n"), F.sum(F.col(value) if value else F.lit(0.0)).cast("double").alias("__value"))
    both = blocks.finite(asking.unionByName(given.select(*empty, *_XYZ, "__n", "__value", F.lit(False).alias("__asks"))))
    # a point that asks is needed in its own strip only
    sent = blocks.strips(both, blocks.large_groups(both, (), radius), (), radius).where("__own or not __asks")
    rows = sent.select(*ids, *_XYZ, "__n", "__value", "__asks", "__own", "__strip")
    return _blocked(rows, (), blocks.surrounded(radius, list(ids), least), f"{_schema(both, ids)}, n long, total double, d2 double")


def sparse_removed(points: DataFrame, radius: float, least: int, ids: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Radius outlier removal: points with at least ``least`` neighbours stay."""
    return _counted(points, radius, tuple(points.columns), keys).where(F.col("neighbours") >= least).drop("neighbours")


def knn_within(points: DataFrame, k: int, reach: float, ids: tuple[str, ...], keys: tuple[str, ...] = (), queries: DataFrame | None = None) -> DataFrame:
    """The k nearest points within ``reach`` of each query (of each point where none are given), itself included; ties by id.

    The rank's limit is taken per cell before pairs are shuffled to their query.
    """
    pairs = range_join((points if queries is None else queries).select(*ids, *keys, *_XYZ), points.select(*ids, *keys, *_XYZ), reach, keys)
    w = Window.partitionBy(*ids, *keys).orderBy("d2", *[F.col("r_" + i) for i in ids])
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def _blocked(rows: DataFrame, keys: tuple[str, ...], task, schema: str) -> DataFrame:
    from cartoflow.runtime import ship

    ship(rows.sparkSession)
    return rows.groupBy(*keys, "__strip").applyInArrow(task, schema)


def _schema(df: DataFrame, names, prefix: str = "") -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{prefix}{n}` {kinds[n]}" for n in names)


def _nearest(points: DataFrame, k: int, ids: tuple[str, ...], keys: tuple[str, ...]):
    """The rows of every strip to search in, and the pairs of points that a strip does not settle (or none).

    A point whose grid cell holds k points has them all within the cell's diagonal, which every
    strip gets beyond its edges; the few others, of large groups only, search with a reach that
    is doubled until it holds k or the whole group.
    """
    from cartoflow.operators import blocks
    from cartoflow.operators.sets import _checkpoint_folder

    cloud = blocks.finite(points.select(*ids, *keys, *_XYZ), keys)
    large = blocks.large_groups(cloud, keys)
    for g in large:
        # a flat or empty extent counts as a thousandth of the largest one
        volume = 1.0
        for span in g["spans"]:
            volume *= max(span, g["__span"] / 1000)
        g["__size"] = (volume * 32 * k / g["__n"]) ** (1 / 3) or None
    more = {"__size": "double"}
    rows = blocks.strips(cloud, large, keys, F.coalesce("__size", F.lit(0.0)) * 3**0.5 if large else 0.0, more)
    large = [g for g in large if g["__size"]]
    if not large:
        return rows, None
    _checkpoint_folder(points.sparkSession)
    cells = [f"__c{n}" for n in _XYZ]
    placed = blocks._placed(cloud, large, keys, more).where("__size is not null").withColumns({f"__c{n}": F.floor(F.col(n) / F.col("__size")) for n in _XYZ})
    sparse = placed.groupBy(*keys, *cells).count().where(F.col("count") < k).select(*keys, *cells).checkpoint()
    few = sparse.count()
    if not few:
        return rows, None
    waiting = placed.join(F.broadcast(sparse) if few < 500_000 else sparse, [*keys, *cells], "left_semi").select(*cloud.columns).checkpoint()
    sizes = points.sparkSession.createDataFrame([tuple(g[n] for n in (*keys, "__n")) for g in large], ", ".join(filter(None, [_schema(cloud, keys), "__n long"])))
    reach, span, done = max(g["__size"] for g in large) * 2, max(g["__span"] for g in large), []
    while True:
        asked = F.broadcast(waiting) if waiting.count() < 100_000 else waiting
        found = knn_within(cloud, k, reach, ids, keys, asked).checkpoint()
        if reach > 2 * span:
            done.append(found)
            break
        got = found.groupBy(*ids, *keys).agg(F.count("*").alias("__got"))
        got = got.join(F.broadcast(sizes), list(keys)) if keys else got.crossJoin(F.broadcast(sizes))
        full = got.where(F.col("__got") >= F.least(F.col("__n"), F.lit(k))).select(*ids, *keys)
        done.append(found.join(full, [*ids, *keys], "left_semi").select(*found.columns))
        waiting = waiting.join(full, [*ids, *keys], "left_anti").checkpoint()
        if waiting.isEmpty():
            break
        reach *= 2
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return rows, out


def nearest(points: DataFrame, k: int, ids: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest points of each point in its group (all of a smaller group), itself included; ties by id: one row a neighbour."""
    from cartoflow.operators import blocks

    rows, rest = _nearest(points, k, ids, keys)
    columns = [*ids, *keys, *_XYZ]
    schema = f"{_schema(rows, columns)}, {_schema(rows, columns, 'r_')}, d2 double, rank int"
    out = _blocked(rows, keys, blocks.paired(k, list(ids), list(keys)), schema)
    return out if rest is None else out.unionByName(rest.select(*out.columns))


def neighbourhoods(points: DataFrame, k: int, ids: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a point on its k nearest points (see ``nearest``): their number k, mean distance d, mean place mx .. mz and population covariance c_xx .. c_zz."""
    from cartoflow.operators import blocks

    rows, rest = _nearest(points, k, ids, keys)
    schema = f"{_schema(rows, [*ids, *keys])}, k long, " + ", ".join(f"{n} double" for n in blocks.STATS)
    out = _blocked(rows, keys, blocks.described(k, list(ids), list(keys)), schema)
    if rest is None:
        return out
    means = [F.avg("r_" + a).alias("m" + a) for a in _XYZ]
    pairs = [F.coalesce(F.covar_pop("r_" + a, "r_" + b), F.lit(0.0)).alias(f"c_{a}{b}") for a, b in blocks.PAIRS]
    made = rest.groupBy(*ids, *keys).agg(F.count("*").alias("k"), F.avg(F.sqrt("d2")).alias("d"), *means, *pairs)
    return out.unionByName(made.select(*out.columns))


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, for use more than once."""
    from uuid import uuid4

    from cartoflow.operators.sets import _checkpoint_folder

    spark = df.sparkSession
    _checkpoint_folder(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/kept-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bracket(queries: DataFrame, samples: DataFrame, by: tuple[str, ...], column: str, values: tuple[str, ...], chunk: float | None = None) -> DataFrame:
    """As-of bracketing: the last sample at or before and the first at or after each query.

    Adds l_/r_ copies of ``column`` and ``values`` and state: ok, late (every sample is newer),
    early (every sample is older).  One shuffle; the window runs over both sides.  With
    ``chunk`` a series is cut into spans of that length, each a window of its own, and the
    samples around a span come from one aggregated row a span: a key with a third of all rows
    is then no single task's work.
    """
    given = F.struct(F.col(column).alias("at"), *values)
    left = samples.select(*by, F.col(column).alias("__t"), F.lit(0).alias("__q"), given.alias("__s"), F.lit(None).cast(queries.select(F.struct("*")).schema[0].dataType).alias("__row"))
    right = queries.select(*by, F.col(column).alias("__t"), F.lit(1).alias("__q"), F.lit(None).cast(left.schema["__s"].dataType).alias("__s"), F.struct("*").alias("__row"))
    both = left.unionByName(right).withColumn("__span", F.floor(F.col("__t") / chunk) if chunk else F.lit(0))
    w = Window.partitionBy(*by, "__span")
    before = F.last("__s", ignorenulls=True).over(w.orderBy("__t", "__q").rowsBetween(Window.unboundedPreceding, 0))
    # samples at the query's own time come first going forward and going back
    after = F.last("__s", ignorenulls=True).over(w.orderBy(F.desc("__t"), "__q").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__l", before).withColumn("__r", after).where("__q = 1")
    if chunk:
        ends = both.groupBy(*by, "__span").agg(F.max_by("__s", F.when(F.col("__q") == 0, F.col("__t"))).alias("__last"), F.min_by("__s", F.when(F.col("__q") == 0, F.col("__t"))).alias("__first"))
        spans = Window.partitionBy(*by).orderBy("__span")
        ends = ends.select(*by, "__span", F.last("__last", ignorenulls=True).over(spans.rowsBetween(Window.unboundedPreceding, -1)).alias("__past"), F.first("__first", ignorenulls=True).over(spans.rowsBetween(1, Window.unboundedFollowing)).alias("__next"))
        out = out.join(ends, [*by, "__span"]).withColumn("__l", F.coalesce("__l", "__past")).withColumn("__r", F.coalesce("__r", "__next"))
    state = F.when(F.col("__l").isNull(), "late").when(F.col("__r").isNull(), "early").otherwise("ok")
    cols = [F.col(f"__{s}.{c}").alias(f"{s}_{n}") for s in "lr" for c, n in [("at", column), *[(v, v) for v in values]]]
    return out.select("__row.*", *cols, state.alias("state"))


def share(column: str) -> Column:
    """Position of a bracketed query between its samples, in [0, 1]."""
    span = F.col("r_" + column) - F.col("l_" + column)
    return F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(column) - F.col("l_" + column)) / span))).otherwise(F.lit(0.0))


def interpolated(bracketed: DataFrame, column: str, values: tuple[str, ...], clamp: bool = True) -> DataFrame:
    """Linear interpolation of bracketed samples; outside, the end sample (or null)."""
    u = share(column)
    made = {}
    for v in values:
        inside = F.col("l_" + v) + (F.col("r_" + v) - F.col("l_" + v)) * u
        made[v] = F.when(F.col("state") == "ok", inside).otherwise(F.coalesce("l_" + v, "r_" + v) if clamp else F.lit(None).cast("double"))
    return bracketed.withColumns(made).drop(*[f"{s}_{v}" for s in "lr" for v in values])


def interpolated_fixes(bracketed: DataFrame, column: str = "id") -> DataFrame:
    """Satellite fixes at query times: linear position, the lesser status, sigma unknown (-1) if either is; only bracketed ones."""
    u = share(column)
    lerp = [(F.col("l_" + v) + (F.col("r_" + v) - F.col("l_" + v)) * u).alias(v) for v in ("lat", "lon", "alt")]
    unknown = (F.col("l_sigma") < 0) | (F.col("r_sigma") < 0)
    sigma = F.when(unknown, -1.0).otherwise(F.col("l_sigma") + (F.col("r_sigma") - F.col("l_sigma")) * u)
    return bracketed.where("state = 'ok'").select(column, *lerp, F.least("l_status", "r_status").alias("status"), sigma.alias("sigma"))


def nearest_in_time(queries: DataFrame, samples: DataFrame, by: tuple[str, ...], column: str, values: tuple[str, ...]) -> DataFrame:
    """The sample nearest in time; of two equally near the earlier one."""
    b = bracket(queries, samples, by, column, values)
    back, ahead = F.col(column) - F.col("l_" + column), F.col("r_" + column) - F.col(column)
    take_left = F.col("r_" + column).isNull() | (F.col("l_" + column).isNotNull() & (back <= ahead))
    return b.select(*queries.columns, F.when(take_left, F.col("l_" + column)).otherwise(F.col("r_" + column)).alias("near_" + column), *[F.when(take_left, F.col("l_" + v)).otherwise(F.col("r_" + v)).alias("near_" + v) for v in values])


def nearest_xy(queries: DataFrame, path: DataFrame, ids: tuple[str, ...], path_order: str, reach: float) -> DataFrame:
    """The path row nearest in the plane within ``reach``; queries without one are left out.

    Each place of the queries searches once, first in a small part of ``reach``, and again in
    more of it while it finds nothing; ties go to the smaller ``path_order``.
    """
    waiting = kept(queries.select("x", "y").where("x is not null and y is not null").distinct())
    row = F.struct(*[F.col("r_" + c) for c in path.columns])
    done = []
    for part in (64, 16, 4, 1):
        asked = F.broadcast(waiting) if waiting.count() < 100_000 else waiting
        pairs = range_join(asked, path, reach / part, names=("x", "y"))
        found = kept(pairs.groupBy("x", "y").agg(F.min_by(row, F.struct("d2", "r_" + path_order)).alias("__r"), F.min("d2").alias("d2")))
        done.append(found)
        waiting = kept(waiting.join(found, ["x", "y"], "left_anti"))
        if waiting.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return queries.join(found, ["x", "y"]).select(*[F.col(c) for c in queries.columns], "__r.*", "d2")


def nearest_group(points: DataFrame, at, group: str, order: tuple[str, ...], step: int) -> DataFrame:
    """The group owning the point nearest to a click, over every ``step``-th point of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    picked = points.withColumn("__k", F.row_number().over(w) - 1).where(F.col("__k") % step == 0)
    d2 = sum(((F.col(n) - v) ** 2 for n, v in zip(_XYZ, at, strict=True)), F.lit(0.0))
    return picked.withColumn("d2", d2).groupBy(group).agg(F.min("d2").alias("d2")).agg(F.min_by(group, F.struct("d2", group)).alias(group), F.min("d2").alias("d2"))


def close_pairs(nodes: DataFrame, reach: float, least_gap: float | None = None) -> DataFrame:
    """Node pairs i < j within ``reach``; with ``least_gap`` only those that far apart along the path."""
    cols = ["id", *_XYZ] + (["travelled"] if least_gap is not None else [])
    pairs = range_join(nodes.select(*cols), nodes.select(*cols), reach).where("id < r_id")
    if least_gap is not None:
        pairs = pairs.where(F.col("r_travelled") - F.col("travelled") >= least_gap)
    return pairs.select(F.col("id").alias("i"), F.col("r_id").alias("j"), "d2")


def without_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return pairs.join(edges.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")), ["i", "j"], "left_anti")


def overlap(source: DataFrame, target: DataFrame, size: float, by: str) -> DataFrame:
    """Share of each source group's points that fall in a voxel of each target group that they meet at all."""
    from cartoflow.functions.keys import packed_cell

    cells = target.select(F.col(by).alias("target"), packed_cell(*_XYZ, size).alias("voxel")).distinct()
    own = source.select(F.col(by).alias("source"), packed_cell(*_XYZ, size).alias("voxel")).groupBy("source", "voxel").agg(F.count("*").alias("c"))
    total = own.groupBy("source").agg(F.sum("c").alias("n"))
    hits = own.join(cells, "voxel").where("source <> target").groupBy("source", "target").agg(F.sum("c").alias("hits"))
    return hits.join(total, "source").select("source", "target", "hits", (F.col("hits") / F.col("n")).alias("overlap"))


def by_pixel(matches: DataFrame, points: DataFrame) -> DataFrame:
    """2D-3D correspondences: matched pixels looked up among projected points, rounded to whole pixels."""
    keyed = matches.withColumns({"u": F.floor(F.col("u_rend") + 0.5).cast("int"), "v": F.floor(F.col("v_rend") + 0.5).cast("int")})
    return keyed.join(points, ["u", "v"])


def cell_window(points: DataFrame, at, size: float, window: int) -> DataFrame:
    """Points in the (2 window + 1)^3 cells around a position."""
    near = F.lit(True)
    for n, v in zip(_XYZ, at, strict=True):
        c = int(v // size)
        near = near & F.floor(F.col(n) / size).between(c - window, c + window)
    return points.where(near)


def gather(points: DataFrame, ids: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return points.join(ids, list(keys), "left_semi")


def remove(points: DataFrame, ids: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return points.join(ids, list(keys), "left_anti")


def closest_pair(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """The closest pair of two small sets within ``reach``."""
    pairs = range_join(left, right, reach)
    return pairs.orderBy("d2", "id", "r_id").limit(1)


def endpoint_positions(edges: DataFrame, submaps: DataFrame, hidden: DataFrame) -> DataFrame:
    """Positions of both ends of each factor: a pose key gives the submap's origin, an endpoint key its left or right end by parity; edges that touch a hidden submap go."""

    def end(df, k):
        key = F.when(F.col(f"{k}_chr") == "e", F.floor(F.col(f"{k}_idx") / 2)).otherwise(F.col(f"{k}_idx")).cast("long")
        side = F.when(F.col(f"{k}_chr") == "x", "o").when(F.col(f"{k}_idx") % 2 == 0, "l").otherwise("r")
        keyed = df.withColumn(f"{k}_submap", key).withColumn(f"{k}_side", side)
        s = submaps.select(F.col("submap_id").alias(f"{k}_submap"), F.struct("ox", "oy", "lx", "ly", "rx", "ry").alias("__s"))
        keyed = keyed.join(s, f"{k}_submap", "left")
        for a in "xy":
            keyed = keyed.withColumn(f"{k}_{a}", F.coalesce(F.when(F.col(f"{k}_side") == "o", F.col(f"__s.o{a}")).when(F.col(f"{k}_side") == "l", F.col(f"__s.l{a}")).otherwise(F.col(f"__s.r{a}")), F.lit(0.0)))
        gone = hidden.select(F.col("submap_id").alias(f"{k}_submap"))
        return keyed.drop("__s").join(gone, f"{k}_submap", "left_anti")

    return end(end(edges, "k1"), "k2")


def vector_nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 65_536) -> DataFrame:
    """Exact feature-space neighbours: blocks of queries against all rows, with a top k per batch.

    At most ``block`` queries (in expectation) are broadcast at once as one matrix; more queries
    make more passes over the rows.
    """
    import numpy as np
    import pandas as pd

    from cartoflow.runtime import ship

    spark = vectors.sparkSession
    ship(spark)
    rounds = max(1, -(-queries.count() // block))

    def against(part: int) -> DataFrame:
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == part).select("vec_id", "embedding").orderBy("vec_id").toPandas()
        ids = rows["vec_id"].to_numpy()
        sent = spark.sparkContext.broadcast(np.stack(rows["embedding"].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, 1)))

        def run(batches):
            wanted = sent.value
            for pdf in batches:
                if not len(pdf) or not len(wanted):
                    continue
                m = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                names = pdf["vec_id"].to_numpy()
                for at in range(0, len(wanted), 1024):
                    some = wanted[at : at + 1024]
                    d = (some**2).sum(1)[:, None] + (m**2).sum(1)[None, :] - 2 * some @ m.T
                    # a few more than k: the exact distances below settle what rounding has swapped
                    top = np.argpartition(d, min(k + 8, d.shape[1]) - 1, axis=1)[:, : k + 8]
                    exact = ((m[top] - some[:, None, :]) ** 2).sum(2)
                    yield pd.DataFrame({"query": np.repeat(ids[at : at + 1024], top.shape[1]), "vec_id": names[top].ravel(), "d2": exact.ravel()})

        return vectors.select("vec_id", "embedding").mapInPandas(run, "query long, vec_id long, d2 double")

    found = against(0)
    for part in range(1, rounds):
        found = found.unionByName(against(part))
    w = Window.partitionBy("query").orderBy("d2", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)
