"""Grouped reductions: voxels, range images, percentiles by index, statistics.

All but the percentiles are single hash aggregations with map-side partials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoflow.functions.keys import packed_cell

_XYZ = ("x", "y", "z")


def voxel_mean(points: DataFrame, size: float, attributes: tuple[str, ...] = ()) -> DataFrame:
    return points.groupBy(packed_cell(*_XYZ, size).alias("voxel")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in (*_XYZ, *attributes)])


def voxel_merge(points: DataFrame, size: float, order: tuple[str, ...]) -> DataFrame:
    """One row a voxel: mean position, highest intensity, lowest range and time, and the first scanner id in ``order``."""
    return points.groupBy(packed_cell(*_XYZ, size).alias("voxel")).agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(c) for c in _XYZ],
        F.max("intensity").alias("intensity"),
        F.min("range").alias("range"),
        F.min("gps_time").alias("gps_time"),
        F.min_by("scanner_id", F.struct(*order)).alias("scanner_id"),
    )


def voxel_quota(points: DataFrame, size: float, rate: float, id_hash: Column) -> DataFrame:
    """Random-grid downsampling: from each voxel the first ceil(rate * n) points in hash order."""
    keyed = points.withColumn("voxel", packed_cell(*_XYZ, size)).withColumn("__h", id_hash)
    w = Window.partitionBy("voxel")
    ranked = keyed.withColumn("__k", F.row_number().over(w.orderBy("__h"))).withColumn("__n", F.count("*").over(w))
    return ranked.where(F.col("__k") <= F.ceil(F.col("__n") * rate)).drop("__h", "__k", "__n")


def voxel_gaussians(points: DataFrame, size: float, levels: int = 2, factor: float = 2.0) -> DataFrame:
    """Mean and population covariance per voxel at ``levels`` resolutions."""
    per_level = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), packed_cell(*_XYZ, size * factor**k).alias("voxel")) for k in range(levels)]))
    wide = points.select(*_XYZ, per_level.alias("lv")).select(*_XYZ, "lv.*")
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return wide.groupBy("level", "voxel").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in _XYZ], *[F.covar_pop(a, b).alias(f"c_{a}{b}") for a, b in pairs])


def voxel_cap(points: DataFrame, size: float, most: int, order: tuple[str, ...]) -> DataFrame:
    """The first ``most`` points of each voxel."""
    keyed = points.withColumn("voxel", packed_cell(*_XYZ, size))
    return keyed.withColumn("__k", F.row_number().over(Window.partitionBy("voxel").orderBy(*order))).where(F.col("__k") <= most).drop("__k")


def voxel_columns(points: DataFrame, size: float, mode: str = "xy_center") -> DataFrame:
    """HD voxels: cell centres, weighted means, or XY centres with the mean height."""
    cells = {f"c{n}": F.floor(F.col(n) / size) for n in ("xy" if mode == "xy_center" else "xyz")}
    keyed = points.withColumns(cells)
    grouped = keyed.groupBy(*cells).agg(F.count("*").alias("n"), *[F.avg(n).alias(n) for n in _XYZ], F.avg("intensity").alias("intensity"))
    if mode == "weighted":
        return grouped
    return grouped.withColumns({n: (F.col(f"c{n}") + 0.5) * size for n in ("xy" if mode == "xy_center" else "xyz")})


def share_out(df: DataFrame, n: int, order: tuple[str, ...], group: tuple[str, ...] = ()) -> DataFrame:
    """Round-robin assignment of rows to ``n`` frames in order, within groups."""
    return df.withColumn("slot", (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) % n)


def bounds(points: DataFrame, *by: str) -> DataFrame:
    return points.groupBy(*by).agg(F.count("*").alias("n"), *[f(c).alias(f"{p}_{c}") for c in _XYZ for f, p in ((F.min, "lo"), (F.max, "hi"))])


def centroid(points: DataFrame, *by: str) -> DataFrame:
    return points.groupBy(*by).agg(*[F.avg(c).alias(f"m{c}") for c in _XYZ])


def gravity(samples: DataFrame, *by: str) -> DataFrame:
    """The unit vector of the summed acceleration."""
    s = samples.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("ax", "ay", "az")])
    n = F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2)
    return s.select(*by, *[(F.col(c) / n).alias(c) for c in ("ax", "ay", "az")])


def statistics(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Mean, sample deviation (0 for a single row), least and largest."""
    return df.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("sd"), F.min(column).alias("least"), F.max(column).alias("most"))


#: Histogram bins in which a percentile's rank is first located.
BINS = 2048


def percentile_at(df: DataFrame, column: str, by: tuple[str, ...], **ranks: Column) -> DataFrame:
    """Values at zero-based positions of the sorted column; a rank is an expression of ``n``, the group's size.

    Values are counted first (map-side), a histogram over each group's range locates the bins
    that hold the ranks, and only the values of those bins are put in order: no task sorts a group.
    """
    value = F.col(column)
    counted = df.where(value.isNotNull()).groupBy(*by, column).agg(F.count("*").alias("c"))
    span = counted.groupBy(*by).agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"), F.sum("c").alias("n"))
    width = F.col("__hi") - F.col("__lo")
    bin_of = F.when((width > 0) & (width < float("inf")), F.least(F.lit(BINS - 1), F.floor((value - F.col("__lo")) / width * BINS))).otherwise(F.lit(0))
    joined = counted.join(span, list(by)) if by else counted.crossJoin(F.broadcast(span))
    keyed = joined.select(*by, column, "c", "n", bin_of.cast("int").alias("__bin"))
    bins = keyed.groupBy(*by, "__bin").agg(F.sum("c").alias("__size"), F.max("n").alias("n"))
    placed = bins.withColumn("__before", F.sum("__size").over(Window.partitionBy(*by).orderBy("__bin")) - F.col("__size"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]))
    holding = placed.withColumn("__q", asked).where((F.col("__q.rank") >= F.col("__before")) & (F.col("__q.rank") < F.col("__before") + F.col("__size")))
    wanted = holding.select(*by, "__bin", "__q.name", (F.col("__q.rank") - F.col("__before")).alias("__rest"))
    inside = keyed.join(wanted, [*by, "__bin"])
    upto = F.sum("c").over(Window.partitionBy(*by, "__bin", "name").orderBy(column))
    picked = inside.withColumn("__upto", upto).where(F.col("__upto") > F.col("__rest"))
    values = [F.min(F.when(F.col("name") == name, value)).alias(name) for name in ranks]
    return picked.groupBy(*by).agg(*values, F.max("n").alias("n"))


def rank_floor(p: float) -> Column:
    """int(p * n), kept inside the group."""
    return F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1)


def rank_inner(p: float) -> Column:
    """int(p * (n - 1))."""
    return F.floor((F.col("n") - 1) * F.lit(p))


def strided_percentiles(df: DataFrame, column: str, order: tuple[str, ...], target: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Every max(1, n / target)-th row in order, then the values at m / 100 and 99 m / 100 of the sorted picks."""
    w = Window.partitionBy(*by)
    numbered = df.withColumn("__k", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    picked = numbered.where(F.col("__k") % F.greatest(F.lit(1), F.floor(F.col("__n") / target)) == 0)
    return percentile_at(picked, column, by, low=F.floor(F.col("n") / 100), high=F.floor(F.col("n") * 99 / 100))


def upper_median(df: DataFrame, column: str, *by: str) -> DataFrame:
    return percentile_at(df, column, by, median=F.floor(F.col("n") / 2)).select(*by, "median", "n")


def score_bands(matches: DataFrame, high: float = 0.8, middle: float = 0.5) -> DataFrame:
    s = F.col("score")
    return matches.agg(F.count_if(s >= high).alias("high"), F.count_if((s >= middle) & (s < high)).alias("middle"), F.count_if(s < middle).alias("low"))


def memory(points: DataFrame, sizes: dict[str, int], *by: str) -> DataFrame:
    """Bytes of the attributes a group holds (an attribute counts for all points when any point has it)."""
    total = F.lit(0)
    for name, size in sizes.items():
        total = total + F.when(F.max(F.col(name).isNotNull().cast("int")) == 1, F.count("*") * size).otherwise(0)
    return points.groupBy(*by).agg(total.cast("long").alias("bytes"))


def adaptive_resolution(points: DataFrame, low: float, high: float, near: float, far: float, by: tuple[str, ...]) -> DataFrame:
    """Voxel size ramped linearly between two median distances."""
    ranged = points.withColumn("range", F.sqrt(sum((F.col(c) ** 2 for c in _XYZ), F.lit(0.0))))
    median = percentile_at(ranged, "range", by, median=F.floor(F.col("n") / 2))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("median") - near) / (far - near)))
    return median.select(*by, "median", (low + share * (high - low)).alias("resolution"))


def exposure_gain(pixels: DataFrame, by: tuple[str, ...], target: float, fallback: DataFrame, least: int = 100) -> DataFrame:
    """Gain from the mean luma of surface pixels, or of the whole image where there are too few; within [1/4, 4]."""
    luma = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    seen = pixels.groupBy(*by).agg(F.avg(luma).alias("surface"), F.count("*").alias("n"))
    joined = fallback.join(seen, list(by), "left")
    mean = F.greatest(F.lit(1.0), F.when(F.coalesce("n", F.lit(0)) >= least, F.col("surface")).otherwise(F.col("image_mean")))
    return joined.select(*by, F.greatest(F.lit(0.25), F.least(F.lit(4.0), F.lit(target * 255.0) / mean)).alias("gain"))
