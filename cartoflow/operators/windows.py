"""Ordered operators: running sums, gaps and islands, stream checks, budgets, anchor-relative scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step_length(w, names=("x", "y", "z")) -> Column:
    d = sum(((F.col(n) - F.lag(n).over(w)) ** 2 for n in names), F.lit(0.0))
    return F.coalesce(F.sqrt(d), F.lit(0.0))


def travel(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], names=("x", "y", "z"), chunk: float | None = None) -> DataFrame:
    """Length of each step and the distance travelled so far.

    With ``chunk`` a path is cut into spans of that length of the first order column, summed
    apart and joined by one row a span, so that a long path is not one task's work.
    """
    if not chunk:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn("step", step_length(w, names)).withColumn("travelled", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cut = df.withColumn("__span", F.floor(F.col(order[0]) / chunk))
    w = Window.partitionBy(*by, "__span").orderBy(*order)
    inside = cut.withColumn("step", step_length(w, names)).withColumn("__first", F.row_number().over(w) == 1)
    key, place = F.struct(*order), F.struct(*names)
    spans = cut.groupBy(*by, "__span").agg(F.min_by(place, key).alias("__in"), F.max_by(place, key).alias("__out"))
    length = inside.groupBy(*by, "__span").agg(F.sum("step").alias("__length"))
    s = Window.partitionBy(*by).orderBy("__span")
    joint = sum(((F.col(f"__in.{n}") - F.lag(f"__out.{n}").over(s)) ** 2 for n in names), F.lit(0.0))
    spans = spans.join(length, [*by, "__span"]).withColumn("__joint", F.coalesce(F.sqrt(joint), F.lit(0.0)))
    past = F.sum(F.col("__joint") + F.col("__length")).over(s.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__length")
    spans = spans.select(*by, "__span", "__joint", past.alias("__past"))
    joined = inside.join(spans, [*by, "__span"]).withColumn("travelled", F.col("__past") + F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.withColumn("step", F.when(F.col("__first"), F.col("__joint")).otherwise(F.col("step"))).select(*df.columns, "step", "travelled")


def deltas(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], names) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"d_{n}": F.col(n) - F.lag(n).over(w) for n in names})


def islands(df: DataFrame, by: tuple[str, ...], column: str, gap: float) -> DataFrame:
    """Rows numbered by run: a step above ``gap`` starts a new one."""
    w = Window.partitionBy(*by).orderBy(column)
    fresh = (F.col(column) - F.lag(column).over(w) > gap).cast("int")
    return df.withColumn("island", F.sum(F.coalesce(fresh, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def island_sizes(df: DataFrame, by: tuple[str, ...], column: str, gap: float) -> DataFrame:
    """Islands with their size, the largest first within each group."""
    found = islands(df, by, column, gap).groupBy(*by, "island").agg(F.count("*").alias("n"), F.min(column).alias("first"), F.max(column).alias("last"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "island")))


def dominant_island(df: DataFrame, by: tuple[str, ...], column: str, gap: float) -> DataFrame:
    """Rows of the largest run of each group (the earliest of equals)."""
    numbered = islands(df, by, column, gap)
    best = numbered.groupBy(*by, "island").agg(F.count("*").alias("n")).groupBy(*by).agg(F.max_by("island", F.struct("n", -F.col("island"))).alias("island"))
    return numbered.join(best, [*by, "island"], "left_semi")


def headings(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Direction of travel from both neighbours, one-sided at the ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    parts = [F.coalesce(F.lead(n).over(w), F.col(n)) - F.coalesce(F.lag(n).over(w), F.col(n)) for n in ("x", "y")]
    return df.withColumn("heading", F.atan2(parts[1], parts[0]))


def budget(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], cost: str, most: float) -> DataFrame:
    """The longest prefix whose cost fits."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= most)


def budget_kept(df: DataFrame, loaded: DataFrame, keys: tuple[str, ...], by: tuple[str, ...], order: tuple[str, ...], cost: str, most: float, slack: float = 0.2) -> DataFrame:
    """A budget with hysteresis: rows loaded before stay until the prefix exceeds the budget by ``slack``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("spent", F.sum(cost).over(w)).join(loaded.select(*keys).distinct().withColumn("__was", F.lit(True)), list(keys), "left")
    return marked.where((F.col("spent") <= most) | (F.col("__was") & (F.col("spent") <= most * (1 + slack)))).drop("__was")


def around(df: DataFrame, by: tuple[str, ...], column: str, anchor: float, rows: int) -> DataFrame:
    """The row nearest to the anchor in each group, and ``rows`` before and after it."""
    numbered = df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(column)))
    at = numbered.groupBy(*by).agg(F.min_by("place", F.struct(F.abs(F.col(column) - anchor), "place")).alias("centre"))
    return numbered.join(at, list(by)).where(F.abs(F.col("place") - F.col("centre")) <= rows)


def waypoints(path: DataFrame, by: tuple[str, ...], order: tuple[str, ...], spacing: float) -> DataFrame:
    """The first row at or past every multiple of ``spacing`` along the path, with the direction travelled."""
    w = Window.partitionBy(*by).orderBy(*order)
    along = travel(path, by, order).withColumn("before", F.coalesce(F.lag("travelled").over(w), F.lit(-1.0)))
    fx, fy = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    back_x, back_y = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    along = along.withColumn("fx", F.coalesce(fx, back_x, F.lit(1.0))).withColumn("fy", F.coalesce(fy, back_y, F.lit(0.0)))
    crossed = F.floor(F.col("travelled") / spacing)
    start = F.when(F.col("before") < 0, F.lit(0)).otherwise(F.floor(F.col("before") / spacing) + 1)
    return along.where(start <= crossed).withColumn("k", F.explode(F.sequence(start.cast("int"), crossed.cast("int"))))


def stream_checks(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], stamp: str, gap: float) -> DataFrame:
    """Rewinds and gaps between consecutive arrivals; a rewound row does not move the clock."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(stamp).over(w)
    state = F.when(last.isNull(), "first").when(F.col(stamp) < last, "rewind").when(F.col(stamp) - last > gap, "gap").otherwise("ok")
    return df.withColumn("state", state)


def pseudo_times(points: DataFrame, by: tuple[str, ...], order: tuple[str, ...], duration: float) -> DataFrame:
    """Times by ordinal for scans without any."""
    w = Window.partitionBy(*by)
    return points.withColumn("t", F.lit(duration) * (F.row_number().over(w.orderBy(*order)) - 1) / F.count("*").over(w))


def normalise_times(points: DataFrame, by: tuple[str, ...], column: str = "t") -> DataFrame:
    """Per-scan seconds from zero: negative offsets are shifted, absolute times made relative, nanoseconds scaled."""
    w = Window.partitionBy(*by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    scale = F.when((high >= 1.0) & (low > 1e16), 1e-9).otherwise(1.0)
    shift = F.when((high >= 1.0) | (low < 0.0), low).otherwise(0.0)
    return points.withColumn("t_rel", (F.col(column) - shift) * scale)


def lowest_in_column(points: DataFrame, size: float, tolerance: float) -> DataFrame:
    """Ground flags revoked above the lowest height of their XY column."""
    w = Window.partitionBy(F.floor(F.col("x") / size), F.floor(F.col("y") / size))
    return points.withColumn("is_ground", F.when((F.col("is_ground") == 1) & (F.col("z") <= F.min("z").over(w) + tolerance), 1).otherwise(0))


def highest_source(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], priority: str) -> DataFrame:
    """Rows of the highest priority a group ever had (a higher one resets the history)."""
    return df.withColumn("__p", F.max(priority).over(Window.partitionBy(*by))).where(F.col(priority) == F.col("__p")).drop("__p")


def in_smoother(df: DataFrame, by: tuple[str, ...], stamp: str, lag: float) -> DataFrame:
    """How many earlier rows a fixed-lag smoother still holds at each row."""
    w = Window.partitionBy(*by).orderBy((F.col(stamp) * 1_000_000).cast("long")).rangeBetween(-round(lag * 1_000_000), 0)
    return df.withColumn("held", F.count("*").over(w) - 1)


def folded(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], fold, schema: str) -> DataFrame:
    """An anchor-relative scan: ``fold`` gets each group, sorted, as pandas.

    For state that no window frame expresses, such as "distance from the last selected row".
    The group is one task's work: group by session, stream or frame, whose sizes are bounded.
    """
    from cartoflow.runtime import ship

    ship(df.sparkSession)

    def run(pdf):
        return fold(pdf.sort_values(list(order), kind="stable"))

    return df.groupBy(*by).applyInPandas(run, schema)


def keyframes(pdf, distance: float, names=("x", "y", "z"), angle: float | None = None, rotation=("qx", "qy", "qz", "qw")):
    """Rows farther than ``distance``, or turned by more than ``angle`` (radians), from the last selected one; the first is always selected."""
    import numpy as np

    xyz = pdf[list(names)].to_numpy(float)
    turns = None if angle is None else pdf[list(rotation)].to_numpy(float)
    keep = []
    for i in range(len(xyz)):
        far = not keep or ((xyz[i] - xyz[keep[-1]]) ** 2).sum() > distance * distance
        if not far and turns is not None:
            # the angle between two unit quaternions, of which q and -q are one rotation
            far = 2 * np.arccos(min(1.0, abs(float(turns[i] @ turns[keep[-1]])))) > angle
        if far:
            keep.append(i)
    return pdf.iloc[np.array(keep, int)]


def time_buckets(pdf, column: str, width: float):
    """A new bucket wherever a row is more than ``width`` past the start of the current one."""
    bucket, start, out = -1, None, []
    for v in pdf[column]:
        if start is None or v - start > width:
            bucket, start = bucket + 1, v
        out.append(bucket)
    return pdf.assign(bucket=out)
