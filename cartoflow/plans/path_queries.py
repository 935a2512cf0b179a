"""Queries over trajectories, time series, graphs and joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cartoflow.functions import pose as se3
from cartoflow.functions.keys import packed_cell
from cartoflow.operators import filters, joins, numeric, projections, sets, windows
from cartoflow.plans.carriers import ORDER, ORDER_SQL, carrier, table, with_sql
from cartoflow.plans.points_queries import IDS, ids, points, r, rs, vox
from cartoflow.plans.registry import query

P, T, S = with_sql("points"), with_sql("trajectory"), with_sql("imu")
_STEP = "sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2))"


def path(spark, sf):
    return carrier(spark, sf, "trajectory")


def signals(spark, sf):
    return carrier(spark, sf, "imu")


@query(f"{T}, s AS (SELECT id, session, submap_id, ts, coalesce({_STEP}, 0) AS step FROM tr WINDOW w AS (PARTITION BY session, submap_id ORDER BY ts, id)) SELECT id, round(step, 4) + 0.0 AS step, round(sum(step) OVER (PARTITION BY session, submap_id ORDER BY ts, id), 4) + 0.0 AS travelled FROM s")
def travel_dist(spark, sf):
    return r(windows.travel(path(spark, sf), ("session", "submap_id"), ("ts", "id")).select("id", "step", "travelled"), "step", "travelled", digits=4)


@query(f"{T}, s AS (SELECT id, session, coalesce({_STEP}, 0) AS step FROM tr WINDOW w AS (PARTITION BY session ORDER BY id)) SELECT id, round(step, 4) + 0.0 AS step, round(sum(step) OVER (PARTITION BY session ORDER BY id), 4) + 0.0 AS travelled FROM s")
def travel_spans(spark, sf):
    """Whole sessions, each cut into spans that are summed apart."""
    got = windows.travel(path(spark, sf), ("session",), ("id",), chunk=400.0)
    return r(got.select("id", "step", "travelled"), "step", "travelled", digits=4)


@query(f"{S} SELECT id, round(signal - lag(signal) OVER (PARTITION BY stream ORDER BY id), 6) + 0.0 AS d_signal FROM imu")
def deltas(spark, sf):
    return r(windows.deltas(signals(spark, sf), ("stream",), ("id",), ("signal",)).select("id", "d_signal"), "d_signal")


_ISL = "i AS (SELECT *, CASE WHEN id - lag(id) OVER (PARTITION BY stream ORDER BY id) > 100 THEN 1 ELSE 0 END AS f FROM imu), j AS (SELECT *, CAST(sum(f) OVER (PARTITION BY stream ORDER BY id) AS BIGINT) AS island FROM i)"


@query(f"{S}, {_ISL}, g AS (SELECT stream, island, count(*) AS n, min(id) AS first, max(id) AS last FROM j GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY stream ORDER BY n DESC, island) AS INT) AS place FROM g")
def islands(spark, sf):
    """Continuity teams: gaps split a stream, the largest team first."""
    return windows.island_sizes(signals(spark, sf), ("stream",), "id", 100)


@query(f"{S}, {_ISL}, g AS (SELECT stream, island, count(*) AS n FROM j GROUP BY 1, 2), b AS (SELECT stream, arg_max(island, (n, -island)) AS island FROM g GROUP BY 1) SELECT j.id, j.stream, j.island FROM j JOIN b USING (stream, island)")
def gps_time_dominant(spark, sf):
    """Rows of the dominant time cluster of each group."""
    return windows.dominant_island(signals(spark, sf), ("stream",), "id", 100).select("id", "stream", "island")


@query(f"{T} SELECT id, round(atan2(coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y), coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)), 6) + 0.0 AS heading FROM tr WINDOW w AS (PARTITION BY session, submap_id ORDER BY ts, id)")
def heading(spark, sf):
    return r(windows.headings(path(spark, sf), ("session", "submap_id"), ("ts", "id")).select("id", "heading"), "heading")


@query(f"{T}, s AS (SELECT id, session, round(sum(CAST(round(x * 100) AS BIGINT)) OVER (PARTITION BY session, submap_id ORDER BY pow(x - 100, 2) + pow(y - 50, 2), id)) AS spent FROM tr) SELECT id, CAST(spent AS BIGINT) AS spent FROM s WHERE spent <= 60000")
def budget_prefix(spark, sf):
    """Nearest first, as many as the budget holds."""
    cost = path(spark, sf).withColumn("cost", F.round(F.col("x") * 100).cast("long")).withColumn("d2", F.pow(F.col("x") - 100, F.lit(2)) + F.pow(F.col("y") - 50, F.lit(2)))
    return windows.budget(cost, ("session", "submap_id"), ("d2", "id"), "cost", 60000).select("id", "spent")


@query(f"{S}, n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY id) AS place FROM imu), c AS (SELECT stream, arg_min(place, (abs(id - 500), place)) AS centre FROM n GROUP BY 1) SELECT n.id, n.stream FROM n JOIN c USING (stream) WHERE abs(place - centre) <= 3")
def anchor_window(spark, sf):
    return windows.around(signals(spark, sf), ("stream",), "id", 500, 3).select("id", "stream")


_ALONG = f"s AS (SELECT *, coalesce({_STEP}, 0) AS step FROM tr WINDOW w AS (PARTITION BY session, submap_id ORDER BY ts, id)), a AS (SELECT *, sum(step) OVER (PARTITION BY session, submap_id ORDER BY ts, id) AS travelled FROM s), b AS (SELECT *, lag(travelled) OVER (PARTITION BY session, submap_id ORDER BY ts, id) AS before FROM a)"


@query(f"{T}, {_ALONG} SELECT id, CAST(unnest(range(CAST(CASE WHEN before IS NULL THEN 0 ELSE floor(before / 250) + 1 END AS BIGINT), CAST(floor(travelled / 250) AS BIGINT) + 1)) AS INT) AS k FROM b")
def chunk_centers(spark, sf):
    """Chunk centres every 250 m of arc length."""
    return windows.waypoints(path(spark, sf), ("session", "submap_id"), ("ts", "id"), 250.0).select("id", "k")


@query(f"{S}, s AS (SELECT id, stream, id * 0.001::DOUBLE + CASE WHEN id % 17 = 0 THEN -0.9 ELSE 0 END AS stamp FROM imu), m AS (SELECT *, max(stamp) OVER (PARTITION BY stream ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM s) SELECT id, CASE WHEN last IS NULL THEN 'first' WHEN stamp < last THEN 'rewind' WHEN stamp - last > 0.5 THEN 'gap' ELSE 'ok' END AS state FROM m")
def stream_gaps(spark, sf):
    stamped = signals(spark, sf).withColumn("stamp", F.col("id") * F.lit(0.001) + F.when(F.col("id") % 17 == 0, -0.9).otherwise(0.0))
    return windows.stream_checks(stamped, ("stream",), ("id",), "stamp", 0.5).select("id", "state")


@query(f"{S}, s AS (SELECT id, stream, id % 3 AS prio FROM imu), m AS (SELECT *, max(prio) OVER (PARTITION BY stream) AS top FROM s) SELECT id, stream FROM m WHERE prio = top")
def source_priority(spark, sf):
    return windows.highest_source(signals(spark, sf).withColumn("prio", F.col("id") % 3), ("stream",), ("id",), "prio").select("id", "stream")


@query(f"{S} SELECT id, count(*) OVER (PARTITION BY stream ORDER BY CAST(id AS DOUBLE) RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) - 1 AS held FROM imu")
def smoother_window(spark, sf):
    return windows.in_smoother(signals(spark, sf).withColumn("stamp", F.col("id").cast("double")), ("stream",), "stamp", 300.0).select("id", "held")


@query(
    f"""{S.replace("WITH", "WITH RECURSIVE", 1)}, n AS (SELECT stream, id, row_number() OVER (PARTITION BY stream ORDER BY id) AS k FROM imu),
    w AS (SELECT stream, id, k, id AS start, CAST(0 AS BIGINT) AS bucket FROM n WHERE k = 1
          UNION ALL SELECT n.stream, n.id, n.k, CASE WHEN n.id - w.start > 250 THEN n.id ELSE w.start END, w.bucket + CASE WHEN n.id - w.start > 250 THEN 1 ELSE 0 END FROM w JOIN n ON n.stream = w.stream AND n.k = w.k + 1)
    SELECT stream, id, bucket FROM w"""
)
def time_buckets(spark, sf):
    """Anchor-relative buckets: new when more than 250 past the bucket's start."""
    src = signals(spark, sf).select("stream", "id")
    return windows.folded(src, ("stream",), ("id",), lambda pdf: windows.time_buckets(pdf, "id", 250), "stream long, id long, bucket long")


@query()
def keyframes(spark, sf):
    """Displacement, or turn, from the last selected row; the heading turns by a fixed step a row."""
    half = F.radians(F.col("id") % 360) / 2
    zero = F.lit(0.0)
    src = path(spark, sf).select("session", "submap_id", "ts", "id", "x", "y", "z", zero.alias("qx"), zero.alias("qy"), F.sin(half).alias("qz"), F.cos(half).alias("qw"))
    schema = "session string, submap_id int, ts timestamp_ntz, id long, x double, y double, z double, qx double, qy double, qz double, qw double"
    out = windows.folded(src, ("session", "submap_id"), ("ts", "id"), lambda pdf: windows.keyframes(pdf, 60.0, angle=1.5), schema)
    return out.select("session", "submap_id", "id")


# as-of joins ---------------------------------------------------------------------------------

_AS = "q AS (SELECT id, stream FROM imu WHERE kind = 'view'), a AS (SELECT id, stream, signal FROM imu WHERE kind = 'error')"
_BR = "b AS (SELECT q.id, q.stream, (SELECT max(a.id) FROM a WHERE a.stream = q.stream AND a.id <= q.id) AS l_id, (SELECT min(a.id) FROM a WHERE a.stream = q.stream AND a.id >= q.id) AS r_id FROM q)"


def _sides(spark, sf):
    s = signals(spark, sf)
    return s.where("kind = 'view'").select("id", "stream"), s.where("kind = 'error'").select("id", "stream", "signal")


@query(f"{S}, {_AS}, {_BR} SELECT id, stream, l_id, r_id, CASE WHEN l_id IS NULL THEN 'late' WHEN r_id IS NULL THEN 'early' ELSE 'ok' END AS state FROM b")
def asof_bracket(spark, sf):
    q, a = _sides(spark, sf)
    return joins.bracket(q, a, ("stream",), "id", ("signal",), chunk=500.0).select("id", "stream", "l_id", "r_id", "state")


_IP = "ip AS (SELECT b.*, l.signal AS lv, rr.signal AS rv, CASE WHEN r_id > l_id THEN (b.id - l_id)::DOUBLE / (r_id - l_id) ELSE 0 END AS u FROM b LEFT JOIN a l ON l.id = l_id LEFT JOIN a rr ON rr.id = r_id)"


@query(f"{S}, {_AS}, {_BR}, {_IP} SELECT id, CASE WHEN l_id IS NOT NULL AND r_id IS NOT NULL THEN round(lv + (rv - lv) * u, 6) + 0.0 END AS signal FROM ip")
def gnss_interp(spark, sf):
    """As-of linear interpolation, null outside."""
    q, a = _sides(spark, sf)
    b = joins.bracket(q, a, ("stream",), "id", ("signal",))
    return r(joins.interpolated(b, "id", ("signal",), clamp=False).select("id", "signal"), "signal")


@query(f"{S}, {_AS}, {_BR}, {_IP} SELECT id, round(CASE WHEN l_id IS NOT NULL AND r_id IS NOT NULL THEN lv + (rv - lv) * u ELSE coalesce(lv, rv) END, 6) + 0.0 AS signal FROM ip")
def anchor_calibration(spark, sf):
    """Calibration anchors, clamped at the ends."""
    q, a = _sides(spark, sf)
    b = joins.bracket(q, a, ("stream",), "id", ("signal",))
    return r(joins.interpolated(b, "id", ("signal",), clamp=True).select("id", "signal"), "signal")


@query(f"{S}, {_AS}, {_BR}, {_IP} SELECT id, round(10 * CASE WHEN l_id IS NOT NULL AND r_id IS NOT NULL THEN l_id + (r_id - l_id) * u ELSE coalesce(l_id, r_id) END, 4) + 0.0 AS tx, round(cos(radians(CASE WHEN l_id IS NOT NULL AND r_id IS NOT NULL THEN lv % 90 + (rv % 90 - lv % 90) * u ELSE coalesce(lv, rv) % 90 END) / 2), 6) + 0.0 AS qw FROM ip")
def pose_lerp(spark, sf):
    """As-of with position lerp and rotation slerp, clamped (turns about one axis, so the oracle lerps the angle)."""
    q, a = _sides(spark, sf)
    half = F.radians(F.col("signal") % 90) / 2
    posed = a.withColumns({"tx": F.col("id") * F.lit(10.0), "qz": F.sin(half), "qw": F.cos(half)})
    b = joins.bracket(q, posed, ("stream",), "id", ("tx", "qz", "qw"))
    zero = F.lit(0.0)
    ends = [se3.Pose(F.coalesce(f"{s}_tx", f"{o}_tx"), zero, zero, zero, zero, F.coalesce(f"{s}_qz", f"{o}_qz"), F.coalesce(f"{s}_qw", f"{o}_qw")) for s, o in ("lr", "rl")]
    u = F.when(F.col("state") == "ok", joins.share("id")).otherwise(0.0)
    made = se3.canonical(se3.slerp(*ends, u))
    out = b.select("id", made.tx.alias("tx"), made.qw.alias("qw"))
    return r(r(out, "tx", digits=4), "qw").select("id", "tx", "qw")


@query(f"{S}, {_AS}, {_BR} SELECT id, CASE WHEN r_id IS NULL OR (l_id IS NOT NULL AND id - l_id <= r_id - id) THEN l_id ELSE r_id END AS near_id FROM b")
def nearest_time(spark, sf):
    q, a = _sides(spark, sf)
    return joins.nearest_in_time(q, a, ("stream",), "id", ("signal",)).select("id", "near_id")


# range joins ---------------------------------------------------------------------------------

_CAM = with_sql("cameras", "trajectory")


@query(f"{_CAM}, c AS (SELECT cam, cx + 100 AS x, cy + 48 AS y FROM cam), d AS (SELECT c.cam, tr.id, pow(c.x - tr.x, 2) + pow(c.y - tr.y, 2) AS d2 FROM c, tr WHERE pow(c.x - tr.x, 2) + pow(c.y - tr.y, 2) <= 400) SELECT cam, arg_min(id, (d2, id)) AS r_id, round(min(d2), 6) + 0.0 AS d2 FROM d GROUP BY 1")
def nearest_xy(spark, sf):
    cams = carrier(spark, sf, "cameras").select("cam", (F.col("cx") + 100).alias("x"), (F.col("cy") + 48).alias("y"))
    found = joins.nearest_xy(cams, path(spark, sf).select("id", "x", "y"), ("cam",), "id", 20.0)
    return r(found.select("cam", "r_id", "d2"), "d2")


_FEW = "f AS (SELECT ok, ln, pk, sk, ep, sd, frame_id, x, y, z FROM p)"


def cloud(spark, sf):
    return points(spark, sf).select(*ORDER, "frame_id", "x", "y", "z")


_PAIRED = f"n AS (SELECT {', '.join('a.' + c.strip() for c in IDS.split(','))}, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) AS d2, b.ok AS r_ok, b.ln AS r_ln, b.pk AS r_pk, b.sk AS r_sk, b.ep AS r_ep, b.sd AS r_sd, b.x AS bx, b.y AS by_, b.z AS bz FROM f a JOIN f b ON a.frame_id = b.frame_id WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 64)"


@query(f"{P}, {_FEW}, {_PAIRED} SELECT {IDS}, count(*) AS neighbours FROM n GROUP BY ALL")
def radius_count(spark, sf):
    return joins.radius_count(cloud(spark, sf), 8.0, ORDER, ("frame_id",)).drop("frame_id")


@query(f"{P}, {_FEW}, {_PAIRED}, c AS (SELECT {IDS}, count(*) AS k FROM n GROUP BY ALL) SELECT {IDS} FROM c WHERE k >= 4")
def sor(spark, sf):
    """Points with enough neighbours within the radius stay."""
    return ids(joins.sparse_removed(cloud(spark, sf), 8.0, 4, ORDER, ("frame_id",)))


def _nearest(k):
    """The k nearest points of each in its frame, in SQL: n with one row a neighbour."""
    d2 = "pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)"
    kept = ", ".join(f"{n} := b.{n}" for n in (*ORDER, "x", "y", "z"))
    own = ", ".join("a." + c for c in ORDER)
    return f"t AS (SELECT {own}, min(struct_pack(d2 := {d2}, {kept}), {k}) AS l FROM f a JOIN f b ON a.frame_id = b.frame_id GROUP BY {own}), u AS (SELECT {IDS}, unnest(l) AS b, generate_subscripts(l, 1) AS rk FROM t), n AS (SELECT {IDS}, rk, b.d2 AS d2, b.ok AS r_ok, b.ln AS r_ln, b.x AS bx, b.y AS by_, b.z AS bz FROM u)"


_K5 = _nearest(5)


@query(f"{P}, {_FEW}, {_K5} SELECT {IDS}, CAST(rk - 1 AS INT) AS rank, r_ok, r_ln, round(d2, 6) + 0.0 AS d2 FROM n")
def knn5(spark, sf):
    found = joins.nearest(cloud(spark, sf), 5, ORDER, ("frame_id",))
    return r(found.select(*ORDER, "rank", "r_ok", "r_ln", "d2"), "d2")


@query(f"{P}, {_FEW}, {_K5}, m AS (SELECT {IDS}, avg(sqrt(d2)) AS d FROM n GROUP BY ALL), g AS (SELECT avg(d) + 1.0 * stddev_samp(d) AS lim FROM m) SELECT {IDS} FROM m, g WHERE d <= lim")
def outlier_removal(spark, sf):
    """Statistical outliers: mean neighbour distance against mean plus deviations (a one-row table)."""
    mean = joins.kept(joins.neighbourhoods(cloud(spark, sf), 5, ORDER, ("frame_id",)).select(*ORDER, "d"))
    limit = mean.agg((F.avg("d") + 1.0 * F.stddev_samp("d")).alias("lim"))
    return ids(mean.crossJoin(F.broadcast(limit)).where("d <= lim"))


def _scaled(m):
    """Covariances times the root of one half, which keeps decimal ties out of the rounding."""
    half = F.sqrt(F.lit(0.5))
    return r(ids(m, "k", (F.col("c_xy") * half).alias("c_xy"), (F.col("c_zz") * half).alias("c_zz")), "c_xy", "c_zz")


@query(f"{P}, {_FEW}, {_K5} SELECT {IDS}, count(*) AS k, round(covar_pop(bx, by_) * sqrt(0.5), 6) + 0.0 AS c_xy, round(covar_pop(bz, bz) * sqrt(0.5), 6) + 0.0 AS c_zz FROM n GROUP BY ALL")
def neighbour_moments(spark, sf):
    """Population covariance of the nearest neighbours."""
    return _scaled(joins.neighbourhoods(cloud(spark, sf), 5, ORDER, ("frame_id",)))


@query(f"{P}, {_FEW}, {_K5} SELECT {IDS}, count(*) AS k, round(coalesce(covar_samp(bx, by_), 0) * sqrt(0.5), 6) + 0.0 AS c_xy, round(coalesce(covar_samp(bz, bz), 0) * sqrt(0.5), 6) + 0.0 AS c_zz FROM n GROUP BY ALL")
def neighbour_moments_sample(spark, sf):
    m = joins.neighbourhoods(cloud(spark, sf), 5, ORDER, ("frame_id",))
    return _scaled(m.withColumns({c: F.when(F.col("k") > 1, F.col(c) * F.col("k") / (F.col("k") - 1)).otherwise(0.0) for c in ("c_xy", "c_zz")}))


@query()
def normals(spark, sf):
    """Eigenvalues and sensor-facing normals of neighbourhoods."""
    near = joins.neighbourhoods(cloud(spark, sf), 10, ORDER, ("frame_id",))
    return r(numeric.eigen(near, ORDER, ("mx", "my", "mz")), "l0", "l1", "l2", digits=4)


_NODES = "n AS (SELECT submap_id AS id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM tr GROUP BY 1), nt AS (SELECT *, sum(coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)), 0)) OVER () AS whole FROM n WINDOW w AS (ORDER BY id))"
_STEPS = "n AS (SELECT submap_id AS id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM tr GROUP BY 1), st AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)), 0) AS step FROM n WINDOW w AS (ORDER BY id)), nt AS (SELECT *, sum(step) OVER (ORDER BY id) AS travelled FROM st)"


def nodes(spark, sf):
    """One node a submap (a bounded number)."""
    return path(spark, sf).groupBy(F.col("submap_id").alias("id")).agg(*[F.avg(c).alias(c) for c in "xyz"])


def _travelled(spark, sf):
    return windows.travel(nodes(spark, sf), (), ("id",)).select("id", "x", "y", "z", "travelled")


@query(f"{T}, {_STEPS} SELECT a.id AS i, b.id AS j, round(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2), 4) + 0.0 AS d2 FROM nt a JOIN nt b ON a.id < b.id WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 100 AND b.travelled - a.travelled >= 50")
def loop_candidates(spark, sf):
    """Near in space, far along the path: the exact set."""
    return r(joins.close_pairs(_travelled(spark, sf), 10.0, 50.0), "d2", digits=4)


@query(f"{T}, {_STEPS}, e AS (SELECT id AS i, id + 1 AS j FROM nt) SELECT a.id AS i, b.id AS j FROM nt a JOIN nt b ON a.id < b.id LEFT JOIN e ON e.i = a.id AND e.j = b.id WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 100 AND e.i IS NULL")
def new_pairs(spark, sf):
    """Close pairs without an existing edge."""
    n = nodes(spark, sf)
    edges = n.select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    return joins.without_edges(joins.close_pairs(n, 10.0), edges).select("i", "j")


@query(f"{P}, c AS (SELECT DISTINCT frame_id, {vox(4.0)} AS v FROM p), o AS (SELECT frame_id, {vox(4.0)} AS v, count(*) AS c FROM p GROUP BY 1, 2), t AS (SELECT frame_id, sum(c) AS n FROM o GROUP BY 1) SELECT o.frame_id AS source, c.frame_id AS target, CAST(sum(o.c) AS BIGINT) AS hits, round(sum(o.c) / any_value(t.n), 6) + 0.0 AS overlap FROM o JOIN c USING (v) JOIN t ON t.frame_id = o.frame_id WHERE o.frame_id <> c.frame_id GROUP BY 1, 2")
def overlap_pairs(spark, sf):
    p = points(spark, sf)
    return r(joins.overlap(p, p, 4.0, "frame_id"), "overlap")


@query(f"{P} SELECT {IDS} FROM p WHERE floor(x / 3) BETWEEN 0 AND 2 AND floor(y / 3) BETWEEN -2 AND 0 AND floor(z / 3) BETWEEN -1 AND 1")
def cell_window(spark, sf):
    return ids(joins.cell_window(points(spark, sf), (4.0, -2.0, 0.5), 3.0, 1))


_SEL = "sel AS (SELECT DISTINCT ok, ln FROM p WHERE pow(x, 2) + pow(y, 2) + pow(z, 2) < 100)"


@query(f"{P}, {_SEL} SELECT {IDS} FROM p ANTI JOIN sel USING (ok, ln)")
def remove_selected(spark, sf):
    p = points(spark, sf)
    return ids(joins.remove(p, filters.in_radius(p, (0.0, 0.0, 0.0), 10.0).select("ok", "ln"), ("ok", "ln")))


@query(f"{P}, {_SEL} SELECT {IDS} FROM p SEMI JOIN sel USING (ok, ln)")
def gather_selected(spark, sf):
    p = points(spark, sf)
    return ids(joins.gather(p, filters.in_radius(p, (0.0, 0.0, 0.0), 10.0).select("ok", "ln"), ("ok", "ln")))


@query(f"{P}, o AS (SELECT submap_id, x, y, z, row_number() OVER (PARTITION BY submap_id ORDER BY {ORDER_SQL}) - 1 AS k FROM p), d AS (SELECT submap_id, pow(x - 1, 2) + pow(y - 2, 2) + pow(z - 0.3, 2) AS d2 FROM o WHERE k % 10 = 0) SELECT arg_min(submap_id, (d2, submap_id)) AS submap_id, round(min(d2), 6) + 0.0 AS d2 FROM d")
def nearest_submap(spark, sf):
    return r(joins.nearest_group(points(spark, sf), (1.0, 2.0, 0.3), "submap_id", ORDER, 10), "d2")


@query(f"{T}, n AS (SELECT submap_id AS id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM tr GROUP BY 1), d AS (SELECT a.id, b.id AS r_id, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) AS d2 FROM n a, n b WHERE a.id < 100 AND b.id >= 100) SELECT id, r_id, round(d2, 6) + 0.0 AS d2 FROM d WHERE d2 <= 900 ORDER BY d.d2, id, r_id LIMIT 1")
def closest_pair(spark, sf):
    n = nodes(spark, sf)
    found = joins.closest_pair(n.where("id < 100"), n.where("id >= 100"), 30.0)
    return r(found.select("id", "r_id", "d2"), "d2")


@query(f"{P}, uv AS (SELECT *, CAST(floor(-320 * y / x + 320 + 0.5) AS INT) AS u, CAST(floor(-320 * z / x + 240 + 0.5) AS INT) AS v FROM p WHERE x > 0.1), px AS (SELECT u, v, min(ok) AS ok FROM uv GROUP BY 1, 2), m AS (SELECT p_partkey AS m, CAST(floor((p_partkey % 640)::DOUBLE + 0.25 + 0.5) AS INT) AS u, CAST(floor(((p_partkey * 7) % 480)::DOUBLE - 0.25 + 0.5) AS INT) AS v FROM part) SELECT m, u, v, ok FROM m JOIN px USING (u, v)")
def pixel_lookup(spark, sf):
    p = points(spark, sf).where("x > 0.1")
    px = p.select(F.floor(-320 * F.col("y") / F.col("x") + 320 + 0.5).cast("int").alias("u"), F.floor(-320 * F.col("z") / F.col("x") + 240 + 0.5).cast("int").alias("v"), "ok").groupBy("u", "v").agg(F.min("ok").alias("ok"))
    m = table(spark, sf, "part").select(F.col("p_partkey").alias("m"), ((F.col("p_partkey") % 640).cast("double") + 0.25).alias("u_rend"), ((F.col("p_partkey") * 7 % 480).cast("double") - 0.25).alias("v_rend"))
    return joins.by_pixel(m, px).select("m", "u", "v", "ok")


@query(f"{with_sql('cameras', 'points')}, m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p) SELECT cam FROM cam, m WHERE located AND pow(cx - mx, 2) + pow(cy - my, 2) + pow(cz - mz, 2) <= 9 * 100")
def camera_cull(spark, sf):
    from cartoflow.operators.aggregates import centroid

    return filters.camera_cull(carrier(spark, sf, "cameras"), centroid(points(spark, sf)), 10.0).select("cam")


@query(f"{with_sql('cameras', 'points')}, f AS (SELECT {IDS}, x, y, z FROM p) SELECT {', '.join('f.' + c.strip() for c in IDS.split(','))}, count(*) AS views, round(min(pow(cx - x, 2) + pow(cy - y, 2) + pow(cz - z, 2)), 6) + 0.0 AS d2 FROM f JOIN cam ON located AND pow(cx - x, 2) + pow(cy - y, 2) + pow(cz - z, 2) <= 64 GROUP BY ALL")
def points_cameras(spark, sf):
    """Points with the cameras in range, counted in strips."""
    p = points(spark, sf).select(*ORDER, "x", "y", "z")
    cams = carrier(spark, sf, "cameras").where("located").select("cam", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    seen = joins.surroundings(p, cams, 8.0, ORDER, least=True).where("n > 0")
    return r(seen.select(*ORDER, F.col("n").alias("views"), "d2"), "d2")


@query("SELECT q.vec_id AS query, v.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda t: pow(t[1]::DOUBLE - t[2]::DOUBLE, 2))), v.vec_id) - 1 AS INT) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 QUALIFY rank < 5")
def feature_knn(spark, sf):
    v = table(spark, sf, "embeddings")
    return joins.vector_nearest(v, v.where("vec_id % 20 = 0"), 5).select("query", "vec_id", "rank")


# graphs and sets -----------------------------------------------------------------------------

_FAC = "fac AS (SELECT o_orderkey AS factor_id, CAST(o_orderkey % 7 AS INT) AS batch_id, CASE o_orderkey % 3 WHEN 0 THEN 'prior' WHEN 1 THEN 'between' ELSE 'match' END AS type, CAST(o_custkey % 200 AS INT) AS i, CAST((o_custkey * 3 + 1) % 200 AS INT) AS j, o_totalprice / 100000 AS sigma FROM orders)"


def factors(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey AS factor_id", "CAST(o_orderkey % 7 AS INT) AS batch_id", "CASE o_orderkey % 3 WHEN 0 THEN 'prior' WHEN 1 THEN 'between' ELSE 'match' END AS type", "CAST(o_custkey % 200 AS INT) AS i", "CAST((o_custkey * 3 + 1) % 200 AS INT) AS j", "o_totalprice / 100000 AS sigma")


@query(f"WITH {_FAC} SELECT factor_id, type FROM fac WHERE type NOT IN ('prior')")
def drop_priors(spark, sf):
    return sets.without_types(factors(spark, sf), "prior").select("factor_id", "type")


@query(f"WITH {_FAC}, fresh AS (SELECT factor_id, 'moved' AS type FROM fac WHERE factor_id % 10 = 0) SELECT factor_id, type FROM fac ANTI JOIN fresh USING (factor_id) UNION ALL SELECT factor_id, type FROM fresh")
def upsert_factors(spark, sf):
    f = factors(spark, sf).select("factor_id", "type")
    return sets.upsert(f, f.where("factor_id % 10 = 0").withColumn("type", F.lit("moved")), ("factor_id",))


@query(f"WITH {_FAC} SELECT factor_id, (i BETWEEN 50 AND 60 OR j BETWEEN 50 AND 60) AS relaxed, round(CASE WHEN i BETWEEN 50 AND 60 OR j BETWEEN 50 AND 60 THEN sigma * 10 ELSE sigma END, 9) + 0.0 AS sigma FROM fac")
def relax_factors(spark, sf):
    return r(sets.relax(factors(spark, sf), 50, 60, 10.0).select("factor_id", "relaxed", "sigma"), "sigma", digits=9)


@query(f"WITH {_FAC} SELECT factor_id FROM fac WHERE batch_id < (SELECT max(batch_id) FROM fac)")
def undo_batch(spark, sf):
    return sets.undo(factors(spark, sf)).select("factor_id")


@query("WITH a AS (SELECT n_nationkey AS submap_id, 0 AS session, n_name AS name FROM nation), b AS (SELECT r_regionkey AS submap_id, 0 AS session, r_name AS name FROM region) SELECT submap_id, session, name FROM a UNION ALL SELECT CAST(submap_id + (SELECT max(submap_id) + 1 FROM a) AS INT), CAST(session + 1 AS INT), name FROM b")
def append_session(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("submap_id"), F.lit(0).alias("session"), F.col("n_name").alias("name"))
    b = table(spark, sf, "region").select(F.col("r_regionkey").alias("submap_id"), F.lit(0).alias("session"), F.col("r_name").alias("name"))
    return sets.append_session(a, b, "submap_id", "session")


@query(f"WITH {_FAC}, live AS (SELECT factor_id FROM fac WHERE batch_id <> 3) SELECT factor_id, i, j FROM fac SEMI JOIN live USING (factor_id) UNION ALL SELECT -factor_id, j, i FROM fac WHERE batch_id = 6")
def live_lines(spark, sf):
    f = factors(spark, sf)
    fresh = f.where("batch_id = 6").select((-F.col("factor_id")).alias("factor_id"), F.col("j").alias("i"), F.col("i").alias("j"))
    return sets.live_lines(f.select("factor_id", "i", "j"), f.where("batch_id <> 3"), fresh)


@query(f"{T}, n AS (SELECT DISTINCT session, submap_id AS id FROM tr), e AS (SELECT session, id AS i, lead(id) OVER (PARTITION BY session ORDER BY id) AS j FROM n), h AS (SELECT DISTINCT i, i + 1 AS j FROM (SELECT submap_id AS i FROM tr WHERE submap_id % 5 <> 0)) SELECT session, i, j FROM e ANTI JOIN h USING (i, j) WHERE j IS NOT NULL")
def graph_recover(spark, sf):
    """Missing consecutive links."""
    t = path(spark, sf)
    n = t.select("session", F.col("submap_id").alias("id")).distinct()
    have = t.where("submap_id % 5 <> 0").select(F.col("submap_id").alias("i"), (F.col("submap_id") + 1).alias("j")).distinct()
    return sets.missing_links(n, have).select("session", "i", "j")


@query(f"WITH {_FAC} SELECT id, count(*) AS degree FROM (SELECT i AS id FROM fac WHERE type = 'match' UNION ALL SELECT j FROM fac WHERE type = 'match') GROUP BY 1")
def graph_degrees(spark, sf):
    return sets.degrees(factors(spark, sf).where("type = 'match'"))


@query(f"WITH RECURSIVE {_FAC}, e AS (SELECT DISTINCT i AS a, j AS b FROM fac UNION SELECT DISTINCT j, i FROM fac), reach AS (SELECT a AS id, a AS other FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.other) SELECT id, min(other) AS root FROM reach GROUP BY 1")
def connected_submaps(spark, sf):
    return sets.connected(factors(spark, sf))


@query(f"{P}, v AS (SELECT {vox(2.0)} AS voxel, CAST(floor(x / 2) AS BIGINT) AS cx, CAST(floor(y / 2) AS BIGINT) AS cy, CAST(floor(z / 2) AS BIGINT) AS cz, count(*) AS n FROM p GROUP BY ALL) SELECT voxel, n, cx, cy, cz FROM v WHERE n >= 1")
def trail_cells(spark, sf):
    """Occupied cells that trail clustering starts from."""
    p = points(spark, sf)
    keyed = p.withColumns({"voxel": packed_cell("x", "y", "z", 2.0), **{f"c{n}": F.floor(F.col(n) / 2) for n in "xyz"}})
    return keyed.groupBy("voxel", "cx", "cy", "cz").agg(F.count("*").alias("n"))


@query()
def trail_clusters(spark, sf):
    """26-neighbour clusters of occupied cells with their extent: grid join, then connected components."""
    cells = points(spark, sf).select(*[F.floor(F.col(n) / 2).cast("double").alias(n) for n in "xyz"]).distinct()
    keyed = cells.withColumn("id", packed_cell("x", "y", "z", 1.0))
    pairs = joins.range_join(keyed, keyed, 1.8)
    edges = pairs.select(F.col("id").alias("i"), F.col("r_id").alias("j"))
    roots = sets.connected(edges)
    out = keyed.join(roots, "id").groupBy("root").agg(F.count("*").alias("cells"), F.min("x").alias("lo_x"), F.max("x").alias("hi_x"))
    return r(out.drop("root"), "lo_x", "hi_x")


@query(f"{T}, s AS (SELECT submap_id, avg(x) AS ox, avg(y) AS oy, min(x) AS lx, min(y) AS ly, max(x) AS rx, max(y) AS ry FROM tr GROUP BY 1), e AS (SELECT o_orderkey AS factor_id, CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE 'e' END AS c1, CAST(o_custkey % 150 AS INT) AS i1, 'e' AS c2, CAST((o_custkey * 5) % 400 AS INT) AS i2 FROM orders), k AS (SELECT *, CASE WHEN c1 = 'e' THEN i1 // 2 ELSE i1 END AS s1, i2 // 2 AS s2 FROM e) SELECT factor_id, round(coalesce(CASE WHEN c1 = 'x' THEN a.ox WHEN i1 % 2 = 0 THEN a.lx ELSE a.rx END, 0), 10) + 0.0 AS k1_x, round(coalesce(CASE WHEN i2 % 2 = 0 THEN b.ly ELSE b.ry END, 0), 10) + 0.0 AS k2_y FROM k LEFT JOIN s a ON a.submap_id = s1 LEFT JOIN s b ON b.submap_id = s2 WHERE s1 % 10 <> 0 AND s2 % 10 <> 0")
def edge_endpoints(spark, sf):
    t = path(spark, sf)
    sub = t.groupBy(F.col("submap_id").cast("long").alias("submap_id")).agg(F.avg("x").alias("ox"), F.avg("y").alias("oy"), F.min("x").alias("lx"), F.min("y").alias("ly"), F.max("x").alias("rx"), F.max("y").alias("ry"))
    hidden = spark.range(0, 400, 10).select(F.col("id").alias("submap_id"))
    e = table(spark, sf, "orders").selectExpr("o_orderkey AS factor_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE 'e' END AS k1_chr", "CAST(o_custkey % 150 AS INT) AS k1_idx", "'e' AS k2_chr", "CAST((o_custkey * 5) % 400 AS INT) AS k2_idx")
    return r(joins.endpoint_positions(e, sub, hidden).select("factor_id", "k1_x", "k2_y"), "k1_x", "k2_y", digits=10)


@query(f"WITH {_FAC} SELECT factor_id, i, j FROM fac WHERE type <> 'prior'")
def pose_edges(spark, sf):
    f = factors(spark, sf).select("factor_id", F.lit("x").alias("k1_chr"), F.col("i").alias("k1_idx"), F.when(F.col("type") != "prior", "x").alias("k2_chr"), F.col("j").alias("k2_idx"))
    return filters.pose_edges(f)


@query(f"{T} SELECT id, submap_id, x, y FROM tr WHERE session <> 'P'")
def trajectory_polyline(spark, sf):
    hidden = spark.createDataFrame([("P",)], "session string")
    return projections.polyline(path(spark, sf), hidden).select("id", "submap_id", "x", "y")


@query(f"{T} SELECT id, {rs('x', 'y')} FROM (SELECT id, 5 - y AS x, x - 3 AS y FROM tr)")
def reanchor(spark, sf):
    half = float(np.sqrt(0.5))
    anchor = spark.createDataFrame([(5.0, -3.0, 0.0, 0.0, 0.0, half, half)], "tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    return r(projections.reanchor(path(spark, sf), anchor).select("id", "x", "y"), "x", "y")


@query(f"{P} SELECT {IDS}, CAST(CASE WHEN rk <= 5 THEN 1 ELSE 0 END AS INT) AS lowest FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY z, {ORDER_SQL}) AS rk FROM p)")
def lowest_points(spark, sf):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("frame_id").orderBy("z", *ORDER))
    return ids(points(spark, sf), (k <= 5).cast("int").alias("lowest"))


@query()
def ground_zones(spark, sf):
    """Ground segmentation: polar patches, seeds, plane refits."""
    patches = numeric.ground_patches(points(spark, sf), 10.0, 45.0)
    return numeric.fit_ground(patches, ("frame_id", "sector", "zone"), ORDER).select(*ORDER, "ground")


@query()
def icp_align(spark, sf):
    """Registration of a cloud with a shifted copy of itself: the recovered transform."""
    n = nodes(spark, sf)
    moved = n.select("id", (F.col("x") + 0.4).alias("x"), (F.col("y") - 0.3).alias("y"), (F.col("z") + 0.1).alias("z"))
    rotation, shift, error = numeric.icp(moved, n, 3.0, 8)
    return spark.createDataFrame([(*map(float, shift), float(np.trace(rotation)), error)], "tx double, ty double, tz double, trace double, error double")


@query()
def pose_graph_opt(spark, sf):
    """Pose-graph optimisation of a noisy loop of submaps (driver-side: one pose a submap)."""
    rows = nodes(spark, sf).orderBy("id").collect()
    truth = {}
    for row in rows:
        m = np.eye(4)
        m[:3, 3] = row["x"], row["y"], row["z"]
        truth[row["id"]] = m
    names = sorted(truth)
    edges = [(a, b, np.linalg.inv(truth[a]) @ truth[b], 0.1) for a, b in zip(names, names[1:] + names[:1], strict=True)]
    start = {n: truth[n] + np.pad(np.array([[0.0], [0.0], [0.0]]) + 0.01 * k, ((0, 1), (3, 0))) for k, n in enumerate(names)}
    solved = numeric.optimise_graph(start, edges)
    return spark.createDataFrame([(int(n), *map(float, solved[n][:3, 3])) for n in names], "id long, x double, y double, z double")


@query(f"{P} SELECT {IDS}, round(x * cos(a) - y * sin(a) + 0.5 * tt, 6) + 0.0 AS x, round(x * sin(a) + y * cos(a), 6) + 0.0 AS y FROM (SELECT *, floor(t * 10000) / 10000 / 0.1 AS tt, 0.3 * floor(t * 10000) / 10000 / 0.1 AS a FROM p)")
def deskew(spark, sf):
    return r(ids(numeric.deskew(points(spark, sf), (0.5, 0.0, 0.0, 0.0, 0.0, 0.3), 0.1), "x", "y"), "x", "y")


@query()
def imu_integrate(spark, sf):
    """Increments of each stream over one interval, the last sample held to its end."""
    import pandas as pd

    from cartoflow.runtime import ship

    ship(spark)
    s = signals(spark, sf).select("stream", (F.col("id") / 1000).alias("stamp"), (F.col("signal") / 100).alias("ax"), F.lit(0.0).alias("ay"), F.lit(0.0).alias("az"), F.lit(0.0).alias("wx"), F.lit(0.0).alias("wy"), (F.col("signal") / 1000).alias("wz"))

    def run(pdf):
        got = numeric.integrate_imu(pdf, 0.0, 1.0)
        return pd.DataFrame({"stream": [pdf["stream"].iloc[0]], "yaw": [numeric.so3_log(got["rotation"])[2]], "vx": [got["velocity"][0]], "px": [got["position"][0]]})

    return s.groupBy("stream").applyInPandas(run, "stream long, yaw double, vx double, px double")
