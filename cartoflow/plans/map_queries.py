"""Queries over map building: HD frames, submaps, teams, keyframe policies, exports."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from cartoflow.functions import pose as se3
from cartoflow.functions.keys import packed_cell
from cartoflow.operators import filters, joins, mapping, numeric, projections, sets, windows
from cartoflow.plans.carriers import ORDER, ORDER_SQL, carrier, table, with_sql
from cartoflow.plans.path_queries import cloud, nodes, path, signals
from cartoflow.plans.points_queries import _BOXES, IDS, ids, points, r, vox
from cartoflow.plans.registry import query
from cartoflow.sources import maps

P, T, G = with_sql("points"), with_sql("trajectory"), with_sql("gnss")


def _frames(spark):
    half = math.sqrt(0.5)
    return spark.range(50).select(F.col("id").alias("frame_id"), F.col("id").cast("double").alias("tx"), F.lit(1.0).alias("ty"), F.lit(0.0).alias("tz"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.lit(half).alias("qz"), F.lit(half).alias("qw"))


@query(f"{P} SELECT {IDS}, round(frame_id - y, 6) + 0.0 AS x, round(1 + x, 6) + 0.0 AS y FROM p WHERE sqrt(x * x + y * y + z * z) >= 10.25")
def hd_load(spark, sf):
    """Per-frame poses applied to HD points (poses are a bounded dimension: one row a frame)."""
    return r(ids(mapping.load_hd(points(spark, sf), _frames(spark), 10.25), "x", "y"), "x", "y")


@query(f"{P}, {_BOXES} SELECT frame_id, round(frame_id - hi_y, 6) + 0.0 AS lo_x, round(frame_id - lo_y, 6) + 0.0 AS hi_x, round(1 + lo_x, 6) + 0.0 AS lo_y, round(1 + hi_x, 6) + 0.0 AS hi_y FROM b")
def bbox_reproject(spark, sf):
    """Boxes under a new pose, rotation included."""
    from cartoflow.operators.aggregates import bounds

    joined = bounds(points(spark, sf), "frame_id").join(_frames(spark), "frame_id")
    box = mapping.reprojected_box(joined)
    out = joined.select("frame_id", *[box[n].alias(n) for n in ("lo_x", "hi_x", "lo_y", "hi_y")])
    return r(out, "lo_x", "hi_x", "lo_y", "hi_y")


@query(f"{G} SELECT user_id, round(avg(sigma), 10) + 0.0 AS sigma, count(*) AS n FROM g WHERE sigma >= 0 GROUP BY 1")
def average_sigma(spark, sf):
    known = carrier(spark, sf, "gnss").where("sigma >= 0")
    return r(known.groupBy("user_id").agg(F.avg("sigma").alias("sigma"), F.count("*").alias("n")), "sigma", digits=10)


@query(f"{T} SELECT DISTINCT session, submap_id FROM tr WHERE x > 200")
def needed_submaps(spark, sf):
    return path(spark, sf).where("x > 200").select("session", "submap_id").distinct()


@query(f"{P}, f AS (SELECT DISTINCT frame_id FROM p) SELECT f.frame_id AS centre, count(*) AS n, round(min(z), 6) + 0.0 AS lowest FROM f JOIN p ON p.frame_id BETWEEN f.frame_id - 2 AND f.frame_id + 2 GROUP BY 1")
def accumulate_frames(spark, sf):
    """Each frame with two neighbours on either side: an equi-join over offsets, not a range join."""
    p = points(spark, sf).select("frame_id", "z")
    wide = p.withColumn("centre", F.explode(F.array(*[F.col("frame_id") + k for k in range(-2, 3)])))
    centres = p.select(F.col("frame_id").alias("centre")).distinct()
    return r(wide.join(centres, "centre").groupBy("centre").agg(F.count("*").alias("n"), F.min("z").alias("lowest")), "lowest")


@query(f"{T}, n AS (SELECT submap_id AS id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM tr GROUP BY 1), c AS (SELECT a.id AS i, b.id AS j FROM n a JOIN n b ON a.id < b.id WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 400) SELECT i, j FROM c ORDER BY ((i * 1000 + j) * 2654435761) % 4294967296, i, j LIMIT 100")
def capped_candidates(spark, sf):
    """A bounded buffer of loop candidates in a reproducible random order (the cap is the feature)."""
    c = joins.close_pairs(nodes(spark, sf), 20.0).select("i", "j")
    return c.orderBy(F.pmod((F.col("i") * F.lit(1000).cast("long") + F.col("j")) * F.lit(2654435761), F.lit(1 << 32)), "i", "j").limit(100)


@query(f"{T}, n AS (SELECT submap_id AS id, avg(x) AS ox, avg(y) AS oy FROM tr GROUP BY 1), ref AS (SELECT ox, oy FROM n WHERE id = 7) SELECT tr.id, round(tr.x - ref.ox, 8) + 0.0 AS x, round(tr.y - ref.oy, 8) + 0.0 AS y FROM tr, ref WHERE tr.submap_id BETWEEN 5 AND 9")
def team_merge(spark, sf):
    """Points of several submaps in the frame of the reference submap (a one-row table)."""
    t = path(spark, sf)
    ref = t.where("submap_id = 7").agg(F.avg("x").alias("ox"), F.avg("y").alias("oy"))
    joined = t.where("submap_id between 5 and 9").crossJoin(F.broadcast(ref))
    return r(joined.select("id", (F.col("x") - F.col("ox")).alias("x"), (F.col("y") - F.col("oy")).alias("y")), "x", "y", digits=8)


@query(f"{T} SELECT id, session, round(CASE WHEN session = 'O' THEN -y + 10 ELSE x END, 6) + 0.0 AS x, round(CASE WHEN session = 'O' THEN x - 5 ELSE y END, 6) + 0.0 AS y FROM tr")
def session_move(spark, sf):
    """All poses of one session moved by a transform; the others stay."""
    t = path(spark, sf)
    turn = se3.literal(10, -5, 0, *se3.from_rpy(0, 0, 90))
    moved = projections.move(t.where("session = 'O'"), turn)
    return r(sets.union(moved, t.where("session <> 'O'")).select("id", "session", "x", "y"), "x", "y")


@query(f"{with_sql('imu')} SELECT id, lag(id) OVER (PARTITION BY stream ORDER BY id) AS released FROM imu")
def one_frame_delay(spark, sf):
    """Each arrival releases the frame before it."""
    w = Window.partitionBy("stream").orderBy("id")
    return signals(spark, sf).select("id", F.lag("id").over(w).alias("released"))


@query(f"{with_sql('imu')}, k AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY id DESC) AS k FROM imu) SELECT id, stream FROM k WHERE k <= 20")
def bounded_queue(spark, sf):
    """A queue that drops the oldest: what is left of each stream."""
    k = F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("id")))
    return signals(spark, sf).withColumn("k", k).where("k <= 20").select("id", "stream")


@query(f"{P} SELECT {IDS}, t FROM p ORDER BY frame_id, t, {ORDER_SQL}")
def time_sorted(spark, sf):
    return ids(points(spark, sf).orderBy("frame_id", "t", *ORDER), "t")


@query(f"{P}, m AS (SELECT {IDS}, round(abs(x * 0.6 + y * 0.8) / sqrt(x * x + y * y + z * z), 9) AS c FROM p WHERE x * x + y * y + z * z > 0) SELECT {IDS} FROM m WHERE c >= 0.5")
def incidence_gate(spark, sf):
    """Views at grazing angles go: the ray against a fixed normal."""
    p = points(spark, sf).where("x * x + y * y + z * z > 0")
    cosine = F.abs(F.col("x") * 0.6 + F.col("y") * 0.8) / F.sqrt(filters.d2())
    return ids(p.where(F.round(cosine, 9) >= 0.5))


@query(f"{T}, h AS (SELECT id, x, y, z, round(cos((o_ % 12) * pi() / 6), 9) AS fx, round(sin((o_ % 12) * pi() / 6), 9) AS fy FROM (SELECT *, id % 12 AS o_ FROM tr)) SELECT id FROM h WHERE fx * 0.8 + fy * 0.6 >= cos(radians(60)) AND pow(x - 100, 2) + pow(y - 50, 2) + z * z <= 10000")
def directional_filter(spark, sf):
    t = path(spark, sf).withColumns({"fx": F.round(F.cos(F.col("id") % 12 * math.pi / 6), 9), "fy": F.round(F.sin(F.col("id") % 12 * math.pi / 6), 9), "fz": F.lit(0.0)})
    return filters.facing(t, (0.8, 0.6, 0.0), 60, (100.0, 50.0, 0.0), 100.0).select("id")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE starts_with(n_name, (SELECT min(n_name)[1:4] FROM nation))")
def name_prefix(spark, sf):
    n = table(spark, sf, "nation")
    first = n.agg(F.substring(F.min("n_name"), 1, 4).alias("__p"))
    return n.crossJoin(F.broadcast(first)).where(F.startswith(F.col("n_name"), F.col("__p"))).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


@query(f"{P}, k AS (SELECT frame_id, CAST(floor(frame_id / 10) AS BIGINT) AS submap, {vox(4.0)} AS voxel, intensity, x FROM p) SELECT submap, voxel, count(*) AS n, round(avg(x), 10) + 0.0 AS x, max(intensity) AS intensity FROM k GROUP BY 1, 2")
def submap_creation(spark, sf):
    """Ten keyframes a submap, merged into voxels."""
    p = points(spark, sf)
    keys = p.select("frame_id", F.lit(0).alias("session")).distinct()
    made = mapping.create_submaps(keys, p.select("frame_id", "x", "y", "z", "intensity"), 4.0, 10, ("session",), ("frame_id",))
    return r(made.select("submap", "voxel", "n", "x", "intensity"), "x", digits=10)


@query(f"{P} SELECT {vox(5.0)} AS voxel, count(*) AS n, round(avg(z), 10) + 0.0 AS z FROM p GROUP BY 1")
def sd_regenerate(spark, sf):
    return r(mapping.sd_from_hd(points(spark, sf), 5.0).select("voxel", "n", "z"), "z", digits=10)


@query()
def keyframe_overlap(spark, sf):
    """Keyframes by voxel overlap with the last one."""
    cells = points(spark, sf).groupBy("submap_id", "frame_id").agg(F.sort_array(F.collect_set(packed_cell("x", "y", "z", 10.0))).alias("voxels"))
    return windows.folded(cells, ("submap_id",), ("frame_id",), lambda pdf: mapping.keyframes_by_overlap(pdf, 0.9)[["submap_id", "frame_id"]], "submap_id long, frame_id long")


@query()
def keyframe_eviction(spark, sf):
    """A bounded keyframe window: what each insertion evicts."""
    src = path(spark, sf).select("session", "submap_id", "ts", "id", "x", "y", "z")

    def run(pdf):
        return mapping.keyframe_window(pdf, 30.0, 5).assign(submap_id=pdf["submap_id"].iloc[0]).astype({"evicted": "Int64"})

    return windows.folded(src, ("session", "submap_id"), ("ts", "id"), run, "id long, evicted long, submap_id int")


@query()
def outlier_select(spark, sf):
    return ids(mapping.outlier_selection(cloud(spark, sf), (0.0, 0.0, 0.0), 20.0, 10.0, 6, ORDER, 1.0))


@query(f"{P}, q AS (SELECT x, y, z, unnest([4.0::DOUBLE, 8.0::DOUBLE, 16.0::DOUBLE]) AS radius FROM p) SELECT radius, count(*) AS k, round(covar_pop(z, z) * sqrt(0.5), 6) + 0.0 AS c_zz FROM q WHERE pow(x - 1, 2) + pow(y - 2, 2) + pow(z, 2) < radius * radius GROUP BY 1 HAVING count(*) >= 5")
def plane_radius(spark, sf):
    """Moments at growing radii around a position."""
    got = mapping.plane_radius(points(spark, sf), (1.0, 2.0, 0.0), [4.0, 8.0, 16.0], 5)
    return r(got.select("radius", "k", (F.col("c_zz") * F.sqrt(F.lit(0.5))).alias("c_zz")), "c_zz")


@query()
def plane_eigenvalues(spark, sf):
    """Eigenvalues and normals of neighbourhoods at growing radii."""
    got = mapping.plane_radius(points(spark, sf), (1.0, 2.0, 0.0), [4.0, 8.0, 16.0], 5)
    return numeric.eigen(got, ("radius", "k"))


@query()
def region_growing(spark, sf):
    """Regions of smooth normals, by iterated joins."""
    n = nodes(spark, sf).withColumns({"nx": F.lit(0.0), "ny": F.sin(F.col("id") % 3), "nz": F.cos(F.col("id") % 3)})
    return mapping.grow_region(n, 15.0, 10.0)


@query()
def initial_state(spark, sf):
    """Upright rotation and gravity magnitude from the mean acceleration (one row, summed on the cluster)."""
    s = points(spark, sf).agg(F.avg("x").alias("ax"), F.avg("z").alias("ay"), (F.avg("y") + 9.81).alias("az")).toPandas()
    rotation, size = mapping.initial_state(pd.DataFrame(s))
    return spark.createDataFrame([(float(rotation[2, 2]), size)], "uprightness double, gravity double")


@query(f"{P} SELECT {IDS}, face FROM (SELECT {IDS}, CASE WHEN abs(z) > abs(x) AND abs(z) > abs(y) THEN CASE WHEN z > 0 THEN 'up' ELSE 'down' END WHEN abs(x) >= abs(y) THEN CASE WHEN x > 0 THEN 'front' ELSE 'back' END WHEN y > 0 THEN 'left' ELSE 'right' END AS face FROM p WHERE abs(x) <> abs(y) AND abs(x) <> abs(z) AND abs(y) <> abs(z))")
def cube_faces(spark, sf):
    """Which cube-map face sees a point: the one whose rotated depth is largest."""
    p = points(spark, sf).where("abs(x) <> abs(y) and abs(x) <> abs(z) and abs(y) <> abs(z)")
    names = ("front", "right", "back", "left", "up", "down")
    depth = []
    for k, n in enumerate(names):
        m = projections.cube_face_rotation(k)
        depth.append(F.struct(sum((F.col(c) * m[i][0] for i, c in enumerate("xyz")), F.lit(0.0)).alias("d"), F.lit(n).alias("face")))
    return ids(p, F.greatest(*depth)["face"].alias("face"))


@query(f"{with_sql('cameras', 'points')} SELECT 'image' AS kind, count(*) AS n FROM cam WHERE abs(cx - 1) <= 12 AND abs(cy - 2) <= 22 UNION ALL SELECT 'point', count(*) FROM p WHERE abs(x - 1) <= 10 AND abs(y - 2) <= 20 UNION ALL SELECT 'camera', 1")
def photogrammetry_export(spark, sf):
    """Lines of a photogrammetry export by kind."""
    cams = carrier(spark, sf, "cameras").select("cam", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    camera, image, point = maps.colmap_tables(points(spark, sf).select("x", "y", "z"), cams, (1, 2), 0.0, (10, 20), 2.0)
    out = [d.agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, d in (("camera", camera), ("image", image), ("point", point))]
    return sets.union(*out)


@query(f"{P} SELECT CAST(floor(x / 10) AS BIGINT) AS tile_x, CAST(floor(y / 10) AS BIGINT) AS tile_y, count(*) AS n FROM p GROUP BY 1, 2")
def tiled_export(spark, sf):
    """Tiles with at least one point, read back from a partitioned export."""
    from cartoflow.streaming.streams import work_folder

    folder = work_folder(spark)
    tile = F.concat_ws("_", F.floor(F.col("x") / 10).cast("string"), F.floor(F.col("y") / 10).cast("string"))
    maps.write_tiles(points(spark, sf).select("x", "y", "z"), tile, folder)
    back = spark.read.parquet(folder).groupBy(F.col("tile").cast("string").alias("tile")).agg(F.count("*").alias("n"))
    part = F.split("tile", "_")
    return back.select(part[0].cast("long").alias("tile_x"), part[1].cast("long").alias("tile_y"), "n")


@query(
    f"""{G}, q AS (SELECT event_id AS id, user_id FROM events WHERE event_type = 'view'),
    b AS (SELECT q.id, q.user_id, (SELECT max(g.id) FROM g WHERE g.user_id = q.user_id AND g.id <= q.id) AS l, (SELECT min(g.id) FROM g WHERE g.user_id = q.user_id AND g.id >= q.id) AS r FROM q)
    SELECT b.id, round(a.alt + (c.alt - a.alt) * (b.id - l)::DOUBLE / (r - l), 6) + 0.0 AS alt, least(a.status, c.status) AS status,
      round(CASE WHEN a.sigma < 0 OR c.sigma < 0 THEN -1 ELSE a.sigma + (c.sigma - a.sigma) * (b.id - l)::DOUBLE / (r - l) END, 6) + 0.0 AS sigma
    FROM b JOIN g a ON a.id = l JOIN g c ON c.id = r"""
)
def fix_interpolation(spark, sf):
    """Satellite fixes at frame times: lesser status, sigma unknown if either is."""
    q = table(spark, sf, "events").where("event_type = 'view'").select(F.col("event_id").alias("id"), "user_id")
    b = joins.bracket(q, carrier(spark, sf, "gnss"), ("user_id",), "id", ("lat", "lon", "alt", "status", "sigma"))
    return r(joins.interpolated_fixes(b).select("id", "alt", "status", "sigma"), "alt", "sigma")


@query(f"{P} SELECT {IDS} FROM p WHERE x > 0.1 AND (CAST(floor(-320 * y / x + 320 + 0.5) AS BIGINT) % 8 <> 0 OR CAST(floor(-320 * z / x + 240 + 0.5) AS BIGINT) % 4 <> 0) AND abs(y / x) < 0.9 AND abs(z / x) < 0.6")
def mask_gate(spark, sf):
    """Pixels under a mask go."""
    from cartoflow.operators.scans import unmasked

    p = points(spark, sf).where("x > 0.1 and abs(y / x) < 0.9 and abs(z / x) < 0.6")
    px = p.withColumns({"u": -320 * F.col("y") / F.col("x") + 320, "v": -320 * F.col("z") / F.col("x") + 240})
    mask = spark.range(0, 640, 8).select(F.col("id").alias("u")).crossJoin(F.broadcast(spark.range(0, 480, 4).select(F.col("id").alias("v"))))
    return ids(unmasked(px, mask))


@query()
def equirect_cube(spark, sf):
    """Sampling table of a cube map from an equirectangular image."""
    from cartoflow.operators.scans import cube_sampling

    return cube_sampling(spark, 16, 256, 128)


@query()
def odometry(spark, sf):
    """Continuous-time odometry of sessions, in parallel."""
    from cartoflow.operators.odometry import odometry as run

    p = points(spark, sf).select("submap_id", "frame_id", (F.col("frame_id") * 0.1).alias("stamp"), "t", "x", "y", "z")
    return run(p, "submap_id", 2.0, 4.0)


@query(
    f"""{P}, f AS (SELECT * FROM p), z AS (SELECT * FROM f WHERE intensity = 0),
    m AS (SELECT {", ".join("z." + c.strip() for c in IDS.split(","))}, avg(o.intensity) AS i FROM z JOIN f o ON o.intensity <> 0 AND pow(z.x - o.x, 2) + pow(z.y - o.y, 2) + pow(z.z - o.z, 2) <= 9 GROUP BY ALL)
    SELECT {IDS}, round(CASE WHEN f.intensity = 0 THEN m.i ELSE f.intensity END, 8) + 0.0 AS intensity FROM f LEFT JOIN m USING ({IDS})"""
)
def livox_interpolate(spark, sf):
    """Zero returns filled from the returns around them."""
    p = points(spark, sf).select(*ORDER, "x", "y", "z", "intensity")
    return r(ids(mapping.fill_zero_intensity(p, 3.0, ORDER), "intensity"), "intensity", digits=8)


@query(f"{P} SELECT {IDS}, round(x + 2 * floor(t * 10000 + 1e-6) / 10000, 6) + 0.0 AS x, round(y - 3 * floor(t * 10000 + 1e-6) / 10000, 6) + 0.0 AS y FROM p")
def deskew_poses(spark, sf):
    """Deskew along a straight trajectory sampled at uneven times."""
    p = points(spark, sf).withColumns({"stamp": F.col("frame_id").cast("double"), "t": F.col("t") + 1e-10})
    zero = F.lit(0.0)
    samples = spark.range(0, 50 * 7).select((F.col("id") / 7).alias("stamp"), F.lit(1).alias("s"))
    poses = samples.select("s", "stamp", (F.col("stamp") * 2).alias("tx"), (F.col("stamp") * -3).alias("ty"), zero.alias("tz"), zero.alias("qx"), zero.alias("qy"), zero.alias("qz"), F.lit(1.0).alias("qw"))
    return r(ids(numeric.deskew_with_poses(p.withColumn("s", F.lit(1)), poses, ("s",)), "x", "y"), "x", "y")


@query(f"{T}, s AS (SELECT id, CAST(sum(CAST(round(x * 100) AS BIGINT)) OVER (PARTITION BY session, submap_id ORDER BY y, id) AS BIGINT) AS spent FROM tr) SELECT id, spent FROM s WHERE spent <= 50000 OR (id % 3 = 0 AND spent <= 60000)")
def budget_hysteresis(spark, sf):
    """What was loaded stays a little beyond the budget."""
    t = path(spark, sf).withColumn("cost", F.round(F.col("x") * 100).cast("long"))
    kept = windows.budget_kept(t, t.where("id % 3 = 0"), ("id",), ("session", "submap_id"), ("y", "id"), "cost", 50000)
    return kept.select("id", "spent")


@query()
def flat_radius(spark, sf):
    """The largest flat neighbourhood of a position."""
    found = mapping.flat_radius(points(spark, sf), (1.0, 2.0, 0.0), [4.0, 8.0, 16.0, 32.0], 5, 0.2)
    return spark.createDataFrame([(found,)], "radius double")
