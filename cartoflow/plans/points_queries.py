"""Queries over points: filters, projections, voxels, range images, colour."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cartoflow.functions import geodesy
from cartoflow.functions import pose as se3
from cartoflow.functions.keys import hash_share, packed_cell, packed_point_id, unpack_point_id
from cartoflow.operators import aggregates, filters, projections, scans, windows
from cartoflow.plans.carriers import ORDER, ORDER_SQL, carrier, table, with_sql
from cartoflow.plans.registry import query

P = with_sql("points")
IDS = "ok, ln, pk, sk, ep, sd"
_D2 = "(x * x + y * y + z * z)"


def r(df, *names, digits=6):
    """Rounded doubles with one zero."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def rs(*names, digits=6):
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def vox(size, x="x", y="y", z="z"):
    a, b, c = (f"(CAST(floor({v} / {float(size)!r}::DOUBLE) AS BIGINT) + 1048576)" for v in (x, y, z))
    return f"(({a} << 42) | ({b} << 21) | {c})"


def points(spark, sf):
    return carrier(spark, sf, "points")


def ids(df, *more):
    return df.select(*ORDER, *more)


@query(f"{P} SELECT {IDS}, round(sqrt{_D2}, 6) + 0.0 AS range FROM p WHERE {_D2} > 25 AND {_D2} < 2025")
def preprocess_filter(spark, sf):
    near = filters.distance_band(points(spark, sf), 5.0, 45.0)
    return r(ids(near.withColumn("range", F.sqrt(filters.d2())), "range"), "range")


@query(
    f"""{P}, b AS (SELECT *, sqrt{_D2} AS range, frame_id * 0.1::DOUBLE + t AS gps_time FROM p WHERE {_D2} > 1 AND {_D2} < 10000)
    SELECT {vox(2.0)} AS voxel, count(*) AS n, round(avg(x), 10) + 0.0 AS x, round(avg(y), 10) + 0.0 AS y, round(avg(z), 10) + 0.0 AS z,
      max(intensity) AS intensity, round(min(range), 6) + 0.0 AS range, round(min(gps_time), 6) + 0.0 AS gps_time,
      CAST(arg_min(sk, ({ORDER_SQL})) AS BIGINT) AS scanner_id FROM b GROUP BY 1"""
)
def voxel_merge(spark, sf):
    """The flagship: band filter, ordering, range and time columns, packed voxel key, multi-mode merge."""
    near = filters.distance_band(points(spark, sf), 1.0, 100.0).withColumn("stamp", F.col("frame_id") * F.lit(0.1))
    ranged = projections.ranges_and_times(near).withColumn("scanner_id", F.col("sk"))
    return r(r(aggregates.voxel_merge(ranged, 2.0, ORDER), "x", "y", "z", digits=10), "range", "gps_time")


@query(f"{P} SELECT {IDS} FROM p WHERE NOT (x BETWEEN -5 AND 5 AND y BETWEEN -10 AND 10 AND z BETWEEN -1 AND 1)")
def crop_box(spark, sf):
    return ids(filters.crop_box(points(spark, sf), (-5, -10, -1), (5, 10, 1)))


@query(f"{P} SELECT {IDS} FROM p WHERE NOT (round(y + 1, 9) BETWEEN -5 AND 5 AND round(2 - x, 9) BETWEEN -10 AND 10 AND round(z, 9) BETWEEN -1 AND 1)")
def crop_box_sensor(spark, sf):
    """The box in a frame turned by -90 degrees and shifted."""
    turned = points(spark, sf)
    moved = se3.transform(se3.literal(1, 2, 0, *se3.from_rpy(0, 0, -90)), F.col("x"), F.col("y"), F.col("z"))
    seen = turned.withColumns({"x0": F.col("x"), "y0": F.col("y"), "z0": F.col("z"), "x": F.round(moved[0], 9), "y": F.round(moved[1], 9), "z": F.round(moved[2], 9)})
    return ids(filters.crop_box(seen, (-5, -10, -1), (5, 10, 1)))


@query(f"{P} SELECT {IDS} FROM p WHERE sqrt{_D2} >= 15.5")
def min_range(spark, sf):
    return ids(filters.min_range(points(spark, sf), 15.5))


@query(f"{P}, d AS (SELECT *, CASE WHEN ln = 3 THEN 'NaN'::DOUBLE WHEN ln = 4 THEN 'Infinity'::DOUBLE ELSE x END AS x2 FROM p) SELECT {IDS}, x2 AS x, 1.0::DOUBLE AS w FROM d WHERE isfinite(x2) AND isfinite(y) AND isfinite(z)")
def repair_rows(spark, sf):
    broken = points(spark, sf).withColumn("x", F.when(F.col("ln") == 3, F.lit(float("nan"))).when(F.col("ln") == 4, F.lit(float("inf"))).otherwise(F.col("x")))
    return ids(filters.repair_rows(broken), "x", "w")


@query(f"{P} SELECT {IDS} FROM p WHERE abs(round((x - 2) * 0.6 + (y - 5) * 0.8, 9)) <= 12 AND abs(round((y - 5) * 0.6 - (x - 2) * 0.8, 9)) <= 12 AND abs(z - 1) <= 2")
def obb_select(spark, sf):
    return ids(filters.oriented_box(points(spark, sf), (2, 5, 1), (3, 4), 12.0, 2.0))


@query(f"{P} SELECT {IDS}, CASE WHEN pow((x - 1) / 8, 2) + pow((y - 2) / 9, 2) + pow(z / 3, 2) < 1 THEN 'sphere' ELSE 'cube' END AS shape FROM p WHERE abs((x - 1) / 8) < 1 AND abs((y - 2) / 9) < 1 AND abs(z / 3) < 1")
def gizmo_select(spark, sf):
    local = se3.literal(-1, -2, 0, 0, 0, 0, 1)
    cube = filters.gizmo(points(spark, sf), local, (8, 9, 3))
    inside = ((F.col("x") - 1) / 8) ** 2 + ((F.col("y") - 2) / 9) ** 2 + (F.col("z") / 3) ** 2 < 1
    return ids(cube, F.when(inside, "sphere").otherwise("cube").alias("shape"))


@query(f"{P} SELECT {IDS} FROM p WHERE pow(x - 3, 2) + pow(y + 4, 2) + pow(z - 0.5, 2) < 100")
def sphere_select(spark, sf):
    return ids(filters.in_radius(points(spark, sf), (3.0, -4.0, 0.5), 10.0))


_BOXES = "b AS (SELECT frame_id, count(*) AS n, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z FROM p GROUP BY 1)"


@query(f"{P}, {_BOXES} SELECT frame_id, n, {rs('lo_x', 'hi_x', 'lo_y', 'hi_y', 'lo_z', 'hi_z')} FROM b")
def frame_bounds(spark, sf):
    return r(aggregates.bounds(points(spark, sf), "frame_id"), *[f"{p}_{c}" for c in "xyz" for p in ("lo", "hi")])


_SMALL = "s AS (SELECT ok, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z FROM p GROUP BY 1)"


@query(f"{P}, {_SMALL} SELECT ok FROM s WHERE pow(greatest(lo_x - 3, 0, 3 - hi_x), 2) + pow(greatest(lo_y - 2, 0, 2 - hi_y), 2) <= 16 AND hi_z >= -1.5 AND lo_z <= 2.5")
def probe_cylinder(spark, sf):
    return filters.box_meets_cylinder(aggregates.bounds(points(spark, sf), "ok"), (3.0, 2.0, 0.5), 4.0, 2.0).select("ok")


@query(f"{P} SELECT DISTINCT ok FROM p WHERE pow(x - 3, 2) + pow(y - 2, 2) <= 16 AND abs(z - 0.5) <= 2")
def probe_points_exists(spark, sf):
    return filters.in_cylinder(points(spark, sf), (3.0, 2.0, 0.5), 4.0, 2.0).select("ok").distinct()


_VP = ((0.1, 0.0, 0.0, 0.1), (0.0, 0.08, 0.0, -0.2), (0.0, 0.0, 0.5, 0.0), (0.02, 0.0, 0.0, 1.0))


@query(
    f"{P}, {_SMALL} SELECT ok FROM s WHERE "
    + " AND ".join(" + ".join(f"({v!r}) * {'hi_' if v >= 0 else 'lo_'}{n}" for v, n in zip(pl[:3], "xyz", strict=True)) + f" + ({pl[3]!r}) >= 0" for pl in filters.frustum_planes(_VP))
)
def frustum(spark, sf):
    return filters.in_frustum(aggregates.bounds(points(spark, sf), "ok"), filters.frustum_planes(_VP)).select("ok")


@query(f"{P} SELECT {IDS} FROM p WHERE abs(round((x - 1) * {math.cos(0.5)!r} + (y - 2) * {math.sin(0.5)!r}, 9)) <= 10 AND abs(round((y - 2) * {math.cos(0.5)!r} - (x - 1) * {math.sin(0.5)!r}, 9)) <= 15")
def tile_bounds(spark, sf):
    return ids(filters.rotated_tile(points(spark, sf), (1, 2), 0.5, 10, 15))


@query(f"{P} SELECT {IDS} FROM p WHERE NOT (degrees(atan2(z, sqrt(x * x + y * y))) < -5 AND z < -0.9 AND intensity < 40)")
def noise_gate(spark, sf):
    return ids(filters.noise_gate(points(spark, sf), 0.1, -5.0, 40.0))


@query(
    f"""{P}, q AS (SELECT *, sqrt{_D2} AS range, floor(x / 4) AS cx, floor(y / 4) AS cy, floor(z / 4) AS cz FROM p),
    m AS (SELECT *, min(range) OVER (PARTITION BY cx, cy, cz) AS nearest FROM q)
    SELECT {IDS}, round(range, 6) + 0.0 AS range FROM m WHERE range <= 20 OR range <= nearest + CASE WHEN nearest <= 20 THEN 1.5 ELSE 2.5 END"""
)
def range_filter(spark, sf):
    return r(ids(filters.range_filter(points(spark, sf), 4.0, 20.0, 1.5, 2.5), "range"), "range")


@query(f"{P} SELECT {IDS} FROM p WHERE intensity >= 10 AND intensity <= 60")
def visibility_threshold(spark, sf):
    return ids(filters.hide(points(spark, sf), "intensity", 10.0, 60.0))


@query(f"{P} SELECT {IDS}, CASE WHEN intensity = 0 THEN NULL ELSE intensity END AS intensity, CASE WHEN intensity = 0 THEN 1 ELSE 0 END AS second_return FROM p WHERE NOT (intensity = 0 AND ln = 1)")
def zero_intensity(spark, sf):
    """Zero returns: dropped on the first ring, marked as second returns elsewhere."""
    kept = points(spark, sf).where("not (intensity = 0 and ln = 1)")
    return ids(kept, F.when(F.col("intensity") != 0, F.col("intensity")).alias("intensity"), (F.col("intensity") == 0).cast("int").alias("second_return"))


@query(f"{P} SELECT {IDS}, round(0.8 * x - 0.6 * y + 1, 6) + 0.0 AS x, round(0.6 * x + 0.8 * y - 2, 6) + 0.0 AS y, round(z + 3, 6) + 0.0 AS z FROM p")
def rigid_transform(spark, sf):
    half = math.atan2(0.6, 0.8) / 2
    moved = projections.move(points(spark, sf), se3.literal(1, -2, 3, 0, 0, math.sin(half), math.cos(half)))
    return r(ids(moved, "x", "y", "z"), "x", "y", "z")


@query(f"{P} SELECT {IDS}, round(-y, 6) + 0.0 AS nx, round(x, 6) + 0.0 AS ny, round(z, 6) + 0.0 AS nz, round(z * z, 6) + 0.0 AS c_yx FROM p")
def rotate_normals(spark, sf):
    """Normals and covariances turn with the frame; only points move."""
    turn = se3.literal(5, 5, 5, *se3.from_rpy(0, 0, 90))
    n = se3.rotate(turn, F.col("x"), F.col("y"), F.col("z"))
    zero, zz = F.lit(0.0), F.col("z") * F.col("z")
    c = projections.rotate_covariance(turn, F.array(zero, -zz, zero, zero, zero, zero, zero, zero, zero))
    out = points(spark, sf).withColumns({"nx": n[0], "ny": n[1], "nz": n[2], "c_yx": c[3]})
    return r(ids(out, "nx", "ny", "nz", "c_yx"), "nx", "ny", "nz", "c_yx")


_AZ, _EL = "atan2(y, x)", "atan2(z, sqrt(x * x + y * y))"


@query(
    f"""{P}, q AS (SELECT frame_id, greatest(0, least(89, CAST(trunc(({_AZ} + pi()) / (2 * pi()) * 90) AS INT))) AS az_bin,
      greatest(0, least(44, CAST(trunc(({_EL} + pi() / 2) / pi() * 45) AS INT))) AS el_bin, sqrt{_D2} AS range FROM p)
    SELECT frame_id, el_bin, az_bin, round(max(range), 6) + 0.0 AS range FROM q WHERE range >= 1.5 GROUP BY 1, 2, 3"""
)
def range_image_max(spark, sf):
    return r(scans.farthest_image(points(spark, sf), ("frame_id",), 90, 45), "range")


_IMAGE = projections.ScanImage(2 * math.pi, math.pi / 2, 0.05, 0.1)
_PIX = f"CAST(trunc(({_EL} / {_IMAGE.fov_v!r} + 0.5) * {_IMAGE.height}) AS INT) AS prow, CAST(trunc(({_AZ} / {_IMAGE.fov_h!r} + 0.5) * {_IMAGE.width}) AS INT) AS pcol"
_INSIDE = f"pcol >= 0 AND pcol < {_IMAGE.width} AND prow >= 0 AND prow < {_IMAGE.height}"


@query(f"""{P}, q AS (SELECT frame_id, {_PIX}, sqrt{_D2} AS range FROM p) SELECT frame_id, prow AS "row", pcol AS col, round(min(range), 6) + 0.0 AS range FROM q WHERE range >= 1.5 AND {_INSIDE} GROUP BY 1, 2, 3""")
def range_image_min(spark, sf):
    return r(scans.nearest_image(points(spark, sf), _IMAGE, ("frame_id",)), "range")


_VOTES = f"""q AS (SELECT *, {_PIX}, sqrt{_D2} AS range FROM p),
 img AS (SELECT frame_id, prow, pcol, min(range) AS seen FROM q WHERE range >= 1.5 AND {_INSIDE} GROUP BY 1, 2, 3),
 win AS (SELECT q.*, prow + dv AS wr, ((pcol + dh) % {_IMAGE.width} + {_IMAGE.width}) % {_IMAGE.width} AS wc, (q.frame_id + 1) % 50 AS other
         FROM q, (SELECT unnest([-1, 0, 1]) AS dv) a, (SELECT unnest([-1, 0, 1]) AS dh) b WHERE {_INSIDE} AND is_ground = 0),
 v AS (SELECT {", ".join("win." + c.strip() for c in IDS.split(","))}, max(CASE WHEN abs(seen - range) <= 0.5 THEN 1 ELSE 0 END) AS a, max(CASE WHEN seen > range + 0.5 THEN 1 ELSE 0 END) AS c
       FROM win JOIN img ON img.frame_id = win.other AND img.prow = win.wr AND img.pcol = win.wc GROUP BY ALL)"""


@query(f"{P}, {_VOTES} SELECT {IDS}, CAST(a AS BIGINT) AS static, CAST(CASE WHEN a = 0 THEN c ELSE 0 END AS BIGINT) AS dynamic FROM v")
def dynamic_votes(spark, sf):
    """Each frame's points against the next frame's range image (a shared sensor frame)."""
    p = points(spark, sf)
    image = scans.nearest_image(p, _IMAGE, ("frame_id",))
    seen = p.where("is_ground = 0").withColumn("frame_id", (F.col("frame_id") + 1) % 50)
    return scans.votes(seen, image, _IMAGE, "frame_id", ORDER, 0.5).select(*ORDER, F.col("static").cast("long").alias("static"), F.col("dynamic").cast("long").alias("dynamic"))


@query(f"{P}, {_VOTES} SELECT count(*) AS n, CAST(sum(CASE WHEN is_ground = 0 AND coalesce(a = 0 AND c = 1, false) THEN 1 ELSE 0 END) AS BIGINT) AS moving FROM p LEFT JOIN v USING ({IDS})")
def dynamic_filter(spark, sf):
    """The whole dynamic-object filter: image, window, votes, decision."""
    p = points(spark, sf)
    image = scans.nearest_image(p, _IMAGE, ("frame_id",))
    seen = p.where("is_ground = 0").withColumn("frame_id", (F.col("frame_id") + 1) % 50)
    voted = scans.votes(seen, image, _IMAGE, "frame_id", ORDER, 0.5)
    return scans.dynamic(p, voted, ORDER).agg(F.count("*").alias("n"), F.sum(F.col("is_dynamic").cast("int")).alias("moving"))


_LENS = projections.Lens(320, 320, 320, 240, 640, 480, 0.01, -0.001, 0.0005, -0.0005, 0.0001)
_XN, _YN = "(-y / x)", "(-z / x)"


@query(
    f"""{P}, n AS (SELECT *, {_XN} AS xn, {_YN} AS yn FROM p WHERE x > 0.1), m AS (SELECT *, xn * xn + yn * yn AS r2 FROM n),
    k AS (SELECT *, 1 + 0.01 * r2 - 0.001 * r2 * r2 + 0.0001 * r2 * r2 * r2 AS rad FROM m),
    uv AS (SELECT *, 320 * (xn * rad + 2 * 0.0005 * xn * yn - 0.0005 * (r2 + 2 * xn * xn)) + 320 AS u, 320 * (yn * rad + 0.0005 * (r2 + 2 * yn * yn) - 2 * 0.0005 * xn * yn) + 240 AS v FROM k)
    SELECT {IDS}, round(u, 4) + 0.0 AS u, round(v, 4) + 0.0 AS v FROM uv WHERE u >= 0 AND u < 640 AND v >= 0 AND v < 480"""
)
def pinhole_project(spark, sf):
    ahead = points(spark, sf).where("x > 0.1")
    u, v = _LENS.project(F.col("x"), F.col("y"), F.col("z"))
    seen = ahead.withColumns({"u": u, "v": v}).where("u >= 0 and u < 640 and v >= 0 and v < 480")
    return r(ids(seen, "u", "v"), "u", "v", digits=4)


_PLAIN = projections.Lens(320, 320, 320, 240, 640, 480)
_UV = f"uv AS (SELECT *, 320 * {_XN} + 320 AS u, 320 * {_YN} + 240 AS v, x AS depth FROM p WHERE x > 0.1), img AS (SELECT * FROM uv WHERE u >= 0 AND u < 640 AND v >= 0 AND v < 480)"


def _pixels(spark, sf):
    u, v = _PLAIN.project(F.col("x"), F.col("y"), F.col("z"))
    return points(spark, sf).where("x > 0.1").withColumns({"u": u, "v": v, "depth": F.col("x")}).where("u >= 0 and u < 640 and v >= 0 and v < 480")


@query(f"{P}, {_UV} SELECT frame_id, CAST(floor(trunc(u) / 8) AS BIGINT) AS zu, CAST(floor(trunc(v) / 8) AS BIGINT) AS zv, round(min(depth), 6) + 0.0 AS zdepth FROM img GROUP BY 1, 2, 3")
def zbuffer(spark, sf):
    return r(scans.depth_buffer(_pixels(spark, sf), ("frame_id",), 8), "zdepth")


@query(
    f"""{P}, {_UV}, zb AS (SELECT frame_id, floor(trunc(u) / 8) AS zu, floor(trunc(v) / 8) AS zv, min(depth) AS zdepth FROM img GROUP BY 1, 2, 3)
    SELECT {", ".join("img." + c.strip() for c in IDS.split(","))} FROM img LEFT JOIN zb ON img.frame_id = zb.frame_id AND floor(floor(u + 0.5) / 8) = zu AND floor(floor(v + 0.5) / 8) = zv
    WHERE zdepth IS NULL OR depth <= zdepth * 1.1"""
)
def occlusion(spark, sf):
    px = _pixels(spark, sf)
    return ids(scans.not_occluded(px, scans.depth_buffer(px, ("frame_id",), 8), ("frame_id",), 8, 0.1))


@query(
    f"""{P}, {_UV}, wt AS (SELECT *, exp(-sqrt{_D2} / 20) * pow(greatest(0, 1 - least(1, pow((u - 320) / 320, 2) + pow((v - 240) / 240, 2))), 2) AS w, {vox(4.0)} AS cell FROM img),
    k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY w DESC, {ORDER_SQL}) AS rk FROM wt WHERE w > 0)
    SELECT cell, count(*) AS views, round(sum(intensity * w) / sum(w), 6) + 0.0 AS intensity FROM k WHERE rk <= 4 GROUP BY 1"""
)
def topk_blend(spark, sf):
    px = _pixels(spark, sf)
    w = scans.view_weight(F.sqrt(filters.d2()), F.col("u"), F.col("v"), _PLAIN, 20.0, 2.0)
    keyed = px.withColumn("w", w).withColumn("cell", packed_cell("x", "y", "z", 4.0))
    return r(scans.blend(keyed, ("cell",), 4, ORDER, ("intensity",)), "intensity")


@query(
    f"""{P}, {_UV}, s AS (SELECT frame_id, avg(0.299 * intensity + 0.587 * ring + 0.114 * (ring * 2)) AS surface, count(*) AS n FROM img GROUP BY 1),
    f AS (SELECT frame_id, avg(intensity) AS image_mean FROM p GROUP BY 1)
    SELECT f.frame_id, round(greatest(0.25, least(4, 0.45 * 255 / greatest(1, CASE WHEN coalesce(n, 0) >= 100 THEN surface ELSE image_mean END))), 6) + 0.0 AS gain FROM f LEFT JOIN s USING (frame_id)"""
)
def exposure_gain(spark, sf):
    px = _pixels(spark, sf).withColumns({"r": F.col("intensity"), "g": F.col("ring").cast("double"), "b": F.col("ring") * F.lit(2.0)})
    whole = points(spark, sf).groupBy("frame_id").agg(F.avg("intensity").alias("image_mean"))
    return r(aggregates.exposure_gain(px, ("frame_id",), 0.45, whole), "gain")


@query(
    f"""{P}, f AS (SELECT frame_id, CAST(list(intensity ORDER BY {ORDER_SQL})[1:20] AS DOUBLE[]) AS a, CAST(list(z ORDER BY {ORDER_SQL})[1:20] AS DOUBLE[]) AS b FROM p GROUP BY 1),
    e AS (SELECT frame_id, unnest(a) AS va, unnest(b) AS vb FROM f), m AS (SELECT *, avg(va) OVER (PARTITION BY frame_id) AS ma, avg(vb) OVER (PARTITION BY frame_id) AS mb FROM e)
    SELECT frame_id, round(sum((va - ma) * (vb - mb)) / sqrt(greatest(1e-12, sum(pow(va - ma, 2)) * sum(pow(vb - mb, 2)))), 6) + 0.0 AS ncc FROM m GROUP BY 1"""
)
def patch_ncc(spark, sf):
    packed = points(spark, sf).groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "intensity", "z"))).alias("s"))
    first = F.slice("s", 1, 20)
    out = packed.select("frame_id", scans.ncc(F.transform(first, lambda v: v["intensity"]), F.transform(first, lambda v: v["z"])).alias("ncc"))
    return r(out, "ncc")


@query(
    f"""{P}, {_UV}, w AS (SELECT CAST(floor(u + 0.5) AS BIGINT) + du AS u, CAST(floor(v + 0.5) AS BIGINT) + dv AS v, depth, intensity FROM img, (SELECT unnest([-1, 0, 1]) AS du) a, (SELECT unnest([-1, 0, 1]) AS dv) b)
    SELECT u, v, arg_min(intensity, (depth, intensity)) AS value, round(min(depth), 6) + 0.0 AS depth FROM w GROUP BY 1, 2"""
)
def intensity_render(spark, sf):
    px = _pixels(spark, sf).select(F.floor(F.col("u") + 0.5).alias("u"), F.floor(F.col("v") + 0.5).alias("v"), "depth", F.col("intensity").alias("value"))
    return r(projections.splat(px, 1), "depth")


@query(f"{P} SELECT {IDS}, round(0.6 * x + 0.8 * y, 6) + 0.0 AS x, round(z, 6) + 0.0 AS y, round(0.8 * x - 0.6 * y, 6) + 0.0 AS z FROM p")
def export_axes(spark, sf):
    return r(ids(projections.export_axes(points(spark, sf), math.atan2(0.8, 0.6), y_up=True), "x", "y", "z"), "x", "y", "z")


@query(f"{P} SELECT {IDS}, (submap_id << 32) | ok AS packed, submap_id AS submap, ok AS point FROM p")
def packed_ids(spark, sf):
    p = points(spark, sf).withColumn("packed", packed_point_id("submap_id", "ok"))
    a, b = unpack_point_id("packed")
    return ids(p, "packed", a.alias("submap"), b.alias("point"))


@query(f"{P} SELECT {IDS} FROM p WHERE (ok * 2654435761) % 4294967296 < {int(0.3 * 2**32)}")
def hash_sample(spark, sf):
    return ids(points(spark, sf).where(hash_share("ok", 0.3)))


@query(
    f"""{P}, k AS (SELECT *, {vox(4.0)} AS voxel FROM p), m AS (SELECT *, row_number() OVER (PARTITION BY voxel ORDER BY (pk * 2654435761) % 4294967296, {ORDER_SQL}) AS rk, count(*) OVER (PARTITION BY voxel) AS n FROM k)
    SELECT {IDS}, voxel FROM m WHERE rk <= ceil(n * 0.25::DOUBLE)"""
)
def random_grid(spark, sf):
    h = F.struct(F.pmod(F.col("pk") * F.lit(2654435761), F.lit(1 << 32)), *ORDER)
    return ids(aggregates.voxel_quota(points(spark, sf), 4.0, 0.25, h), "voxel")


@query(f"{P} SELECT {vox(1.5)} AS voxel, count(*) AS n, round(avg(x), 10) + 0.0 AS x, round(avg(y), 10) + 0.0 AS y, round(avg(z), 10) + 0.0 AS z, round(avg(intensity), 10) + 0.0 AS intensity FROM p GROUP BY 1")
def voxel_mean(spark, sf):
    return r(aggregates.voxel_mean(points(spark, sf), 1.5, ("intensity",)), "x", "y", "z", "intensity", digits=10)


_COV = ", ".join(f"round(covar_pop({a}, {b}) * sqrt(0.5), 6) + 0.0 AS c_{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))


@query(
    f"""{P}, l AS (SELECT 0 AS level, {vox(3.0)} AS voxel, x, y, z FROM p UNION ALL SELECT 1, {vox(6.0)}, x, y, z FROM p)
    SELECT level, voxel, count(*) AS n, round(avg(x), 10) + 0.0 AS x, round(avg(y), 10) + 0.0 AS y, round(avg(z), 10) + 0.0 AS z, {_COV} FROM l GROUP BY 1, 2"""
)
def voxel_gauss_levels(spark, sf):
    made = aggregates.voxel_gaussians(points(spark, sf), 3.0, 2, 2.0)
    names = ["c_xx", "c_xy", "c_xz", "c_yy", "c_yz", "c_zz"]
    scaled = made.withColumns({n: F.col(n) * F.sqrt(F.lit(0.5)) for n in names})  # keeps decimal ties out of the rounding
    return r(r(scaled, "x", "y", "z", digits=10), *names)


@query(f"{P}, k AS (SELECT *, {vox(4.0)} AS voxel FROM p), m AS (SELECT *, row_number() OVER (PARTITION BY voxel ORDER BY {ORDER_SQL}) AS rk FROM k) SELECT {IDS}, voxel FROM m WHERE rk <= 3")
def voxel_cap(spark, sf):
    return ids(aggregates.voxel_cap(points(spark, sf), 4.0, 3, ORDER), "voxel")


@query(f"{P} SELECT CAST(floor(x / 2) AS BIGINT) AS cx, CAST(floor(y / 2) AS BIGINT) AS cy, count(*) AS n, round((floor(x / 2) + 0.5) * 2, 10) + 0.0 AS x, round((floor(y / 2) + 0.5) * 2, 10) + 0.0 AS y, round(avg(z), 10) + 0.0 AS z, round(avg(intensity), 10) + 0.0 AS intensity FROM p WHERE is_ground = 1 GROUP BY cx, cy, floor(x / 2), floor(y / 2)")
def voxelize_xy_z(spark, sf):
    return r(aggregates.voxel_columns(points(spark, sf).where("is_ground = 1"), 2.0), "x", "y", "z", "intensity", digits=10)


@query(f"{P}, v AS (SELECT {vox(2.0)} AS voxel, frame_id, count(*) AS n FROM p GROUP BY 1, 2) SELECT voxel, frame_id, n, CAST((row_number() OVER (PARTITION BY frame_id ORDER BY voxel) - 1) % 5 AS INT) AS slot FROM v")
def frame_round_robin(spark, sf):
    cells = points(spark, sf).groupBy(packed_cell("x", "y", "z", 2.0).alias("voxel"), "frame_id").agg(F.count("*").alias("n"))
    return aggregates.share_out(cells, 5, ("voxel",), ("frame_id",))


@query(f"{P} SELECT frame_id, round(avg(x), 10) + 0.0 AS mx, round(avg(y), 10) + 0.0 AS my, round(avg(z), 10) + 0.0 AS mz FROM p GROUP BY 1")
def centroid(spark, sf):
    return r(aggregates.centroid(points(spark, sf), "frame_id"), "mx", "my", "mz", digits=10)


@query(f"{P}, s AS (SELECT frame_id, sum(x) AS ax, sum(y) AS ay, sum(z) + 9.81 * count(*) AS az FROM p GROUP BY 1), m AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS m FROM s) SELECT frame_id, round(ax / m, 6) + 0.0 AS ax, round(ay / m, 6) + 0.0 AS ay, round(az / m, 6) + 0.0 AS az FROM m")
def gravity_direction(spark, sf):
    acc = points(spark, sf).select("frame_id", F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("z") + 9.81).alias("az"))
    return r(aggregates.gravity(acc, "frame_id"), "ax", "ay", "az")


_IDX = "q AS (SELECT submap_id, intensity + z AS v FROM p), s AS (SELECT *, row_number() OVER (PARTITION BY submap_id ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY submap_id) AS n FROM q)"


@query(f"{P}, {_IDX} SELECT submap_id, max(n) AS n, round(min(v) FILTER (k = floor(0.02 * n)), 6) + 0.0 AS p2, round(min(v) FILTER (k = floor(0.95 * n)), 6) + 0.0 AS p95, round(min(v) FILTER (k = floor(0.99 * n)), 6) + 0.0 AS p99 FROM s GROUP BY 1")
def idx_percentiles(spark, sf):
    """Positions int(p * n) of the sorted values."""
    v = points(spark, sf).select("submap_id", (F.col("intensity") + F.col("z")).alias("v"))
    f = aggregates.rank_floor
    return r(aggregates.percentile_at(v, "v", ("submap_id",), p2=f(0.02), p95=f(0.95), p99=f(0.99)), "p2", "p95", "p99")


@query(f"{P}, {_IDX}, g AS (SELECT submap_id, min(v) FILTER (k = floor(0.01 * (n - 1))) AS lo, min(v) FILTER (k = floor(0.99 * (n - 1))) AS hi FROM s GROUP BY 1) SELECT round(min(lo), 6) + 0.0 AS lo, round(max(hi), 6) + 0.0 AS hi FROM g")
def percentile_range(spark, sf):
    """Per submap int(p * (n - 1)), then widened over submaps."""
    v = points(spark, sf).select("submap_id", (F.col("intensity") + F.col("z")).alias("v"))
    per = aggregates.percentile_at(v, "v", ("submap_id",), lo=aggregates.rank_inner(0.01), hi=aggregates.rank_inner(0.99))
    return r(per.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "lo", "hi")


@query(
    f"""{P}, o AS (SELECT frame_id, z, row_number() OVER (PARTITION BY frame_id ORDER BY {ORDER_SQL}) - 1 AS k0, count(*) OVER (PARTITION BY frame_id) AS n0 FROM p),
    d AS (SELECT frame_id, z FROM o WHERE k0 % greatest(1, CAST(floor(n0 / 200) AS BIGINT)) = 0),
    s AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY z) - 1 AS k, count(*) OVER (PARTITION BY frame_id) AS n FROM d)
    SELECT frame_id, max(n) AS n, round(min(z) FILTER (k = floor(n / 100)), 6) + 0.0 AS low, round(min(z) FILTER (k = floor(n * 99 / 100)), 6) + 0.0 AS high FROM s GROUP BY 1"""
)
def strided_percentiles(spark, sf):
    return r(aggregates.strided_percentiles(points(spark, sf), "z", ORDER, 200, ("frame_id",)), "low", "high")


@query(f"{P}, s AS (SELECT frame_id, ep AS v, row_number() OVER (PARTITION BY frame_id ORDER BY ep) - 1 AS k, count(*) OVER (PARTITION BY frame_id) AS n FROM p) SELECT frame_id, max(n) AS n, min(v) FILTER (k = CAST(floor(n / 2) AS BIGINT)) AS median FROM s GROUP BY 1")
def upper_median(spark, sf):
    return aggregates.upper_median(points(spark, sf), "ep", "frame_id")


@query(f"{P} SELECT CAST(count_if(intensity / 80 >= 0.8) AS BIGINT) AS high, CAST(count_if(intensity / 80 >= 0.5 AND intensity / 80 < 0.8) AS BIGINT) AS middle, CAST(count_if(intensity / 80 < 0.5) AS BIGINT) AS low FROM p")
def score_hist(spark, sf):
    return aggregates.score_bands(points(spark, sf).withColumn("score", F.col("intensity") / 80))


@query(f"{P} SELECT submap_id, CAST(count(*) * 32 + CASE WHEN bool_or(CASE WHEN ln = 7 AND submap_id > 1 THEN intensity END IS NOT NULL) THEN count(*) * 8 ELSE 0 END AS BIGINT) AS bytes FROM p GROUP BY 1")
def submap_memory(spark, sf):
    p = points(spark, sf).withColumn("extra", F.when((F.col("ln") == 7) & (F.col("submap_id") > 1), F.col("intensity")))
    return aggregates.memory(p, {"x": 32, "extra": 8}, "submap_id")


@query(f"{P}, s AS (SELECT frame_id, sqrt{_D2} AS v, row_number() OVER (PARTITION BY frame_id ORDER BY sqrt{_D2}) - 1 AS k, count(*) OVER (PARTITION BY frame_id) AS n FROM p), m AS (SELECT frame_id, min(v) FILTER (k = CAST(floor(n / 2) AS BIGINT)) AS median FROM s GROUP BY 1) SELECT frame_id, round(median, 6) + 0.0 AS median, round(0.5 + greatest(0, least(1, (median - 10) / 30)) * 0.5, 6) + 0.0 AS resolution FROM m")
def adaptive_resolution(spark, sf):
    return r(aggregates.adaptive_resolution(points(spark, sf), 0.5, 1.0, 10.0, 40.0, ("frame_id",)), "median", "resolution")


@query(f"{P} SELECT submap_id, count(*) AS n, round(avg(z), 6) + 0.0 AS mean, round(coalesce(stddev_samp(z), 0), 6) + 0.0 AS sd, round(min(z), 6) + 0.0 AS least, round(max(z), 6) + 0.0 AS most FROM p GROUP BY 1")
def running_statistics(spark, sf):
    return r(aggregates.statistics(points(spark, sf), "z", "submap_id"), "mean", "sd", "least", "most")


@query(f"{P}, m AS (SELECT min(x) AS base, max(x) AS top FROM p WHERE isfinite(x)) SELECT {IDS}, round((x - base) / (top - base), 6) + 0.0 AS level FROM p, m")
def attribute_rebase(spark, sf):
    """An attribute relative to its finite minimum over everything, scaled by the range (a one-row table)."""
    p = points(spark, sf)
    span = p.where(filters.finite("x")).agg(F.min("x").alias("base"), F.max("x").alias("top"))
    return r(ids(p.crossJoin(F.broadcast(span)), ((F.col("x") - F.col("base")) / (F.col("top") - F.col("base"))).alias("level")), "level")


@query(f"{P}, m AS (SELECT *, min(z) OVER (PARTITION BY floor(x / 3), floor(y / 3)) AS lo FROM p) SELECT {IDS}, CASE WHEN is_ground = 1 AND z <= lo + 1.5 THEN 1 ELSE 0 END AS is_ground FROM m")
def zcolumn_refine(spark, sf):
    return ids(windows.lowest_in_column(points(spark, sf), 3.0, 1.5), "is_ground")


@query(f"{P} SELECT {IDS}, round(0.1::DOUBLE * (row_number() OVER (PARTITION BY frame_id ORDER BY {ORDER_SQL}) - 1) / count(*) OVER (PARTITION BY frame_id), 12) + 0.0 AS t FROM p")
def pseudo_time(spark, sf):
    return r(ids(windows.pseudo_times(points(spark, sf), ("frame_id",), ORDER, 0.1), "t"), "t", digits=12)


@query(
    f"""{P}, a AS (SELECT *, CASE frame_id % 3 WHEN 0 THEN t - 0.02 WHEN 1 THEN 1000 + t ELSE 2e16 + ln * 1e7 END AS raw FROM p), m AS (SELECT *, min(raw) OVER (PARTITION BY frame_id) AS lo, max(raw) OVER (PARTITION BY frame_id) AS hi FROM a)
    SELECT {IDS}, round((raw - CASE WHEN hi >= 1 OR lo < 0 THEN lo ELSE 0 END) * CASE WHEN hi >= 1 AND lo > 1e16 THEN 1e-9 ELSE 1 END, 6) + 0.0 AS t_rel FROM m"""
)
def time_normalise(spark, sf):
    kind = F.col("frame_id") % 3
    raw = F.when(kind == 0, F.col("t") - 0.02).when(kind == 1, F.col("t") + 1000).otherwise(F.lit(2e16) + F.col("ln") * F.lit(1e7))
    return r(ids(windows.normalise_times(points(spark, sf).withColumn("raw", raw), ("frame_id",), "raw"), "t_rel"), "t_rel")


@query(
    f"""{P}, q AS (SELECT *, CAST(floor(degrees(atan2(y, x)) / 45) AS BIGINT) AS sector, CAST(floor(sqrt(x * x + y * y) / 10) AS BIGINT) AS zone FROM p),
    k AS (SELECT *, row_number() OVER (PARTITION BY frame_id, sector, zone ORDER BY z, {ORDER_SQL}) AS rk FROM q)
    SELECT frame_id, sector, zone, round(avg(z) FILTER (rk <= 5), 10) + 0.0 AS seed, count(*) AS n FROM k GROUP BY 1, 2, 3"""
)
def ground_seeds(spark, sf):
    """Lowest-point representative heights of polar patches."""
    from cartoflow.operators.numeric import ground_patches, seed_heights

    return r(seed_heights(ground_patches(points(spark, sf), 10.0, 45.0), ("frame_id", "sector", "zone"), ORDER, 5), "seed", digits=10)


_GEO = with_sql("gnss")


def _geo(spark, sf):
    return carrier(spark, sf, "gnss")


@query(f"{_GEO} SELECT id, status, greatest(0.005, sigma) AS sigma FROM g WHERE status >= 1 AND sigma <= 20 AND sigma >= 0 UNION ALL SELECT id, status, sigma FROM g WHERE status >= 1 AND sigma < 0")
def gnss_gate(spark, sf):
    return filters.satellite_gate(_geo(spark, sf)).select("id", "status", "sigma")


@query(f"{_GEO} SELECT id, utm_zone, round(m_east, 4) + 0.0 AS m_east, round(m_north, 4) + 0.0 AS m_north FROM (SELECT *, {geodesy.sql(geodesy.utm())} FROM g)")
def utm_forward(spark, sf):
    return r(geodesy.apply(_geo(spark, sf).select("id", "lat", "lon"), geodesy.utm(), ["utm_zone", "m_east", "m_north"]).drop("lat", "lon"), "m_east", "m_north", digits=4)


@query(f"{_GEO} SELECT id, round(lat, 6) + 0.0 AS u_lat, round(lon, 6) + 0.0 AS u_lon FROM g")
def utm_roundtrip(spark, sf):
    """The oracle is the identity."""
    there = geodesy.apply(_geo(spark, sf).select("id", "lat", "lon"), geodesy.utm(), ["utm_zone", "m_east", "m_north"])
    return r(geodesy.apply(there, geodesy.utm_inverse(), ["u_lat", "u_lon"]).select("id", "u_lat", "u_lon"), "u_lat", "u_lon")


@query(f"{_GEO} SELECT id, round(lat, 6) + 0.0 AS g_lat, round(lon, 6) + 0.0 AS g_lon, round(alt, 3) + 0.0 AS g_alt FROM g")
def ecef_roundtrip(spark, sf):
    there = geodesy.apply(_geo(spark, sf).select("id", "lat", "lon", "alt"), geodesy.wgs84_to_ecef(), ["ecef_x", "ecef_y", "ecef_z"])
    back = geodesy.apply(there, geodesy.ecef_to_wgs84(), ["g_lat", "g_lon", "g_alt"]).select("id", "g_lat", "g_lon", "g_alt")
    return r(r(back, "g_lat", "g_lon"), "g_alt", digits=3)


@query(f"{_GEO} SELECT id, round(ecef_x, 4) + 0.0 AS ecef_x, round(ecef_y, 4) + 0.0 AS ecef_y, round(ecef_z, 4) + 0.0 AS ecef_z FROM (SELECT *, {geodesy.sql(geodesy.wgs84_to_ecef())} FROM g)")
def ecef_forward(spark, sf):
    there = geodesy.apply(_geo(spark, sf).select("id", "lat", "lon", "alt"), geodesy.wgs84_to_ecef(), ["ecef_x", "ecef_y", "ecef_z"])
    return r(there.drop("lat", "lon", "alt"), "ecef_x", "ecef_y", "ecef_z", digits=4)


@query(f"{_GEO} SELECT id, {rs('nx', 'ny', 'nz', 'wx', 'wy', 'wz')} FROM (SELECT *, {geodesy.sql(geodesy.wgs84_to_ecef() + geodesy.north_west_up())} FROM g)")
def local_frame(spark, sf):
    chain = geodesy.wgs84_to_ecef() + geodesy.north_west_up()
    axes = ["nx", "ny", "nz", "wx", "wy", "wz"]
    return r(geodesy.apply(_geo(spark, sf).select("id", "lat", "lon", "alt"), chain, axes).drop("lat", "lon", "alt"), *axes)


@query(f"{_GEO} SELECT id, round(2 * 6378137 * asin(sqrt(pow(sin((radians(lat) - radians(40)) / 2), 2) + cos(radians(40)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(-3)) / 2), 2))), 3) + 0.0 AS d FROM g")
def great_circle(spark, sf):
    d = geodesy.great_circle("radians(CAST(40 AS DOUBLE))", "radians(CAST(-3 AS DOUBLE))", "radians(lat)", "radians(lon)")
    return r(_geo(spark, sf).selectExpr("id", f"{d} AS d"), "d", digits=3)


@query(f"{_GEO} SELECT id, round(j_east, 4) + 0.0 AS j_east, round(j_north, 4) + 0.0 AS j_north FROM (SELECT id, lat - 2 AS la, lon + 142 AS lo, {geodesy.sql(geodesy.plane_rectangular('(lat - 2)', '(lon + 142)'))} FROM g)")
def tm_jgd(spark, sf):
    shifted = _geo(spark, sf).selectExpr("id", "lat - 2 AS lat", "lon + 142 AS lon")
    return r(geodesy.apply(shifted, geodesy.plane_rectangular(), ["j_east", "j_north"]).drop("lat", "lon"), "j_east", "j_north", digits=4)


@query(f"{_GEO} SELECT id, {geodesy.tile_pnoa('m_east', 'm_north')} AS pnoa, {geodesy.tile_icgc('m_east', 'm_north')} AS icgc FROM (SELECT *, {geodesy.sql(geodesy.utm())} FROM g)")
def tile_names(spark, sf):
    there = geodesy.apply(_geo(spark, sf).select("id", "lat", "lon"), geodesy.utm(), ["m_east", "m_north"])
    return there.selectExpr("id", f"{geodesy.tile_pnoa('m_east', 'm_north')} AS pnoa", f"{geodesy.tile_icgc('m_east', 'm_north')} AS icgc")


@query(f"{P} SELECT {IDS}, tile FROM (SELECT *, {geodesy.sql(geodesy.tile_japan('(x * 900)', '(y * 1200)'))} FROM p)")
def tile_japan(spark, sf):
    chain = geodesy.tile_japan("(x * 900)", "(y * 1200)")
    return ids(geodesy.apply(points(spark, sf), chain, ["tile"]), "tile")


@query("SELECT n_nationkey AS id, ln AS zone, CAST(floor((ln * 15.0 - 180 + 180) / 6) AS INT) % 60 + 1 AS utm_zone FROM nation, (SELECT unnest(range(0, 25)) AS ln) z")
def utm_zones(spark, sf):
    """Zone numbers around the globe, the antimeridian included."""
    lons = table(spark, sf, "nation").withColumn("zone", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long")))).withColumn("lon", F.col("zone") * F.lit(15.0) - 180)
    return lons.selectExpr("n_nationkey AS id", "zone", f"{geodesy.utm_zone()} AS utm_zone")


