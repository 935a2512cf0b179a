"""Row filters over points, boxes, satellite fixes and matches.  All are single expressions that reach the scan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoflow.functions import pose as se3


def finite(*names: str) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < F.lit(float("inf")))
    return ok


def d2(x="x", y="y", z="z", cx=0.0, cy=0.0, cz=0.0) -> Column:
    dx, dy, dz = F.col(x) - cx, F.col(y) - cy, F.col(z) - cz
    return dx * dx + dy * dy + dz * dz


def distance_band(points: DataFrame, near: float = 1.0, far: float = 100.0) -> DataFrame:
    """Strictly between the two radii, and finite."""
    return points.where(finite("x", "y", "z") & (d2() > near * near) & (d2() < far * far))


def crop_box(points: DataFrame, low, high, sensor: se3.Pose | None = None) -> DataFrame:
    """Drops what is inside the box, bounds included; with ``sensor`` the box is in that frame."""
    if any(a > b for a, b in zip(low, high, strict=True)):
        raise ValueError("the crop box is empty: a lower bound exceeds its upper bound")
    at = (F.col("x"), F.col("y"), F.col("z")) if sensor is None else se3.transform(sensor, F.col("x"), F.col("y"), F.col("z"))
    inside = F.lit(True)
    for v, a, b in zip(at, low, high, strict=True):
        inside = inside & v.between(float(a), float(b))
    return points.where(~inside)


def min_range(points: DataFrame, least: float = 1.5) -> DataFrame:
    return points.where(F.sqrt(d2()) >= least)


def repair_rows(points: DataFrame, covariance: str | None = None) -> DataFrame:
    """Drops non-finite rows; the homogeneous weight is one; an implausible covariance becomes null."""
    out = points.where(finite("x", "y", "z")).withColumn("w", F.lit(1.0))
    if covariance:
        c = F.col(covariance)
        symmetric = (F.abs(c[1] - c[3]) < 1e-9) & (F.abs(c[2] - c[6]) < 1e-9) & (F.abs(c[5] - c[7]) < 1e-9)
        trace = c[0] + c[4] + c[8]
        out = out.withColumn(covariance, F.when(symmetric & (trace > 3e-6) & (trace < 3e6), c))
    return out


def oriented_box(points: DataFrame, centre, forward_xy, half_size: float, half_height: float) -> DataFrame:
    """Inside a box whose first horizontal axis is ``forward_xy``; bounds included."""
    norm = math.hypot(*forward_xy)
    fx, fy = forward_xy[0] / norm, forward_xy[1] / norm
    dx, dy, dz = F.col("x") - centre[0], F.col("y") - centre[1], F.col("z") - centre[2]
    along, across = dx * fx + dy * fy, dy * fx - dx * fy
    return points.where((F.abs(along) <= half_size) & (F.abs(across) <= half_size) & (F.abs(dz) <= half_height))


def gizmo(points: DataFrame, world_to_local: se3.Pose, scale, shape: str = "cube") -> DataFrame:
    """Strictly inside the unit cube (half side 1) or the unit sphere of a scaled local frame."""
    x, y, z = (v / float(s) for v, s in zip(se3.transform(world_to_local, F.col("x"), F.col("y"), F.col("z")), scale, strict=True))
    if shape == "sphere":
        return points.where(x * x + y * y + z * z < 1)
    return points.where((F.abs(x) < 1) & (F.abs(y) < 1) & (F.abs(z) < 1))


def in_radius(points: DataFrame, centre, radius: float, cell: float | None = None) -> DataFrame:
    """Strictly within ``radius``; the axis windows come first, so they can prune files."""
    box = F.lit(True)
    for n, c in zip("xyz", centre, strict=True):
        box = box & F.col(n).between(c - radius, c + radius)
    return points.where(box & (d2(cx=centre[0], cy=centre[1], cz=centre[2]) < radius * radius))


def box_meets_cylinder(boxes: DataFrame, centre, radius: float, half_height: float) -> DataFrame:
    """Boxes (lo_x .. hi_z) that reach into a vertical cylinder."""
    dx = F.greatest(F.col("lo_x") - centre[0], F.lit(0.0), F.lit(centre[0]) - F.col("hi_x"))
    dy = F.greatest(F.col("lo_y") - centre[1], F.lit(0.0), F.lit(centre[1]) - F.col("hi_y"))
    return boxes.where((dx * dx + dy * dy <= radius * radius) & (F.col("hi_z") >= centre[2] - half_height) & (F.col("lo_z") <= centre[2] + half_height))


def in_cylinder(points: DataFrame, centre, radius: float, half_height: float) -> DataFrame:
    dx, dy = F.col("x") - centre[0], F.col("y") - centre[1]
    return points.where((dx * dx + dy * dy <= radius * radius) & (F.abs(F.col("z") - centre[2]) <= half_height))


def frustum_planes(view_projection) -> list[tuple[float, ...]]:
    """The six clip planes of a 4 x 4 matrix given as four rows."""
    m = view_projection
    return [tuple(m[3][k] + s * m[i][k] for k in range(4)) for i in range(3) for s in (1.0, -1.0)]


def in_frustum(boxes: DataFrame, planes) -> DataFrame:
    """Boxes not entirely behind any plane (judged by the corner farthest along the plane's normal)."""
    keep = F.lit(True)
    for a, b, c, w in planes:
        corner = [F.col(("hi_" if v >= 0 else "lo_") + n) * v for v, n in ((a, "x"), (b, "y"), (c, "z"))]
        keep = keep & (corner[0] + corner[1] + corner[2] + w >= 0)
    return boxes.where(keep)


def rotated_tile(points: DataFrame, centre_xy, yaw: float, half_x: float, half_y: float) -> DataFrame:
    c, s = math.cos(yaw), math.sin(yaw)
    dx, dy = F.col("x") - centre_xy[0], F.col("y") - centre_xy[1]
    return points.where((F.abs(dx * c + dy * s) <= half_x) & (F.abs(dy * c - dx * s) <= half_y))


def satellite_gate(fixes: DataFrame, least_status: int = 1, worst_sigma: float = 20.0, floor: float = 0.005) -> DataFrame:
    """Fixes of a sufficient status and a plausible, known sigma; tiny sigmas are raised to the floor."""
    ok = (F.col("status") >= 0) & (F.col("status") >= least_status) & ~F.isnan("sigma") & (F.col("sigma") <= worst_sigma)
    return fixes.where(ok).withColumn("sigma", F.when(F.col("sigma") < 0, F.col("sigma")).otherwise(F.greatest(F.col("sigma"), F.lit(floor))))


def camera_cull(cameras: DataFrame, centroid: DataFrame, max_range: float) -> DataFrame:
    """Located cameras no farther than three times the range from the cloud's centroid (a one-row table)."""
    joined = cameras.where("located").crossJoin(F.broadcast(centroid))
    far = (F.col("cx") - F.col("mx")) ** 2 + (F.col("cy") - F.col("my")) ** 2 + (F.col("cz") - F.col("mz")) ** 2
    return joined.where(far <= 9.0 * max_range * max_range).drop("mx", "my", "mz")


def noise_gate(points: DataFrame, sensor_height: float, vertical_angle_deg: float, intensity_limit: float) -> DataFrame:
    """Drops likely reflections: steeply below the sensor, lower than the ground, and faint."""
    ground = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)
    steep = F.degrees(F.atan2(F.col("z"), ground)) < vertical_angle_deg
    return points.where(~(steep & (F.col("z") < -sensor_height - 0.8) & (F.col("intensity") < intensity_limit)))


def facing(frames: DataFrame, anchor_forward, most_degrees: float, centre, most_range: float) -> DataFrame:
    """Frames whose forward axis is within an angle of the anchor's, and whose position is in range."""
    fx, fy, fz = anchor_forward
    cosine = F.col("fx") * fx + F.col("fy") * fy + F.col("fz") * fz
    return frames.where((cosine >= math.cos(math.radians(most_degrees))) & (d2(cx=centre[0], cy=centre[1], cz=centre[2]) <= most_range * most_range))


def range_filter(points: DataFrame, size: float, safe: float, near_delta: float, far_delta: float, ground_only: bool = False) -> DataFrame:
    """Per cell, far returns go where the cell also holds much nearer ones.

    A cell with returns within ``safe`` keeps those not farther than the nearest plus
    ``near_delta``; any other cell uses ``far_delta``.
    """
    ranged = points.withColumn("range", F.sqrt(d2()))
    cells = [F.floor(F.col(c) / size).alias(f"cell_{c}") for c in "xyz"]
    keyed = ranged.select("*", *cells)
    keys = ["cell_x", "cell_y", "cell_z"]
    stats = keyed.groupBy(*keys).agg(F.min("range").alias("nearest"))
    delta = F.when(F.col("nearest") <= safe, near_delta).otherwise(far_delta)
    kept = (F.col("range") <= safe) | (F.col("range") <= F.col("nearest") + delta)
    if ground_only:
        kept = kept | (F.col("is_ground") == 0)
    return keyed.join(stats, keys).where(kept).drop(*keys, "nearest")


def hide(points: DataFrame, column: str, below: float | None = None, above: float | None = None) -> DataFrame:
    ok = F.lit(True)
    if below is not None:
        ok = ok & (F.col(column) >= below)
    if above is not None:
        ok = ok & (F.col(column) <= above)
    return points.where(ok)


def pose_edges(factors: DataFrame) -> DataFrame:
    """Two-key factors between poses, as (i, j)."""
    return factors.where("k1_chr = 'x' and k2_chr = 'x'").select("factor_id", F.col("k1_idx").alias("i"), F.col("k2_idx").alias("j"))
