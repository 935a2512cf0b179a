"""Coordinate transforms and projections as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoflow.functions import pose as se3

_XYZ = ("x", "y", "z")


def move(points: DataFrame, pose: se3.Pose, names=_XYZ) -> DataFrame:
    """Points in the target frame of ``pose`` (literals, or columns joined before)."""
    moved = se3.transform(pose, *[F.col(n) for n in names])
    return points.withColumns(dict(zip(names, moved, strict=True)))


def rotate_covariance(pose: se3.Pose, c: Column) -> Column:
    """R C R^T of a row-major array of nine."""
    axes = [se3.rotate(pose, *[F.lit(float(i == k)) for i in range(3)]) for k in range(3)]
    r = [[axes[col][row] for col in range(3)] for row in range(3)]
    entry = [[sum((r[i][k] * c[3 * k + m] * r[j][m] for k in range(3) for m in range(3)), F.lit(0.0)) for j in range(3)] for i in range(3)]
    return F.array(*[v for row in entry for v in row])


def ranges_and_times(points: DataFrame, scanner_id: int = 1) -> DataFrame:
    return points.withColumns({"range": F.sqrt(sum((F.col(n) * F.col(n) for n in _XYZ), F.lit(0.0))), "gps_time": F.col("stamp") + F.col("t"), "scanner_id": F.lit(scanner_id)})


def frame_world_pose(origin: se3.Pose, origin_to_left: se3.Pose, odom_first: se3.Pose, odom_frame: se3.Pose, lidar_imu: se3.Pose) -> se3.Pose:
    """The optimised sensor pose of a frame inside its submap."""
    start = se3.compose(origin, origin_to_left)
    along = se3.compose(se3.inverse(odom_first), odom_frame)
    return se3.compose(se3.compose(start, along), se3.inverse(lidar_imu))


def corners_box(centre, half, pose: se3.Pose) -> dict[str, Column]:
    """Axis-aligned bounds of an oriented box from its eight corners."""
    corners = [se3.transform(pose, *[F.lit(0.0) + c + s * h for c, s, h in zip(centre, signs, half, strict=True)]) for signs in [(a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]]
    out = {}
    for i, n in enumerate(_XYZ):
        out[f"lo_{n}"] = F.least(*[c[i] for c in corners])
        out[f"hi_{n}"] = F.greatest(*[c[i] for c in corners])
    return out


def spherical_bins(az_bins: int = 720, el_bins: int = 360) -> dict[str, Column]:
    """Azimuth and elevation bins, clamped at the ends."""
    x, y, z = (F.col(n) for n in _XYZ)
    az, el = F.atan2(y, x), F.atan2(z, F.sqrt(x * x + y * y))

    def bins(v, n):
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), (v * n).cast("int")))

    return {"az_bin": bins((az + math.pi) / (2 * math.pi), az_bins), "el_bin": bins((el + math.pi / 2) / math.pi, el_bins)}


class ScanImage:
    """Pixel grid of a spherical range image whose coarser axis is scaled to the finer one."""

    def __init__(self, fov_h=2 * math.pi, fov_v=math.pi, res_h=0.01, res_v=0.02):
        self.fov_h, self.fov_v = min(fov_h, 2 * math.pi), min(fov_v, math.pi)
        self.scale_h, self.scale_v = (1.0, res_h / res_v) if res_h < res_v else (res_v / res_h, 1.0)
        self.spinning = 2 * math.pi - self.fov_h < res_h
        finest = min(res_h, res_v)
        self.width = math.ceil(self.fov_h * self.scale_h / finest)
        self.height = math.ceil(self.fov_v * self.scale_v / finest)

    def pixel(self, x="x", y="y", z="z") -> tuple[Column, Column]:
        """(row, col), truncated towards zero; outside the image where not within its bounds."""
        x, y, z = (F.col(n) if isinstance(n, str) else n for n in (x, y, z))
        az, el = F.atan2(y, x), F.atan2(z, F.sqrt(x * x + y * y))
        return ((el / self.fov_v + 0.5) * self.height).cast("int"), ((az / self.fov_h + 0.5) * self.width).cast("int")

    def inside(self, row: Column, col: Column) -> Column:
        return (col >= 0) & (col < self.width) & (row >= 0) & (row < self.height)


class Lens:
    """A pinhole camera with radial and tangential distortion; depth runs along +x."""

    def __init__(self, fx, fy, cx, cy, width, height, k1=0.0, k2=0.0, p1=0.0, p2=0.0, k3=0.0):
        self.fx, self.fy, self.cx, self.cy, self.width, self.height = fx, fy, cx, cy, width, height
        self.k1, self.k2, self.p1, self.p2, self.k3 = k1, k2, p1, p2, k3

    def project(self, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
        """(u, v) of a point in the camera's frame (not gated by depth)."""
        xn, yn = -y / x, -z / x
        if any((self.k1, self.k2, self.p1, self.p2)):
            r2 = xn * xn + yn * yn
            radial = 1 + self.k1 * r2 + self.k2 * r2 * r2 + self.k3 * r2 * r2 * r2
            xn, yn = xn * radial + 2 * self.p1 * xn * yn + self.p2 * (r2 + 2 * xn * xn), yn * radial + self.p1 * (r2 + 2 * yn * yn) + 2 * self.p2 * xn * yn
        return self.fx * xn + self.cx, self.fy * yn + self.cy


def cube_face_rotation(face: int) -> tuple[tuple[float, ...], ...]:
    """Rotation of the front, right, back, left, up and down faces of a cube map (depth along +x)."""
    if face < 4:
        a = -math.pi / 2 * face
        return (math.cos(a), -math.sin(a), 0.0), (math.sin(a), math.cos(a), 0.0), (0.0, 0.0, 1.0)
    a = -math.pi / 2 if face == 4 else math.pi / 2
    return (math.cos(a), 0.0, math.sin(a)), (0.0, 1.0, 0.0), (-math.sin(a), 0.0, math.cos(a))


def cube_face_lens(size: int) -> Lens:
    return Lens(size / 2, size / 2, size / 2, size / 2, size, size)


def extrinsic(lever, rpy_deg) -> se3.Pose:
    return se3.literal(*lever, *se3.from_rpy(*rpy_deg))


def export_axes(points: DataFrame, yaw: float = 0.0, y_up: bool = False, camera: bool = False) -> DataFrame:
    """World axes of an export: turned by yaw, then Y-up, or x right / y down / z forward."""
    c, s = math.cos(yaw), math.sin(yaw)
    x, y, z = F.col("x") * c + F.col("y") * s, F.col("y") * c - F.col("x") * s, F.col("z")
    if y_up:
        x, y, z = x, z, -y
    if camera:
        x, y, z = -y, -z, x
    return points.withColumns({"x": x, "y": y, "z": z})


def rekey(df: DataFrame, column: str, offset: int) -> DataFrame:
    return df.withColumn(column, F.col(column) + F.lit(offset))


def polyline(frames: DataFrame, hidden: DataFrame) -> DataFrame:
    """Visible frames in submap and frame order."""
    return frames.join(hidden, "session", "left_anti").orderBy("submap_id", "id")


def reanchor(points: DataFrame, anchor: DataFrame, names=_XYZ) -> DataFrame:
    """Odometry coordinates in the world, by the one-row table ``anchor`` (tx .. qw)."""
    joined = points.crossJoin(F.broadcast(anchor))
    return move(joined, se3.columns(), names).drop(*se3.Pose._fields)


def splat(pixels: DataFrame, radius: int = 1) -> DataFrame:
    """Each projected point covers a square of pixels; the nearest depth keeps a pixel."""
    steps = F.array(*[F.lit(k) for k in range(-radius, radius + 1)])
    wide = pixels.withColumn("du", F.explode(steps)).withColumn("dv", F.explode(steps))
    return wide.groupBy((F.col("u") + F.col("du")).alias("u"), (F.col("v") + F.col("dv")).alias("v")).agg(F.min_by("value", F.struct("depth", "value")).alias("value"), F.min("depth").alias("depth"))
