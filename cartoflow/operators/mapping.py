"""Map building blocks composed from the other operators: HD loading, submaps, keyframe policies, segmentation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartoflow.functions import pose as se3
from cartoflow.functions.keys import packed_cell
from cartoflow.operators import aggregates, filters, joins, projections, sets, windows

_XYZ = ("x", "y", "z")


def load_hd(points: DataFrame, frames: DataFrame, least: float = 1.5) -> DataFrame:
    """Points of a submap's frames in the world: near returns dropped before the per-frame transform."""
    near = filters.min_range(points, least)
    return projections.move(near.join(frames.select("frame_id", *se3.Pose._fields), "frame_id"), se3.columns()).drop(*se3.Pose._fields)


def reprojected_box(frames: DataFrame) -> dict[str, F.Column]:
    """World bounds of a sensor-frame box under a new pose, from all eight corners (rotation included)."""
    centre = [(F.col(f"lo_{n}") + F.col(f"hi_{n}")) / 2 for n in _XYZ]
    half = [(F.col(f"hi_{n}") - F.col(f"lo_{n}")) / 2 for n in _XYZ]
    return projections.corners_box(centre, half, se3.columns())


def create_submaps(keyframes: DataFrame, points: DataFrame, size: float, most: int, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Every ``most`` keyframes make a submap; its points are merged into voxels."""
    numbered = keyframes.withColumn("submap", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / most))
    joined = points.join(numbered.select(*by, "frame_id", "submap"), "frame_id")
    voxels = joined.groupBy(*by, "submap", packed_cell(*_XYZ, size).alias("voxel"))
    return voxels.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in _XYZ], F.max("intensity").alias("intensity"))


def sd_from_hd(points: DataFrame, size: float) -> DataFrame:
    """Downsampled points with neighbourhood moments per voxel."""
    return aggregates.voxel_gaussians(points, size, 1)


def keyframes_by_overlap(pdf: pd.DataFrame, most: float) -> pd.DataFrame:
    """Frames whose voxels overlap the last keyframe's by less than ``most``; column ``voxels`` is a list."""
    keep, last = [], None
    for i, cells in enumerate(pdf["voxels"]):
        own = set(cells)
        if last is None or len(own & last) < most * max(len(own), 1):
            keep.append(i)
            last = own
    return pdf.iloc[np.array(keep, int)]


def evicted_keyframe(xyz: np.ndarray, leave: int = 2) -> int:
    """The keyframe to drop from a full window: largest sqrt(distance to newest) times the sum of inverse distances to the others; the newest ``leave`` stay."""
    newest = xyz[-1]
    best, score = 0, -1.0
    for i in range(len(xyz) - leave):
        others = np.delete(np.arange(len(xyz) - 1), i) if i < len(xyz) - 1 else np.arange(len(xyz) - 1)
        inverse = (1 / (np.linalg.norm(xyz[others] - xyz[i], axis=1) + 1e-3)).sum()
        value = float(np.sqrt(np.linalg.norm(xyz[i] - newest)) * inverse)
        if value > score:
            best, score = i, value
    return best


def keyframe_window(pdf: pd.DataFrame, distance: float, most: int) -> pd.DataFrame:
    """Keyframes by displacement with a bounded window: which frame each insertion evicts."""
    held: list[tuple] = []
    out = []
    for row in windows.keyframes(pdf, distance).itertuples():
        held.append((row.id, np.array([row.x, row.y, row.z])))
        gone = None
        if len(held) > most:
            k = evicted_keyframe(np.array([p for _, p in held]))
            gone = held.pop(k)[0]
        out.append((row.id, gone))
    return pd.DataFrame(out, columns=["id", "evicted"])


def outlier_selection(points: DataFrame, centre, radius: float, offset: float, k: int, ids: tuple[str, ...], factor: float) -> DataFrame:
    """Points within a radius whose mean neighbour distance, judged in a wider context, is an outlier."""
    context = filters.in_radius(points, centre, radius + offset)
    mean = joins.kept(joins.neighbourhoods(context, k, ids).select(*ids, "d"))
    limit = mean.agg((F.avg("d") + factor * F.coalesce(F.stddev_samp("d"), F.lit(0.0))).alias("lim"))
    outliers = mean.crossJoin(F.broadcast(limit)).where("d > lim").select(*ids)
    return filters.in_radius(points, centre, radius).join(outliers, list(ids), "left_semi")


def grow_region(points: DataFrame, reach: float, angle_deg: float, ids: str = "id") -> DataFrame:
    """Smooth regions: neighbours with similar normals (nx, ny, nz) are one region; iterated joins to a fixed point."""
    pairs = joins.range_join(points, points, reach)
    cosine = F.abs(sum((F.col(f"n{c}") * F.col(f"r_n{c}") for c in _XYZ), F.lit(0.0)))
    smooth = pairs.where(cosine >= float(np.cos(np.radians(angle_deg))))
    return sets.connected(smooth.select(F.col(ids).alias("i"), F.col("r_" + ids).alias("j")))


def initial_state(samples: pd.DataFrame) -> tuple[np.ndarray, float]:
    """Rotation that turns the mean acceleration to +z, and its magnitude: the naive initial state."""
    mean = samples[["ax", "ay", "az"]].mean().to_numpy()
    size = float(np.linalg.norm(mean))
    z = mean / size
    axis = np.cross(z, [0, 0, 1.0])
    sine, cosine = np.linalg.norm(axis), z[2]
    if sine < 1e-12:
        return np.diag([1.0, 1.0, 1.0]) if cosine > 0 else np.diag([1.0, -1.0, -1.0]), size
    k = axis / sine
    m = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + sine * m + (1 - cosine) * m @ m, size


def plane_radius(points: DataFrame, centre, radii: list[float], least: int) -> DataFrame:
    """Moments of the neighbourhood of a position at growing radii (one row a radius), to pick the largest flat one."""
    d2 = filters.d2(cx=centre[0], cy=centre[1], cz=centre[2])
    wide = points.withColumn("radius", F.explode(F.array(*[F.lit(float(v)) for v in radii]))).where(d2 < F.col("radius") * F.col("radius"))
    pairs = [(a, b) for i, a in enumerate(_XYZ) for b in _XYZ[i:]]
    return wide.groupBy("radius").agg(F.count("*").alias("k"), *[F.avg(c).alias("m" + c) for c in _XYZ], *[F.covar_pop(a, b).alias(f"c_{a}{b}") for a, b in pairs]).where(F.col("k") >= least)


def flat_radius(points: DataFrame, centre, radii: list[float], least: int, flatness: float = 0.05) -> float | None:
    """The largest radius at which the neighbourhood is still a plane (smallest eigenvalue's share below ``flatness``)."""
    from cartoflow.operators.numeric import eigen

    rows = eigen(plane_radius(points, centre, radii, least), ("radius",)).collect()
    flat = [r.radius for r in rows if r.l0 <= flatness * (r.l0 + r.l1 + r.l2)]
    return max(flat, default=None)


def fill_zero_intensity(points: DataFrame, radius: float, ids: tuple[str, ...]) -> DataFrame:
    """Zero returns get the mean intensity of the non-zero ones around them (null where there is none); the others, also those without intensity, stay."""
    zero, other = points.where("intensity = 0"), points.where("intensity <> 0")
    carried = tuple(dict.fromkeys([*ids, *[c for c in points.columns if c not in (*_XYZ, "intensity")]]))
    places = {f"__{n}": F.col(n) for n in _XYZ}
    near = joins.surroundings(zero.withColumns(places), other, radius, (*carried, *places), "intensity")
    filled = near.select(*carried, *[F.col(f"__{n}").alias(n) for n in _XYZ], F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("intensity"))
    lost = zero.where(" or ".join(f"not coalesce(abs({n}) < double('inf'), false)" for n in _XYZ)).withColumn("intensity", F.lit(None).cast("double"))
    rest = points.where("intensity is null or intensity <> 0")
    return sets.union(rest, filled.select(*points.columns), lost)


def trails(cells: DataFrame, size: float, shortest: float, slimmest: float, sparsest: float) -> DataFrame:
    """Clusters (root, x, y, z cell centres) that look like the trail of a moving object: long, slim and dense enough."""
    spans = [(F.max(c) - F.min(c) + size).alias("s" + c) for c in _XYZ]
    made = cells.groupBy("root").agg(F.count("*").alias("cells"), *spans)
    length, breadth = F.greatest("sx", "sy"), F.least("sx", "sy")
    box = F.col("sx") * F.col("sy") * F.col("sz") / (size**3)
    return made.where((length >= shortest) & (length / breadth >= slimmest) & (F.col("cells") / box >= sparsest))


def image_folder(spark, path: str, glob: str = "*.jpg") -> DataFrame:
    """Images of a folder by name with time and position from EXIF."""
    from cartoflow.runtime import ship
    from cartoflow.sources.formats import parse_exif

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            rows = [parse_exif(bytes(c)) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], **{k: [r.get(k) for r in rows] for k in ("time", "subsec", "lat", "lon", "alt")}})

    return files.mapInPandas(run, "path string, time string, subsec string, lat double, lon double, alt double").orderBy("path")
