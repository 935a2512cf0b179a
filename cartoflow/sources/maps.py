"""Saving and loading maps, submaps, HD frames and exports as tables."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoflow.functions import pose as se3
from cartoflow.operators import filters, projections, sets
from cartoflow.runtime import ship


def save_submaps(points: DataFrame, submaps: DataFrame, path: str) -> None:
    points.write.mode("overwrite").partitionBy("session_id", "submap_id").parquet(f"{path}/points")
    submaps.write.mode("overwrite").parquet(f"{path}/submaps")


def load_submaps(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Points with non-finite rows dropped (all rows are checked), and submaps with session 0 where older maps have none."""
    points = filters.repair_rows(spark.read.parquet(f"{path}/points"))
    submaps = spark.read.parquet(f"{path}/submaps")
    if "session_id" not in submaps.columns:
        submaps = submaps.withColumn("session_id", F.lit(0))
    return points, submaps


def save_map(path: str, factors: DataFrame, values: DataFrame, trajectories: dict[str, DataFrame], config: dict, matching: bool = True) -> None:
    """Graph tables, trajectories as text lines, and the configuration; a pose-graph map leaves matching costs out."""
    (factors if matching else sets.without_types(factors, "matching")).write.mode("overwrite").parquet(f"{path}/factors")
    values.write.mode("overwrite").parquet(f"{path}/values")
    for name, lines in trajectories.items():
        lines.select("line").write.mode("overwrite").text(f"{path}/{name}")
    spark = factors.sparkSession
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").write.mode("overwrite").text(f"{path}/config")


def load_map(spark: SparkSession, path: str, id_offset: int = 0, datum: tuple[float, float, float] | None = None, drop: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Factors and values with keys moved past an earlier session's, priors dropped, positions shifted to a common datum."""
    factors, values = spark.read.parquet(f"{path}/factors"), spark.read.parquet(f"{path}/values")
    factors = sets.without_types(factors, *drop).where("k1_chr is not null")
    factors = factors.withColumns({"k1_idx": F.col("k1_idx") + id_offset, "k2_idx": F.col("k2_idx") + id_offset})
    values = projections.rekey(values, "idx", id_offset)
    if datum:
        for k in range(3):
            values = values.withColumn("value", F.when(F.col("chr") == "x", F.transform("value", lambda v, i, k=k: F.when(i == k, v + datum[k]).otherwise(v))).otherwise(F.col("value")))
    return factors, values


def export_points(points: DataFrame, submaps: DataFrame) -> DataFrame:
    """Points of all submaps in the world; intensity only where every submap has it."""
    moved = projections.move(points.join(submaps.select("submap_id", *se3.Pose._fields), "submap_id"), se3.columns()).drop(*se3.Pose._fields)
    having = points.groupBy("submap_id").agg(F.max(F.col("intensity").isNotNull()).alias("has")).agg(F.min("has").alias("__all"))
    return moved.crossJoin(F.broadcast(having)).withColumn("intensity", F.when(F.col("__all"), F.col("intensity"))).drop("__all")


def hd_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frame metadata of every frame directory; a frame without a box gets one of 200 m around its pose."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "frame_meta.json").option("wholetext", "true").text(path)
    schema = "frame_id long, num_points int, stamp double, T_world_lidar array<double>, bbox_min array<double>, bbox_max array<double>"
    got = raw.select(F.from_json("value", schema).alias("m"), F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("dir")).select("dir", "m.*")
    at = [F.get("T_world_lidar", F.lit(4 * i + 3)) for i in range(3)]
    return got.withColumns({"bbox_min": F.coalesce("bbox_min", F.array(*[p - 200.0 for p in at])), "bbox_max": F.coalesce("bbox_max", F.array(*[p + 200.0 for p in at]))})


def hd_summary(frames: DataFrame) -> DataFrame:
    return frames.agg(F.count("*").alias("frames"), F.sum(F.coalesce("num_points", F.lit(0))).alias("points"), F.count_if(F.col("num_points").isNull()).alias("without_meta"))


def read_attributes(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Attribute files `<frame>/<name>.bin` as (dir, name, pt_idx, value...); ``names`` maps a name to a numpy type."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bin").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                folder, _, name = file.rpartition("/")
                name = name.removesuffix(".bin")
                if name in names:
                    values = np.frombuffer(content, names[name]).astype(float)
                    yield pd.DataFrame({"dir": folder, "name": name, "pt_idx": np.arange(len(values), dtype=np.int64), "value": values})

    return files.mapInPandas(run, "dir string, name string, pt_idx long, value double")


def keep_rows(attributes: DataFrame, kept: DataFrame) -> DataFrame:
    """Attributes of kept points only, renumbered in order within each frame and name."""
    from pyspark.sql import Window

    left = attributes.join(kept, ["dir", "pt_idx"], "left_semi")
    w = Window.partitionBy("dir", "name").orderBy("pt_idx")
    return left.withColumn("pt_idx", F.row_number().over(w) - 1)


def write_hd_frames(points: DataFrame, path: str) -> None:
    """Deskewed frames with range, partitioned for pruning by frame."""
    points.withColumn("range", F.sqrt(filters.d2()).cast("float")).write.mode("overwrite").partitionBy("frame_id").parquet(path)


def write_tiles(points: DataFrame, tile, path: str, origin=(0.0, 0.0, 0.0)) -> None:
    """One folder a tile that holds a point."""
    shifted = points.withColumns({n: F.col(n) - o for n, o in zip("xyz", origin, strict=True)})
    shifted.withColumn("tile", tile).write.mode("overwrite").partitionBy("tile").parquet(path)


def ply(points: pd.DataFrame) -> bytes:
    """A binary little-endian PLY of x, y, z and further numeric columns."""
    names = {"float64": "double", "float32": "float", "int32": "int", "int64": "int"}
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(points)}", *[f"property {names[str(points[c].dtype)]} {c}" for c in points.columns], "end_header\n"]
    kinds = np.dtype([(c, {"double": "<f8", "float": "<f4", "int": "<i4"}[names[str(points[c].dtype)]]) for c in points.columns])
    body = np.zeros(len(points), kinds)
    for c in points.columns:
        body[c] = points[c]
    return "\n".join(head).encode() + body.tobytes()


def ply_files(points: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(tile, content) binary PLY per group; groups are tiles, whose sizes the tiling bounds."""
    ship(points.sparkSession)

    def run(pdf):
        return pd.DataFrame({by: [str(pdf[by].iloc[0])], "content": [ply(pdf[columns])]})

    return points.groupBy(by).applyInPandas(run, f"{by} string, content binary")


def colmap_tables(points: DataFrame, cameras: DataFrame, centre, yaw: float, half, margin: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cameras / images / points lines of a photogrammetry export: points inside the rotated box, cameras inside the widened one."""
    inside = projections.export_axes(filters.rotated_tile(points, centre, yaw, *half), yaw)
    near = filters.rotated_tile(cameras, centre, yaw, half[0] + margin, half[1] + margin)
    near = projections.export_axes(near, yaw)
    camera_lines = cameras.sparkSession.createDataFrame([("1 PINHOLE 640 480 320 320 320 240",)], "line string")
    image_lines = near.select(F.format_string("%d %.9f %.9f %.9f %.9f %.6f %.6f %.6f 1 %s", F.col("cam").cast("long"), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), -F.col("x"), -F.col("y"), -F.col("z"), F.concat(F.lit("cam_"), F.col("cam").cast("string"), F.lit(".jpg"))).alias("line"))
    point_lines = inside.select(F.format_string("%.6f %.6f %.6f", "x", "y", "z").alias("line"))
    return camera_lines, image_lines, point_lines


def bundler_lines(cameras: DataFrame, focal: float) -> DataFrame:
    """Camera blocks of a Bundler file (identity rotation rows, negated position), one line of text a camera."""
    return cameras.select(F.format_string(f"{focal:.6f} 0 0\n1 0 0\n0 1 0\n0 0 1\n%.6f %.6f %.6f", -F.col("x"), -F.col("y"), -F.col("z")).alias("line"))


def blocks_exchange(cameras: DataFrame) -> DataFrame:
    """Photo elements of a BlocksExchange document, one a camera; ``blocks_document`` wraps them."""
    name = F.concat(F.lit("cam_"), F.col("cam").cast("string"), F.lit(".jpg"))
    return cameras.select(F.format_string("<Photo><Id>%d</Id><ImagePath>%s</ImagePath><Pose><Center><x>%.6f</x><y>%.6f</y><z>%.6f</z></Center></Pose></Photo>", F.col("cam").cast("long"), name, "x", "y", "z").alias("line"))


def blocks_document(photos: str, width: int, height: int, focal: float) -> str:
    head = f"<ImageDimensions><Width>{width}</Width><Height>{height}</Height></ImageDimensions><FocalLengthPixels>{focal:.6f}</FocalLengthPixels>"
    return f'<?xml version="1.0"?><BlocksExchange version="2.1"><Block><Photogroups><Photogroup>{head}{photos}</Photogroup></Photogroups></Block></BlocksExchange>'


def manifest(stats: dict) -> str:
    return json.dumps(stats, sort_keys=True)
