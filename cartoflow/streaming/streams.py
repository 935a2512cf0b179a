"""Structured Streaming forms of the live operators, and batch-driven runs of them.

Every stream is a file source read with a rate limit (``maxFilesPerTrigger``); ``availableNow``
is the end-of-sequence flush, a processing-time trigger the idle re-optimisation.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoflow.runtime import ship


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """A backpressured file stream: at most so many files a batch; progress metrics tell the backlog."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(path)


def work_folder(spark: SparkSession) -> str:
    """A new folder that all executors share; a temporary one only where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="cartoflow-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything there is, and return what it wrote."""
    spark = stream.sparkSession
    folder = work_folder(spark)
    if mode == "append":
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    target = f"{folder}/out"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def dropped_late(stream: DataFrame, stamp: str, delay: str, key: str) -> DataFrame:
    """Out-of-order rows within the delay are kept once; later ones are dropped by the watermark."""
    return stream.withWatermark(stamp, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, stamp: str, delay: str, width: str, key: str) -> DataFrame:
    return stream.withWatermark(stamp, delay).groupBy(F.window(stamp, width), key).agg(F.count("*").alias("n"), F.max("value").alias("most")).select(F.col("window.start").alias("start"), key, "n", "most")


def sessions(stream: DataFrame, stamp: str, delay: str, gap: str, key: str) -> DataFrame:
    return stream.withWatermark(stamp, delay).groupBy(F.session_window(stamp, gap).alias("s"), key).agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), key, "n")


def gate(frames: DataFrame, imu: DataFrame, stamp: str, delay: str, lookahead: str) -> DataFrame:
    """Frames that inertial data has passed: held until a sample of the same stream within the lookahead after the frame.

    A stream-stream interval join; both watermarks bound its state, and a frame is given out
    once per bracketing sample batch (take the first by frame id).
    """
    f = frames.withWatermark(stamp, delay).alias("f")
    i = imu.withWatermark(stamp, delay).select(F.col("user_id").alias("i_user"), F.col(stamp).alias("i_ts"), F.col("event_id").alias("i_id")).alias("i")
    on = F.expr(f"f.user_id = i.i_user AND i.i_ts >= f.{stamp} AND i.i_ts <= f.{stamp} + INTERVAL {lookahead}")
    return f.join(i, on).select("f.event_id", "f.user_id", "i_id")


def counted_windows(stream: DataFrame, key: str, order: str, size: int, schema: str) -> DataFrame:
    """A submap every ``size`` rows of a key: count-triggered windows in arrival order."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ship(stream.sparkSession)

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, held, total = state.get if state.exists else (0, 0, 0.0)
        out = []
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        for value in rows["value"]:
            held, total = held + 1, total + float(value)
            if held == size:
                out.append((k[0], done, held, total))
                done, held, total = done + 1, 0, 0.0
        state.update((done, held, total))
        yield pd.DataFrame(out, columns=["key", "submap", "n", "total"])

    return stream.groupBy(key).applyInPandasWithState(step, schema, "done int, held int, total double", "append", GroupStateTimeout.NoTimeout)


def fixed_lag(stream: DataFrame, key: str, order: str, lag: float, schema: str) -> DataFrame:
    """How many rows a fixed-lag smoother holds at each arrival: rows older than the lag leave the state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ship(stream.sparkSession)

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        for at in pd.concat(list(batches)).sort_values(order, kind="stable")[order]:
            held = [h for h in held if at - h <= lag]
            out.append((k[0], int(at), len(held)))
            held.append(float(at))
        state.update((held,))
        yield pd.DataFrame(out, columns=["key", "id", "held"])

    return stream.groupBy(key).applyInPandasWithState(step, schema, "held array<double>", "append", GroupStateTimeout.NoTimeout)


def silent(stream: DataFrame, stamp: str, delay: str, gap: str, key: str) -> DataFrame:
    """Liveness: sessions of a key end after ``gap`` without data; each end is an alarm."""
    return sessions(stream, stamp, delay, gap, key)


def replay_folder(df: DataFrame, files: int, order: str) -> str:
    """Rows as a folder of files written one after the other, to play back as a stream in order."""
    spark = df.sparkSession
    folder = work_folder(spark)
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    part = F.least(F.lit(files - 1), F.floor((F.col(order) - lo) * files / (hi - lo + 1)))
    for k in range(files):
        df.where(part == k).coalesce(1).sortWithinPartitions(order).write.mode("append").parquet(folder)
    return folder
