"""Message and file formats: point-cloud messages, trajectories, NMEA, match lists, EXIF fields, geoid grids."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoflow.runtime import ship

#: numpy types of the message's datatype codes (fixed values of the public message definition).
FIELD_TYPES = {1: "i1", 2: "u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 8: "<f8"}
TIME_FIELDS = ("t", "time", "time_stamp", "timestamp")


def decode_points(data: bytes, point_step: int, fields: list[tuple[str, int, int]], intensity: str = "intensity", ring: str = "ring") -> pd.DataFrame | None:
    """Points of one message; None without x, y, z.  Integer times are nanoseconds."""
    at = {name: (offset, code) for name, offset, code in fields}
    if not {"x", "y", "z"} <= at.keys():
        return None
    n = len(data) // point_step
    raw = np.frombuffer(data[: n * point_step], np.uint8).reshape(n, point_step)

    def column(name):
        offset, code = at[name]
        kind = np.dtype(FIELD_TYPES[code])
        return np.ascontiguousarray(raw[:, offset : offset + kind.itemsize]).view(kind)[:, 0]

    out = {c: column(c).astype(float) for c in "xyz"}
    time = next((f for f in TIME_FIELDS if f in at), None)
    if time:
        values = column(time)
        out["t"] = values / 1e9 if values.dtype.kind in "ui" else values.astype(float)
    if intensity in at:
        out["intensity"] = column(intensity).astype(float)
    if ring in at:
        out["ring"] = column(ring).astype(np.int32)
    if "rgba" in at:
        packed = column("rgba").view(np.uint8).reshape(n, 4) / 255.0
        out |= dict(zip(("r", "g", "b", "a"), packed.T, strict=True))
    return pd.DataFrame(out)


def encode_points(pdf: pd.DataFrame) -> tuple[bytes, int, list[tuple[str, int, int]]]:
    """x, y, z, t, intensity as float32 and clamped colours, as one message."""
    names = [c for c in ("x", "y", "z", "t", "intensity") if c in pdf]
    kinds = [(c, "<f4") for c in names]
    colour = all(c in pdf for c in "rgba")
    if colour:
        kinds.append(("rgba", "u1", 4))
    out = np.zeros(len(pdf), np.dtype(kinds))
    for c in names:
        out[c] = pdf[c]
    if colour:
        out["rgba"] = np.clip(pdf[list("rgba")].to_numpy(float) * 255, 0, 255).astype(np.uint8)
    fields = [(c, 4 * i, 7) for i, c in enumerate(names)] + ([("rgba", 4 * len(names), 6)] if colour else [])
    return out.tobytes(), out.dtype.itemsize, fields


def points_from_messages(messages: DataFrame, point_step: int, fields: list[tuple[str, int, int]]) -> DataFrame:
    """One row a point of (frame_id, stamp, data BINARY) rows."""
    ship(messages.sparkSession)

    def run(batches):
        for batch in batches:
            for frame, stamp, data in zip(batch["frame_id"], batch["stamp"], batch["data"], strict=True):
                got = decode_points(bytes(data), point_step, fields)
                if got is not None:
                    got = got.reindex(columns=["x", "y", "z", "t", "intensity"])
                    got.insert(0, "pt_idx", np.arange(len(got), dtype=np.int32))
                    got.insert(0, "stamp", stamp)
                    got.insert(0, "frame_id", frame)
                    yield got

    return messages.select("frame_id", "stamp", "data").mapInPandas(run, "frame_id long, stamp double, pt_idx int, x double, y double, z double, t double, intensity double")


def messages_from_points(points: DataFrame) -> DataFrame:
    """(frame_id, stamp, data) messages of points grouped by frame."""
    ship(points.sparkSession)

    def run(pdf):
        data, _, _ = encode_points(pdf.sort_values("pt_idx"))
        return pd.DataFrame({"frame_id": [pdf["frame_id"].iloc[0]], "stamp": [float(pdf["stamp"].iloc[0])], "data": [data]})

    return points.groupBy("frame_id").applyInPandas(run, "frame_id long, stamp double, data binary")


#: Layout of the messages that ``messages_from_points`` writes.
POINT_STEP, POINT_FIELDS = 20, [("x", 0, 7), ("y", 4, 7), ("z", 8, 7), ("t", 12, 7), ("intensity", 16, 7)]


def tum_line(stamp, pose) -> Column:
    """`stamp tx ty tz qx qy qz qw` with nine and six decimals."""
    return F.format_string("%.9f " + " ".join(["%.6f"] * 7), F.col(stamp) if isinstance(stamp, str) else stamp, *pose)


def read_tum(lines: DataFrame, column: str = "value") -> DataFrame:
    parts = F.split(F.trim(F.col(column)), r"\s+")
    names = ("stamp", "tx", "ty", "tz", "qx", "qy", "qz", "qw")
    good = lines.where(~F.col(column).startswith("#")).withColumn("__p", parts).where(F.size("__p") == 8)
    return good.select(*[c for c in lines.columns if c != column], *[F.col("__p")[i].cast("double").alias(n) for i, n in enumerate(names)])


def _degrees(text: Column, hemisphere: Column, negative: str) -> Column:
    value = text.try_cast("double")
    whole = F.floor(value / 100)
    degrees = whole + (value - whole * 100) / 60
    return F.when(hemisphere == negative, -degrees).otherwise(degrees)


def parse_rmc(lines: DataFrame, column: str = "value") -> DataFrame:
    """Recommended-minimum sentences with a right checksum: date, time, position, speed, track."""
    text = F.col(column)
    body = F.regexp_extract(text, r"^\$([^*]*)\*", 1)
    given = F.upper(F.regexp_extract(text, r"\*([0-9A-Fa-f]{1,2})", 1))
    codes = F.transform(F.split(body, ""), lambda c: F.ascii(c))
    check = F.aggregate(codes, F.lit(0), lambda a, c: a.bitwiseXOR(c))
    good = lines.where((body != "") & (F.lpad(given, 2, "0") == F.lpad(F.hex(check), 2, "0")) & (F.substring(body, 3, 3) == "RMC"))
    p = F.split(body, ",")
    clock, date = F.get(p, F.lit(1)).try_cast("double").cast("long"), F.get(p, F.lit(9)).try_cast("long")
    return good.select(
        *[c for c in lines.columns if c != column],
        F.get(p, F.lit(2)).alias("status"),
        F.floor(clock / 10000).cast("int").alias("hour"),
        (F.floor(clock / 100) % 100).cast("int").alias("minute"),
        (clock % 100).cast("int").alias("second"),
        _degrees(F.get(p, F.lit(3)), F.get(p, F.lit(4)), "S").alias("lat"),
        _degrees(F.get(p, F.lit(5)), F.get(p, F.lit(6)), "W").alias("lon"),
        F.get(p, F.lit(7)).try_cast("double").alias("knots"),
        F.get(p, F.lit(8)).try_cast("double").alias("track"),
        F.floor(date / 10000).cast("int").alias("day"),
        (F.floor(date / 100) % 100).cast("int").alias("month"),
        (date % 100).cast("int").alias("year"),
    )


def parse_matches(files: DataFrame, column: str = "value", least: float | None = None) -> DataFrame:
    """Match lists from JSON; malformed rows are skipped and a missing score is 1."""
    rows = F.from_json(F.col(column), "struct<matches:array<struct<u_real:double,v_real:double,u_rend:double,v_rend:double,score:double>>>")
    flat = files.select(*[c for c in files.columns if c != column], F.explode(rows["matches"]).alias("m")).select(*[c for c in files.columns if c != column], "m.*")
    flat = flat.where("u_real is not null and v_real is not null and u_rend is not null and v_rend is not null").withColumn("score", F.coalesce("score", F.lit(1.0)))
    return flat if least is None else flat.where(F.col("score") >= least)


def exif_position(deg: Column, minute: Column, second: Column, ref: Column) -> Column:
    value = deg + minute / 60 + second / 3600
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def exif_time(original: Column, subsecond: Column) -> Column:
    """`YYYY:MM:DD HH:MM:SS` in UTC with the digits of the sub-second field, as epoch seconds."""
    whole = F.unix_timestamp(F.try_to_timestamp(original, F.lit("yyyy:MM:dd HH:mm:ss")))
    return whole + F.coalesce(F.concat(F.lit("0."), subsecond).try_cast("double"), F.lit(0.0))


def parse_exif(data: bytes) -> dict:
    """Time and position fields of a JPEG's EXIF block (big or little endian)."""
    out: dict = {}
    start = data.find(b"Exif\x00\x00")
    if start < 0:
        return out
    base = start + 6
    order = "<" if data[base : base + 2] == b"II" else ">"

    def read(fmt, at):
        return struct.unpack_from(order + fmt, data, base + at)

    def values(kind, count, at):
        size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 10: 8}.get(kind, 1) * count
        place = at if size <= 4 else read("I", at)[0]
        if kind == 2:
            return data[base + place : base + place + count].split(b"\x00")[0].decode("ascii", "replace")
        if kind in (5, 10):
            pairs = [read("II" if kind == 5 else "ii", place + 8 * i) for i in range(count)]
            return [a / b if b else 0.0 for a, b in pairs]
        return [read({1: "B", 3: "H", 4: "I"}.get(kind, "B"), place + i * {3: 2, 4: 4}.get(kind, 1))[0] for i in range(count)]

    def directory(at):
        found = {}
        for i in range(read("H", at)[0]):
            entry = at + 2 + 12 * i
            tag, kind, count = read("HHI", entry)
            found[tag] = values(kind, count, entry + 8)
        return found

    top = directory(read("I", 4)[0])
    detail = directory(top[0x8769][0]) if 0x8769 in top else {}
    place = directory(top[0x8825][0]) if 0x8825 in top else {}
    out["time"], out["subsec"] = detail.get(0x9003), detail.get(0x9291)
    for name, tag, negative in (("lat", 2, "S"), ("lon", 4, "W")):
        if tag in place:
            d, m, s = (*place[tag], 0.0, 0.0)[:3]
            out[name] = (d + m / 60 + s / 3600) * (-1 if place.get(tag - 1) == negative else 1)
    if 6 in place:
        out["alt"] = place[6][0] * (-1 if place.get(5, [0])[0] == 1 else 1)
    return out


def read_geoid(lines: DataFrame, table: str) -> DataFrame:
    """(table, lat, lon, n) grid nodes of one text file whose rows run from south to north.

    ``lines`` has (line_no, value); header lines are `key: value` or `key=value`.
    """
    header = {r["k"]: float(r["v"]) for r in lines.select(F.regexp_extract("value", r"^#?\s*(lat_min|lat_max|lon_min|lon_max|lat_step|lon_step)\s*[:=]?\s*(-?[0-9.]+)", 1).alias("k"), F.regexp_extract("value", r"(-?[0-9.]+)\s*$", 1).alias("v")).where("k <> ''").limit(6).collect()}
    body = lines.where(F.col("value").rlike(r"^\s*-?[0-9]+(\.[0-9]+)?(\s+-?[0-9]|\s*$)"))
    first = body.agg(F.min("line_no")).first()[0]
    cells = body.select((F.col("line_no") - first).alias("i"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("j", "n"))
    return cells.select(F.lit(table).alias("table"), (F.lit(header["lat_min"]) + F.col("i") * header["lat_step"]).alias("lat"), (F.lit(header["lon_min"]) + F.col("j") * header["lon_step"]).alias("lon"), F.col("n").cast("double").alias("n"))


def undulation(fixes: DataFrame, grid: DataFrame, lat_min: float, lon_min: float, step: float) -> DataFrame:
    """Bilinear geoid height of each fix: one equi-join on the cell, which holds its corners; none outside the grid.

    Every fix is a row of its own, also of fixes that share an id; a corner without weight may be missing.
    """
    gi, gj = F.floor((F.col("lat") - lat_min) / step), F.floor((F.col("lon") - lon_min) / step)
    nodes = grid.select(F.round((F.col("lat") - lat_min) / step).cast("long").alias("i"), F.round((F.col("lon") - lon_min) / step).cast("long").alias("j"), F.col("n").alias("n00"))
    cells = nodes
    for a, b in ((0, 1), (1, 0), (1, 1)):
        cells = cells.join(nodes.select((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), F.col("n00").alias(f"n{a}{b}")), ["i", "j"], "left")
    u, v = (F.col("lat") - lat_min) / step - F.col("i"), (F.col("lon") - lon_min) / step - F.col("j")
    parts = [((u if a else 1 - u) * (v if b else 1 - v), F.col(f"n{a}{b}")) for a in (0, 1) for b in (0, 1)]
    height = sum((F.when(w == 0, 0.0).otherwise(w * n) for w, n in parts), F.lit(0.0))
    found = fixes.select("id", "lat", "lon", gi.alias("i"), gj.alias("j")).join(cells, ["i", "j"])
    return found.select("id", height.alias("undulation")).where("undulation is not null")


def point_in_polygon(points: DataFrame, edges: DataFrame, name: str = "area") -> DataFrame:
    """Even-odd rule against polygon edges (area, x1, y1, x2, y2), for a bounded set of areas.

    Edges are cut into latitude bands, so that the join is an equi-join on the band.
    """
    band = 1.0
    spans = edges.withColumn("band", F.explode(F.sequence(F.floor(F.least("y1", "y2") / band), F.floor(F.greatest("y1", "y2") / band))))
    keyed = points.withColumn("band", F.floor(F.col("lat") / band))
    crosses = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    left = F.col("lon") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    hit = keyed.join(spans, "band").where(crosses).where(left)
    return hit.groupBy("id", name).agg(F.count("*").alias("c")).where("c % 2 = 1").select("id", name)
