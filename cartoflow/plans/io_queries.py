"""Queries over formats, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartoflow.functions import pose as se3
from cartoflow.operators import sets
from cartoflow.plans.carriers import carrier, table, with_sql
from cartoflow.plans.points_queries import points, r
from cartoflow.plans.registry import query
from cartoflow.sources import formats
from cartoflow.streaming import streams

T, G = with_sql("trajectory"), with_sql("gnss")


@query("SELECT o_orderkey AS id, format('{:.9f} {:.6f} {:.6f} {:.6f} {:.6f} {:.6f} {:.6f} {:.6f}', CAST(o_orderkey AS DOUBLE) / 8, CAST(o_custkey AS DOUBLE) / 4, CAST(o_custkey % 97 AS DOUBLE), 0.5::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE) AS line FROM orders")
def tum_format(spark, sf):
    o = table(spark, sf, "orders")
    pose = se3.Pose(F.col("o_custkey").cast("double") / 4, (F.col("o_custkey") % 97).cast("double"), F.lit(0.5), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return o.select(F.col("o_orderkey").alias("id"), formats.tum_line(F.col("o_orderkey").cast("double") / 8, pose).alias("line"))


@query("SELECT o_orderkey AS id, CAST(o_orderkey AS DOUBLE) / 8 AS stamp, CAST(o_custkey AS DOUBLE) / 4 AS tx, CAST(o_custkey % 97 AS DOUBLE) AS ty, 1.0::DOUBLE AS qw FROM orders")
def tum_roundtrip(spark, sf):
    return formats.read_tum(tum_format(spark, sf), "line").select("id", "stamp", "tx", "ty", "qw")


_RMC = "concat('GPRMC,', lpad(CAST(id % 24 AS STRING), 2, '0'), '3519,A,', lpad(CAST(4800 + id % 60 AS STRING), 4, '0'), '.25,', CASE WHEN id % 2 = 0 THEN 'N' ELSE 'S' END, ',', lpad(CAST(1100 + id % 60 AS STRING), 5, '0'), '.5,', CASE WHEN id % 3 = 0 THEN 'W' ELSE 'E' END, ',022.4,084.4,230394,003.1,W')"


@query(
    f"""{G}, b AS (SELECT id, 48 + (id % 60 + 0.25) / 60 AS la, 11 + (id % 60 + 0.5) / 60 AS lo FROM g WHERE id % 7 <> 0)
    SELECT id, 'A' AS status, CAST(id % 24 AS INT) AS hour, 35 AS minute, 19 AS second, round(CASE WHEN id % 2 = 0 THEN la ELSE -la END, 8) + 0.0 AS lat, round(CASE WHEN id % 3 = 0 THEN -lo ELSE lo END, 8) + 0.0 AS lon, 22.4::DOUBLE AS knots, 84.4::DOUBLE AS track, 23 AS day, 3 AS month, 94 AS year FROM b"""
)
def nmea_parse(spark, sf):
    """Sentences with checksums; every seventh is corrupt and goes."""
    made = carrier(spark, sf, "gnss").selectExpr("id", f"{_RMC} AS body")
    xor = F.aggregate(F.transform(F.split("body", ""), lambda c: F.ascii(c)), F.lit(0), lambda a, c: a.bitwiseXOR(c))
    check = F.when(F.col("id") % 7 == 0, xor.bitwiseXOR(F.lit(1))).otherwise(xor)
    lines = made.select("id", F.concat(F.lit("$"), F.col("body"), F.lit("*"), F.lpad(F.hex(check), 2, "0")).alias("value"))
    return r(formats.parse_rmc(lines), "lat", "lon", digits=8)


@query("SELECT p_partkey AS id, k AS u_real, CAST(p_size AS DOUBLE) AS v_real, k + 1 AS u_rend, 2.0::DOUBLE AS v_rend, CASE WHEN k = 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM part, (SELECT unnest([1.0::DOUBLE, 2.0::DOUBLE]) AS k) q")
def match_json(spark, sf):
    """A missing score is one, a malformed match is skipped."""
    text = "concat('{\"matches\":[{\"u_real\":1,\"v_real\":', p_size, ',\"u_rend\":2,\"v_rend\":2},{\"u_real\":2,\"v_real\":', p_size, ',\"u_rend\":3,\"v_rend\":2,\"score\":0.5},{\"u_real\":9}]}')"
    return formats.parse_matches(table(spark, sf, "part").selectExpr("p_partkey AS id", f"{text} AS value"))


@query("SELECT p_partkey AS id, 2.0::DOUBLE AS u_real FROM part WHERE p_size % 10 >= 6")
def match_filter(spark, sf):
    text = "concat('{\"matches\":[{\"u_real\":2,\"v_real\":1,\"u_rend\":3,\"v_rend\":2,\"score\":', (p_size % 10) / 10, '}]}')"
    return formats.parse_matches(table(spark, sf, "part").selectExpr("p_partkey AS id", f"{text} AS value"), least=0.6).select("id", "u_real")


@query(f"{with_sql('points')} SELECT frame_id, count(*) AS n, round(sum(CAST(x AS FLOAT)::DOUBLE), 3) + 0.0 AS sx, round(max(CAST(t AS FLOAT)::DOUBLE), 6) + 0.0 AS mt FROM p GROUP BY 1")
def message_roundtrip(spark, sf):
    """Points packed into binary messages and decoded again."""
    p = points(spark, sf).select("frame_id", (F.col("frame_id") * 0.1).alias("stamp"), (F.col("ok") * 8 + F.col("ln")).alias("pt_idx"), "x", "y", "z", "t", "intensity")
    back = formats.points_from_messages(formats.messages_from_points(p), formats.POINT_STEP, formats.POINT_FIELDS)
    out = back.groupBy("frame_id").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.max("t").alias("mt"))
    return r(r(out, "sx", digits=3), "mt")


@query("SELECT event_id AS id, epoch(ts) + CAST('0.' || lpad(CAST(event_id % 100 AS STRING), 2, '0') AS DOUBLE) - extract('microsecond' FROM ts) % 1000000 / 1e6 AS stamp FROM events")
def exif_time(spark, sf):
    e = table(spark, sf, "events")
    text, sub = F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0")
    return r(e.select(F.col("event_id").alias("id"), formats.exif_time(text, sub).alias("stamp")), "stamp")


@query(f"{G} SELECT id, round(45 + 0.1 * lat + 0.2 * lon, 6) + 0.0 AS undulation FROM g")
def geoid_lookup(spark, sf):
    """Bilinear lookup in a plane-shaped grid, on which it is exact."""
    grid = spark.range(0, 20 * 40).select((F.lit(35.0) + F.floor(F.col("id") / 40) * 0.5).alias("lat"), (F.lit(-10.0) + (F.col("id") % 40) * 0.5).alias("lon"))
    grid = grid.withColumn("n", 45 + 0.1 * F.col("lat") + 0.2 * F.col("lon"))
    return r(formats.undulation(carrier(spark, sf, "gnss"), grid, 35.0, -10.0, 0.5), "undulation")


@query(f"{G} SELECT id, CASE WHEN lat + lon < 40 THEN 'low' END AS area FROM g WHERE lat > 36.5 AND lat < 43.5 AND lon > -8.5 AND lon < 3.5 AND lat + lon < 40")
def polygon_lookup(spark, sf):
    """Point in polygon by the even-odd rule; the area is a box cut by a diagonal."""
    rim = [(-8.5, 36.5), (3.5, 36.5), (-3.5, 43.5), (-8.5, 43.5)]
    edges = spark.createDataFrame([("low", *a, *b) for a, b in zip(rim, rim[1:] + rim[:1], strict=True)], "area string, x1 double, y1 double, x2 double, y2 double")
    return formats.point_in_polygon(carrier(spark, sf, "gnss").select("id", "lat", "lon"), edges)


@query(f"{T} SELECT session, submap_id, count(*) AS n, CAST(sum(CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS lost FROM tr GROUP BY 1, 2")
def hd_summary(spark, sf):
    """Frames, points and frames without metadata per submap."""
    t = carrier(spark, sf, "trajectory")
    return t.groupBy("session", "submap_id").agg(F.count("*").alias("n"), F.count_if(F.col("id") % 5 == 0).alias("lost"))


# streams -------------------------------------------------------------------------------------


def _stream(spark, sf, files=4):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.file_stream(spark, streams.replay_folder(e, files, "event_id"), e.schema, 1)


@query("SELECT user_id AS key, submap, n, round(total, 4) + 0.0 AS total FROM (SELECT user_id, CAST(k // 10 AS INT) AS submap, CAST(count(*) AS INT) AS n, sum(value) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events) GROUP BY 1, 2) WHERE n = 10")
def stream_submaps(spark, sf):
    """Count-triggered submaps from a replayed stream equal the batch windows."""
    made = streams.counted_windows(_stream(spark, sf), "user_id", "event_id", 10, "key long, submap int, n int, total double")
    return r(streams.drain(made), "total", digits=4)


@query("SELECT user_id AS key, event_id AS id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 200 PRECEDING AND CURRENT ROW) - 1 AS INT) AS held FROM events")
def stream_fixed_lag(spark, sf):
    return streams.drain(streams.fixed_lag(_stream(spark, sf), "user_id", "event_id", 200.0, "key long, id long, held int"))


@query("SELECT event_id, user_id, value FROM events")
def stream_late_drop(spark, sf):
    """In-order replay: nothing is late, nothing is lost."""
    return streams.drain(streams.dropped_late(_stream(spark, sf), "ts", "1 hour", "event_id").select("event_id", "user_id", "value"))


@query("SELECT event_type, count(*) AS n, round(max(value), 6) + 0.0 AS most FROM events GROUP BY 1")
def stream_progress(spark, sf):
    """A running aggregate, complete mode through foreachBatch."""
    s = _stream(spark, sf)
    return r(streams.drain(s.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("most")), "complete"), "most")


@query("SELECT f.event_id, f.user_id, min(i.event_id) AS released_by FROM events f JOIN events i ON i.user_id = f.user_id AND i.event_type = 'error' AND i.ts >= f.ts AND i.ts <= f.ts + INTERVAL 6 HOUR WHERE f.event_type = 'view' GROUP BY 1, 2")
def stream_gate(spark, sf):
    """Frames released by the first inertial sample that passes them."""
    s = _stream(spark, sf)
    joined = streams.gate(s.where("event_type = 'view'"), s.where("event_type = 'error'"), "ts", "12 hours", "6 HOURS")
    return streams.drain(joined).groupBy("event_id", "user_id").agg(F.min("i_id").alias("released_by"))


@query("SELECT event_id, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, value FROM events WHERE event_id % 10 = 1")
def union_sources(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return sets.union(e.where("event_id % 2 = 0"), e.where("event_id % 10 = 1"))
