"""Deterministic sensor tables over the driver's business tables, for Spark and as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POINTS = """SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_extendedprice AS ep, l_shipdate AS sd,
 l_orderkey % 50 AS frame_id, l_orderkey % 5 AS submap_id,
 l_quantity - CAST(25.5 AS DOUBLE) AS x, l_extendedprice / CAST(1000 AS DOUBLE) - CAST(50 AS DOUBLE) AS y,
 l_discount * CAST(50 AS DOUBLE) - CAST(2.5 AS DOUBLE) + l_tax * CAST(10 AS DOUBLE) AS z,
 l_tax * CAST(1000 AS DOUBLE) AS intensity, (l_linenumber - 1) * CAST(0.01 AS DOUBLE) AS t, l_linenumber AS ring,
 CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS is_ground FROM lineitem"""
#: Total order of the points (shorter keys are not unique).
ORDER = ("ok", "ln", "pk", "sk", "ep", "sd")
ORDER_SQL = ", ".join(ORDER)

TRAJECTORY = """SELECT o_orderkey AS id, o_orderstatus AS session, CAST(o_custkey % 200 AS INT) AS submap_id, o_orderdate AS ts,
 (o_totalprice / CAST(1000 AS DOUBLE)) AS x, CAST(o_custkey % 97 AS DOUBLE) AS y, CAST(o_orderkey % 13 AS DOUBLE) / 4 AS z FROM orders"""

GNSS = """SELECT event_id AS id, user_id, CAST(36 AS DOUBLE) + value / CAST(490.02 AS DOUBLE) * 8 AS lat,
 CAST(-9 AS DOUBLE) + (user_id % 150) / CAST(150 AS DOUBLE) * 13 AS lon, value AS alt, CAST(event_id % 4 AS INT) - 1 AS status,
 CASE WHEN event_id % 11 = 0 THEN CAST(-1 AS DOUBLE) ELSE value / CAST(20 AS DOUBLE) END AS sigma FROM events WHERE event_type = 'signup'"""

CAMERAS = """SELECT s_suppkey AS cam, s_acctbal / CAST(300 AS DOUBLE) - CAST(15 AS DOUBLE) AS cx, CAST(s_nationkey AS DOUBLE) * 4 - 48 AS cy,
 CAST(s_suppkey % 7 AS DOUBLE) / 2 AS cz, CAST(s_suppkey AS DOUBLE) / 10 AS stamp, s_suppkey % 9 <> 0 AS located FROM supplier"""

IMU = """SELECT event_id AS id, user_id AS stream, value AS signal, event_type AS kind FROM events"""

_SQL = {"points": POINTS, "trajectory": TRAJECTORY, "gnss": GNSS, "cameras": CAMERAS, "imu": IMU}
_TABLES = {"points": "lineitem", "trajectory": "orders", "gnss": "events", "cameras": "supplier", "imu": "events"}


def carrier(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = _TABLES[name]
    select, source = _SQL[name].split(f" FROM {table}")
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if source.strip().startswith("WHERE"):
        df = df.where(source.strip()[len("WHERE") :])
    fields = select.strip()[len("SELECT") :]
    return df.selectExpr(*_split(fields))


def _split(fields: str) -> list[str]:
    """Select-list items at top-level commas."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(fields[start:i].strip())
            start = i + 1
    return [*out, fields[start:].strip()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_sql(*names: str) -> str:
    """WITH list of carriers for comparison SQL: p (points), tr, g, cam, imu."""
    short = {"points": "p", "trajectory": "tr", "gnss": "g", "cameras": "cam", "imu": "imu"}
    return "WITH " + ", ".join(f"{short[n]} AS ({_SQL[n]})" for n in names)
