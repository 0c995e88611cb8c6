"""Aerial-survey views of the test tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "telemetry": """
        SELECT user_id AS flight_id, event_id AS seq, {us} / 1e10 AS t, 37 + (event_id % 997) * 1e-7 AS lat, -122 + (event_id % 991) * 1e-7 AS lon,
          CAST(value AS DOUBLE) AS alt, CASE WHEN event_type <> 'error' THEN value / 2 END AS baro, CASE WHEN event_type = 'view' THEN value / 4 END AS rel,
          CAST((event_id * 37) % 360 AS DOUBLE) AS heading, event_type = 'purchase' AS has_rtk, event_type
        FROM events""",
    "observations": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) AS x, CAST(round(l_discount * 100) AS DOUBLE) AS y,
          CAST(floor(l_extendedprice / 1000) AS DOUBLE) AS z, CAST(l_suppkey AS INT) AS frame, CAST(l_linenumber AS INT) AS cls, CAST(100 - round(l_tax * 1000) AS INT) AS conf_pct
        FROM lineitem""",
    "frames": """
        SELECT o_custkey % 500 AS job_id, row_number() OVER (PARTITION BY o_custkey % 500 ORDER BY o_orderkey) - 1 AS frame_index, o_orderkey,
          CAST(o_totalprice AS DOUBLE) - 100 * floor(o_totalprice / 100) AS blur FROM orders""",
    "faces": """
        SELECT (((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey) * 4 + copy AS fid, l_partkey % 300 AS i0, l_suppkey % 300 AS i1, (l_orderkey + l_linenumber) % 300 AS i2
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_extendedprice) - 1 AS copy FROM lineitem)""",
    "vertices": """
        SELECT DISTINCT CAST(p_partkey % 300 AS BIGINT) AS vid, CAST((p_partkey % 300) % 17 AS DOUBLE) AS x, CAST((p_partkey % 300) % 13 AS DOUBLE) AS y, CAST((p_partkey % 300) % 5 AS DOUBLE) AS z FROM part""",
}
#: Faces for Spark: as in SQL while fid fits a BIGINT. Beyond (from 28.8 million orders on), where the SQL only has an overflow, fid is the same number less 2^64, so that
#: faces stay apart up to 57.6 million orders; after that it is an error here, too.
_FACE, _REST = "(l_orderkey * 8 + l_linenumber)", "((l_partkey * 10000 + l_suppkey) * 4 + copy)"
_EXACT = f"(CAST({_FACE} AS DECIMAL(20, 0)) * 40000000000 + CAST({_REST} AS DECIMAL(20, 0)))"
SPARK = {
    "faces": f"""
        SELECT CASE WHEN {_FACE} < 230000000 THEN {_FACE} * 40000000000 + {_REST} ELSE CAST({_EXACT} - CASE WHEN {_EXACT} > 9223372036854775807 THEN 18446744073709551616 ELSE 0 END AS BIGINT) END AS fid,
          l_partkey % 300 AS i0, l_suppkey % 300 AS i1, (l_orderkey + l_linenumber) % 300 AS i2
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_extendedprice) - 1 AS copy FROM lineitem)""",
}
_US = {"spark": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)", "duckdb": "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))"}
_TABLES = {"telemetry": "events", "observations": "lineitem", "frames": "orders", "faces": "lineitem", "vertices": "part"}


def sql(name: str) -> str:
    """The view as a subquery for the SQL counterpart."""
    return "(" + SQL[name].replace("{us}", _US["duckdb"]) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(SPARK.get(name, SQL[name]).replace("{us}", _US["spark"]).replace(f"FROM {_TABLES[name]}", "FROM {source}"), source=table(spark, sf_dir, _TABLES[name]))
