"""Reports (name, AE, count, date) from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.sources.readers import read_table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_name", "p_size", "p_type")
    lines = read_table(spark, f"{sf_dir}/lineitem.parquet")
    return lines.join(part, lines["l_partkey"] == part["p_partkey"])


def brand_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and quantities of lines."""
    return _lines(spark, sf_dir).select(
        F.col("p_brand").alias("name"),
        F.concat(F.lit("Q"), F.col("l_quantity").cast("int").cast("string")).alias("AE"),
        F.lit(1).cast("bigint").alias("count"),
        F.col("l_shipdate").cast("timestamp").alias("date"),
    )


def name_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and sizes of the parts of lines: many zero cells."""
    return _lines(spark, sf_dir).select(
        F.col("p_name").alias("name"),
        F.concat(F.lit("S"), F.col("p_size").cast("string")).alias("AE"),
        F.lit(1).cast("bigint").alias("count"),
        F.col("l_shipdate").cast("timestamp").alias("date"),
    )


def user_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and types of events: many products, small counts, times within a day."""
    return read_table(spark, f"{sf_dir}/events.parquet").select(
        F.col("user_id").cast("string").alias("name"),
        F.col("event_type").alias("AE"),
        F.lit(1).cast("bigint").alias("count"),
        F.col("ts").cast("timestamp").alias("date"),
    )


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of parts against flags and priorities: few cells."""
    orders = read_table(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority")
    lines = _lines(spark, sf_dir)
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("p_type").alias("name"),
        F.concat_ws("-", "l_returnflag", "l_linestatus", "o_orderpriority").alias("AE"),
        F.lit(1).cast("bigint").alias("count"),
        F.col("l_shipdate").cast("timestamp").alias("date"),
    )


def multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two products to a report."""
    return _lines(spark, sf_dir).select(
        F.col("p_brand").alias("name"),
        F.col("p_type").alias("name2"),
        F.col("l_returnflag").alias("AE"),
        F.lit(1).cast("bigint").alias("count"),
    )


def brand_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands against return flags."""
    return multi(spark, sf_dir).select("name", "AE", "count")


#: The same views in SQL, for DuckDB.
SQL = {
    "brand_quantity": """SELECT p_brand AS name, 'Q' || CAST(CAST(l_quantity AS INT) AS VARCHAR) AS ae, 1 AS cnt,
      CAST(l_shipdate AS TIMESTAMP) AS dt FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "name_size": """SELECT p_name AS name, 'S' || CAST(p_size AS VARCHAR) AS ae, 1 AS cnt,
      CAST(l_shipdate AS TIMESTAMP) AS dt FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "user_event": """SELECT CAST(user_id AS VARCHAR) AS name, event_type AS ae, 1 AS cnt, CAST(ts AS TIMESTAMP) AS dt FROM events""",
    "flags": """SELECT p_type AS name, l_returnflag || '-' || l_linestatus || '-' || o_orderpriority AS ae, 1 AS cnt,
      CAST(l_shipdate AS TIMESTAMP) AS dt FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "multi": """SELECT p_brand AS name, p_type AS name2, l_returnflag AS ae, 1 AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey""",
}
