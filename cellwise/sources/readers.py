"""Readers of reports: any format that Spark reads, with a schema rather than inference."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORTS = "name string, AE string, count bigint, date timestamp"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_reports(spark: SparkSession, path: str, format: str = "csv", schema: str | None = REPORTS, **options) -> DataFrame:
    """Reports from files; CSV files have a header. ``schema=None`` takes that of the files."""
    reader = spark.read.format(format).options(**({"header": "true"} | options if format == "csv" else options))
    return (reader.schema(schema) if schema and format in ("csv", "json", "text") else reader).load(path)


def from_pandas(spark: SparkSession, frame: pd.DataFrame) -> DataFrame:
    """Reports that are already in memory."""
    return spark.createDataFrame(frame)


def parse_dates(reports: DataFrame, column: str = "date") -> DataFrame:
    """The reports with dates as timestamps; the caller's frame is left as it is."""
    return reports.withColumn(column, F.col(column).cast("timestamp"))
