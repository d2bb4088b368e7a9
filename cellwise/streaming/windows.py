"""Structured Streaming over reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellwise.operators.cells import convert
from cellwise.operators.result import Signals


def windowed_counts(reports: DataFrame, window: str, late: str = "0 seconds", slide: str | None = None) -> DataFrame:
    """Counts by window, product and event; reports later than ``late`` behind the latest are dropped."""
    return (
        reports.withWatermark("date", late)
        .groupBy(F.window("date", window, slide), "name", "AE")
        .agg(F.sum("count").alias("count"))
        .select(F.col("window.start").alias("slice_ts"), "name", "AE", "count")
    )


def score_stream(
    reports: DataFrame, model: Callable[..., Signals], path: str, checkpoint: str, **kwargs
) -> StreamingQuery:
    """Score the cells of all reports so far with each batch.

    ``path/counts/batch=i`` holds the counts of a batch and ``path/scores/batch=i`` the
    results after it. A batch that is run again after a failure overwrites its own
    folders, so each report counts once.
    """

    def step(batch: DataFrame, number: int) -> None:
        own = batch.groupBy("name", "AE").agg(F.sum("count").alias("count"))
        own.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        every = batch.sparkSession.read.parquet(f"{path}/counts").filter(F.col("batch") <= number)
        result = model(convert(every.select("name", "AE", "count")), **kwargs)
        result.all_signals.write.mode("overwrite").parquet(f"{path}/scores/batch={number}")

    return reports.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
