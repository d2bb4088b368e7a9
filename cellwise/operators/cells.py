"""Reports to contingency cells."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwise.operators.ordering import join_groups


@dataclass(frozen=True)
class Cells:
    """Cells of products and events with their margins, lazily.

    ``data``: the group columns, ``events, product_aes, count_across_brands, ae_name,
    product_name``. ``contingency``: ``product_name, ae_name, events`` of the kept
    products and events, zeros implied. ``totals``: the group columns and ``N``.
    """

    data: DataFrame
    contingency: DataFrame
    totals: DataFrame
    groups: tuple[str, ...] = ()
    type: str = "contingency"

    @property
    def N(self) -> int:
        """The number of events of all cells; an action. Only without groups."""
        if self.groups:
            raise ValueError("there is an N for each group; see totals")
        return int(self.totals.first()["N"] or 0)

    def cache(self) -> Cells:
        """Keep the cells for several models."""
        self.data.cache()
        return self


def contingency_table(
    reports: DataFrame,
    margin_threshold: float = 1,
    product_label: str = "name",
    count_label: str = "count",
    ae_label: str = "AE",
    groups: Sequence[str] = (),
) -> DataFrame:
    """Summed counts by product and event, without products and events of small margins.

    Both margins are those of the unfiltered table, in one pass. Null products or
    events are dropped; null counts add nothing.
    """
    sums = (
        reports.filter(F.col(product_label).isNotNull() & F.col(ae_label).isNotNull())
        .groupBy(*groups, F.col(product_label).alias("product_name"), F.col(ae_label).alias("ae_name"))
        .agg(F.coalesce(F.sum(count_label), F.lit(0)).alias("events"))
    )
    margin = lambda by: F.sum("events").over(Window.partitionBy(*groups, by))
    # By product first: the event's margin then leaves the rows dealt by event.
    wide = sums.withColumn("_p", margin("product_name")).withColumn("_a", margin("ae_name"))
    return wide.filter((F.col("_p") >= margin_threshold) & (F.col("_a") >= margin_threshold)).drop("_p", "_a")


def convert(
    reports: DataFrame,
    margin_threshold: float = 1,
    product_label: str = "name",
    count_label: str = "count",
    ae_label: str = "AE",
    groups: Sequence[str] = (),
) -> Cells:
    """Cells with positive counts, their margins among what is kept, and the total of the cells."""
    kept = contingency_table(reports, margin_threshold, product_label, count_label, ae_label, groups)
    margin = lambda by: F.sum("events").over(Window.partitionBy(*groups, by))
    data = (
        kept.withColumn("count_across_brands", margin("ae_name"))
        .withColumn("product_aes", margin("product_name"))
        .filter("events > 0")
        .select(*groups, "events", "product_aes", "count_across_brands", "ae_name", "product_name")
    )
    return Cells(data, kept, _totals(data, groups), tuple(groups))


def _totals(data: DataFrame, groups: Sequence[str]) -> DataFrame:
    return data.groupBy(*groups).agg(F.coalesce(F.sum("events"), F.lit(0)).alias("N"))


def scored(cells: Cells, min_events: float = 1) -> DataFrame:
    """The cells that a model scores, as doubles ``n11, n1j, ni1, N``, with their names."""
    rows = join_groups(cells.data, cells.totals, cells.groups)
    if min_events > 1:
        rows = rows.filter(F.col("events") >= min_events)
    return rows.select(
        *cells.groups,
        "ae_name",
        "product_name",
        F.col("events").cast("double").alias("n11"),
        F.col("product_aes").cast("double").alias("n1j"),
        F.col("count_across_brands").cast("double").alias("ni1"),
        F.col("N").cast("double").alias("N"),
    )
