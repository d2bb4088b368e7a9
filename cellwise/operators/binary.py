"""Reports as sparse binary designs, and reports with several products."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.operators.cells import contingency_table


@dataclass(frozen=True)
class BinaryDesign:
    """A design in distinct patterns: equal rows are one row with a number.

    ``patterns``: ``products`` (sorted ``array<struct<product, x>>``), ``ae``, ``y``,
    ``rows``: how many rows have these products, event and outcome.
    """

    patterns: DataFrame
    type: str = "binary"

    @property
    def N(self) -> int:
        """Rows of the design; an action."""
        return int(self.patterns.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])

    def product_features(self) -> DataFrame:
        """``product, x, rows``: how many rows hold a product x times."""
        flat = self.patterns.select(F.explode("products").alias("p"), "rows")
        return flat.groupBy("p.product", "p.x").agg(F.sum("rows").alias("rows"))

    def event_outcomes(self) -> DataFrame:
        """``ae, y, rows``."""
        return self.patterns.groupBy("ae", "y").agg(F.sum("rows").alias("rows"))


def _labels(product_label: str | Sequence[str]) -> list[str]:
    return [product_label] if isinstance(product_label, str) else list(product_label)


def _held(labels: Sequence[str]) -> Column:
    """Products of a row with the number of columns that hold them; empty and null columns hold none."""
    every = F.filter(F.array(*[F.col(c) for c in labels]), lambda p: p.isNotNull() & (p != ""))
    return F.transform(
        F.array_sort(F.array_distinct(every)),
        lambda p: F.struct(p.alias("product"), F.size(F.filter(every, lambda q: q == p)).cast("bigint").alias("x")),
    )


def convert_binary(
    reports: DataFrame,
    product_label: str | Sequence[str] = "name",
    count_label: str = "count",
    ae_label: str = "AE",
    use_counts: bool = False,
) -> BinaryDesign:
    """The binary design of reports, or with ``use_counts`` one row for each product set and event.

    Without ``use_counts`` a report of count c stands for c rows if any count exceeds 1;
    otherwise each report is a row, those of count 0 too. Rows are never repeated: a
    pattern carries their number. Reports without an event are dropped.
    """
    count = F.coalesce(F.col(count_label), F.lit(0)).cast("bigint")
    rows = reports.filter(F.col(ae_label).isNotNull()).select(
        _held(_labels(product_label)).alias("products"), F.col(ae_label).alias("ae"), count.alias("c")
    )
    if use_counts:
        sums = rows.groupBy("products", "ae").agg(F.sum("c").alias("y"))
        return BinaryDesign(sums.select("products", "ae", "y", F.lit(1).cast("bigint").alias("rows")), "binary_count")
    by_count = rows.groupBy("products", "ae").agg(
        F.sum(F.greatest("c", F.lit(0))).alias("expanded"), F.count(F.lit(1)).alias("plain"), F.max("c").alias("most")
    )
    most = by_count.agg(F.max("most").alias("_most"))
    number = F.when(F.col("_most") > 1, F.col("expanded")).otherwise(F.col("plain"))
    sized = by_count.crossJoin(F.broadcast(most)).select("products", "ae", F.lit(1).cast("bigint").alias("y"), number.alias("rows"))
    return BinaryDesign(sized.filter("rows > 0"))


@dataclass(frozen=True)
class MultiItem:
    """Combinations of products: ``data`` of all of them, ``contingency`` of the frequent ones, and ``totals``."""

    data: DataFrame
    contingency: DataFrame
    totals: DataFrame

    @property
    def N(self) -> int:
        return int(self.totals.first()["N"] or 0)


def convert_multi_item(
    reports: DataFrame,
    product_cols: Sequence[str] = ("name",),
    ae_col: str = "AE",
    count_col: str = "count",
    min_threshold: float = 3,
) -> MultiItem:
    """Every non-empty set of a report's products, joined by ``|`` in sorted order, with each event.

    ``product_aes`` adds the rows of the set's members over all product columns;
    ``count_across_brands`` counts pairs of a row and a filled product column by event;
    ``events`` sums the counts by event and set. ``N`` sums them over all sets of all
    rows (the event total of each set). A report with more than 20 products is refused, for it has too many sets.
    """
    labels = _labels(product_cols)
    given = F.filter(F.array(*[F.col(c) for c in labels]), lambda p: p.isNotNull() & (p != ""))
    # Equal reports are one row first, so sets are made once for each kind of report.
    kinds = (
        reports.filter(F.col(ae_col).isNotNull())
        .select(F.array_sort(given).alias("_given"), F.col(ae_col).alias("ae_name"), F.coalesce(F.col(count_col), F.lit(0)).alias("_c"))
        .groupBy("_given", "ae_name")
        .agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_products", F.array_distinct("_given"))
    )
    n = F.size("_products")
    checked = F.when(n > 20, F.raise_error(F.lit("a report has more than 20 products")).cast("int")).otherwise(n)
    masks = F.when(n > 0, F.sequence(F.lit(1), F.pow(F.lit(2), checked).cast("int") - 1))
    member = lambda m: F.filter("_products", lambda p, i: F.getbit(m, i) == 1)
    sets = kinds.select("ae_name", "_c", "_rows", F.explode(F.transform(masks, member)).alias("_set"))
    margins = kinds.select(F.explode("_given").alias("p"), "_rows").groupBy("p").agg(F.sum("_rows").alias("_n"))
    across = kinds.groupBy("ae_name").agg(F.sum(F.col("_rows") * F.size("_given")).cast("bigint").alias("count_across_brands"))
    events = sets.groupBy("ae_name", "_set").agg(F.sum("_c").alias("events"), F.sum("_rows").alias("_uses"))
    sums = (
        events.select("_set").distinct().select("_set", F.explode("_set").alias("p"))
        .join(margins, "p").groupBy("_set").agg(F.sum("_n").alias("product_aes"))
    )
    every = events.join(sums, "_set").join(across, "ae_name")
    name = F.array_join("_set", "|").alias("product_name")
    data = every.select("events", "product_aes", "count_across_brands", "ae_name", name)
    # Each of a report's sets counts the event total of the set once more.
    totals = events.agg(F.coalesce(F.sum(F.col("_uses") * F.col("events")), F.lit(0)).alias("N"))
    contingency = contingency_table(data, min_threshold, "product_name", "events", "ae_name")
    return MultiItem(data, contingency, totals)


def wide(design: DataFrame, index: str, columns: str, values: str) -> DataFrame:
    """A long table pivoted on demand, for few columns."""
    return design.groupBy(index).pivot(columns).agg(F.coalesce(F.sum(values), F.lit(0))).na.fill(0)
