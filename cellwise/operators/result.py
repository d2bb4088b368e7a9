"""Results of scoring models, decision rules and export."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.operators.ordering import join_groups, with_rank
from cellwise.sources.workbook import write_workbook

METRICS = ("fdr", "signals", "rank")
SEMANTICS = ("reference", "corrected")


@dataclass
class Signals:
    """All scored cells, those that signal, and how many there are."""

    all_signals: DataFrame
    signals: DataFrame
    counts: DataFrame  # the group columns and num_signals
    params: dict = field(default_factory=dict)
    groups: tuple[str, ...] = ()
    statistic: str = ""  # the column that ranks the cells
    descending: bool = False  # whether its large values come first

    def ranked(self, which: str = "all_signals") -> DataFrame:
        """``all_signals`` or ``signals`` sorted by the statistic, with ``index``, its place from 0 in its group.

        Ties go by event and product; null statistics come last.
        """
        names = {"ae_name": F.col("Adverse Event"), "product_name": F.col("Product")}
        rows = with_rank(getattr(self, which).withColumns(names), self.statistic, "index", self.groups, self.descending)
        return rows.withColumn("index", F.col("index") - 1).drop(*names).orderBy(*self.groups, "index")

    @property
    def num_signals(self) -> int:
        """The number of signals; an action. Only without groups."""
        if self.groups:
            raise ValueError("there is a number for each group; see counts")
        row = self.counts.first()
        return int(row["num_signals"]) if row else 0

    def export(self, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
        """Write ``signals`` and ``all_data`` below ``path``; ``excel`` makes one workbook of two sheets.

        A workbook (a file on the driver's machine) holds at most the 1,048,575 rows a sheet
        that the format allows; a larger result is refused before anything is written.
        """
        if format == "excel":
            write_workbook(path, {"Signals": self.signals, "all_data": self.all_signals})
            return
        for name, frame in (("signals", self.signals), ("all_data", self.all_signals)):
            # Parquet and CSV allow the names as they are.
            writer = frame.write.format(format).mode(mode)
            (writer.option("header", True) if format == "csv" else writer).save(f"{path.rstrip('/')}/{name}")


def check_options(decision_metric: str, semantics: str) -> None:
    if decision_metric not in METRICS:
        raise ValueError(f"decision_metric must be one of {METRICS}, not {decision_metric!r}")
    if semantics not in SEMANTICS:
        raise ValueError(f"semantics must be one of {SEMANTICS}, not {semantics!r}")


def count_rule(metric: str, threshold: float, statistic: str, rising: bool) -> Column:
    """The aggregate that counts signals; ``rising``: large values of the statistic speak for a signal."""
    if metric == "fdr":
        return F.count_if(F.col("fdr") <= threshold)
    if metric == "rank" and rising:
        return F.count_if(F.col(statistic) >= threshold)
    return F.count_if(F.col(statistic) <= threshold)


def signal_counts(
    rows: DataFrame, groups: Sequence[str], metric: str, threshold: float, statistic: str, rising: bool, less: int = 0
) -> DataFrame:
    """``num_signals`` by group; ``less`` of them are left off."""
    count = count_rule(metric, threshold, statistic, rising)
    return rows.groupBy(*groups).agg(F.greatest(count - less, F.lit(0)).cast("bigint").alias("num_signals"))


def first_signals(
    rows: DataFrame, counts: DataFrame, groups: Sequence[str], statistic: str, descending: bool
) -> DataFrame:
    """The first ``num_signals`` rows of each group by the statistic."""
    ranked = with_rank(rows, statistic, "_rank", groups, descending)
    return join_groups(ranked, counts, groups).filter(F.col("_rank") <= F.col("num_signals")).drop("_rank", "num_signals")


def null_for_nan(x: Column) -> Column:
    """Null instead of NaN and of infinite values."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
