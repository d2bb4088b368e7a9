"""Models over time slices: cumulative or disjoint, all slices in one plan.

A slice is a group column of the cells, so every model scores all slices at once.
Cumulative slices carry running totals by product and event over the calendar of
slices; reports are aggregated to (slice, product, event) first.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.operators.binary import convert_binary
from cellwise.operators.cells import Cells, convert
from cellwise.operators.result import Signals
from cellwise.sources.shared import staged

SLICE = "slice_ts"
# Time units by their alias, as (unit of truncation, its length in months, days, hours or minutes, labelled at its end).
UNITS = {
    "A": ("year", 12, True), "Y": ("year", 12, True), "YE": ("year", 12, True), "AS": ("year", 12, False), "YS": ("year", 12, False),
    "Q": ("quarter", 3, True), "QE": ("quarter", 3, True), "QS": ("quarter", 3, False),
    "M": ("month", 1, True), "ME": ("month", 1, True), "MS": ("month", 1, False),
    "W": ("week", 7, True), "W-SUN": ("week", 7, True), "D": ("day", 1, False),
    "h": ("hour", 1, False), "H": ("hour", 1, False), "min": ("minute", 1, False), "T": ("minute", 1, False),
}


def slice_start(date: Column, unit: str) -> Column:
    """The midnight at which a date's slice begins; weeks run from Monday to Sunday."""
    return F.date_trunc(UNITS[unit][0], date)


def _step(unit: str) -> Column:
    """The length of a slice as an interval."""
    name, size, _ = UNITS[unit]
    part = {"week": "days", "day": "days", "hour": "hours", "minute": "mins"}.get(name, "months")
    return F.make_interval(**{part: F.lit(size)})


def next_start(start: Column, unit: str) -> Column:
    return start + _step(unit)


def label(start: Column, unit: str) -> Column:
    """The slice's label: its start, or for end-labelled units the midnight of its last day."""
    return next_start(start, unit) - F.make_interval(days=F.lit(1)) if UNITS[unit][2] else start


def _union(frames: list[DataFrame]) -> DataFrame:
    """All frames, joined in pairs, so that a plan of many is not deep."""
    half = len(frames) // 2
    return _union(frames[:half]).unionByName(_union(frames[half:])) if half else frames[0]


@dataclass
class LongitudinalModel:
    """Reports and a time unit; ``run`` and ``run_disjoint`` score each slice.

    ``semantics="reference"`` cuts a cumulative slice at its label's midnight;
    ``"corrected"`` takes all reports up to the slice's end.
    """

    reports: DataFrame
    time_unit: str
    product_label: str = "name"
    count_label: str = "count"
    ae_label: str = "AE"
    date_label: str = "date"
    semantics: str = "reference"

    def __post_init__(self) -> None:
        if self.time_unit not in UNITS:
            raise ValueError(f"time_unit must be one of {sorted(UNITS)}")

    def regroup_dates(self, time_unit: str) -> LongitudinalModel:
        """The same reports by another unit."""
        self.time_unit = time_unit
        self.__post_init__()
        return self

    def _dated(self) -> DataFrame:
        date = F.col(self.date_label).cast("timestamp")
        return self.reports.select(
            date.alias("_date"), F.col(self.product_label).alias("name"), F.col(self.ae_label).alias("AE"),
            F.coalesce(F.col(self.count_label), F.lit(0)).alias("count"), slice_start(date, self.time_unit).alias("_start"),
        ).filter("_date IS NOT NULL")

    def calendar(self) -> DataFrame:
        """``slice_ts, _start, count``: every slice from the first date to the last, with its own count."""
        dated = self._dated()
        ends = dated.agg(F.min("_start").alias("a"), F.max("_start").alias("b")).filter("a IS NOT NULL")
        every = ends.select(F.explode(F.sequence(F.col("a"), F.col("b"), _step(self.time_unit))).alias("_start"))
        counts = dated.groupBy("_start").agg(F.sum("count").alias("count"))
        return every.join(counts, "_start", "left").select(
            label(F.col("_start"), self.time_unit).alias(SLICE), "_start", F.coalesce("count", F.lit(0)).alias("count")
        )

    def _disjoint_rows(self) -> DataFrame:
        sums = self._dated().groupBy("_start", "name", "AE").agg(F.sum("count").alias("count"))
        return sums.join(F.broadcast(self.calendar().filter("count <> 0").select(SLICE, "_start")), "_start").drop("_start")

    def _cumulative_rows(self) -> DataFrame:
        """Each pair's total at every slice with reports, from running sums and not by joining reports."""
        dated = self._dated()
        if self.semantics == "reference":
            # A report first counts in the earliest slice whose label isn't before it.
            now = label(F.col("_start"), self.time_unit)
            first = F.when(F.col("_date") <= now, F.col("_start")).otherwise(next_start(F.col("_start"), self.time_unit))
            dated = dated.withColumn("_start", first)
        sums = dated.groupBy("_start", "name", "AE").agg(F.sum("count").alias("count"))
        # Slices with reports are numbered; a step's number is that of the first slice at or behind it.
        every = self.calendar().select(SLICE, "_start", "count")
        number = F.coalesce(F.sum((F.col("count") != 0).cast("int")).over(Window.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        every = staged(every.withColumn("_number", number))
        slices = every.filter("count <> 0").select(SLICE, "_number")
        last = slices.count()
        at = every.select("_start", "_number")
        numbered = sums.join(F.broadcast(at), "_start", "left").withColumn("_number", F.coalesce("_number", F.lit(last)))
        pair = Window.partitionBy("name", "AE").orderBy("_start")
        # A pair's running total holds until the pair's next step, so each slice is made once.
        steps = numbered.withColumns(
            {"count": F.sum("count").over(pair), "_until": F.coalesce(F.lead("_number").over(pair), F.lit(last)) - 1}
        ).filter("_number <= _until")
        filled = steps.select("name", "AE", "count", F.explode(F.sequence("_number", "_until")).alias("_number"))
        return filled.join(F.broadcast(slices), "_number").select(SLICE, "name", "AE", "count")

    def cells(self, cumulative: bool) -> Cells:
        """Cells by slice."""
        rows = self._cumulative_rows() if cumulative else self._disjoint_rows()
        return convert(rows, groups=(SLICE,))

    def _run(self, model: Callable[..., Signals], cumulative: bool, include_gaps: bool, use_binary: bool, kwargs: dict) -> Signals:
        if use_binary:
            return self._run_binary(model, cumulative, include_gaps, kwargs)
        found = model(self.cells(cumulative), **kwargs)
        return self._with_gaps(found) if include_gaps else found

    def _with_gaps(self, found: Signals) -> Signals:
        """A row of nulls for each slice without results."""
        slices = self.calendar().select(SLICE)
        return Signals(
            slices.join(found.all_signals, SLICE, "left"), found.signals, slices.join(found.counts, SLICE, "left"),
            found.params, found.groups, found.statistic, found.descending,
        )

    def _run_binary(self, model: Callable[..., Signals], cumulative: bool, include_gaps: bool, kwargs: dict) -> Signals:
        """Binary designs differ in their columns from slice to slice, so slices are fitted in turn."""
        made: list[tuple[DataFrame, ...]] = []
        rows = self._cumulative_rows() if cumulative else self._disjoint_rows()
        for r in self.calendar().filter("count <> 0").orderBy(SLICE).collect():
            own = rows.filter(F.col(SLICE) == F.lit(r[SLICE]))
            at = F.lit(r[SLICE]).alias(SLICE)
            try:
                found = model(convert_binary(own), **kwargs)
            except ValueError as e:  # the model can't fit the slice, which is left as a gap
                warnings.warn(f"slice {r[SLICE]}: {e}", stacklevel=3)
                continue
            made.append(tuple(x.select(at, "*") for x in (found.all_signals, found.signals, found.counts)))
        if not made:  # no slice: the columns of an empty one
            found = model(convert_binary(rows.limit(0).drop(SLICE)), **kwargs)
            at = F.lit(None).cast("timestamp").alias(SLICE)
            made.append(tuple(x.limit(0).select(at, "*") for x in (found.all_signals, found.signals, found.counts)))
        found = Signals(*(_union(list(frames)) for frames in zip(*made, strict=True)), {}, (SLICE,), found.statistic, found.descending)
        return self._with_gaps(found) if include_gaps else found

    def run(self, model: Callable[..., Signals], include_gaps: bool = True, use_binary: bool = False, **kwargs) -> Signals:
        """Score each slice with all reports up to it."""
        return self._run(model, True, include_gaps, use_binary, kwargs)

    def run_disjoint(self, model: Callable[..., Signals], include_gaps: bool = True, use_binary: bool = False, **kwargs) -> Signals:
        """Score each slice with its own reports."""
        return self._run(model, False, include_gaps, use_binary, kwargs)
