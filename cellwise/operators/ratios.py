"""Proportional reporting ratio, reporting odds ratio and Fisher's exact test."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cellwise.functions.numeric import hypergeom_pmf, hypergeom_upper
from cellwise.functions.special import Z975, upper_normal
from cellwise.operators.cells import Cells, scored
from cellwise.operators.expected import MARGINS, fitted
from cellwise.operators.lbe import with_rates
from cellwise.operators.ordering import with_position, with_rank
from cellwise.operators.result import Signals, check_options, first_signals, signal_counts
from cellwise.sources.shared import staged

#: Added to the events of other products, which keeps logarithms finite.
SMALL = 1e-7


def _table(cells: Cells, min_events: float, method: str, alpha: float) -> DataFrame:
    rows = fitted(scored(cells, min_events), method, alpha, cells.groups)
    rows = rows.withColumns({"n10": F.col("n1j") - F.col("n11"), "n01": F.col("ni1") - F.col("n11") + SMALL})
    return rows.withColumn("n00", F.col("N") - (F.col("n11") + F.col("n10") + F.col("n01")))


def _finish(rows: DataFrame, cells: Cells, statistic: str, metric: str, threshold: float, semantics: str, params: dict) -> Signals:
    """Rates, decision and output columns from rows with ``p``, ``lower`` and ``ratio``."""
    check_options(metric, semantics)
    groups, reference = cells.groups, semantics == "reference"
    stat = "p" if statistic == "p_value" else "lower"
    kept = ["ae_name", "product_name", "n11", "n1j", "ni1", "E", "p", "lower", "ratio"]
    rows = staged(rows.select(*groups, *[c for c in kept if c in rows.columns]))
    rows = with_position(rows, groups)
    if statistic == "CI":
        rows = rows.withColumn("fdr", F.lit(None).cast("double"))
    else:
        rows = with_rates(rows, "p", groups, reference, with_rank(rows, "p", "rank", groups))
    counts = signal_counts(rows, groups, metric, threshold, stat, statistic != "p_value")
    descending = stat == "lower" and not reference
    chosen = first_signals(rows, counts, groups, stat, descending)
    name = "lower_bound_CI(95%)" if statistic == "CI" else "p_value"
    columns = [
        *[F.col(g) for g in groups],
        F.col("product_name").alias("Product"),
        F.col("ae_name").alias("Adverse Event"),
        F.col("n11").alias("Count"),
        F.col("E").alias("Expected Count"),
        F.col(stat).alias(name),
        F.col("ratio").alias("PRR"),
        F.col("n1j").alias("product margin"),
        F.col("ni1").alias("event margin"),
        F.col("fdr"),
    ]
    return Signals(rows.select(*columns), chosen.select(*columns), counts, params, groups, name, descending)


def _normal_scores(rows: DataFrame, relative_risk: float) -> DataFrame:
    """``p, lower, ratio`` from the logarithm of a ratio and its variance; null where these aren't numbers."""
    safe = F.when(F.col("variance") > 0, F.sqrt("variance"))
    rows = rows.withColumn("root", safe).withColumn("z", (F.col("log_ratio") - math.log(relative_risk)) / F.col("root"))
    return rows.withColumns(
        {
            # least and greatest would skip a null
            "p": F.when(F.col("z").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), upper_normal("z")))),
            "lower": F.col("log_ratio") - Z975 * F.col("root"),
        }
    )


def _log(x):
    return F.when(x > 0, F.ln(x))


def prr(
    container: Cells,
    relative_risk: float = 1,
    min_events: float = 1,
    decision_metric: str = "fdr",
    decision_thres: float = 0.05,
    ranking_statistic: str = "p_value",
    expected_method: str = MARGINS,
    method_alpha: float = 1,
    fdr_threshold: float = 0.05,
    semantics: str = "reference",
) -> Signals:
    """Proportional reporting ratios.

    ``fdr_threshold`` has no influence on the result; it is there for callers that give it.
    """
    rows = _table(container, min_events, expected_method, method_alpha)
    others = F.col("n01") + F.col("n00")
    log_ratio = _log(F.try_divide(F.try_divide(F.col("n11"), F.col("n1j")), F.try_divide(F.col("n01"), others)))
    inverse = lambda x: F.try_divide(F.lit(1.0), x)
    variance = inverse(F.col("n11")) - inverse(F.col("n1j")) + inverse(F.col("n01")) - inverse(others)
    rows = _normal_scores(rows.withColumns({"log_ratio": log_ratio, "variance": variance}), relative_risk)
    params = dict(model="prr", relative_risk=relative_risk, min_events=min_events, expected_method=expected_method)
    rows = rows.withColumn("ratio", F.exp("log_ratio"))
    return _finish(rows, container, ranking_statistic, decision_metric, decision_thres, semantics, params)


def ror(
    container: Cells,
    relative_risk: float = 1,
    min_events: float = 1,
    decision_metric: str = "fdr",
    decision_thres: float = 0.05,
    ranking_statistic: str = "p_value",
    expected_method: str = MARGINS,
    method_alpha: float = 1,
    semantics: str = "reference",
) -> Signals:
    """Reporting odds ratios; in a column named as that of ``prr``. Null p-values and ratios where n10 is 0."""
    rows = _table(container, min_events, expected_method, method_alpha)
    odds = F.try_divide(F.col("n11") * F.col("n00"), F.col("n10") * F.col("n01"))
    inverse = [F.try_divide(F.lit(1.0), F.col(c)) for c in ("n11", "n10", "n01", "n00")]
    rows = rows.withColumns({"log_ratio": _log(odds), "variance": sum(inverse[1:], inverse[0])})
    rows = _normal_scores(rows, relative_risk).withColumn("ratio", F.exp("log_ratio"))
    params = dict(model="ror", relative_risk=relative_risk, min_events=min_events, expected_method=expected_method)
    return _finish(rows, container, ranking_statistic, decision_metric, decision_thres, semantics, params)


@F.pandas_udf(DoubleType())
def _fisher(k: pd.Series, total: pd.Series, successes: pd.Series, draws: pd.Series) -> pd.Series:
    return pd.Series(hypergeom_upper(k.values, total.values, successes.values, draws.values))


@F.pandas_udf(DoubleType())
def _point(k: pd.Series, total: pd.Series, successes: pd.Series, draws: pd.Series) -> pd.Series:
    return pd.Series(hypergeom_pmf(k.values, total.values, successes.values, draws.values))


def rfet(
    container: Cells,
    relative_risk: float = 1,
    min_events: float = 1,
    decision_metric: str = "fdr",
    decision_thres: float = 0.05,
    mid_pval: bool = False,
    expected_method: str = MARGINS,
    method_alpha: float = 1,
    semantics: str = "reference",
) -> Signals:
    """One-sided Fisher's exact test; ``relative_risk`` has no influence.

    With ``semantics="reference"`` the fourth cell is cut to a whole number after the
    small amount is taken off, so it is one less; otherwise it is exact.
    """
    rows = _table(container, min_events, expected_method, method_alpha)
    whole = lambda c: F.col(c).cast("bigint").cast("double")
    n01 = whole("n01")
    n00 = whole("n00") if semantics == "reference" else F.greatest(F.lit(0.0), F.round("n00"))
    rows = rows.withColumns({"_t": F.col("n1j") + n01 + n00, "_d": F.col("n11") + n01})
    p = _fisher("n11", "_t", "n1j", "_d")
    if mid_pval:
        p = p - 0.5 * _point("n11", "_t", "n1j", "_d")
    odds = F.try_divide(F.col("n11") * F.col("n00"), F.col("n10") * F.col("n01"))
    rows = rows.withColumns({"p": F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)), "ratio": F.when(odds > 0, odds)})
    params = dict(model="rfet", min_events=min_events, mid_pval=mid_pval, expected_method=expected_method)
    return _finish(rows, container, "p_value", decision_metric, decision_thres, semantics, params)
