"""Expected counts: product of margins, or a Poisson or negative binomial regression."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.functions.numeric import t_quantile
from cellwise.operators.cells import Cells, scored
from cellwise.sources.shared import small_table, staged

MARGINS, NEGATIVE_BINOMIAL, POISSON = "mantel-haentzel", "negative-binomial", "poisson"
STEPS, TOLERANCE = 100, 1e-8
SINGULAR = "The regression has no solution; the product of margins is used for the expected counts."


def _irls(rows: DataFrame, groups: Sequence[str], alpha: float) -> dict[tuple, np.ndarray | None]:
    """Coefficients of ``n11 ~ 1 + n1j + ni1`` with a log link and variance mu + alpha mu^2, by group.

    Each step is one aggregate of nine sums; only 3 x 3 systems come to the driver.
    None stands for a group whose system is singular.
    """
    start = rows.groupBy(*groups).agg(
        F.avg("n11").alias("mean"), F.greatest(F.max("n1j"), F.lit(1.0)).alias("u"), F.greatest(F.max("ni1"), F.lit(1.0)).alias("v")
    ).collect()
    spark = rows.sparkSession
    keys = {tuple(r[g] for g in groups): (r["mean"], r["u"], r["v"]) for r in start if r["mean"] is not None}
    state: dict[tuple, np.ndarray | None] = {k: None for k in keys}
    live, last = set(keys), {k: math.inf for k in keys}
    kinds = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in groups)
    for step in range(STEPS):
        if not live:
            break
        table = [(*k, *keys[k], *(state[k].tolist() if state[k] is not None else (0.0, 0.0, 0.0))) for k in sorted(live, key=str)]
        now = small_table(spark, table, (kinds + ", " if kinds else "") + "m double, u double, v double, c0 double, c1 double, c2 double")
        joined = rows.join(F.broadcast(now), list(groups)) if groups else rows.crossJoin(F.broadcast(now))
        x = {0: F.lit(1.0), 1: F.col("n1j") / F.col("u"), 2: F.col("ni1") / F.col("v")}
        mu = (F.col("n11") + F.col("m")) / 2 if step == 0 else F.exp(F.col("c0") + F.col("c1") * x[1] + F.col("c2") * x[2])
        parts = joined.select(*groups, "n11", x[1].alias("x1"), x[2].alias("x2"), mu.alias("mu"))
        y, w = F.col("n11"), F.col("mu") / (1 + alpha * F.col("mu"))
        z = F.ln("mu") + (y - F.col("mu")) / F.col("mu")
        log_ratio = F.when(y > 0, y * F.ln(y / F.col("mu"))).otherwise(0.0)
        deviance = log_ratio - (y - F.col("mu")) if alpha == 0 else (
            log_ratio - (y + 1 / alpha) * F.ln((1 + alpha * y) / (1 + alpha * F.col("mu")))
        )
        one, two = F.col("x1"), F.col("x2")
        sums = parts.groupBy(*groups).agg(
            *[F.sum(e).alias(n) for n, e in {
                "a00": w, "a01": w * one, "a02": w * two, "a11": w * one * one, "a12": w * one * two, "a22": w * two * two,
                "b0": w * z, "b1": w * z * one, "b2": w * z * two, "d": deviance,
            }.items()]
        )
        for r in sums.collect():
            k = tuple(r[g] for g in groups)
            done = step > 1 and abs(2 * r["d"] - last[k]) <= TOLERANCE * 0.1
            last[k] = 2 * r["d"]
            if done:
                live.discard(k)
                continue
            a = np.array([[r["a00"], r["a01"], r["a02"]], [r["a01"], r["a11"], r["a12"]], [r["a02"], r["a12"], r["a22"]]])
            try:
                if np.linalg.cond(a) > 1e15:
                    raise np.linalg.LinAlgError
                state[k] = np.linalg.solve(a, np.array([r["b0"], r["b1"], r["b2"]]))
            except np.linalg.LinAlgError:
                state[k] = None
                live.discard(k)
    return {k: None if c is None else c / np.array([1.0, *keys[k][1:]]) for k, c in state.items()}


def with_expected(rows: DataFrame, method: str = MARGINS, alpha: float = 1, groups: Sequence[str] = ()) -> DataFrame:
    """Adds ``E`` to rows with ``n11, n1j, ni1, N``."""
    if method not in (MARGINS, NEGATIVE_BINOMIAL, POISSON):
        raise AssertionError(f"unknown method {method!r} of expected counts")
    margins = F.col("n1j") * F.col("ni1") / F.col("N")
    if method == MARGINS:
        return rows.withColumn("E", margins)
    found = _irls(rows, groups, alpha if method == NEGATIVE_BINOMIAL else 0.0)
    if any(c is None for c in found.values()):
        warnings.warn(SINGULAR, stacklevel=2)
    kinds = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in groups)
    table = [(*k, *(c.tolist() if c is not None else (None,) * 3)) for k, c in found.items()]
    fits = small_table(rows.sparkSession, table, (kinds + ", " if kinds else "") + "_c0 double, _c1 double, _c2 double")
    if not groups and not table:
        return rows.withColumn("E", margins)
    joined = rows.join(F.broadcast(fits), list(groups), "left") if groups else rows.crossJoin(F.broadcast(fits))
    fitted = F.exp(F.col("_c0") + F.col("_c1") * F.col("n1j") + F.col("_c2") * F.col("ni1"))
    return joined.withColumn("E", F.coalesce(fitted, margins)).drop("_c0", "_c1", "_c2")


def fitted(rows: DataFrame, method: str = MARGINS, alpha: float = 1, groups: Sequence[str] = ()) -> DataFrame:
    """``with_expected`` for cells still to be made from reports, with a warning where a Poisson regression is a poor choice.

    A regression reads its cells at each step, so they are made once and staged; otherwise
    every step would read, join and aggregate the reports again.
    """
    if method in (NEGATIVE_BINOMIAL, POISSON):
        rows = staged(rows)
    made = with_expected(rows, method, alpha, groups)
    if method == POISSON and not groups:
        warn_if_dispersed(made)
    return made


def calculate_expected(cells: Cells, method: str = MARGINS, alpha: float = 1, min_events: float = 1) -> DataFrame:
    """The scored cells with their expected count ``E``."""
    return fitted(scored(cells, min_events), method, alpha, cells.groups)


def dispersion_table(cells: Cells) -> DataFrame:
    """``dispersion, alpha, lb, ub`` by group: Pearson's statistic and the Cameron-Trivedi test on all cells.

    alpha is the slope through the origin of ((y - mu)^2 - y) / mu on mu; its 95 %
    bounds are those of Student's t with m - 1 degrees of freedom. Null where there
    are too few cells.
    """
    rows = with_expected(staged(scored(cells)), POISSON, groups=cells.groups)
    return _dispersion(rows, cells.groups)


def _dispersion(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The table from rows whose ``E`` is that of a Poisson regression."""
    known = rows.select(*groups, "n11", F.col("E").alias("mu"))
    r = ((F.col("n11") - F.col("mu")) ** 2 - F.col("n11")) / F.col("mu")
    sums = known.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("m"),
        F.sum((F.col("n11") - F.col("mu")) ** 2 / F.col("mu")).alias("chi"),
        F.sum(F.col("mu") * r).alias("mr"),
        F.sum(F.col("mu") * F.col("mu")).alias("mm"),
        F.sum(r * r).alias("rr"),
    )
    found = []
    for s in sums.collect():
        m, key = s["m"], tuple(s[g] for g in groups)
        if m < 4 or not s["mm"]:
            found.append((*key, None, None, None, None))
            continue
        slope = s["mr"] / s["mm"]
        error = math.sqrt(max(s["rr"] - slope * s["mr"], 0.0) / (m - 1) / s["mm"])
        t = t_quantile(0.975, m - 1)
        found.append((*key, s["chi"] / (m - 3), slope, slope - t * error, slope + t * error))
    kinds = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in groups)
    schema = (kinds + ", " if kinds else "") + "dispersion double, alpha double, lb double, ub double"
    return small_table(rows.sparkSession, found, schema)


def test_dispersion(cells: Cells) -> dict[str, float]:
    """The row of ``dispersion_table`` as a dict; without groups."""
    return _dispersion(with_expected(staged(scored(cells)), POISSON), ()).first().asDict()


test_dispersion.__test__ = False


def select_alpha(cells: Cells) -> float:
    """The dispersion parameter to use: the test's alpha if the counts are overdispersed, or else 1."""
    found = test_dispersion(cells)
    return found["alpha"] if found["dispersion"] is not None and found["dispersion"] > 2 else 1.0


def warn_if_dispersed(rows: DataFrame) -> None:
    """Of rows whose ``E`` is that of a Poisson regression."""
    found = _dispersion(rows, ()).first()
    if found["dispersion"] is not None and found["dispersion"] > 2:
        warnings.warn(
            f"The counts are overdispersed ({found['dispersion']:.3g}); a negative binomial model with alpha "
            f"{found['alpha']:.3g} ({found['lb']:.3g} to {found['ub']:.3g}) may suit them better.",
            stacklevel=4,
        )
