"""Fit of the shrinker's prior to squashed counts.

The likelihood needs only how often each (count, expected count) occurs. Zero
cells are never made: their expected count depends on the two margins alone, so
their number for a pair of margins is the number of such products times that of such
events, less the cells that aren't zero. What is squashed comes to the driver up to
DRIVER_ROWS rows; above, each evaluation is an aggregate over the executors.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.functions.numeric import digamma, lgamma
from cellwise.operators.cells import Cells
from cellwise.operators.ordering import join_groups

START = {"alpha1": 0.2041, "beta1": 0.05816, "alpha2": 1.415, "beta2": 1.838, "w": 0.0969}
DRIVER_ROWS = 2_000_000
STEPS = 500
FLOOR = 1e-7


@dataclass(frozen=True)
class Fit:
    values: tuple[float, ...]  # alpha1, beta1, alpha2, beta2, w
    objective: float | None
    message: str


def squash(cells: Cells, scored_rows: DataFrame, truncate: bool, least: int) -> DataFrame:
    """``hits, E, times`` by group: all cells, zeros included, or with ``truncate`` those from ``least`` on."""
    groups = list(cells.groups)
    if truncate:
        chosen = scored_rows.filter(F.col("n11") >= least)
        return chosen.groupBy(*groups, F.col("n11").alias("hits"), "E").agg(F.count(F.lit(1)).cast("double").alias("times"))
    table = cells.contingency
    rows = table.groupBy(*groups, "product_name").agg(F.sum("events").cast("double").alias("u"))
    columns = table.groupBy(*groups, "ae_name").agg(F.sum("events").cast("double").alias("v"))
    us = rows.groupBy(*groups, "u").agg(F.count(F.lit(1)).alias("nu"))
    vs = columns.groupBy(*groups, "v").agg(F.count(F.lit(1)).alias("nv"))
    pairs = us.join(vs, groups) if groups else us.crossJoin(vs)  # of distinct margins, not of cells
    held = table.join(rows, [*groups, "product_name"]).join(columns, [*groups, "ae_name"])
    found = held.filter("events <> 0").groupBy(*groups, "u", "v", F.col("events").cast("double").alias("hits")).agg(
        F.count(F.lit(1)).alias("times")
    )
    taken = found.groupBy(*groups, "u", "v").agg(F.sum("times").alias("taken"))
    zeros = pairs.join(taken, [*groups, "u", "v"], "left").select(
        *groups, "u", "v", F.lit(0.0).alias("hits"), (F.col("nu") * F.col("nv") - F.coalesce("taken", F.lit(0))).alias("times")
    )
    every = join_groups(found.select(*groups, "u", "v", "hits", "times").unionByName(zeros), cells.totals, groups)
    return (
        every.filter("times > 0")
        .groupBy(*groups, "hits", (F.col("u") * F.col("v") / F.col("N")).alias("E"))
        .agg(F.sum("times").cast("double").alias("times"))
    )


def _component(n: np.ndarray, e: np.ndarray, a: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of n, and its derivatives by ln a and ln b."""
    log = lgamma(n + a) - math.lgamma(a) - lgamma(n + 1) + a * np.log(b / (b + e)) + n * np.log(e / (b + e))
    p = np.exp(log)
    by_a = a * (digamma(n + a) - digamma(np.array([a]))[0] + np.log(b / (b + e)))
    by_b = a - b * (a + n) / (b + e)
    return p, p * by_a, p * by_b


def _natural(x: np.ndarray) -> tuple[float, ...]:
    a1, b1, a2, b2 = np.exp(np.clip(x[:4], -30, 30))
    return float(a1), float(b1), float(a2), float(b2), float(1 / (1 + math.exp(-min(max(x[4], -30), 30))))


def value_and_slope(x: np.ndarray, n: np.ndarray, e: np.ndarray, times: np.ndarray, least: int | None) -> tuple[float, np.ndarray]:
    """Negative log likelihood at logarithms of the shapes and rates and the logit of the weight."""
    a1, b1, a2, b2, w = _natural(x)

    def mixture(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p1, p1a, p1b = _component(k, e, a1, b1)
        p2, p2a, p2b = _component(k, e, a2, b2)
        slope = np.stack([w * p1a, w * p1b, (1 - w) * p2a, (1 - w) * p2b, w * (1 - w) * (p1 - p2)])
        return w * p1 + (1 - w) * p2, slope

    p, slope = mixture(n)
    if least is None:
        return float(-(times * np.log(p + FLOOR)).sum()), -(times * slope / (p + FLOOR)).sum(axis=1)
    rest, rest_slope = np.ones_like(p), np.zeros_like(slope)
    for k in range(least):
        below, below_slope = mixture(np.full_like(n, k))
        rest, rest_slope = rest - below, rest_slope - below_slope
    p, rest = np.maximum(p, 1e-300), np.maximum(rest, 1e-300)
    return float(-(times * np.log(p / rest)).sum()), -(times * (slope / p - rest_slope / rest)).sum(axis=1)


def minimise(objective: Callable, x: np.ndarray, steps: int = STEPS, tolerance: float = 1e-8) -> tuple[np.ndarray, float, str]:
    """Quasi-Newton descent with a backtracking line search."""
    f, g = objective(x)
    h = np.eye(len(x)) / max(np.linalg.norm(g), 1.0)
    for _ in range(steps):
        d = -h @ g
        if d @ g >= 0:
            h = np.eye(len(x)) / max(np.linalg.norm(g), 1.0)
            d = -h @ g
        d = d * min(1.0, 4.0 / max(np.abs(d).max(), 1e-300))
        t = 1.0
        while True:
            nf, ng = objective(x + t * d)
            if np.isfinite(nf) and nf <= f + 1e-4 * t * (g @ d):
                break
            t /= 2
            if t < 1e-12:
                return x, f, "converged: no descent is left"
        s, y = t * d, ng - g
        x, done = x + s, abs(f - nf) <= tolerance * (1 + abs(f)) and np.abs(ng).max() <= 1e-4 * (1 + abs(f))
        f, g = nf, ng
        if done:
            return x, f, "converged"
        if s @ y > 1e-12:
            r = 1 / (s @ y)
            v = np.eye(len(x)) - r * np.outer(s, y)
            h = v @ h @ v.T + r * np.outer(s, s)
    return x, f, f"stopped after {steps} steps"


def _fit(objective: Callable, start: dict, method, bounds, options: dict) -> Fit:
    first = np.array([start[k] for k in ("alpha1", "beta1", "alpha2", "beta2", "w")])
    x = np.concatenate([np.log(first[:4]), [math.log(first[4] / (1 - first[4]))]])
    if callable(method):
        values = tuple(float(v) for v in method(lambda v: objective(_internal(v))[0], first))
        return Fit(values, objective(_internal(values))[0], "by the given method")
    x, f, message = minimise(objective, x, int(options.get("maxiter", STEPS)), float(options.get("tol", 1e-8)))
    values = _natural(x)
    if bounds is not None:
        values = tuple(min(max(v, lo), hi) for v, (lo, hi) in zip(values, bounds, strict=True))
        f = objective(_internal(values))[0]
    if not all(math.isfinite(v) for v in values):
        warnings.warn(f"The fitted prior isn't usable: {values}", stacklevel=2)
    return Fit(values, f, message)


def _internal(values: Sequence[float]) -> np.ndarray:
    w = min(max(values[4], 1e-13), 1 - 1e-13)
    return np.array([*(math.log(max(v, 1e-13)) for v in values[:4]), math.log(w / (1 - w))])


def fit_groups(
    squashed: DataFrame, groups: Sequence[str], start: dict, least: int | None, method, bounds, options: dict
) -> dict[tuple, Fit]:
    """A prior for each group, () without groups."""
    squashed = squashed.cache()
    if groups:
        kinds = ", ".join(f"`{g}` {squashed.schema[g].dataType.simpleString()}" for g in groups)
        schema = f"{kinds}, a1 double, b1 double, a2 double, b2 double, w double, f double, message string"

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            data = (pdf["hits"].to_numpy(), pdf["E"].to_numpy(), pdf["times"].to_numpy(), least)
            fit = _fit(lambda x: value_and_slope(x, *data), start, method, bounds, options)
            return pd.DataFrame([(*key, *fit.values, fit.objective, fit.message)])

        rows = squashed.groupBy(*groups).applyInPandas(run, schema).collect()
        squashed.unpersist()
        k = len(groups)
        return {tuple(r[:k]): Fit(tuple(r[k : k + 5]), r[k + 5], r[k + 6]) for r in rows}
    count = squashed.count()
    if not count:
        squashed.unpersist()
        return {(): Fit(tuple(start[k] for k in ("alpha1", "beta1", "alpha2", "beta2", "w")), None, "no cells")}
    if count <= DRIVER_ROWS:
        pdf = squashed.orderBy("hits", "E").toPandas()
        data = (pdf["hits"].to_numpy(), pdf["E"].to_numpy(), pdf["times"].to_numpy(), least)
        fit = _fit(lambda x: value_and_slope(x, *data), start, method, bounds, options)
    else:
        fit = _fit(lambda x: _distributed(squashed, x, least), start, method, bounds, options)
    squashed.unpersist()
    return {(): fit}


def _distributed(squashed: DataFrame, x: np.ndarray, least: int | None) -> tuple[float, np.ndarray]:
    def part(batches):
        for pdf in batches:
            f, g = value_and_slope(x, pdf["hits"].to_numpy(), pdf["E"].to_numpy(), pdf["times"].to_numpy(), least)
            yield pd.DataFrame([(f, *g)], columns=["f", "g0", "g1", "g2", "g3", "g4"])

    parts = squashed.mapInPandas(part, "f double, g0 double, g1 double, g2 double, g3 double, g4 double")
    row = parts.agg(*[F.sum(c) for c in ("f", "g0", "g1", "g2", "g3", "g4")]).first()
    return row[0], np.array(row[1:])
