"""L1-penalised regression of each event on product indicators, from sufficient statistics.

All fits need only n, the sums of the products, their co-occurrence and their sums
with each event, which one pass over distinct report patterns gives. Events are then
fitted side by side. The co-occurrence matrix goes to every task, so the number of
products is bounded (MAX_PRODUCTS); ``wide_lasso`` fits wider designs with Spark's own
distributed solver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.operators.binary import BinaryDesign
from cellwise.operators.result import Signals
from cellwise.sources.shared import small_table

MAX_PRODUCTS = 2_000
#: Distinct patterns that bootstrap and count models read at a time, on each task.
MAX_PATTERNS = 1_000_000
PASSES, TOLERANCE = 10_000, 1e-10


def coordinate_descent(gram: np.ndarray, xy: np.ndarray, penalty: float, start: np.ndarray | None = None) -> np.ndarray:
    """Minimises w'Gw/2 - w'xy + penalty |w|_1 for a centred Gram matrix and cross product, both over n."""
    w = np.zeros(len(xy)) if start is None else start.copy()
    slope = xy - gram @ w
    for _ in range(PASSES):
        most = 0.0
        for j in range(len(w)):
            if gram[j, j] <= 0:
                continue
            part = slope[j] + gram[j, j] * w[j]
            new = math.copysign(max(abs(part) - penalty, 0.0), part) / gram[j, j]
            if new != w[j]:
                slope -= gram[:, j] * (new - w[j])
                most = max(most, abs(new - w[j]))
                w[j] = new
        if most < TOLERANCE:
            break
    return w


def information_path(gram: np.ndarray, xy: np.ndarray, yy: float, n: float, criterion: str) -> np.ndarray:
    """The coefficients of least AIC or BIC along the path of penalties.

    The noise variance is that of the least squares fit, n yy / (n - p - 1); the criterion
    is n ln(2 pi s2) + RSS / s2 + k d for d coefficients other than 0, k = 2 or ln n. The
    penalties are those of a fine geometric grid, each fit starting from the last.
    """
    p = len(xy)
    least, *_ = np.linalg.lstsq(gram, xy, rcond=None)
    rss = lambda w: max(n * (yy - 2 * w @ xy + w @ gram @ w), 0.0)
    noise = max(rss(least) / max(n - p - 1, 1.0), 1e-300)
    k = 2.0 if criterion == "aic" else math.log(n)
    best, lowest, w = np.zeros(p), math.inf, np.zeros(p)
    top = np.abs(xy).max(initial=0.0)
    for penalty in [*np.geomspace(max(top, 1e-12), max(top, 1e-12) * 1e-4, 100), 0.0]:
        w = coordinate_descent(gram, xy, penalty, w)
        value = n * math.log(2 * math.pi * noise) + rss(w) / noise + k * np.count_nonzero(np.abs(w) > 1e-12)
        if value < lowest - 1e-12:
            best, lowest = w.copy(), value
    return best


def count_model(x: np.ndarray, y: np.ndarray, rows: np.ndarray, alpha: float, penalty: float) -> np.ndarray:
    """Negative binomial regression (log link, no intercept) with an L1 penalty on the mean loss, by proximal steps."""
    n, w = rows.sum(), np.zeros(x.shape[1])
    for _ in range(100):
        eta = np.clip(x @ w, -30, 30)
        mu = np.exp(eta)
        weight = rows * mu / (1 + alpha * mu) / n
        z = eta + (y - mu) / mu
        new = coordinate_descent((x * weight[:, None]).T @ x, x.T @ (weight * z), penalty, w)
        done = np.abs(new - w).max(initial=0.0) < 1e-8
        w = new
        if done:
            break
    return w


def lasso(
    design: BinaryDesign,
    lasso_thresh: float = 0,
    alpha: float = 0.5,
    min_events: float = 3,
    num_bootstrap: int = 10,
    ci: float = 95,
    use_lars: bool = False,
    use_IC: bool = False,
    IC_criterion: str = "bic",
    lasso_kwargs: dict | None = None,
    use_glm: bool = False,
    nb_alpha: float = 1,
    lasso_alpha: float = 1e-9,
    seed: int = 0,
) -> Signals:
    """Coefficients of all products for each event, with bootstrap intervals.

    ``use_lars`` finds the same optimum as the default; ``use_IC`` chooses the penalty.
    A bootstrap sample draws multinomial row numbers for the distinct patterns. Events
    with fewer than ``min_events`` have zeros. Count models have no interval (zeros) and
    no negative coefficients. ``lasso_kwargs`` may hold ``fit_intercept`` and ``positive``.
    """
    if IC_criterion not in ("aic", "bic"):
        raise ValueError("IC_criterion must be 'aic' or 'bic'")
    options = dict(lasso_kwargs or {})
    centre, positive = options.get("fit_intercept", True), options.get("positive", False)
    patterns = design.patterns
    names = [r[0] for r in patterns.select(F.explode("products.product")).distinct().orderBy("col").limit(MAX_PRODUCTS + 1).collect()]
    if len(names) > MAX_PRODUCTS:
        raise ValueError(f"more than {MAX_PRODUCTS} products; use wide_lasso")
    spark = patterns.sparkSession
    # Product sets with the outcomes of every event; events meet each set once.
    sets = patterns.groupBy("products").agg(F.sum("rows").alias("rows"))
    held = sets.limit(MAX_PATTERNS + 1).collect()
    if len(held) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} distinct product sets; use wide_lasso")
    held.sort(key=lambda r: str(r["products"]))
    index = {p: i for i, p in enumerate(names)}
    x = np.zeros((len(held), len(names)))
    for i, r in enumerate(held):
        for p in r["products"]:
            x[i, index[p["product"]]] = p["x"]
    place = {tuple((p["product"], p["x"]) for p in r["products"]): i for i, r in enumerate(held)}
    shared = spark.sparkContext.broadcast((x, np.array([float(r["rows"]) for r in held]), place, names))

    def fit(x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
        n = rows.sum()
        mx, my = (rows @ x / n, rows @ y / n) if centre else (0.0, 0.0)
        cx = x - mx
        gram, xy = (cx * rows[:, None]).T @ cx / n, cx.T @ (rows * (y - my)) / n
        if use_IC:
            w = information_path(gram, xy, float(rows @ (y - my) ** 2 / n), n, IC_criterion)
        else:
            w = coordinate_descent(gram, xy, alpha)
        return np.maximum(w, 0) if positive else w

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, total, place, names = shared.value
        # A set's rows without this event are rows of outcome 0.
        at = [place[tuple((p["product"], p["x"]) for p in s)] for s in pdf["products"]]
        rest = total.copy()
        np.subtract.at(rest, at, pdf["rows"].to_numpy(float))
        xs = np.vstack([x[at], x])
        y = np.concatenate([pdf["y"].to_numpy(float), np.zeros(len(x))])
        rows = np.concatenate([pdf["rows"].to_numpy(float), np.maximum(rest, 0)])
        low = high = w = np.zeros(len(names))
        if (rows * y).sum() >= min_events:
            if use_glm:
                w = np.clip(count_model(xs, y, rows, nb_alpha, lasso_alpha), 0, None)
            else:
                w = fit(xs, y, rows)
                random = np.random.default_rng([seed, *key[0].encode()])
                n = int(rows.sum())
                draws = [fit(xs, y, random.multinomial(n, rows / rows.sum()).astype(float)) for _ in range(num_bootstrap)]
                if draws:
                    low, high = np.percentile(draws, [(100 - ci) / 2, 100 - (100 - ci) / 2], axis=0)
        return pd.DataFrame({"Product": names, "Adverse Event": key[0], "LASSO Coefficient": w, "CI Lower": low, "CI Upper": high})

    schema = "Product string, `Adverse Event` string, `LASSO Coefficient` double, `CI Lower` double, `CI Upper` double"
    outcomes = patterns.groupBy("ae", "products", "y").agg(F.sum("rows").alias("rows"))
    found = outcomes.groupBy("ae").applyInPandas(run, schema)
    signals = found.filter(F.col("LASSO Coefficient") > lasso_thresh)
    counts = signals.agg(F.count(F.lit(1)).alias("num_signals"))
    return Signals(found, signals, counts, dict(model="lasso", alpha=alpha, min_events=min_events, num_bootstrap=num_bootstrap),
                   statistic="LASSO Coefficient", descending=True)


def wide_lasso(design: BinaryDesign, alpha: float = 0.5, min_events: float = 3) -> Iterator[tuple[str, DataFrame]]:
    """``(event, Product and LASSO Coefficient)`` by Spark's distributed solver, for designs of any width."""
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.regression import LinearRegression

    rows = design.patterns.select(F.flatten(F.transform("products", lambda p: F.array_repeat(p["product"], p["x"].cast("int")))).alias("words"), "ae", "y", "rows")
    vector = CountVectorizer(inputCol="words", outputCol="features", minDF=1.0).fit(rows)
    data = vector.transform(rows).withColumn("weight", F.col("rows").cast("double")).cache()
    totals = data.groupBy("ae").agg(F.sum(F.col("y") * F.col("rows")).alias("n")).filter(F.col("n") >= min_events)
    solver = LinearRegression(elasticNetParam=1.0, regParam=alpha, standardization=False, weightCol="weight", tol=1e-10, maxIter=1000)
    for r in totals.orderBy("ae").toLocalIterator():
        model = solver.fit(data.withColumn("label", F.when(F.col("ae") == r["ae"], F.col("y")).otherwise(0).cast("double")))
        table = [(p, float(c)) for p, c in zip(vector.vocabulary, model.coefficients, strict=True)]
        yield r["ae"], small_table(data.sparkSession, table, "Product string, `LASSO Coefficient` double")
