"""Information component (closed form and Monte Carlo) and the gamma-Poisson shrinker."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.functions.numeric import digamma as digamma_of
from cellwise.functions.numeric import gamma_p, mixture_quantile, normal_cdf, trigamma
from cellwise.functions.special import Z975, digamma, ln_nbinom
from cellwise.operators import prior
from cellwise.operators.cells import Cells, scored
from cellwise.operators.expected import MARGINS, fitted
from cellwise.operators.ordering import join_groups, running
from cellwise.operators.result import Signals, check_options, first_signals, signal_counts
from cellwise.sources.shared import small_table, staged

LN2 = math.log(2)
#: Simulated tables that a task holds at a time.
DRAWN = 1_000_000


def with_error_rates(rows: DataFrame, groups: Sequence[str], reversed_sums: bool, reference: bool) -> DataFrame:
    """Adds ``fdr, FNR, Se, Sp`` from ``post``, the posterior probability of the null hypothesis.

    In the reference order sums run in data order, and with ``reversed_sums`` those of
    FNR and Sp are read from the other end. Otherwise they run from the least posterior up,
    and FNR and Sp are those of the cells that are left.
    """
    sums = {"pos": F.lit(1), "_post": F.col("post"), "_rest": 1 - F.col("post")}
    if reference:
        rows = running(rows, groups, "ae_name", [F.col("product_name")], sums)
    else:
        rows = rows.withColumn("_bucket", (F.col("post") * 4096).cast("int"))
        order = [F.col("post"), F.col("ae_name"), F.col("product_name")]
        rows = running(rows, groups, "_bucket", order, sums).drop("_bucket")
    totals = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_m"), F.sum("post").alias("_all_post"), F.sum(1 - F.col("post")).alias("_all_rest")
    )
    rows = join_groups(rows, totals, groups)
    fnr, sp = F.col("_rest"), F.col("_post")
    if not reference:
        fnr, sp = F.col("_all_rest") - F.col("_rest"), F.col("_all_post") - F.col("_post")
    elif reversed_sums:
        # The value at place i is the running sum at place m + 1 - i.
        mirror = rows.select(
            *groups, (F.col("_m") + 1 - F.col("pos")).alias("pos"), F.col("_rest").alias("_r"), F.col("_post").alias("_p")
        )
        rows = rows.join(mirror, [*groups, "pos"])
        fnr, sp = F.col("_r"), F.col("_p")
    made = rows.withColumns(
        {
            "fdr": F.col("_post") / F.col("pos"),
            # Behind the last cell none is left, whatever the rounding of the sums.
            "FNR": F.when(F.lit(reference) | (F.col("pos") < F.col("_m")), fnr / (F.col("_m") - F.col("pos") + 1e-7)).otherwise(0.0),
            "Se": F.try_divide(F.col("_rest"), F.col("_all_rest")),
            "Sp": F.try_divide(sp, F.col("_m") - F.col("_all_rest")),
        }
    )
    return made.drop("_post", "_rest", "_m", "_all_post", "_all_rest", "_r", "_p")


def _columns(groups: Sequence[str], statistic: str, name: str, more: dict[str, str] | None = None) -> list[Column]:
    return [
        *[F.col(g) for g in groups],
        F.col("product_name").alias("Product"),
        F.col("ae_name").alias("Adverse Event"),
        F.col("n11").alias("Count"),
        F.col("E").alias("Expected Count"),
        F.col(statistic).alias(name),
        (F.col("n11") / F.col("E")).alias("count/expected"),
        F.col("n1j").alias("product margin"),
        F.col("ni1").alias("event margin"),
        *[F.col(c) for c in ("fdr", "FNR", "Se", "Sp")],
        *[F.col(c).alias(n) for n, c in (more or {}).items()],
    ]


def _information_component(rows: DataFrame, relative_risk: float) -> DataFrame:
    """``post`` and ``lower`` in closed form.

    On arrays: as columns the functions become methods too long for the JVM to compile, and are interpreted.
    """
    threshold = math.log(relative_risk)

    @F.pandas_udf("struct<post:double,lower:double>")
    def component(n11: pd.Series, n1j: pd.Series, ni1: pd.Series, n: pd.Series) -> pd.DataFrame:
        p1, q1, r1, pq = (1 + n1j).to_numpy(), (1 + ni1).to_numpy(), (1 + n11).to_numpy(), (2 + n).to_numpy()
        with np.errstate(all="ignore"):
            rr = r1 + (n.to_numpy() - n11.to_numpy() - 1 + pq * pq / (q1 * p1))
            known = np.minimum.reduce([p1, q1, r1, rr, pq]) > 0
            ic = (digamma_of(r1) - digamma_of(rr) - (digamma_of(p1) + digamma_of(q1) - 2 * digamma_of(pq))) / LN2
            spread = trigamma(r1) - trigamma(rr) + trigamma(p1) + trigamma(q1) - 2 * trigamma(pq)
            sd = np.sqrt(np.maximum(spread, 0.0)) / LN2
            z = np.where(known & (sd > 0), (threshold - ic) / sd, np.nan)
            # NaN becomes null.
            return pd.DataFrame({"post": normal_cdf(z), "lower": np.where(known, ic - Z975 * sd, np.nan)})

    made = rows.withColumn("_s", component("n11", "n1j", "ni1", "N"))
    return made.withColumns({"post": F.col("_s.post"), "lower": F.col("_s.lower")}).drop("_s")


def _simulated(rows: DataFrame, relative_risk: float, draws: int, seed: int) -> DataFrame:
    """``post`` and ``lower`` from Dirichlet draws, DRAWN at a time for all cells of a batch.

    A cell's draws depend on the seed, its product, event and counts only, not on where it is computed.
    """
    threshold = math.log(relative_risk)

    @F.pandas_udf("struct<post:double,lower:double>")
    def simulate(key: pd.Series, n11: pd.Series, n1j: pd.Series, ni1: pd.Series, n: pd.Series) -> pd.DataFrame:
        a, b, c, total = (np.asarray(v, float) for v in (n11, n1j, ni1, n))
        pj, pi = (b + 0.5) / (total + 1), (c + 0.5) / (total + 1)
        qj, qi = (total - b + 0.5) / (total + 1), (total - c + 0.5) / (total + 1)
        shares = np.stack([pj * pi, pj * qi, qj * pi, qj * qi], 1)
        alpha = np.maximum(0.5 / (pj * pi)[:, None] * shares + np.stack([a, b - a, c - a, total - b - c + a], 1), 1e-9)
        out = np.empty((len(a), 2))
        step = max(1, DRAWN // draws)
        for at in range(0, len(a), step):
            part = slice(at, at + step)
            # Gamma draws over their sum are Dirichlet draws.
            g = np.stack([
                np.random.Generator(np.random.Philox(key=int(k) % (1 << 64))).standard_gamma(x, (draws, 4))
                for k, x in zip(key.iloc[part], alpha[part], strict=True)
            ])
            first, all_four = g[:, :, 0], g.sum(2)
            ic = np.log(first * all_four / ((first + g[:, :, 1]) * (first + g[:, :, 2])))
            out[part, 0] = (ic < threshold).mean(1)
            place = min(draws - 1, round(0.025 * draws))
            out[part, 1] = np.partition(ic, place, axis=1)[:, place]
        return pd.DataFrame(out, columns=["post", "lower"])

    key = F.xxhash64(F.lit(seed), "product_name", "ae_name", "n11", "n1j", "ni1", "N")
    made = rows.withColumn("_s", simulate(key, "n11", "n1j", "ni1", "N"))
    return made.withColumns({"post": F.col("_s.post"), "lower": F.col("_s.lower")}).drop("_s")


def bcpnn(
    container: Cells,
    relative_risk: float = 1,
    min_events: float = 1,
    decision_metric: str = "rank",
    decision_thres: float = 0.05,
    ranking_statistic: str = "quantile",
    MC: bool = False,
    num_MC: int = 10_000,
    expected_method: str = MARGINS,
    method_alpha: float = 1,
    semantics: str = "reference",
    seed: int = 0,
) -> Signals:
    """Bayesian confidence propagation: information component, its posterior and lower bound.

    ``signals`` holds the cells whose statistic passes the threshold, whatever the
    decision metric; the count follows the metric, less one in the reference semantics.
    """
    check_options(decision_metric, semantics)
    if ranking_statistic not in ("p_value", "quantile"):
        raise ValueError("ranking_statistic must be 'p_value' or 'quantile'")
    groups, reference = container.groups, semantics == "reference"
    rows = fitted(scored(container, min_events), expected_method, method_alpha, groups)
    rows = _simulated(rows, relative_risk, int(num_MC), seed) if MC else _information_component(rows, relative_risk)
    rows = staged(rows.select(*groups, "ae_name", "product_name", "n11", "n1j", "ni1", "E", "post", "lower"))
    rows = with_error_rates(rows, groups, True, reference)
    by_p = ranking_statistic == "p_value"
    stat = "post" if by_p else "lower"
    counts = signal_counts(rows, groups, decision_metric, decision_thres, stat, not by_p, less=int(reference))
    columns = _columns(groups, stat, ranking_statistic)
    passing = F.col(stat) <= decision_thres if by_p else F.col(stat) >= decision_thres
    params = dict(model="bcpnn", relative_risk=relative_risk, min_events=min_events, MC=MC, num_MC=num_MC, seed=seed)
    return Signals(rows.select(*columns), rows.filter(passing).select(*columns), counts, params, groups, ranking_statistic, not by_p)


def gps(
    container: Cells,
    relative_risk: float = 1,
    min_events: float = 1,
    decision_metric: str = "rank",
    decision_thres: float = 0.05,
    ranking_statistic: str = "log2",
    truncate: bool = False,
    truncate_thres: int = 1,
    prior_init: dict[str, float] | None = None,
    prior_param: Sequence[float] | None = None,
    expected_method: str = MARGINS,
    method_alpha: float = 1,
    minimization_method: str | Callable = "L-BFGS",
    minimization_bounds: Sequence[tuple[float, float]] | None = None,
    minimization_options: dict | None = None,
    semantics: str = "reference",
) -> Signals:
    """Gamma-Poisson shrinker with a prior of two gamma distributions.

    The prior (alpha1, beta1, alpha2, beta2, w) is ``prior_param`` where given, or else
    fitted by group to squashed counts (see ``cellwise.operators.prior``);
    ``minimization_method`` may be a callable ``(objective, start) -> parameters``.
    """
    check_options(decision_metric, semantics)
    if ranking_statistic not in ("p_value", "quantile", "log2"):
        raise ValueError("ranking_statistic must be 'p_value', 'quantile' or 'log2'")
    groups, reference = container.groups, semantics == "reference"
    start = prior.START | (prior_init or {})
    # The expected counts are those of all cells; rare ones go afterwards.
    every = fitted(scored(container), expected_method, method_alpha, groups)
    if prior_param is not None:
        values = prior_param.values() if isinstance(prior_param, dict) else prior_param
        fits = {(): prior.Fit(tuple(float(v) for v in values), None, "given")}
    else:
        options = dict(minimization_options or {})
        squashed = prior.squash(container, every, truncate, truncate_thres)
        fits = prior.fit_groups(squashed, groups, start, truncate_thres if truncate else None, minimization_method,
                                minimization_bounds, options)
    rows = every.filter(F.col("n11") >= min_events) if min_events > 1 else every
    rows = _shrunk(rows, groups, fits, relative_risk)
    by_p = ranking_statistic == "p_value"
    rows = staged(rows.select(*groups, "ae_name", "product_name", "n11", "n1j", "ni1", "E", "post", "lower", "eb_log2"))
    rows = with_error_rates(rows, groups, not by_p, reference)
    stat = {"p_value": "post", "quantile": "lower", "log2": "eb_log2"}[ranking_statistic]
    counts = signal_counts(rows, groups, decision_metric, decision_thres, stat, not by_p, less=int(reference))
    more = {"p_value": {}, "quantile": {"posterior_probability": "post"}, "log2": {"LowerBound": "lower", "p_value": "post"}}
    columns = _columns(groups, stat, ranking_statistic, more[ranking_statistic])
    chosen = first_signals(rows, counts, groups, stat, not by_p)
    params = dict(model="gps", relative_risk=relative_risk, min_events=min_events, prior_init=start, truncate=truncate,
                  prior_param={k: f.values for k, f in fits.items()} if groups else fits.get((), prior.Fit((), None, "no cells")).values,
                  convergence={k: f.message for k, f in fits.items()})
    return Signals(rows.select(*columns), chosen.select(*columns), counts, params, groups, ranking_statistic, not by_p)


def _shrunk(rows: DataFrame, groups: Sequence[str], fits: dict, relative_risk: float) -> DataFrame:
    """``post, lower, eb_log2`` of each cell."""
    kinds = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in groups)
    names = ("a1", "b1", "a2", "b2", "w")
    if () in fits:
        rows = rows.withColumns({n: F.lit(v) for n, v in zip(names, fits[()].values, strict=True)})
        a1, b1, a2, b2, _ = fits[()].values
        log1, log2 = ln_nbinom("n11", a1, b1, "E"), ln_nbinom("n11", a2, b2, "E")
        rows = rows.withColumns({"l1": log1, "l2": log2})
    else:
        table = [(*k, *f.values) for k, f in fits.items()]
        schema = (kinds + ", " if kinds else "") + ", ".join(f"{n} double" for n in names)
        rows = join_groups(rows, F.broadcast(small_table(rows.sparkSession, table, schema)), groups)
        rows = rows.withColumns({f"l{i}": _ln_nbinom(f"a{i}", f"b{i}") for i in (1, 2)})
    ratio = (1 - F.col("w")) / F.col("w") * F.exp(F.col("l2") - F.col("l1"))
    rows = rows.withColumn("q", F.when(F.col("w") > 0, 1 / (1 + ratio)).otherwise(0.0))
    rows = rows.withColumns({f"s{i}": F.col(f"a{i}") + F.col("n11") for i in (1, 2)} | {f"t{i}": F.col(f"b{i}") + F.col("E") for i in (1, 2)})
    q = F.col("q")
    eb = q * (digamma("s1") - F.ln("t1")) + (1 - q) * (digamma("s2") - F.ln("t2"))

    @F.pandas_udf("struct<post:double,lower:double>")
    def tail(q: pd.Series, s1: pd.Series, t1: pd.Series, s2: pd.Series, t2: pd.Series) -> pd.DataFrame:
        post = q * gamma_p(s1, relative_risk * t1) + (1 - q) * gamma_p(s2, relative_risk * t2)
        return pd.DataFrame({"post": post, "lower": mixture_quantile(0.05, q, s1, t1, s2, t2)})

    rows = rows.withColumn("_t", tail("q", "s1", "t1", "s2", "t2"))
    return rows.withColumns({"eb_log2": eb / LN2, "post": F.col("_t.post"), "lower": F.col("_t.lower")}).drop("_t")


def _ln_nbinom(size: str, beta: str) -> Column:
    """ln of the negative binomial probability up to terms that both components share."""
    from cellwise.functions.special import lgamma

    a, b, n, e = F.col(size), F.col(beta), F.col("n11"), F.col("E")
    return lgamma(n + a) - lgamma(a) + a * F.ln(b / (b + e)) + n * F.ln(e / (b + e))
