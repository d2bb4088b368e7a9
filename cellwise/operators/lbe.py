"""Location based estimate of the share of true null hypotheses, and false discovery rates."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwise.operators.ordering import join_groups, magnitude
from cellwise.sources.shared import small_table

BOUND = 0.05


def _spread(a: float) -> float:
    """m times the variance bound of the estimate with exponent a."""
    return math.exp(math.lgamma(2 * a + 1) - 2 * math.lgamma(a + 1)) - 1


def exponent(m: int, bound: float = BOUND) -> float:
    """The exponent a >= 1 at which the standard deviation's bound for m p-values reaches ``bound``."""
    if m <= 0 or _spread(1.0) >= m * bound * bound:
        return 1.0
    low, high = 1.0, 2.0
    while _spread(high) < m * bound * bound:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _spread(middle) < m * bound * bound else (low, middle)
    return (low + high) / 2


def null_shares(rows: DataFrame, p: str, groups: Sequence[str] = (), skip_null: bool = False) -> DataFrame:
    """``pi0, m`` by group from one-sided p-values, taken two-sided.

    The exponent depends on m alone, so one small aggregate comes first. A null p
    makes pi0 1 for its group, unless ``skip_null``. No p-values give no row.
    """
    spark = rows.sparkSession
    used = rows.filter(F.col(p).isNotNull()) if skip_null else rows
    counts = used.groupBy(*groups).agg(F.count(F.lit(1)).alias("m")).collect()
    kinds = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in groups)
    table = []
    for r in counts:
        a = exponent(r["m"])
        table.append((*[r[g] for g in groups], r["m"], a, math.gamma(a + 1)))
    known = small_table(spark, table, (kinds + ", " if kinds else "") + "m bigint, a double, gamma_a double")
    two = 2 * F.least(F.col(p), 1 - F.col(p))
    joined = used.select(*groups, F.when(F.col(p).isNotNull(), two).alias("_p"))
    joined = joined.join(F.broadcast(known), list(groups)) if groups else joined.crossJoin(F.broadcast(known))
    # ln(0) would be null and drop out of the mean, where it has to make it infinite.
    part = F.when(F.col("_p") >= 1, F.lit(math.inf)).otherwise(F.pow(-F.log1p(-F.col("_p")), F.col("a")))
    mean = F.avg(part / F.col("gamma_a"))
    return joined.groupBy(*groups).agg(
        F.when(F.count("_p") < F.count(F.lit(1)), F.lit(1.0)).otherwise(F.least(F.lit(1.0), mean)).alias("pi0"),
        F.max("m").alias("m"),
    )


def rank_rates(rows: DataFrame, p: str, groups: Sequence[str] = ()) -> DataFrame:
    """Adds ``fdr`` to rows with ``rank`` (by p), ``pi0``, ``m`` and ``k``, the number of p-values up to 0.5."""
    rank, m, k = F.col("rank"), F.col("m"), F.col("k")
    near = F.col("pi0") * F.col(p) * m / rank
    j = rank - 1  # zero-based place behind the first k
    far = F.when(j > 0, F.col("pi0") * m / (2 * j) + 1 - k / j)
    rate = F.when(rank <= k, near).otherwise(far)
    return rows.withColumn("fdr", F.when(rate <= 1, rate).when(rate > 1, 1.0))


@dataclass(frozen=True)
class Lbe:
    """Result of ``lbe``."""

    fdr: float | None
    pi0: float
    icpi0: tuple[float, float]
    ci_level: float
    a: float | None
    sdbound: float
    values: DataFrame  # p, rank (from 0, ties averaged), q
    significant: DataFrame
    count: int


def lbe(
    pvals: DataFrame,
    column: str = "p",
    a: float | None = None,
    bound: float = BOUND,
    ci_level: float = 0.95,
    fdr_level: float = 0.05,
    n_significant: int | None = None,
) -> Lbe:
    """Share of null hypotheses, q-values and significance of p-values in a column.

    q-values are the least of pi0 * m * p / rank over this and all larger p-values.
    Ranks are taken over distinct values in ordered buckets, so the p-values are never
    in one task, however many are equal.
    """
    p = F.col(column)
    about = pvals.agg(F.min(column), F.max(column), F.count(F.lit(1)), F.avg(column)).first()
    if not about[2]:
        raise ValueError("no p-values")
    if about[0] < 0 or about[1] > 1:
        raise ValueError("p-values must lie between 0 and 1")
    m = about[2]
    quantile = _normal_quantile(1 - ci_level)
    if a is not None and a < 1:
        a, sd = None, math.sqrt(1 / (3 * m))
        pi0 = min(1.0, 2 * about[3])
        bounds = (0.0, pi0 - quantile * sd)
    else:
        a = exponent(m, bound) if a is None else a
        sd = math.sqrt(_spread(a) / m)
        part = F.when(p >= 1, F.lit(math.inf)).otherwise(F.pow(-F.log1p(-p), F.lit(a)))
        pi0 = min(1.0, pvals.agg(F.avg(part)).first()[0] / math.gamma(a + 1))
        bounds = (0.0, min(1.0, pi0 - quantile * sd))
    if sd > 0.5:
        warnings.warn(f"The standard deviation's bound is {sd:.3g}; a smaller exponent is advisable.", stacklevel=2)
    single = pvals.groupBy(p.alias("p")).agg(F.count(F.lit(1)).alias("_ties")).withColumn("_b", magnitude(F.col("p")))
    counts = single.groupBy("_b").agg(F.sum("_ties").alias("_n"))
    up = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(up), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_b").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = single.join(counts, "_b").withColumn("_last", F.col("_before") + F.sum("_ties").over(inside))
    ranked = ranked.withColumn("rank", F.col("_last") - (F.col("_ties") + 1) / 2)
    ranked = ranked.withColumn("_raw", F.lit(pi0 * m) * F.col("p") / F.col("_last"))
    later = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    lows = ranked.groupBy("_b").agg(F.min("_raw").alias("_low"))
    lows = lows.withColumn("_next", F.min("_low").over(later)).drop("_low")
    from_here = Window.partitionBy("_b").orderBy("p").rowsBetween(0, Window.unboundedFollowing)
    q = F.least(F.min("_raw").over(from_here), F.coalesce("_next", F.lit(math.inf)), F.lit(1.0))
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_ties")))
    values = ranked.join(lows, "_b").select("p", "rank", q.alias("q"), "_ties").select("p", "rank", "q", each.alias("_copy")).drop("_copy")
    if n_significant is not None:
        fdr = values.orderBy("p").limit(n_significant + 1).agg(F.max("q")).first()[0]
        count = n_significant
    else:
        found = values.filter(F.col("q") <= fdr_level).agg(F.max("q"), F.count(F.lit(1))).first()
        fdr, count = (found[0] if found[1] else 0.0), found[1]
    return Lbe(fdr, pi0, bounds, ci_level, a, sd, values, values.filter(F.col("q") <= (fdr or 0.0)), count)


def _normal_quantile(p: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 0.5 * math.erfc(-middle / math.sqrt(2)) < p else (low, middle)
    return (low + high) / 2


def with_rates(
    rows: DataFrame, p: str, groups: Sequence[str], reference_order: bool, ranked: DataFrame
) -> DataFrame:
    """Adds ``fdr`` to ``rows``; ``ranked`` is ``rows`` with ``rank``.

    In the reference order the i-th rate goes to the i-th row in data order (``pos``);
    otherwise each rate goes to its own row.
    """
    shares = null_shares(rows, p, groups, skip_null=not reference_order)
    below = rows.groupBy(*groups).agg(F.count_if(F.col(p) <= 0.5).alias("k"))
    known = join_groups(shares, below, groups)
    rated = rank_rates(join_groups(ranked, known, groups), p, groups)
    if not reference_order:
        return rated.withColumn("fdr", F.when(F.col(p).isNotNull(), F.col("fdr"))).drop("rank", "pi0", "m", "k")
    by_place = rated.select(*groups, F.col("rank").alias("pos"), "fdr")
    return rows.join(by_place, [*groups, "pos"])
