"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.operators import bayes, binary, cells, expected, ratios
from cellwise.operators.lasso import lasso
from cellwise.operators.longitudinal import LongitudinalModel
from cellwise.operators.lbe import lbe
from cellwise.operators.ordering import with_position
from cellwise.plans import oracle as O
from cellwise.plans import views
from cellwise.plans.rounding import rounded

Query = Callable[[SparkSession, str], DataFrame]


def _cells(view: Callable, **options) -> Callable[[SparkSession, str], cells.Cells]:
    return lambda spark, sf_dir: cells.convert(view(spark, sf_dir), **options)


def _signals(model: Callable, view: Callable, which: str = "all_signals", **options) -> Query:
    return lambda spark, sf_dir: rounded(getattr(model(cells.convert(view(spark, sf_dir)), **options), which))


def _q_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.convert(views.user_event(spark, sf_dir), margin_threshold=10).data


def _q_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.contingency_table(views.name_size(spark, sf_dir), margin_threshold=100)


def _q_expected_mh(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = expected.calculate_expected(_cells(views.brand_quantity)(spark, sf_dir))
    return rounded(found.select("product_name", "ae_name", "n11", "E"))


def _q_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_position(cells.convert(views.name_size(spark, sf_dir)).data).select("ae_name", "product_name", "pos")


def _expected(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = expected.calculate_expected(_cells(views.name_size)(spark, sf_dir), method, 1.0)
        return rounded(found.select("product_name", "ae_name", "n11", "E"), 4)

    return run


def _q_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(expected.dispersion_table(_cells(views.name_size)(spark, sf_dir)), 4)


def _long(model: Callable, view: Callable, unit: str, cumulative: bool, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        slices = LongitudinalModel(view(spark, sf_dir), unit)
        found = (slices.run if cumulative else slices.run_disjoint)(model, include_gaps=False, **options)
        return rounded(found.all_signals.withColumn("slice_ts", F.date_format("slice_ts", "yyyy-MM-dd")))

    return run


def _q_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = binary.convert_binary(views.multi(spark, sf_dir), ["name", "name2"]).patterns
    return found.select(F.concat_ws("|", "products.product").alias("products"), "ae", "y", "rows")


def _q_binary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = binary.convert_binary(views.multi(spark, sf_dir), ["name", "name2"], use_counts=True).patterns
    return found.select(F.concat_ws("|", "products.product").alias("products"), "ae", "y")


def _q_multi_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.convert_multi_item(views.multi(spark, sf_dir), ["name", "name2"]).data


def _q_multi_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.convert_multi_item(views.multi(spark, sf_dir), ["name", "name2"]).totals


def _lasso(**options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        design = binary.convert_binary(views.brand_flag(spark, sf_dir))
        return rounded(lasso(design, **options).all_signals)

    return run


def _q_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bayes.bcpnn(_cells(views.user_event)(spark, sf_dir)).ranked()
    return rounded(found.select("index", "Product", "Adverse Event", "quantile"))


def _q_lbe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ratios.prr(_cells(views.brand_quantity)(spark, sf_dir)).all_signals
    result = lbe(found, "p_value")
    return rounded(result.values.select("*", F.lit(result.pi0).alias("pi0"), (F.col("q") <= result.fdr).alias("significant")))


def _q_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years without reports between years with some."""
    even = views.brand_quantity(spark, sf_dir).filter(F.year("date") % 2 == 0)
    found = LongitudinalModel(even, "YE").run_disjoint(bayes.bcpnn, include_gaps=True)
    return rounded(found.all_signals.withColumn("slice_ts", F.date_format("slice_ts", "yyyy-MM-dd")))


PRIOR = dict(zip(("alpha1", "beta1", "alpha2", "beta2", "w"), O.PRIOR, strict=True))


def queries() -> dict[str, Query]:
    """One entry for each operator and its variants."""
    return {
        "cells": _q_cells,
        "contingency": _q_contingency,
        "cell_position": _q_position,
        "expected_mh": _q_expected_mh,
        "expected_poisson": _expected("poisson"),
        "expected_nb": _expected("negative-binomial"),
        "dispersion": _q_dispersion,
        "prr": _signals(ratios.prr, views.name_size),
        "prr_flags": _signals(ratios.prr, views.flags),
        "prr_ci": _signals(ratios.prr, views.name_size, ranking_statistic="CI", decision_metric="rank", decision_thres=0.5),
        "prr_signals": _signals(ratios.prr, views.name_size, "signals", decision_metric="rank", decision_thres=0.05),
        "prr_min_events": _signals(ratios.prr, views.name_size, min_events=20),
        "ror": _signals(ratios.ror, views.brand_quantity),
        "ror_signals": _signals(ratios.ror, views.name_size, "signals", decision_metric="signals", decision_thres=0.01),
        "rfet": _signals(ratios.rfet, views.brand_quantity),
        "rfet_mid": _signals(ratios.rfet, views.brand_quantity, mid_pval=True),
        "bcpnn": _signals(bayes.bcpnn, views.user_event),
        "bcpnn_p": _signals(bayes.bcpnn, views.name_size, ranking_statistic="p_value"),
        "bcpnn_signals": _signals(bayes.bcpnn, views.name_size, "signals"),
        "bcpnn_mc": _signals(bayes.bcpnn, views.flags, MC=True, seed=7),
        "gps": _signals(bayes.gps, views.name_size, ranking_statistic="p_value", prior_param=list(O.PRIOR)),
        "gps_log2": _signals(bayes.gps, views.user_event, prior_param=list(O.PRIOR)),
        "gps_quantile": _signals(bayes.gps, views.name_size, "signals", ranking_statistic="quantile", prior_param=list(O.PRIOR)),
        "prr_corrected": _signals(ratios.prr, views.name_size, semantics="corrected"),
        "prr_rr": _signals(ratios.prr, views.name_size, relative_risk=1.5),
        "ror_fdr": _signals(ratios.ror, views.name_size, "signals", decision_metric="fdr", decision_thres=0.05, semantics="corrected"),
        "rfet_signals": _signals(ratios.rfet, views.name_size, "signals", decision_metric="signals", decision_thres=0.01),
        "bcpnn_corrected": _signals(bayes.bcpnn, views.user_event, semantics="corrected"),
        "bcpnn_rr": _signals(bayes.bcpnn, views.name_size, relative_risk=2),
        "bcpnn_ranked": _q_ranked,
        "gps_rr": _signals(bayes.gps, views.name_size, ranking_statistic="p_value", prior_param=list(O.PRIOR), relative_risk=2),
        "lbe": _q_lbe,
        "long_gaps": _q_gaps,
        "long_cumulative": _long(ratios.prr, views.brand_quantity, "YE", True),
        "long_disjoint": _long(bayes.bcpnn, views.brand_quantity, "YE", False),
        "long_daily": _long(bayes.bcpnn, views.user_event, "D", True),
        "binary": _q_binary,
        "binary_counts": _q_binary_counts,
        "multi_item": _q_multi_item,
        "multi_item_total": _q_multi_total,
        "lasso": _lasso(alpha=0.0005, num_bootstrap=0),
        "lasso_ic": _lasso(use_IC=True, num_bootstrap=0),
        "lasso_bootstrap": _lasso(alpha=0.0005, num_bootstrap=10),
        "lasso_glm": _lasso(use_glm=True),
        "gps_fit": _signals(bayes.gps, views.name_size),
        "gps_fit_truncated": _signals(bayes.gps, views.name_size, truncate=True, truncate_thres=1),
    }


def oracle_sql() -> dict[str, str]:
    """The same results by independent formulas."""
    ns, bq, ue = O.cells("name_size"), O.cells("brand_quantity"), O.cells("user_event")
    with_prr = O.ratio_query(ns, O.prr_scores(), O.ratio_columns())
    found = {
        "cells": O.cells("user_event", 10)
        + " SELECT events, n1j AS product_aes, ni1 AS count_across_brands, ae AS ae_name, name AS product_name FROM c",
        "contingency": O.cells("name_size", 100) + " SELECT name AS product_name, ae AS ae_name, events FROM k",
        "cell_position": ns + " SELECT ae AS ae_name, name AS product_name, pos FROM c",
        "expected_mh": bq + f" SELECT name AS product_name, ae AS ae_name, n11, {O.rnd('e')} AS \"E\" FROM c",
        "prr": with_prr,
        "prr_flags": O.ratio_query(O.cells("flags"), O.prr_scores(), O.ratio_columns()),
        "prr_ci": O.ratio_query(
            ns, O.prr_scores(), O.ratio_columns("lower_", "lower_bound_CI(95%)", "CAST(NULL AS DOUBLE)")
        ),
        "prr_signals": f"SELECT * FROM ({with_prr}) WHERE p_value <= 0.05",
        "ror": O.ratio_query(bq, O.ror_scores(), O.ratio_columns()),
        "rfet": O.ratio_query(bq, O.rfet_scores(), O.ratio_columns()),
        "bcpnn": ue + f", {O.bcpnn_scores()}, {O.error_rates()} SELECT {O.bayes_columns('lower_', 'quantile')} FROM z",
        "bcpnn_p": ns + f", {O.bcpnn_scores()}, {O.error_rates()} SELECT {O.bayes_columns('post', 'p_value')} FROM z",
        "bcpnn_signals": ns
        + f", {O.bcpnn_scores()}, {O.error_rates()} SELECT {O.bayes_columns('lower_', 'quantile')} FROM z WHERE lower_ >= 0.05",
        "gps": ns + f", {O.gps_scores()}, {O.error_rates(mirrored=False)} SELECT {O.bayes_columns('post', 'p_value')} FROM z",
        "gps_log2": ue
        + f", {O.gps_scores()}, {O.error_rates()} SELECT {O.bayes_columns('eb', 'log2', f', {O.rnd("post")} AS p_value, {O.rnd(O.quantile())} AS "LowerBound"')} FROM z",
    }
    found |= _more_oracles() | _model_oracles()
    return found


def _model_oracles() -> dict[str, str]:
    """Regressions, quantiles and the other options, by formulas or algorithms of their own."""
    ns, ue = O.cells("name_size"), O.cells("user_event")
    recursive = ns.replace("WITH", "WITH RECURSIVE", 1)
    four = lambda x: f"round(({x})::DOUBLE * 1.000000000001::DOUBLE, 4) + 0.0"
    fitted = lambda alpha: recursive + f", {O.glm(alpha)} SELECT name AS product_name, ae AS ae_name, n11, {four('mu')} AS \"E\" FROM f"
    t = O.t_quantile(1.959963984540054, "(m - 1)")
    dispersion = f"""{recursive}, {O.glm(0.0)},
      d AS (SELECT count(*)::DOUBLE AS m, sum((n11 - mu) * (n11 - mu) / mu) AS chi, sum(mu * y) AS mr, sum(mu * mu) AS mm, sum(y * y) AS rr
            FROM (SELECT *, ((n11 - mu) * (n11 - mu) - n11) / mu AS y FROM f)),
      o AS (SELECT *, mr / mm AS slope, sqrt((rr - mr * mr / mm) / (m - 1) / mm) * {t} AS half FROM d)
      SELECT {four('chi / (m - 3)')} AS dispersion, {four('slope')} AS alpha, {four('slope - half')} AS lb, {four('slope + half')} AS ub FROM o"""
    lower = f"l AS (SELECT *, {O.quantile()} AS lower_ FROM b)"
    quantile = f"""{ns}, {O.gps_scores()}, {lower}, {O.error_rates().replace('FROM b)', 'FROM l)', 1)}
      SELECT {O.bayes_columns('lower_', 'quantile', f', {O.rnd("post")} AS posterior_probability')}
      FROM (SELECT *, row_number() OVER (ORDER BY lower_ DESC, ae, name) AS rk, count(*) FILTER (lower_ >= 0.05) OVER () AS passing FROM z)
      WHERE rk <= passing - 1"""
    rows = views.SQL["multi"]
    fixed = "SELECT ae, 0 AS i, 0.0005::DOUBLE AS a FROM e"
    # The largest penalty that leaves a coefficient, and a hundred steps down to a ten-thousandth of it, and none.
    grid = """SELECT ae, i, CASE WHEN i < 100 THEN greatest(top, 1e-12) * pow(1e-4::DOUBLE, i / 99.0::DOUBLE) ELSE 0.0 END AS a
      FROM (SELECT ae, list_max(list_transform(shares, lambda x: abs(x.p * (x.r - mean)))) AS top FROM e), (SELECT unnest(range(0, 101)) AS i)"""
    columns = f"""w.name AS "Product", w.ae AS "Adverse Event", {O.rnd('w.w')} AS "LASSO Coefficient", 0.0::DOUBLE AS "CI Lower", 0.0::DOUBLE AS "CI Upper\""""
    choice = """v AS (SELECT ae, i, any_value(n) AS n, sum(p * r * (1 - r) + p * (r - b - w) * (r - b - w)) AS rss, sum(p * r * (1 - r)) AS least,
                             count(*) AS products, count(*) FILTER (abs(w) > 1e-12) AS held FROM w GROUP BY ae, i),
      best AS (SELECT ae, arg_min(i, {'v': round(rss / (least / (n - products - 1)) + ln(n) * held, 9), 'i': i}) AS i FROM v GROUP BY ae)"""
    even = f"SELECT make_date(year(dt)::BIGINT, 12, 31)::TIMESTAMP AS ts, name, ae, cnt FROM ({views.SQL['brand_quantity']}) WHERE year(dt) % 2 = 0"
    gaps = f"""{O.cells("", key="ts", source=even)}, {O.bcpnn_scores()}, {O.error_rates('ts')},
      every AS (SELECT unnest(range(min(year(ts)), max(year(ts)) + 1)) AS y FROM rep),
      out AS (SELECT year(ts) AS y, {O.bayes_columns('lower_', 'quantile')} FROM z)
      SELECT every.y || '-12-31' AS slice_ts, out.* EXCLUDE (y) FROM every LEFT JOIN out USING (y)"""
    lbe_sql = f"""{O.cells("brand_quantity")}, ms AS (SELECT m, {O.exponent('m')} AS ex FROM (SELECT DISTINCT m FROM c)),
      s1 AS (SELECT c.*, ex, n1j - n11 AS n10, ni1 - n11 + 1e-7::DOUBLE AS n01 FROM c JOIN ms USING (m)),
      s0 AS (SELECT *, n - (n11 + n10 + n01) AS n00 FROM s1), {O.prr_scores()},
      j AS (SELECT p, m, least(1.0, avg(CASE WHEN p >= 1 THEN 1e300 ELSE pow(-ln(1 - p), ex) END / exp(lgamma(ex + 1))) OVER ()) AS pi0,
                   row_number() OVER (ORDER BY p) AS i FROM s2),
      o AS (SELECT *, avg(i) OVER (PARTITION BY p) - 1 AS rank, max(i) OVER (PARTITION BY p) AS last_ FROM j),
      q AS (SELECT *, least(1.0, min(pi0 * m * p / last_) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM o)
      SELECT {O.rnd('p')} AS p, {O.rnd('rank')} AS rank, {O.rnd('q')} AS q, {O.rnd('pi0')} AS pi0, q <= 0.05 AS significant FROM q"""
    rfet = O.ratio_query(ns, O.rfet_scores(), O.ratio_columns())
    return {
        "expected_poisson": fitted(0.0),
        "expected_nb": fitted(1.0),
        "dispersion": dispersion,
        "gps_quantile": quantile,
        "gps_rr": ns + f", {O.gps_scores(2.0)}, {O.error_rates(mirrored=False)} SELECT {O.bayes_columns('post', 'p_value')} FROM z",
        "bcpnn_rr": ns + f", {O.bcpnn_scores(2.0)}, {O.error_rates()} SELECT {O.bayes_columns('lower_', 'quantile')} FROM z",
        "bcpnn_corrected": ue + f", {O.bcpnn_scores()}, {O.own_rates()} SELECT {O.bayes_columns('lower_', 'quantile')} FROM z",
        "bcpnn_ranked": ue + f""", {O.bcpnn_scores()} SELECT row_number() OVER (ORDER BY lower_ DESC, ae, name) - 1 AS "index",
          name AS "Product", ae AS "Adverse Event", {O.rnd('lower_')} AS quantile FROM b""",
        "prr_corrected": O.ratio_query(ns, O.prr_scores(), O.ratio_columns(), own=True),
        "prr_rr": O.ratio_query(ns, O.prr_scores(1.5), O.ratio_columns()),
        "ror_fdr": f"SELECT * EXCLUDE (rk, passing) FROM (SELECT *, count(*) FILTER (fdr <= 0.05) OVER () AS passing FROM "
        f"({O.ratio_query(ns, O.ror_scores(), O.ratio_columns() + ', x.rk', own=True)})) WHERE rk <= passing",
        "rfet_signals": f"SELECT * FROM ({rfet}) WHERE p_value <= 0.01",
        "lbe": lbe_sql,
        "long_gaps": gaps,
        "lasso": f"{O.one_hot_lasso(rows, fixed)} SELECT {columns} FROM w",
        "lasso_ic": f"{O.one_hot_lasso(rows, grid)}, {choice} SELECT {columns} FROM w JOIN best USING (ae, i)",
        "lasso_glm": f"{O.one_hot_lasso(rows, fixed)} SELECT {columns.replace('w.w', 'CASE WHEN w.r > 0 THEN greatest(ln(w.r), 0.0) ELSE 0.0 END')} FROM w",
    }


def _more_oracles() -> dict[str, str]:
    years = f"""SELECT s.y AS ts, name, ae, cnt FROM ({views.SQL['brand_quantity']}) r
      JOIN (SELECT DISTINCT last_day(make_date(year(dt)::BIGINT, 12, 1))::TIMESTAMP AS y FROM ({views.SQL['brand_quantity']})) s
      ON {{on}}"""
    days = f"""SELECT s.d AS ts, name, ae, cnt FROM ({views.SQL['user_event']}) r
      JOIN (SELECT DISTINCT date_trunc('day', dt)::TIMESTAMP AS d FROM ({views.SQL['user_event']})) s ON r.dt <= s.d"""
    own = "make_date(year(r.dt)::BIGINT, 12, 31)::TIMESTAMP = s.y"
    disjoint = O.cells("", key="ts", source=years.format(on=own))
    daily = O.cells("", key="ts", source=days)
    stamp = "strftime(ts, '%Y-%m-%d') AS slice_ts"
    cumulative = O.ratio_query(
        O.cells("", key="ts", source=years.format(on="r.dt <= s.y")), O.prr_scores(), O.ratio_columns(), key="ts"
    )
    pairs = f"""WITH rep AS ({views.SQL['multi']}),
      s AS (SELECT ae, cnt, name AS p, name AS a, NULL AS b FROM rep UNION ALL SELECT ae, cnt, name2, name2, NULL FROM rep
            UNION ALL SELECT ae, cnt, least(name, name2) || '|' || greatest(name, name2), name, name2 FROM rep),
      e AS (SELECT ae, p, any_value(a) AS a, any_value(b) AS b, sum(cnt)::BIGINT AS events, count(*) AS uses FROM s GROUP BY ae, p),
      n AS (SELECT p, count(*) AS c FROM (SELECT name AS p FROM rep UNION ALL SELECT name2 FROM rep) GROUP BY p),
      x AS (SELECT ae, 2 * count(*) AS c FROM rep GROUP BY ae)"""
    ror_names = O.ratio_query(O.cells("name_size"), O.ror_scores(), O.ratio_columns())
    return {
        "prr_min_events": O.ratio_query(O.cells("name_size", min_events=20), O.prr_scores(), O.ratio_columns()),
        "ror_signals": f"SELECT * FROM ({ror_names}) WHERE p_value <= 0.01",
        "rfet_mid": O.ratio_query(O.cells("brand_quantity"), O.rfet_scores(mid=True), O.ratio_columns()),
        "long_cumulative": f"SELECT * EXCLUDE (ts), {stamp} FROM ({cumulative})",
        "long_disjoint": disjoint
        + f", {O.bcpnn_scores()}, {O.error_rates('ts')} SELECT {stamp}, {O.bayes_columns('lower_', 'quantile')} FROM z",
        "long_daily": daily
        + f", {O.bcpnn_scores()}, {O.error_rates('ts')} SELECT {stamp}, {O.bayes_columns('lower_', 'quantile')} FROM z",
        "binary": f"""SELECT least(name, name2) || '|' || greatest(name, name2) AS products, ae, 1::BIGINT AS y, count(*) AS rows
          FROM ({views.SQL['multi']}) GROUP BY ALL""",
        "binary_counts": f"""SELECT least(name, name2) || '|' || greatest(name, name2) AS products, ae, sum(cnt)::BIGINT AS y
          FROM ({views.SQL['multi']}) GROUP BY ALL""",
        "multi_item": pairs
        + """ SELECT events, (na.c + coalesce(nb.c, 0))::BIGINT AS product_aes, x.c::BIGINT AS count_across_brands, e.ae AS ae_name, e.p AS product_name
          FROM e JOIN n na ON na.p = e.a LEFT JOIN n nb ON nb.p = e.b JOIN x ON x.ae = e.ae""",
        "multi_item_total": pairs + ' SELECT sum(events * uses)::BIGINT AS "N" FROM e',
    }

