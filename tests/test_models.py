"""Every formula against the hand-computed fixture, and properties that hold on any data."""

import math

import pytest

import cellwise
from cellwise.operators import bayes, prior, ratios
from cellwise.operators.expected import calculate_expected
from cellwise.operators.ordering import with_position, with_rank
from tests import fixture_g1 as g1


@pytest.fixture(scope="module")
def reports(spark):
    return spark.createDataFrame(g1.ROWS, "name string, AE string, date string, count bigint")


@pytest.fixture(scope="module")
def cells(reports):
    return cellwise.convert(reports).cache()


def by_cell(frame, column):
    return {(r["Adverse Event"], r["Product"]): r[column] for r in frame.collect()}


def check(found, name, tolerance=2e-6):
    at = g1.NAMES.index(name)
    assert len(found) == len(g1.CELLS)
    for cell, expected in g1.CELLS.items():
        if expected[at] is None:
            assert found[cell] is None
        else:
            assert found[cell] == pytest.approx(expected[at], abs=tolerance), (name, cell)


def test_margins(cells):
    rows = {(r["ae_name"], r["product_name"]): r for r in cells.data.collect()}
    assert cells.N == 56 and len(rows) == 10
    assert rows["rash", "drugC"]["product_aes"] == 20 and rows["nausea", "drugA"]["count_across_brands"] == 17


def test_prr(cells):
    result = cellwise.prr(cells)
    check(by_cell(result.all_signals, "PRR"), "PRR")
    check(by_cell(result.all_signals, "p_value"), "p_prr")
    check(by_cell(result.all_signals, "Expected Count"), "E")
    # Rates come in the order of p and go to the rows in data order.
    found = by_cell(result.all_signals, "fdr")
    assert [found[c] for c in sorted(found)] == pytest.approx(g1.PRR_FDR, abs=2e-6)
    assert result.num_signals == 4 and result.signals.count() == 4
    corrected = cellwise.prr(cells, semantics="corrected").all_signals.orderBy("p_value").collect()
    assert [r["fdr"] for r in corrected] == pytest.approx(g1.PRR_FDR, abs=2e-6)


def test_prr_other_statistics(cells):
    ci = cellwise.prr(cells, ranking_statistic="CI", decision_metric="rank", decision_thres=0.5)
    check(by_cell(ci.all_signals, "lower_bound_CI(95%)"), "PRRlb")
    assert ci.num_signals == 3
    lows = sorted(by_cell(ci.all_signals, "lower_bound_CI(95%)").values())[:3]
    assert sorted(by_cell(ci.signals, "lower_bound_CI(95%)").values()) == lows
    check(by_cell(cellwise.prr(cells, ranking_statistic="quantile").all_signals, "p_value"), "PRRlb")
    with pytest.raises(ValueError):
        cellwise.prr(cells, decision_metric="other")


def test_ror(cells):
    result = cellwise.ror(cells)
    check(by_cell(result.all_signals, "PRR"), "ROR")
    check(by_cell(result.all_signals, "p_value"), "p_ror")
    check(by_cell(cellwise.ror(cells, ranking_statistic="CI").all_signals, "lower_bound_CI(95%)"), "RORlb")


def test_rfet(cells):
    check(by_cell(cellwise.rfet(cells).all_signals, "p_value"), "fish_cut")
    exact = cellwise.rfet(cells, semantics="corrected").all_signals
    check(by_cell(exact, "p_value"), "fish")
    assert [r["fdr"] for r in exact.orderBy("p_value").collect()] == pytest.approx(g1.FISHER_FDR, abs=2e-6)
    mid, full = by_cell(cellwise.rfet(cells, mid_pval=True).all_signals, "p_value"), by_cell(exact, "p_value")
    assert all(mid[c] < full[c] + 0.05 for c in mid)


def test_bcpnn(cells):
    result = cellwise.bcpnn(cells, ranking_statistic="p_value")
    check(by_cell(result.all_signals, "p_value"), "post")
    found = by_cell(result.all_signals, "fdr")
    assert [found[c] for c in sorted(found)] == pytest.approx(g1.BCPNN_FDR, abs=2e-6)
    check(by_cell(cellwise.bcpnn(cells).all_signals, "quantile"), "IClb")
    own = cellwise.bcpnn(cells, ranking_statistic="p_value", semantics="corrected").all_signals.orderBy("p_value")
    assert [r["fdr"] for r in own.collect()] == pytest.approx(g1.BCPNN_FDR_SORTED, abs=2e-6)
    with pytest.raises(ValueError):
        cellwise.bcpnn(cells, ranking_statistic="CI")


def test_bcpnn_monte_carlo(cells):
    first = by_cell(cellwise.bcpnn(cells, MC=True, num_MC=4000, ranking_statistic="p_value").all_signals, "p_value")
    again = by_cell(cellwise.bcpnn(cells, MC=True, num_MC=4000, ranking_statistic="p_value").all_signals, "p_value")
    assert first == again and all(0 <= p <= 1 for p in first.values())
    assert first["nausea", "drugB"] < 0.05 < 0.9 < first["rash", "drugA"]


def test_gps_with_given_prior(cells):
    check(by_cell(cellwise.gps(cells, prior_param=g1.PRIOR, ranking_statistic="p_value").all_signals, "p_value"), "post_gps")
    log2 = cellwise.gps(cells, prior_param=g1.PRIOR).all_signals
    check(by_cell(log2, "log2"), "EBlog2")
    check(by_cell(log2, "LowerBound"), "EB05", 6e-5)
    check(by_cell(cellwise.gps(cells, prior_param=g1.PRIOR, ranking_statistic="quantile").all_signals, "quantile"), "EB05", 6e-5)


@pytest.mark.parametrize("truncate", [False, True])
def test_gps_fit_lowers_the_objective(cells, truncate):
    import numpy as np

    squashed = prior.squash(cells, calculate_expected(cells), truncate, 1).toPandas()
    assert squashed["times"].sum() == (10 if truncate else 12)
    data = (squashed["hits"].to_numpy(), squashed["E"].to_numpy(), squashed["times"].to_numpy(), 1 if truncate else None)
    x = prior._internal(g1.PRIOR)
    start, slope = prior.value_and_slope(x, *data)
    for i in range(5):
        step = np.eye(5)[i] * 1e-5
        numeric = (prior.value_and_slope(x + step, *data)[0] - prior.value_and_slope(x - step, *data)[0]) / 2e-5
        assert slope[i] == pytest.approx(numeric, rel=1e-3, abs=1e-5)
    _, value, _ = prior.minimise(lambda v: prior.value_and_slope(v, *data), x)
    assert value <= start
    result = bayes.gps(cells, truncate=truncate)
    assert len(result.params["prior_param"]) == 5 and result.all_signals.count() == 10


def test_expected_counts_by_regression(cells):
    for method, values in (("poisson", g1.POISSON), ("negative-binomial", g1.NB)):
        found = {(r["ae_name"], r["product_name"]): r["E"] for r in calculate_expected(cells, method, 1).collect()}
        assert [found[c] for c in sorted(found)] == pytest.approx(values, abs=1e-5)
    with pytest.raises(AssertionError):
        calculate_expected(cells, "other")


def test_dispersion(cells):
    found = cellwise.test_dispersion(cells)
    assert found["dispersion"] == pytest.approx(3.405484, abs=1e-5)
    assert found["alpha"] == pytest.approx(0.250491, abs=1e-5)
    assert found["ub"] - found["alpha"] == pytest.approx(2.262157 * 0.101559, abs=1e-4)
    assert cellwise.select_alpha(cells) == pytest.approx(0.250491, abs=1e-5)


def test_lbe(spark):
    p = spark.createDataFrame([(x,) for x in (0.001, 0.01, 0.01, 0.2, 0.5, 0.9)], "p double")
    found = cellwise.lbe(p)
    assert found.a == 1 and 0 < found.pi0 <= 1
    rows = found.values.orderBy("p").collect()
    assert [r["rank"] for r in rows] == [0, 1.5, 1.5, 3, 4, 5]
    assert all(a["q"] <= b["q"] for a, b in zip(rows, rows[1:], strict=False))
    small = cellwise.lbe(p, a=0.5)
    assert small.pi0 == pytest.approx(min(1, 2 * 1.621 / 6)) and small.sdbound == pytest.approx(math.sqrt(1 / 18))
    with pytest.raises(ValueError):
        cellwise.lbe(spark.createDataFrame([(1.5,)], "p double"))


def test_thresholds_nulls_and_empty(spark):
    rows = [("a", "x", 5), ("a", None, 3), (None, "x", 2), ("b", "x", None), ("a", "y", 1), ("b", "y", 4)]
    found = cellwise.convert(spark.createDataFrame(rows, "name string, AE string, count bigint"))
    assert {(r["product_name"], r["ae_name"], r["events"]) for r in found.data.collect()} == {("a", "x", 5), ("a", "y", 1), ("b", "y", 4)}
    cut = cellwise.convert(spark.createDataFrame(rows, "name string, AE string, count bigint"), margin_threshold=5)
    assert {(r["product_name"], r["ae_name"]) for r in cut.data.collect()} == {("a", "x"), ("a", "y")}
    empty = cellwise.convert(spark.createDataFrame([], "name string, AE string, count bigint"))
    assert empty.N == 0
    for model in (cellwise.prr, cellwise.ror, cellwise.rfet, cellwise.bcpnn):
        result = model(empty)
        assert result.all_signals.count() == 0 and result.num_signals == 0


def test_positions_and_ranks(spark):
    rows = [(f"e{i % 7}", f"p{i}", (i * 37 % 11 - 5) / 3 if i % 10 else None) for i in range(60)]
    frame = spark.createDataFrame(rows, "ae_name string, product_name string, s double")
    placed = [(r["ae_name"], r["product_name"]) for r in with_position(frame).orderBy("pos").collect()]
    assert placed == sorted((a, p) for a, p, _ in rows)
    up = [(r["s"], r["ae_name"], r["product_name"]) for r in with_rank(frame, "s", "r").orderBy("r").collect()]
    assert up == sorted(((s, a, p) for a, p, s in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2]))
    down = [r["s"] for r in with_rank(frame, "s", "r", descending=True).orderBy("r").collect()]
    assert down[0] == max(s for *_, s in rows if s is not None) and down[-1] is None


def test_min_events_and_options_grid(cells):
    for method in ("mantel-haentzel", "negative-binomial", "poisson"):
        for metric in ("fdr", "signals", "rank"):
            assert ratios.prr(cells, min_events=3, decision_metric=metric, expected_method=method).num_signals >= 0
    assert cellwise.prr(cells, min_events=3).all_signals.count() == 7


def test_export(cells, tmp_path, spark):
    cellwise.prr(cells).export(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "all_data")).count() == 10
