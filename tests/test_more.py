"""Slices, designs, several products, penalised regression, streams and sources."""

import math
import random
from datetime import datetime

import numpy as np
import pytest

import cellwise
from cellwise.operators.binary import convert_binary, convert_multi_item
from cellwise.operators.lasso import coordinate_descent, lasso, wide_lasso
from cellwise.sources.readers import from_pandas, read_reports
from cellwise.sources.shared import small_table
from cellwise.streaming.windows import score_stream, windowed_counts
from tests import fixture_g1 as g1


@pytest.fixture(scope="module")
def reports(spark):
    return spark.createDataFrame(g1.ROWS, "name string, AE string, date string, count bigint").selectExpr(
        "name", "AE", "timestamp(date) AS date", "count"
    )


def test_slices(reports):
    model = cellwise.LongitudinalModel(reports, "YE")
    calendar = [(str(r["slice_ts"])[:10], r["count"]) for r in model.calendar().orderBy("slice_ts").collect()]
    assert calendar == [("2020-12-31", 19), ("2021-12-31", 12), ("2022-12-31", 25)]
    totals = [r["N"] for r in model.cells(True).totals.orderBy("slice_ts").collect()]
    assert totals == [19, 31, 56]
    last = model.run(cellwise.prr).all_signals.filter("slice_ts = '2022-12-31'")
    full = cellwise.prr(cellwise.convert(reports)).all_signals
    a = sorted((r["Product"], r["Adverse Event"], round(r["p_value"], 9), round(r["fdr"], 9)) for r in last.collect())
    assert a == sorted((r["Product"], r["Adverse Event"], round(r["p_value"], 9), round(r["fdr"], 9)) for r in full.collect())


def test_gaps_and_units(reports):
    model = cellwise.LongitudinalModel(reports, "M")
    rows = model.run_disjoint(cellwise.bcpnn).all_signals.collect()
    empty = {str(r["slice_ts"])[:10] for r in rows if r["Product"] is None}
    assert "2020-04-30" in empty and "2020-03-31" not in empty
    assert {r["slice_ts"] for r in model.run_disjoint(cellwise.bcpnn, include_gaps=False).all_signals.collect() if r["Product"] is None} == set()
    assert model.regroup_dates("QS").calendar().count() == 12
    assert model.regroup_dates("W").calendar().count() == 153
    hours = cellwise.LongitudinalModel(reports.filter("year(date) = 2021 AND month(date) IN (1)"), "h")
    assert hours.calendar().count() == 1
    with pytest.raises(ValueError):
        cellwise.LongitudinalModel(reports, "fortnight")


def test_cumulative_cut_at_the_label(spark):
    rows = [("a", "x", "2020-12-31 10:00:00", 1), ("a", "x", "2020-05-01", 2), ("b", "x", "2021-02-01", 4)]
    frame = spark.createDataFrame(rows, "name string, AE string, date string, count bigint")
    totals = lambda s: [r["N"] for r in cellwise.LongitudinalModel(frame, "YE", semantics=s).cells(True).totals.orderBy("slice_ts").collect()]
    assert totals("reference") == [2, 7] and totals("corrected") == [3, 7]


def test_longitudinal_binary(reports):
    found = cellwise.LongitudinalModel(reports, "YE").run(lasso, use_binary=True, alpha=0.01, num_bootstrap=0, min_events=1)
    assert {str(r["slice_ts"])[:4] for r in found.all_signals.collect()} == {"2020", "2021", "2022"}


def test_binary(spark):
    rows = [("a", "b", "x", 2), ("a", "a", "x", 1), ("b", "", "y", 0)]
    frame = spark.createDataFrame(rows, "name string, name2 string, AE string, count bigint")
    found = convert_binary(frame, ["name", "name2"])
    assert found.N == 3
    shapes = {(tuple((p["product"], p["x"]) for p in r["products"]), r["ae"], r["rows"]) for r in found.patterns.collect()}
    assert shapes == {((("a", 1), ("b", 1)), "x", 2), ((("a", 2),), "x", 1)}
    counts = convert_binary(frame, ["name", "name2"], use_counts=True)
    assert {(r["ae"], r["y"]) for r in counts.patterns.collect()} == {("x", 2), ("x", 1), ("y", 0)}
    kept = convert_binary(frame.filter("count < 2"), ["name", "name2"])
    assert kept.N == 2  # no count exceeds 1, so the row of count 0 stays


def test_multi_item(spark):
    rows = [("a", "b", "x", 2), ("b", "a", "x", 1), ("a", "", "y", 1)]
    frame = spark.createDataFrame(rows, "name string, name2 string, AE string, count bigint")
    found = convert_multi_item(frame, ["name", "name2"], min_threshold=1)
    got = {(r["ae_name"], r["product_name"], r["events"], r["product_aes"], r["count_across_brands"]) for r in found.data.collect()}
    assert got == {("x", "a", 3, 3, 4), ("x", "b", 3, 2, 4), ("x", "a|b", 3, 5, 4), ("y", "a", 1, 3, 1)}
    assert found.N == 3 * 2 * 3 + 1


def test_coordinate_descent_meets_the_optimality_conditions():
    random = np.random.default_rng(1)
    x = random.normal(size=(200, 6))
    x -= x.mean(0)
    y = x @ [2, 0, 0, -1, 0, 0.3] + random.normal(size=200)
    gram, xy = x.T @ x / 200, x.T @ (y - y.mean()) / 200
    w = coordinate_descent(gram, xy, 0.2)
    slope = xy - gram @ w
    assert np.all(np.abs(slope) <= 0.2 + 1e-8) and np.allclose(slope[w != 0], 0.2 * np.sign(w[w != 0]), atol=1e-8)


def test_lasso_agrees_with_the_distributed_solver(spark):
    rows = [("a", "x", 9), ("a", "y", 1), ("b", "x", 2), ("b", "y", 8), ("c", "x", 5), ("c", "y", 5)]
    design = convert_binary(spark.createDataFrame(rows, "name string, AE string, count bigint"))
    found = {(r["Adverse Event"], r["Product"]): r["LASSO Coefficient"] for r in lasso(design, alpha=0.02).all_signals.collect()}
    for event, frame in wide_lasso(design, alpha=0.02):
        for r in frame.collect():
            assert found[event, r["Product"]] == pytest.approx(r["LASSO Coefficient"], abs=1e-4)
    result = lasso(design, alpha=0.02, num_bootstrap=20)
    assert all(r["CI Lower"] <= r["CI Upper"] for r in result.all_signals.collect()) and result.num_signals >= 1
    for options in (dict(use_IC=True), dict(use_IC=True, IC_criterion="aic"), dict(use_glm=True), dict(use_lars=True, alpha=0.02)):
        assert lasso(design, **options).all_signals.count() == 6


def test_sources(spark, tmp_path, reports):
    reports.selectExpr("name", "AE", "count", "date").write.option("header", True).csv(str(tmp_path / "csv"))
    assert read_reports(spark, str(tmp_path / "csv")).count() == 12
    assert from_pandas(spark, reports.toPandas()).count() == 12


def test_streams(spark, tmp_path, reports):
    reports.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = score_stream(stream, cellwise.prr, str(tmp_path / "out"), str(tmp_path / "marks"))
    query.awaitTermination(120)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "scores").glob("batch=*"))
    assert spark.read.parquet(str(tmp_path / "out" / "scores" / f"batch={last}")).count() == 10
    assert windowed_counts(stream, "365 days", "1 day").isStreaming


def test_workbook_holds_both_sheets(spark, tmp_path):
    import zipfile
    from xml.etree import ElementTree

    from cellwise.sources.workbook import write_workbook

    frame = spark.createDataFrame([("a <&> \x01b", 1.5, 3, True), (None, float("inf"), None, False)], "t string, d double, n bigint, b boolean")
    write_workbook(str(tmp_path / "x.xlsx"), {"Signals": frame, "all_data": frame.limit(0)})
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(tmp_path / "x.xlsx") as book:
        names = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{space}sheet")]
        rows = [["".join(c.itertext()) for c in r] for r in ElementTree.fromstring(book.read("xl/worksheets/sheet1.xml")).iter(f"{space}row")]
        assert all(ElementTree.fromstring(book.read(n)) is not None for n in book.namelist())
    assert names == ["Signals", "all_data"]
    assert rows[0] == ["t", "d", "n", "b"] and sorted(rows[1:]) == sorted([["a <&> b", "1.5", "3", "1"], ["", "", "", "0"]])


def test_export_of_a_model(spark, reports, tmp_path):
    from cellwise import convert, prr

    found = prr(convert(reports))
    found.export(str(tmp_path / "out.xlsx"), format="excel")
    found.export(str(tmp_path / "out"))
    assert (tmp_path / "out.xlsx").stat().st_size > 1000
    assert spark.read.parquet(str(tmp_path / "out" / "all_data")).count() == found.all_signals.count()


def test_ranked_results(reports):
    from cellwise import bcpnn, convert

    rows = bcpnn(convert(reports)).ranked().collect()
    assert [r["index"] for r in rows] == list(range(len(rows)))
    assert [r["quantile"] for r in rows] == sorted((r["quantile"] for r in rows), reverse=True)


def test_ranks_of_many_ties_and_of_values_near_one(spark):
    from cellwise.operators.ordering import with_rank

    random.seed(4)
    values = [0.0] * 30 + [1.0] * 30 + [1 - 2.0**-k for k in range(1, 50)] + [2.0**-k for k in range(1, 50)] + [None] * 5 + [1.5, 3.0, -1.0, -0.2]
    data = [(v, f"e{random.randrange(9)}", f"p{i}") for i, v in enumerate(values)]
    frame = spark.createDataFrame(data, "x double, ae_name string, product_name string")
    for descending in (False, True):
        order = sorted(data, key=lambda r: (r[0] is None, (-r[0] if descending else r[0]) if r[0] is not None else 0, r[1], r[2]))
        found = {r["product_name"]: r["k"] for r in with_rank(frame, "x", "k", (), descending).collect()}
        assert [found[r[2]] for r in order] == list(range(1, len(order) + 1))


def test_binary_slices_of_an_empty_table_and_failing_slices(reports):
    from cellwise import LongitudinalModel, lasso

    empty = LongitudinalModel(reports.limit(0), "YE").run(lasso, use_binary=True, num_bootstrap=0)
    assert empty.all_signals.count() == 0

    def fails(design, **options):
        found = lasso(design, **options)
        if found.all_signals.select("Product").distinct().count() < 3:
            raise ValueError("too few products")
        return found

    with pytest.warns(UserWarning, match="too few"):
        found = LongitudinalModel(reports, "YE").run_disjoint(fails, use_binary=True, num_bootstrap=0)
    rows = found.all_signals.collect()
    assert {str(r["slice_ts"])[:4] for r in rows if r["Product"] is None} and {str(r["slice_ts"])[:4] for r in rows} == {"2020", "2021", "2022"}


def test_cumulative_totals_against_plain_loops(spark):
    from cellwise import LongitudinalModel

    random.seed(3)
    rows = [(f"p{random.randrange(4)}", f"e{random.randrange(3)}", random.randrange(3), f"20{random.choice((10, 11, 14, 15, 19))}-{random.randrange(1, 13):02d}-{random.randrange(1, 29):02d}") for _ in range(120)]
    reports = spark.createDataFrame(rows, "name string, AE string, count bigint, date string").selectExpr("name", "AE", "count", "cast(date as timestamp) date")
    for unit, length in (("YE", 4), ("MS", 7)):
        for semantics in ("corrected", "reference"):
            found = LongitudinalModel(reports, unit, semantics=semantics)._cumulative_rows().collect()
            got = {(str(r["slice_ts"])[:length], r["name"], r["AE"]): r["count"] for r in found}
            held = {d[:length] for _, _, n, d in rows}
            slices = {s for s in held if sum(n for _, _, n, d in rows if d[:length] == s)}
            within = lambda d, s: d[:length] <= s if semantics == "corrected" or unit == "YE" else d <= s + "-01"  # noqa: B023, E731
            expected = {}
            for s in slices:
                for name, ae, n, d in rows:
                    if within(d, s):
                        expected[s, name, ae] = expected.get((s, name, ae), 0) + n
            assert got == expected, (unit, semantics)


def test_small_table_keeps_values_without_an_rdd(spark):
    moment = datetime(2020, 3, 29, 12, 30)
    schema = "`a b` string, t timestamp, d date, n bigint, x double"
    rows = [("é", moment, moment.date(), 2**60, 0.1 + 0.2), (None, None, None, None, None), ("", moment, None, 0, math.inf)]
    made = small_table(spark, rows, schema)
    assert [tuple(r) for r in made.collect()] == rows
    assert made.schema == spark.createDataFrame([], schema).schema
    assert "RDD" not in made._jdf.queryExecution().executedPlan().toString()
    assert small_table(spark, [], schema).collect() == []
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert small_table(spark, rows, schema).collect()[0]["t"] == moment
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
