"""Counts, steps and plans as they are on tables larger than those of the other tests."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwise import convert
from cellwise.functions.numeric import normal_cdf
from cellwise.operators import bayes, expected
from cellwise.plans.rounding import rounded
from tests.fixture_g1 import ROWS


def reports(spark):
    return spark.createDataFrame(ROWS, "name string, AE string, date string, count bigint").withColumn("date", F.to_timestamp("date"))


def test_large_counts_stay_whole(spark):
    rows = spark.createDataFrame([(525120.0, 692880.0, 36e6, 0.1234565)], "`product margin` double, `event margin` double, Count double, p double")
    assert rounded(rows).first() == (525120.0, 692880.0, 36e6, 0.123457)


def _plans_of_steps(monkeypatch, run):
    """The plans of the cells that each regression of ``run`` reads."""
    plans, steps = [], expected._irls

    def watched(rows, *rest):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return steps(rows, *rest)

    monkeypatch.setattr(expected, "_irls", watched)
    run()
    return plans


def test_steps_of_expected_counts_read_no_reports(spark, monkeypatch):
    cells = convert(reports(spark))
    methods = (expected.POISSON, expected.NEGATIVE_BINOMIAL)
    plans = _plans_of_steps(monkeypatch, lambda: [expected.calculate_expected(cells, m).collect() for m in methods])
    assert len(plans) == 2  # one each: the warning uses the fit of the counts
    assert not [p for p in plans if "Aggregate" in p]


def test_steps_of_dispersion_read_no_reports(spark, monkeypatch):
    cells = convert(reports(spark))
    plans = _plans_of_steps(monkeypatch, lambda: (expected.dispersion_table(cells).collect(), expected.select_alpha(cells)))
    assert len(plans) == 2
    assert not [p for p in plans if "Aggregate" in p]


def _longest_method(df):
    """The most bytes of a generated method: the JVM compiles none above 8,000 and interprets it."""
    debug = getattr(getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    found = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max([found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())], default=0)


def test_scores_are_compiled(spark):
    rows = spark.range(1, 9).selectExpr("double(id) n11", "double(id * 3) n1j", "double(id * 4) ni1", "900D N")
    scored = bayes._information_component(rows, 1)
    assert 0 < _longest_method(scored) < 8000


def test_normal_distribution_on_arrays():
    z = np.array([-30.0, -9.0, -3.5, -2.9, -1.0, 0.0, 0.5, 2.9, 4.0, 40.0])
    assert normal_cdf(z) == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in z], rel=1e-12)
    assert np.isnan(normal_cdf(np.array([np.nan]))).all()


def test_rounding_is_half_away_from_zero(spark):
    rows = spark.createDataFrame([(0.1234565, -0.1234565, 2.5e-7, 123456789.1234565, -1e-9)], "a double, b double, c double, d double, e double")
    assert rounded(rows).first() == (0.123457, -0.123457, 0.0, 123456789.12358, 0.0)
