from fractions import Fraction
from math import comb, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise.functions.beta import beta_quantile
from cohortwise.operators.intervals import with_intervals, with_rate_ci

TAILS = (0.025, 0.5, 0.975)


def _one(p, a, b):
    return float(beta_quantile(p, np.array([a]), np.array([b]))[0])


@pytest.mark.parametrize("p", TAILS)
def test_closed_forms(p):
    assert _one(p, 0.5, 0.5) == pytest.approx(np.sin(np.pi * p / 2) ** 2, rel=1e-12)
    for b in (0.5, 1.0, 7.0, 123.25, 1e6):
        assert _one(p, 1.0, b) == pytest.approx(-np.expm1(np.log1p(-p) / b), rel=1e-12)
        assert _one(p, b, 1.0) == pytest.approx(p ** (1 / b), rel=1e-12)


@pytest.mark.parametrize("p", TAILS)
@pytest.mark.parametrize("a, b", [(1, 4), (6, 995), (40, 3), (200, 300)])
def test_whole_parameters_meet_the_binomial_tail(p, a, b):
    x = Fraction(_one(p, float(a), float(b)))
    n = a + b - 1
    tail = sum(comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(a, n + 1))
    assert float(tail) == pytest.approx(p, rel=1e-10)


def test_very_large_cohorts_approach_the_normal_limit():
    a, b = 2.5e11, 7.5e11
    mean, spread = a / (a + b), sqrt(a * b / (a + b)) / (a + b)
    for p, z in ((0.025, -1.959963984540054), (0.975, 1.959963984540054)):
        assert _one(p, a, b) == pytest.approx(mean + z * spread, abs=1e-5 * spread)
    assert 0 < _one(0.025, 0.5, 1e11) < _one(0.975, 0.5, 1e11) < 1e-9


def test_symmetry_and_order():
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0.5, 500, 3000), rng.uniform(0.5, 5000, 3000)
    low, mid, high = (beta_quantile(p, a, b) for p in TAILS)
    assert (low < mid).all() and (mid < high).all() and (low > 0).all() and (high < 1).all()
    np.testing.assert_allclose(high, 1 - beta_quantile(0.025, b, a), rtol=0, atol=1e-12)


def test_rate_bounds_need_a_possible_rate(spark):
    rows = [(1.0, 2.0), (0.0, 5.0), (3.0, 3.0), (4.0, 3.0), (-1.0, 3.0), (0.0, 0.0),
            (None, 1.0), (1.0, None), (1.0, float("inf"))]
    df = spark.createDataFrame(rows, "Sum_MAC double, Sum_MOC double")
    got = with_rate_ci(df).collect()
    assert [r["Rate_CI_Lower"] is not None for r in got] == [True] * 3 + [False] * 6
    assert got[1]["Rate_CI_Lower"] > 0


def test_ratio_bounds(spark):
    columns = "Sum_MAC double, Sum_MOC double, Sum_MEC double, Sum_MAF double, Sum_MEF double"
    rows = [(5.0, 1000.0, 4.0, 5e5, 4e5), (0.0, 1000.0, 4.0, 0.0, 4e5), (1.0, 2.0, 0.0, 1.0, 1.0),
            (1.0, 2.0, 1.0, 1.0, 0.0)]
    got = with_intervals(spark.createDataFrame(rows, columns)).collect()
    rate = _one(0.025, 5.5, 995.5)
    assert got[0]["AE_Count_CI_Lower"] == pytest.approx(rate * 1000 / 4)
    assert got[0]["AE_Amount_CI_Lower"] == pytest.approx(rate * 1000 * 1e5 / 4e5)
    # without claims the expected average claim (4e5 / 4) stands in
    upper = _one(0.975, 0.5, 1000.5)
    assert got[1]["AE_Amount_CI_Upper"] == pytest.approx(upper * 1000 * 1e5 / 4e5)
    assert got[2]["AE_Count_CI_Lower"] is None and got[2]["AE_Amount_CI_Lower"] is None
    assert got[3]["AE_Count_CI_Lower"] is not None and got[3]["AE_Amount_CI_Lower"] is None


def test_each_cohort_meets_the_udf_once(spark):
    columns = "Sum_MAC double, Sum_MOC double, Sum_MEC double, Sum_MAF double, Sum_MEF double"
    df = with_intervals(spark.range(1).select(*[F.lit(1.0).alias(c.split()[0])
                                               for c in columns.split(", ")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
