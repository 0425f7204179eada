"""Cohort sums against plain Python over random rows."""

import random
from collections import defaultdict

import pytest

from cohortwise.contracts import MEASURES, SUMS
from cohortwise.operators.cohorts import ae_multi_grouping, cohort_totals
from cohortwise.operators.ranking import rank_cohorts

SCHEMA = "A string, B int, MAC double, MOC double, MEC double, MAF double, MEF double"


def _rows(seed, n=2000):
    rng = random.Random(seed)

    def measure():
        return None if rng.random() < 0.1 else round(rng.uniform(0, 5), 2)

    return [
        # one cohort holds a third of the rows
        ("hot" if rng.random() < 1 / 3 else rng.choice(["x", "y", None]),
         rng.choice([1, 2, 3, None]), *[measure() for _ in MEASURES])
        for _ in range(n)
    ]


def _sums(rows, key):
    sums = defaultdict(lambda: [0.0] * len(MEASURES))
    for row in rows:
        for i, value in enumerate(row[2:]):
            sums[key(row)][i] += value or 0.0
    return sums


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_totals(spark, seed):
    rows = _rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = _sums(rows, lambda r: (r[0], r[1]))
    got = {(r["A"], r["B"]): [r[s] for s in SUMS]
           for r in cohort_totals(df, ["A", "B"]).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_groupings_out_of_one_scan(spark):
    rows = _rows(9)
    df = spark.createDataFrame(rows, SCHEMA)
    got = ae_multi_grouping(df, [["A"], ["B", "A"], ["B"]], min_claims=150).collect()

    def text(value):
        return "nan" if value is None else str(value)

    keys = {"a": lambda r: f"A={text(r[0])}", "b": lambda r: f"B={text(r[1])}",
            "b_a": lambda r: f"B={text(r[1])} | A={text(r[0])}"}
    for scenario, key in keys.items():
        want = {k: v for k, v in _sums(rows, key).items() if v[0] >= 150}
        mine = {r["Dimensions"]: r for r in got if r["scenario"] == scenario}
        assert mine.keys() == want.keys() and mine
        for label, sums in want.items():
            assert mine[label]["Sum_MEF"] == pytest.approx(sums[4])
            assert mine[label]["AE_Ratio_Amount"] == pytest.approx(sums[3] / sums[4])
            assert mine[label]["Sum_MAC"] == int(sums[0])


def test_ranks(spark):
    rng = random.Random(7)
    rows = [(f"c{i}", rng.choice([None, 0.0, 0.0, rng.random()])) for i in range(800)]
    df = spark.createDataFrame(rows, "Dimensions string, Sum_MAF double")
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    got = rank_cohorts(df, "Sum_MAF", slices=5).orderBy("cohort_rank").collect()
    assert [r["Dimensions"] for r in got] == [label for label, _ in order]
    assert [r["cohort_rank"] for r in got] == list(range(1, 801))
