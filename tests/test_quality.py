import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortwise.operators.quality import (
    check_rows,
    death_exposure,
    dq_gate,
    dq_report,
    duplicate_keys,
    key_checks,
    raw_checks,
)
from cohortwise.operators.profile import (
    profile_feature_types,
    profile_nulls,
    profile_summary,
    schema_columns,
)
from cohortwise.plans.sweep import Sweep, later_rows
from cohortwise.sources.inforce import read_inforce, read_raw_strings


def _counts(report):
    return {(r["check_id"], r["column_name"]): r["issue_count"] for r in report.collect()
            if r["status"] == "FAIL"}


def test_sample_passes(sample, spark, sample_csv):
    report = dq_report(sample, read_raw_strings(spark, sample_csv))
    assert _counts(report) == {}
    assert tuple(dq_gate(report).first()) == ("PASS", 0)
    assert report.where("message is not null").count() == 0


def test_every_row_rule(spark):
    columns = ("Policy_Number string, Duration double, MAC double, MOC double, MEC double, "
               "MAF double, MEF double, COLA string, Face_Amount double, Issue_Age int")
    good = ("P0", 1.0, 0.0, 0.5, 0.1, 0.0, 1.0, None, 10.0, 30)
    bad = [
        ("P1", 1.5, 2.0, 0.0, 0.0, 0.0, 1.0, None, 0.0, 0),
        ("P2", math.inf, 1.0, 1.5, 1.0, 1.0, 1.0, "", -5.0, -1),
        ("P3", 1.0, 0.0, -1.0, math.inf, 0.0, 1.0, "9", 1.0, 40),
        ("P4", 1.0, 1.0, 1.0 - 1e-6, 0.5, 5.0, 1.0, "5", 1.0, 40),
        ("P5", 1.0, 1.0, 1.0 - 1e-12, 0.5, 5.0, 1.0, "5", 1.0, 40),
        ("P6", None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([good, *bad], columns)
    assert _counts(dq_report(df)) == {
        ("dq_integer_valued", "Duration"): 2,
        ("dq_mac_binary", "MAC"): 1,
        ("dq_mec_range", "MEC"): 3,
        ("dq_moc_range", "MOC"): 3,
        ("dq_face_positive", "Face_Amount"): 2,
        ("dq_age_positive", "Issue_Age"): 2,
        ("dq_cola_null_when_alive", "COLA"): 1,
        ("dq_cola_set_when_claim", "COLA"): 1,
        ("dq_moc_full_when_claim", "MOC"): 2,
    }


def test_schema_issues_and_text_columns(spark):
    df = spark.createDataFrame([("x", 1.0, "-4", 1)], "Age string, MAC double, Face_Amount string, "
                               "Study_Year int")
    found = _counts(dq_report(df))
    assert {k for k in found if k[0] == "dq_missing_columns"} == {
        ("dq_missing_columns", c) for c in ("MOC", "MEC", "MAF", "MEF")
    }
    assert ("dq_numeric_type", "Age") in found and ("dq_numeric_type", "Face_Amount") in found
    assert found[("dq_face_positive", "Face_Amount")] == 1
    gate = dq_gate(dq_report(df)).first()
    assert gate["status"] == "FAIL" and gate["issue_count"] == len(found)


def test_issue_age_goes_before_age(spark):
    df = spark.createDataFrame([(0, 5)], "Age int, Issue_Age int")
    assert ("dq_age_positive", "Age") not in _counts(dq_report(df))
    assert _counts(dq_report(df.drop("Issue_Age")))[("dq_age_positive", "Age")] == 1


def test_raw_values(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("MAC,MEC\n1,0.1\nNA,1d\n x ,\nnull,1e-3\n")
    raw = read_raw_strings(spark, str(path))
    assert _counts(check_rows(raw, raw_checks(raw))) == {
        ("dq_raw_non_numeric", "MAC"): 1, ("dq_raw_non_numeric", "MEC"): 1
    }
    # once read as numbers, the faults are gone from sight
    assert ("dq_mac_binary", "MAC") not in _counts(dq_report(read_inforce(spark, str(path))))


def _random_policies(seed, rows=600):
    rng = np.random.default_rng(seed)
    policy = np.where(rng.random(rows) < 1 / 3, "hot", [f"P{i}" for i in rng.integers(0, 60, rows)])
    pdf = pd.DataFrame({
        "Policy_Number": policy.astype(object),
        "Duration": rng.integers(0, 40, rows) / (4 if seed % 2 else 1),
        "MAC": (rng.random(rows) < 0.2).astype(float),
    })
    pdf.loc[rng.random(rows) < 0.05, "Policy_Number"] = None
    pdf.loc[rng.random(rows) < 0.05, "Duration"] = np.nan
    return pdf


@pytest.mark.parametrize("seed", [1, 2])
def test_key_checks_equal_brute_force(spark, seed):
    pdf = _random_policies(seed)
    whole = pdf.dropna(subset=["Policy_Number", "Duration"])
    pairs = whole[whole.MAC == 1].merge(whole, on="Policy_Number", suffixes=("_d", "_l"))
    deaths = int((pairs.Duration_l > pairs.Duration_d).sum())
    repeats = int((whole.groupby(["Policy_Number", "Duration"]).size() > 1).sum())
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "Policy_Number string, Duration double, MAC double")
    assert death_exposure(df).first()["issue_count"] == deaths
    # many ranges cut the hot policy, small batches cut it inside a range
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        for slices in (1, 7, 60):
            assert death_exposure(df, slices=slices).first()["issue_count"] == deaths
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert duplicate_keys(df).first()["issue_count"] == repeats
    both = {r["check_id"]: r["issue_count"] for r in key_checks(df).collect()}
    assert both == {"dq_duplicate_key": repeats, "dq_death_exposure": deaths}


def test_sweep_borders(spark):
    """One policy over all ranges, policies that begin and end at borders, and sums beyond 64 bits."""
    fields = "policy string, at double, copies long, claims long"

    def met(rows, slices):
        return later_rows(spark.createDataFrame(rows, fields), slices=slices).first()["later"]

    one = [("p", float(i), 1 + i % 3, int(i % 5 == 0)) for i in range(200)]
    want = sum(b[2] * a[3] for i, a in enumerate(one) for b in one[i + 1 :])
    many = [(f"p{i // 4}", float(i % 4), 2, 1) for i in range(80)]
    for slices in (1, 2, 9, 50):
        assert met(one, slices) == want and met(many, slices) == 20 * 2 * (1 + 2 + 3)
        assert met(one + many + [(None, 1.0, 5, 5), ("p", None, 5, 5)], slices) == want + 240
    assert met([], 3) == 0
    assert met([("p", 1.0, 1, 2**31), ("p", 2.0, 2**31, 0), ("p", 3.0, 2**31 - 1, 0)], 2) == 2**31 * (2**32 - 1)


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_sweep_state_over_batches(batch):
    rng = np.random.default_rng(5)
    policy = np.sort(rng.integers(0, 12, 300)).astype(str).tolist()
    policy.sort()
    copies, claims = rng.integers(1, 5, 300), rng.integers(0, 3, 300)
    state = Sweep()
    for at in range(0, 300, batch):
        state.take(pa.array(policy[at : at + batch]), copies[at : at + batch], claims[at : at + batch])
    want = sum(int(copies[j] * claims[i]) for j in range(300) for i in range(j) if policy[i] == policy[j])
    assert state.pairs == want and (state.first, state.open) == (policy[0], policy[-1])
    assert state.first_copies == copies[np.array(policy) == policy[0]].sum()
    assert state.claims == claims[np.array(policy) == policy[-1]].sum()


def test_numbers_are_grouped_once(spark):
    rows = [("a", 1, 1.0), ("a", 2, 0.0), ("a", 2, 0.0), ("b", 2**53 + 1, 0.0), ("b", 2**53, 1.0), ("b", 2**53 + 4, 0.0), (None, 5, 1.0)]
    df = spark.createDataFrame(rows, "Policy_Number string, Duration long, MAC double")
    again = lambda table: len(re.findall(r"hashpartitioning\(policy#\d+, at#", key_checks(table)._jdf.queryExecution().optimizedPlan().toString() + key_checks(table)._jdf.queryExecution().executedPlan().toString()))
    small = df.where("Duration < 10").withColumn("Duration", F.col("Duration").cast("int"))
    assert again(small) == 0
    assert again(small.withColumn("Duration", F.col("Duration").cast("string"))) == 1
    # Longs that share a double are one duration: of b, one later row and no more.
    assert {r.check_id: r.issue_count for r in key_checks(df).collect()} == {"dq_duplicate_key": 1, "dq_death_exposure": 3}


def test_repeated_incomplete_keys_fail_without_pairs(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 1.0), ("a", 2.0)],
                               "Policy_Number string, Duration double")
    assert tuple(duplicate_keys(df).first())[2:4] == ("FAIL", 0)


def test_profile(spark, sample):
    assert tuple(profile_summary(sample).first()) == (8, 8)
    assert profile_summary(sample, approximate=True).first()["unique_policy_count"] == 8
    assert profile_summary(sample.drop("Policy_Number")).first()["unique_policy_count"] == 0
    nulls = {r[0]: r[1] for r in profile_nulls(sample).collect()}
    assert nulls["COLA"] == 5 and sum(nulls.values()) == 5
    nan = spark.createDataFrame([(math.nan, "x"), (1.0, None)], "a double, b string")
    assert {r[0]: r[1] for r in profile_nulls(nan).collect()} == {"a": 1, "b": 1}
    rows = schema_columns(sample).orderBy("position").collect()
    assert [r["column_name"] for r in rows] == sample.columns


@pytest.mark.parametrize("distinct, kind", [(20, "categorical"), (21, "numerical"), (500, "numerical")])
def test_feature_types(spark, distinct, kind):
    df = spark.range(3000).selectExpr(
        f"cast(id % {distinct} as int) as n", "cast(id as string) as t", "1.0D as MAC",
        "cast(id % 2 as int) as Issue_Age", "id % 2 = 0 as b",
    )
    got = {r[0]: r[1] for r in profile_feature_types(df).collect()}
    assert got == {"n": kind, "t": "categorical", "MAC": "numerical", "Issue_Age": "numerical",
                   "b": "categorical"}


def test_text_durations_are_keys_as_stored(spark):
    def counts(rows):
        df = spark.createDataFrame(rows, "Policy_Number string, Duration string, MAC string")
        return duplicate_keys(df).first()["status"], duplicate_keys(df).first()["issue_count"]

    assert counts([("P1", "abc", "0"), ("P1", "def", "0")]) == ("PASS", 0)
    assert counts([("P1", "abc", "0"), ("P1", "abc", "0")]) == ("FAIL", 1)
    df = spark.createDataFrame([("P1", "1", "1"), ("P1", "1.0", "0"), ("P1", "2", "0")], "Policy_Number string, Duration string, MAC string")
    assert death_exposure(df).first()["issue_count"] == 1
