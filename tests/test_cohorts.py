import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortwise.contracts import SUMMARY_COLUMNS, default_sort, row_limit
from cohortwise.operators.cohorts import (
    ae_measure_view,
    ae_multi_grouping,
    ae_summary,
    check_grouping,
    cohort_totals,
    ranked_summary,
)
from cohortwise.operators.filters import RowFilter, apply_filters, parse_filters
from cohortwise.operators.ranking import ae_sort, ae_top_n, evidence_ref, rank_cohorts

COLUMNS = "G string, H int, MAC double, MOC double, MEC double, MAF double, MEF double"


def _by_label(df):
    return {r["Dimensions"]: r for r in df.collect()}


def test_known_ratios(sample):
    summary = ae_summary(sample, ["Gender"])
    assert summary.columns == list(SUMMARY_COLUMNS)
    assert dict(summary.dtypes)["Sum_MAC"] == "bigint"
    rows = _by_label(summary)
    assert rows["Gender=M"]["Sum_MAC"] == 2 and rows["Gender=F"]["Sum_MAC"] == 1
    assert rows["Gender=M"]["AE_Ratio_Count"] == pytest.approx(2.5316455696202533)
    assert rows["Gender=M"]["AE_Ratio_Amount"] == pytest.approx(0.8517350157728707)
    assert rows["Gender=F"]["AE_Ratio_Count"] == pytest.approx(1.5873015873015872)
    assert rows["Gender=F"]["AE_Ratio_Amount"] == pytest.approx(0.39215686274509803)


def test_claims_are_the_same_in_every_grouping(sample):
    many = ae_multi_grouping(
        sample, [["Gender"], ["Risk_Class"], ["Study_Year", "Smoker"], ["Smoker", "Study_Year"]]
    )
    sums = many.groupBy("scenario").agg(F.sum("Sum_MAC").alias("n")).collect()
    assert {r["scenario"]: r["n"] for r in sums} == {
        "gender": 3, "risk_class": 3, "study_year_smoker": 3, "smoker_study_year": 3
    }
    two = _by_label(many.where("scenario = 'study_year_smoker'"))
    alone = _by_label(ae_summary(sample, ["Study_Year", "Smoker"]))
    assert two.keys() == alone.keys()
    for label, row in alone.items():
        assert two[label]["AE_Amount_CI_Upper"] == pytest.approx(row["AE_Amount_CI_Upper"])
    assert "Study_Year=2021 | Smoker=No" in two


def test_missing_keys_and_measures(spark):
    rows = [("a", 1, None, 1.0, 0.1, None, 1.0), ("a", 1, None, 1.0, 0.1, None, 1.0),
            (None, 2, 1.0, 1.0, 0.5, 10.0, 5.0), (None, None, 0.0, 1.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, COLUMNS)
    one = _by_label(ae_summary(df, ["G"]))
    assert one["G=a"]["Sum_MAC"] == 0 and one["G=a"]["Sum_MAF"] == 0.0
    assert one["G=a"]["AE_Ratio_Count"] == 0.0
    assert one["G=nan"]["Sum_MAC"] == 1
    # a missing key is a cohort of its own, apart from the totals of other grouping sets
    many = ae_multi_grouping(df, [["G"], ["G", "H"], ["H"]])
    labels = {(r["scenario"], r["Dimensions"]): r["Sum_MAC"] for r in many.collect()}
    assert labels == {
        ("g", "G=a"): 0, ("g", "G=nan"): 1, ("g_h", "G=a | H=1"): 0, ("g_h", "G=nan | H=2"): 1,
        ("g_h", "G=nan | H=nan"): 0, ("h", "H=1"): 0, ("h", "H=2"): 1, ("h", "H=nan"): 0,
    }
    zero = _by_label(ae_summary(df.where("MEC = 0"), ["G"]))["G=nan"]
    assert zero["AE_Ratio_Count"] is None and zero["AE_Count_CI_Lower"] is None


def test_impossible_sums_leave_no_interval(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 1.0, 0.5, 4.0, 5.0)], COLUMNS)
    row = ae_summary(df, ["G"]).first()
    assert row["AE_Ratio_Count"] == 4.0 and row["AE_Count_CI_Upper"] is None


def test_boolean_and_odd_column_names(spark):
    df = spark.createDataFrame([(True, "x", 1.0, 1.0, 0.5, 1.0, 1.0)],
                               "`Is.Active` boolean, `a b` string, MAC double, MOC double, "
                               "MEC double, MAF double, MEF double")
    assert ae_summary(df, ["Is.Active", "a b"]).first()["Dimensions"] == "Is.Active=True | a b=x"


def test_min_claims_and_filters(sample):
    got = _by_label(ae_summary(sample, ["Gender", "Risk_Class"], min_claims=1,
                               filters=[{"column": "Product_Group", "op": "=", "value": "Term"}]))
    assert set(got) == {"Gender=F | Risk_Class=Preferred", "Gender=M | Risk_Class=Standard Plus",
                        "Gender=M | Risk_Class=Standard"}
    assert ae_summary(sample, ["Gender"], min_claims=9).count() == 0


def test_filter_operators(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, t string")

    def kept(*specs):
        return sorted(r["n"] for r in apply_filters(df, specs).collect())

    assert kept(RowFilter("t", "=", "a")) == [1]
    assert kept(RowFilter("t", "!=", "a")) == [2, 3]
    assert kept(RowFilter("n", ">", 1)) == [2, 3]
    assert kept(RowFilter("n", ">=", 2), RowFilter("n", "<", 3)) == [2]
    assert kept(RowFilter("n", "<=", 1.5)) == [1]
    assert kept() == [1, 2, 3]
    with pytest.raises(KeyError, match="zip"):
        kept(RowFilter("zip", "=", 1))


def test_filters_of_another_type(spark):
    df = spark.createDataFrame([(1, "a", True), (2, None, None)], "n int, t string, b boolean")

    def kept(*spec):
        return sorted(r["n"] for r in apply_filters(df, [RowFilter(*spec)]).collect())

    assert kept("n", "=", "a") == [] and kept("n", "!=", "a") == [1, 2]
    assert kept("t", "=", 1) == [] and kept("t", "!=", 1) == [1, 2]
    assert kept("n", "=", None) == [] and kept("n", "!=", None) == [1, 2]
    assert kept("b", "=", True) == [1] and kept("b", "!=", 1) == [2] and kept("n", "=", True) == [1]
    for spec in (("n", ">", "a"), ("t", "<=", 3)):
        with pytest.raises(ValueError, match="ordered"):
            kept(*spec)
    with pytest.raises(ValueError, match="one text or number"):
        RowFilter("n", "=", [1])


def test_filter_specs():
    assert parse_filters(None) == [] and parse_filters("") == []
    text = '[{"column": "a", "op": "==", "value": null}, {"column": "b", "operator": "<", "value": 3}]'
    assert [f.as_dict() for f in parse_filters(text)] == [
        {"column": "a", "operator": "=", "value": None},
        {"column": "b", "operator": "<", "value": 3},
    ]
    for bad in ('{"column": "a"}', "[1]", '[{"column": "a", "op": "="}]',
                '[{"column": "a", "op": "~", "value": 1}]', '[{"op": "=", "value": 1}]'):
        with pytest.raises(ValueError):
            parse_filters(bad)


def test_grouping_rules(sample):
    assert check_grouping(sample, "Gender") == ["Gender"]
    for bad in ([], ["Gender", "Smoker", "Study_Year"], ["Gender", "Gender"]):
        with pytest.raises(ValueError):
            check_grouping(sample, bad)
    for raw in ("Issue_Age", "Face_Amount", "Duration", "Policy_Number", "MAC", "COLA"):
        with pytest.raises(ValueError, match="cannot form cohorts"):
            check_grouping(sample, [raw])
    with pytest.raises(KeyError):
        check_grouping(sample, ["Nope"])
    with pytest.raises(ValueError, match="MEF"):
        cohort_totals(sample.drop("MEF"), ["Gender"])


def test_measures_and_sort_defaults(sample):
    assert default_sort("count") == "AE_Ratio_Count"
    assert default_sort("amount") == default_sort("both") == "AE_Ratio_Amount"
    with pytest.raises(ValueError):
        default_sort("volume")
    with pytest.raises(ValueError):
        ae_sort(sample, "Gender")
    view = ae_measure_view(ae_summary(sample, ["Gender"]), "both")
    assert view.columns == [
        "Dimensions", "measure", "actual", "expected", "ratio", "ci_lower", "ci_upper"
    ]
    got = {(r["Dimensions"], r["measure"]): r["actual"] for r in view.collect()}
    assert got[("Gender=M", "count")] == 2.0 and got[("Gender=M", "amount")] == 270000.0
    assert {r["measure"] for r in ae_measure_view(ae_summary(sample, ["Gender"]), "count").collect()} == {"count"}


def test_order_ranks_and_top_n(spark, sample):
    rows = [("b", 1.0), ("a", 1.0), ("d", None), ("c", 5.0), ("e", None)]
    df = spark.createDataFrame(rows, "Dimensions string, AE_Ratio_Count double")
    assert [r[0] for r in ae_sort(df, "AE_Ratio_Count").collect()] == ["c", "a", "b", "d", "e"]
    ranked = rank_cohorts(df, "AE_Ratio_Count", slices=3)
    assert {r[0]: r["cohort_rank"] for r in ranked.collect()} == dict(c=1, a=2, b=3, d=4, e=5)
    top = ae_top_n(df, "AE_Ratio_Count", 2)
    assert [(r[0], r["cohort_rank"]) for r in top.collect()] == [("c", 1), ("a", 2)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert [row_limit(n) for n in (1, 20, 99)] == [1, 20, 99] and row_limit(20, 20) == 20
    for bad in ((0,), (-3,), (21, 20)):
        with pytest.raises(ValueError, match="may be|must be"):
            row_limit(*bad)
    refs = spark.createDataFrame([(1,), (12345,)], "cohort_rank long").select(evidence_ref())
    assert [r[0] for r in refs.collect()] == ["row_0001", "row_12345"]


def test_ranks_over_many_slices_equal_one_window(spark):
    # two thirds of the cohorts tie on the metric
    df = spark.range(5000).select(
        F.concat(F.lit("c="), F.col("id").cast("string")).alias("Dimensions"),
        F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).alias("Sum_MEC"),
        (F.col("id") % 7 == 0).alias("g"),
    )
    order = [F.col("Sum_MEC").desc_nulls_last(), F.col("Dimensions")]
    ranked = rank_cohorts(df, "Sum_MEC", within=["g"], slices=16)
    window = F.row_number().over(Window.partitionBy("g").orderBy(*order))
    assert ranked.withColumn("want", window).where("want != cohort_rank").count() == 0
    whole = rank_cohorts(df, "Sum_MEC", slices=16)
    window = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    assert whole.withColumn("want", window).where("want != cohort_rank").count() == 0


def test_ranked_summary_keeps_all_cohorts(sample):
    ranked = ranked_summary(sample, [["Gender"], ["Risk_Class"]], "AE_Ratio_Amount").collect()
    assert sorted((r["scenario"], r["cohort_rank"]) for r in ranked) == [
        ("gender", 1), ("gender", 2),
        ("risk_class", 1), ("risk_class", 2), ("risk_class", 3), ("risk_class", 4),
    ]
    assert all(r["AE_Count_CI_Lower"] is not None for r in ranked)


def test_infinite_sums_do_not_break(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1.0, math.inf, 1.0, 1.0)], COLUMNS)
    row = ae_summary(df, ["G"]).first()
    assert row["AE_Ratio_Count"] is None and row["AE_Count_CI_Lower"] is None
    assert row["AE_Ratio_Amount"] == 1.0


def test_groupings_of_one_name_stay_apart(spark, sample):
    df = sample.withColumn("Gender_Smoker", F.col("Study_Year").cast("string"))
    found = ranked_summary(df, [["Gender", "Smoker"], ["Gender_Smoker"]], "AE_Ratio_Count").collect()
    assert {r.scenario for r in found} == {"gender_smoker"}
    for place, columns, size in ((1, ["Gender", "Smoker"], 3), (2, ["Gender_Smoker"], 3)):
        own = [r for r in found if r.grouping == place]
        assert all(r.group_columns == columns for r in own)
        assert sorted(r.cohort_rank for r in own) == list(range(1, len(own) + 1)) and len(own) >= size


def test_top_n_gives_as_many_as_asked(spark, sample):
    df = spark.range(60).selectExpr("concat('A=', id) as Dimensions", "cast(id as double) as AE_Ratio_Count")
    assert ae_top_n(df, "AE_Ratio_Count", 50).count() == 50


def test_order_against_nothing_is_refused(sample):
    with pytest.raises(ValueError, match="missing value"):
        apply_filters(sample, [{"column": "COLA", "op": ">", "value": None}])


def test_all_faults_of_filters_are_reported():
    with pytest.raises(ValueError, match="Filter 1.*lacks op.*Filter 3.*no JSON object"):
        parse_filters('[{"column": "a", "value": 1}, {"column": "a", "op": "=", "value": 1}, 5]')
