"""Plans that must hold for large and skewed tables."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortwise.operators.cohorts import ae_summary, cohort_totals
from cohortwise.operators.profile import profile_feature_types, profile_nulls
from cohortwise.operators.quality import check_rows, row_checks
from cohortwise.plans.ordered import running_total
from cohortwise.registry import tables as table_queries
from cohortwise.scratch import cut_lineage, new_table_path, shared_dir
from cohortwise.sources.stores import read_prepared, write_prepared


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def prepared(spark, sample, tmp_path_factory):
    path = write_prepared(sample, str(tmp_path_factory.mktemp("prepared")))
    return read_prepared(spark, path)


def test_filters_and_columns_reach_the_scan(prepared):
    totals = cohort_totals(prepared, ["Gender"], filters=[
        {"column": "Study_Year", "op": ">=", "value": 2022},
        {"column": "Smoker", "op": "=", "value": "No"}])
    plan = _plan(totals)
    assert "GreaterThanOrEqual(Study_Year,2022)" in plan and "EqualTo(Smoker,No)" in plan
    scanned = plan.split("FileScan parquet [")[1].split("]")[0]
    assert {c.split("#")[0] for c in scanned.split(",")} == {
        "MAC", "MOC", "MEC", "MAF", "MEF", "Gender", "Smoker", "Study_Year"
    }


def test_cohorts_shuffle_once_and_only_partial_sums(prepared):
    plan = _plan(ae_summary(prepared, ["Gender", "Smoker"]))
    assert plan.count("Exchange") == 1
    assert "partial_sum" in plan.split("Exchange")[1]


def test_profiles_and_row_checks_shuffle_one_row_per_task(prepared):
    for df in (profile_nulls(prepared), check_rows(prepared, row_checks(prepared))):
        plan = _plan(df)
        assert plan.count("Exchange") == 1 and "Exchange SinglePartition" in plan
        assert "partial_" in plan.split("Exchange SinglePartition")[1]
    assert "Window" not in _plan(profile_feature_types(prepared))


def test_a_hot_segment_is_cut_into_many_slices(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
        F.col("id").alias("at"),
        (F.col("id") % 5).alias("n"),
    )
    total = running_total(df, "n", order=[F.col("at")], segment=["key"], name="before", slices=12)
    hot = sorted((r["at"], r["n"], r["before"]) for r in total.where("key = 'hot'").collect())
    cursor = 0
    for _, n, before in hot:
        assert before == cursor
        cursor += n
    cut = spark.read.parquet(_newest_cut(spark))
    assert cut.where("key = 'hot'").select("_slice").distinct().count() >= 6
    assert cut.groupBy("_slice").count().agg(F.max("count")).first()[0] < 3 * 30000 / 12


def test_running_totals_shuffle_the_rows_once_after_the_cut(spark):
    df = spark.range(100).select(F.col("id").alias("at"), F.lit(1).cast("bigint").alias("n"),
                                 (F.col("id") % 9).alias("key"))
    total = running_total(df, "n", order=[F.col("at")], segment=["key"], name="b", slices=4)
    plan = _plan(total)
    rows_side = plan.split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in rows_side and rows_side.count("Exchange hashpartitioning") == 1


def _newest_cut(spark):
    import os

    root = shared_dir(spark)
    cuts = [os.path.join(root, name) for name in os.listdir(root) if name.startswith("cut-")]
    return max(cuts, key=os.path.getmtime)


def test_slices_follow_the_data(spark):
    df = spark.range(200000).select((F.col("id") * 7919 % 200003).alias("at"),
                                    F.lit(1).cast("bigint").alias("n"), F.lit("k").alias("key"))
    running_total(df.limit(50), "n", order=[F.col("at")], segment=["key"], name="before")
    small = spark.read.parquet(_newest_cut(spark))
    assert small.select("_slice").distinct().count() == 1
    smallest = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(smallest, "50KB")
    try:
        total = running_total(df, "n", order=[F.col("at")], segment=["key"], name="before")
    finally:
        spark.conf.unset(smallest)
    large = spark.read.parquet(_newest_cut(spark))
    assert large.select("_slice").distinct().count() > 1
    ordered = total.withColumn("want", F.row_number().over(Window.orderBy("at")) - 1)
    assert ordered.where("want != before").count() == 0


def test_running_total_with_missing_segments_and_descending_order(spark):
    rows = [(None, 1, 5), (None, 2, 7), ("a", 1, 1), ("a", 2, 2), ("a", 3, 4)]
    df = spark.createDataFrame(rows, "k string, at int, n long")
    got = running_total(df, "n", order=[F.col("at").desc()], segment=["k"], name="b", slices=3)
    assert sorted((r["k"] or "", r["at"], r["b"]) for r in got.collect()) == [
        ("", 1, 7), ("", 2, 0), ("a", 1, 6), ("a", 2, 4), ("a", 3, 0)
    ]


def test_cut_tables_live_in_the_named_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == root and new_table_path(spark, "x").startswith(root)
    cut = cut_lineage(spark.range(5).withColumn("s", F.array(F.lit("a"))))
    assert cut.count() == 5 and root in cut.inputFiles()[0]


def test_joins_of_the_view_are_left_to_measured_sizes(spark):
    sf_dir = "/root/testdata/sf0.001"
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(table_queries.inforce(spark, sf_dir))
        assert plan.count("SortMergeJoin") == 3 and "Broadcast" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
