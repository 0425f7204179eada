import math

import pandas as pd
import pytest
from pyspark.sql import types as T

from cohortwise.contracts import MEASURES, SUMMARY_COLUMNS
from cohortwise.functions.labels import summary_slug
from cohortwise.operators.cohorts import ae_summary
from cohortwise.operators.dimensions import Band
from cohortwise.operators.quality import death_exposure, dq_gate, duplicate_keys, key_checks
from cohortwise.plans.study import Study
from cohortwise.sources.inforce import (
    malformed_records,
    coerce_core_numeric,
    policy_key_string,
    read_inforce,
    read_raw_strings,
    source_format,
)
from cohortwise.sources.stores import (
    bucket_number,
    check_ae_summary,
    read_ae_summary,
    read_prepared,
    write_prepared,
)


def test_format_follows_the_suffix():
    assert source_format("/a/b.CSV") == "csv"
    assert source_format("s3://x/y.parquet/") == "parquet"
    for bad in ("/a/b.xlsx", "/a/b", "/a.csv/b"):
        with pytest.raises(ValueError, match="suffix"):
            source_format(bad)


def test_csv_types_come_from_whole_columns(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text(
        "Policy_Number,MAC,Duration,Rate,Gender,Empty,Big,Note\n"
        "1,1,1,0.5,F,,12345678901234567890,a\n"
        "2,bad,NA,2,None,,1,\"x, \"\"y\"\"\"\n"
        "3,,3,n/a,NA,,2,3\n"
    )
    df = read_inforce(spark, str(path))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert kinds == {
        "Policy_Number": "string", "MAC": "double", "Duration": "bigint", "Rate": "double",
        "Gender": "string", "Empty": "double", "Big": "double", "Note": "string",
    }
    rows = sorted(df.collect(), key=lambda r: r["Policy_Number"])
    assert [r["MAC"] for r in rows] == [1.0, None, None]
    assert [r["Duration"] for r in rows] == [1, None, 3]
    assert [r["Gender"] for r in rows] == ["F", None, None]
    assert rows[1]["Note"] == 'x, "y"'


def test_csv_schema_saves_the_type_pass(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("Policy_Number,MAC,Duration\nP1,1,4\nP2,x,5\n")
    schema = T.StructType.fromDDL("Policy_Number string, MAC double, Duration int")
    df = read_inforce(spark, str(path), schema=schema)
    assert df.schema["Duration"].dataType == T.IntegerType()
    assert sorted((r["Duration"], r["MAC"]) for r in df.collect()) == [(4, 1.0), (5, None)]


def test_parquet_nan_and_text_measures(spark, tmp_path):
    path = str(tmp_path / "x.parquet")
    pd.DataFrame(
        {"Policy_Number": [7, 8], "MAC": ["1", "oops"], "MEC": [0.5, math.nan],
         "COLA": [math.nan, 5.0]}
    ).to_parquet(path)
    rows = sorted(read_inforce(spark, path).collect(), key=lambda r: r["Policy_Number"])
    assert [tuple(r) for r in rows] == [("7", 1.0, 0.5, None), ("8", None, None, 5.0)]


def test_raw_strings_keep_tokens(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('MAC,MOC\nNA,\n" 1 ",""\n')
    got = sorted(tuple(r) for r in read_raw_strings(spark, str(path)).collect())
    assert got == [(" 1 ", ""), ("NA", "")]
    parquet = str(tmp_path / "y.parquet")
    pd.DataFrame({"MAC": [1.5, math.nan]}).to_parquet(parquet)
    got = sorted(tuple(r) for r in read_raw_strings(spark, parquet).collect())
    assert got == [("",), ("1.5",)]


def test_small_coercions(spark):
    df = spark.createDataFrame([(1, True, "2")], "Policy_Number long, MAC boolean, MOC string")
    row = policy_key_string(coerce_core_numeric(df)).first()
    assert tuple(row) == ("1", 1.0, 2.0)
    assert policy_key_string(spark.range(1)).columns == ["id"]


def test_prepared_versions_do_not_replace_each_other(spark, sample, tmp_path):
    root = str(tmp_path / "study")
    first = write_prepared(sample, root)
    second = write_prepared(read_prepared(spark, first).limit(3), root, partition_by=["Study_Year"])
    assert first != second
    assert read_prepared(spark, first).count() == 8
    assert read_prepared(spark, second).count() == 3
    plan = read_prepared(spark, second).where("Study_Year = 2021")
    assert "PartitionFilters: [isnotnull(Study_Year" in plan._jdf.queryExecution().toString()


def test_summary_needs_its_columns(spark, sample, tmp_path):
    summary = ae_summary(sample, ["Gender"])
    with pytest.raises(ValueError, match="Sum_MOC"):
        check_ae_summary(summary.drop("Sum_MOC"))
    with pytest.raises(ValueError, match="no cohorts"):
        check_ae_summary(summary.where("false"), allow_empty=False)
    ranks = {r["Dimensions"]: r["cohort_rank"] for r in check_ae_summary(summary).collect()}
    assert ranks == {"Gender=M": 1, "Gender=F": 2}


def test_summaries_from_elsewhere_keep_the_order_of_their_rows(spark, sample, tmp_path):
    labels = [f"Segment={i * 7919 % 3000}" for i in range(3000)]
    row = {c: 1.0 for c in SUMMARY_COLUMNS}
    pdf = pd.DataFrame([{**row, "Dimensions": label, "Extra": "x"} for label in labels])
    pdf.to_csv(tmp_path / "s.csv", index=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        back = read_ae_summary(spark, str(tmp_path / "s.csv"), fmt="csv")
        assert back.columns == [*SUMMARY_COLUMNS, "cohort_rank"]
        assert spark.read.csv(str(tmp_path / "s.csv")).rdd.getNumPartitions() > 3
        got = [r["Dimensions"] for r in back.orderBy("cohort_rank").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == labels


def test_slug():
    assert summary_slug(["Risk Class", "Issue_Age_Band", "Smoker?"]) == (
        "risk_class_issue_age_band_smoker"
    )
    assert summary_slug(["Smoker?", "Risk Class"]) == "smoker_risk_class"
    assert summary_slug(["??"]) == "all"


def test_sample_measures(sample):
    assert all(sample.schema[m].dataType == T.DoubleType() for m in MEASURES)
    assert sample.count() == 8


def test_malformed_records_are_refused_or_listed(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("Policy_Number,MAC\nP1,1\nP2,2,extra\nP3\nP4,4\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_inforce(spark, str(path)).collect()
    assert sorted(r.record for r in malformed_records(spark, str(path)).collect()) == ["P2,2,extra", "P3"]


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('Policy_Number,MAC\nP1,1\n"P\n2",2\n')
    got = sorted((r.Policy_Number, r.MAC) for r in read_inforce(spark, str(path), multi_line=True).collect())
    assert got == [("P\n2", 2.0), ("P1", 1.0)]
    assert malformed_records(spark, str(path)).count() == 1
    assert malformed_records(spark, str(path), multi_line=True).count() == 0


def test_headers_of_all_files_agree(spark, tmp_path):
    folder = tmp_path / "x.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("Policy_Number,MAC\nP1,1\n")
    (folder / "b.csv").write_text("MAC,Policy_Number\n1,P1\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_inforce(spark, str(folder)).collect()


def test_folders_keep_text_and_order(spark, tmp_path):
    df = spark.createDataFrame([("007", 1, "a"), ("7", 2, "b"), (None, 3, "c")], "Code string, MAC long, Gender string")
    back = read_prepared(spark, write_prepared(df, str(tmp_path / "s"), partition_by=["Code"]))
    assert back.columns == df.columns and back.schema["Code"].dataType == T.StringType()
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    empty = spark.createDataFrame([("", 1)], "Code string, MAC long")
    with pytest.raises(Exception, match="Empty text"):
        write_prepared(empty, str(tmp_path / "t"), partition_by=["Code"])


def test_undefined_values_of_a_csv_summary(spark, sample, tmp_path):
    row = {c: 1.0 for c in SUMMARY_COLUMNS}
    rows = [{**row, "Dimensions": "G=a", "AE_Ratio_Amount": "NA"}, {**row, "Dimensions": "G=b", "AE_Ratio_Amount": "nan"}]
    pd.DataFrame(rows).to_csv(tmp_path / "s.csv", index=False)
    assert [r.AE_Ratio_Amount for r in read_ae_summary(spark, str(tmp_path / "s.csv"), fmt="csv").collect()] == [None, None]


def test_bucketed_versions_are_read_where_they_lie(spark, sample, tmp_path):
    root = str(tmp_path / "study's")
    path = write_prepared(sample, root, buckets=4)
    again = spark.newSession()
    for session in (spark, again):
        df = read_prepared(session, path)
        assert df.schema.simpleString() == sample.schema.simpleString() and df.columns == sample.columns
        assert sorted(map(str, df.collect())) == sorted(map(str, sample.collect()))
    df = read_prepared(spark, path)
    for check in (duplicate_keys(df), death_exposure(df, co_located=True)):
        plan = check._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange" in line and "SinglePartition" not in line]
        assert moved == [] and "Bucketed: true" in plan
    with pytest.raises(ValueError, match="not both"):
        write_prepared(sample, root, buckets=4, partition_by=["Gender"])


def test_key_checks_of_buckets_equal_those_of_ranges(spark, tmp_path):
    rows = [(f"P{i % 40}" if i % 9 else None, float(i % 7) if i % 11 else None, float(i % 5 == 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "Policy_Number string, Duration double, MAC double")
    path = write_prepared(df, str(tmp_path / "s"), buckets=3)
    want = sorted(key_checks(df).collect())
    assert sorted(key_checks(read_prepared(spark, path), co_located=True).collect()) == want
    assert {r["status"] for r in want} == {"FAIL"}


def test_buckets_grow_with_the_table(spark):
    assert [bucket_number(spark.range(n)) for n in (0, 10, 4_000_000, 4_000_001, 40_000_000)] == [8, 8, 8, 9, 80]


def test_a_study_in_buckets(spark, sample_csv, tmp_path):
    study = Study(spark, str(tmp_path / "study"))
    study.profile(sample_csv, buckets=2)
    assert dq_gate(study.validate()).first()["status"] == "PASS"
    study.band("Face_Amount", "Face_Amount_Band", Band("quantile", bins=4))
    assert study.unchanged() and study.validate().where("status = 'FAIL'").count() == 0
    plan = study.prepared().groupBy("Policy_Number").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
