import pytest

from cohortwise.operators.dimensions import Band
from cohortwise.plans.study import Study


def test_run_band_and_share(spark, sample_csv, tmp_path):
    study = Study(spark, str(tmp_path / "study"))
    rows, warnings = study.run(
        sample_csv, [["Gender"], ["Gender", "Smoker"]], min_claims=1, top_n=1
    )
    assert rows.count() == 1 and warnings.count() == 0
    # the stored summaries are whole
    counts = study.summaries().groupBy("scenario").count().collect()
    assert {r["scenario"]: r["count"] for r in counts} == {"gender": 2, "gender_smoker": 3}
    steps = [r["step_name"] for r in study.steps().orderBy("event_ts").collect()]
    assert steps == [
        "Source dataset profiled",
        "Validation checks run",
        "Grouped A/E analysis run",
        "Grouped A/E analysis run",
        "Sanitized AI A/E packet built",
    ]
    kinds = {r["artifact_type"] for r in study.artifacts().collect()}
    assert kinds == {
        "source_dataset", "prepared_dataset", "ae_summary", "latest_ae_summary", "ai_ae_packet"
    }
    assert study.stale().count() == 0

    banded = study.band("Face_Amount", "Face_Amount_Band", Band("quantile", bins=4))
    assert banded.select("Face_Amount_Band").distinct().count() == 4
    assert study.stale().count() == 2
    reached = {(r["artifact_type"], r["steps"]) for r in study.stale_downstream().collect()}
    assert reached == {("ae_summary", 1), ("latest_ae_summary", 1), ("ai_ae_packet", 2)}
    assert study.unchanged()
    with pytest.raises(FileNotFoundError, match="stale"):
        study.packet()
    with pytest.raises(ValueError, match="already exists"):
        study.band("Face_Amount", "Face_Amount_Band", Band("quantile", bins=2))

    # a study resumes from its folder
    again = Study(spark, study.root)
    summary = again.ae(["Face_Amount_Band"], measure="amount", filters=[
        {"column": "Policy_Number", "op": "!=", "value": "P999"}])
    got = [(r["Dimensions"], round(r["AE_Amount_CI_Lower"], 2), round(r["AE_Amount_CI_Upper"], 2))
           for r in summary.orderBy("cohort_rank").collect()]
    assert got == [
        ("Face_Amount_Band=215000 to 252500", 0.44, 1.33),
        ("Face_Amount_Band=252500 to 300000", 0.11, 1.67),
        ("Face_Amount_Band=125000 to 195000", 0.00, 4.05),
        ("Face_Amount_Band=195000 to 215000", 0.00, 4.34),
    ]
    rows, warnings = again.packet()
    assert {tuple(r["Dimension_Columns"]) for r in rows.collect()} == {("Face_Amount_Band",)}
    assert [r["code"] for r in warnings.collect()] == ["sensitive_filter_masked"]
    assert "P0" not in str(rows.collect())
    about = again.packet_metadata().orderBy("packet_version").collect()
    assert len(about) == 2 and about[1]["group_by"] == ["Face_Amount_Band"]
    assert "P999" not in about[1]["filters"] and "[masked value]" in about[1]["filters"]
    assert about[0]["packet_fingerprint"] != about[1]["packet_fingerprint"]
    ways = {r["way"]: r["scenario"] for r in again.latest_by_way().collect()}
    assert ways == {1: "face_amount_band", 2: "gender_smoker"}
    given, _ = again.packet(summary=summary.drop("run_id", "scenario"), top_n=2)
    assert given.count() == 2
    assert again.exhibits("amount").count() == 4

    grouped = again.regroup("Risk_Class", "Risk_Class_Group",
                            {"Preferred": ["Preferred", "Preferred Plus"],
                             "Standard": ["Standard", "Standard Plus"]})
    assert {r[0] for r in grouped.select("Risk_Class_Group").distinct().collect()} == {
        "Preferred", "Standard"
    }


def test_failed_checks_stop_the_run(spark, sample_csv, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text(open(sample_csv).read().replace("P001,1,1,", "P001,1,2,"))
    study = Study(spark, str(tmp_path / "study"))
    with pytest.raises(ValueError, match="Validation failed"):
        study.run(str(path), [["Gender"]])
    assert [r["tool_name"] for r in study.steps().orderBy("event_ts").collect()] == [
        "profile", "validate"
    ]
    assert study.summaries().count() == 0
    with pytest.raises(FileNotFoundError):
        study.packet()


def test_order_of_steps(spark, tmp_path):
    study = Study(spark, str(tmp_path / "empty"))
    with pytest.raises(FileNotFoundError, match="profile"):
        study.ae(["Gender"])
    with pytest.raises(ValueError, match="grouping"):
        study.run("x.csv", [])
