import pytest
from pyspark.sql import types as T

from cohortwise.operators.audit import table_fingerprint
from cohortwise.operators.quality import check_rows, counted_raw_report, dq_report, raw_checks
from cohortwise.plans.study import Study
from cohortwise.sources.inforce import land_csv, read_inforce, read_landed_inforce, read_raw_strings
from cohortwise.sources.landing import land, landed_at, read_landed

ODD = (
    'Policy_Number,MAC,MOC,Duration,Rate,Code,Note,Empty,Big\n'
    'P1,1,0.5, 7 ,0.10,007,"x, ""y""",,9223372036854775807\n'
    'P2,n/a,oops,8,1e3,12,NA,NaN,1\n'
    '8,#N/A,1,+9,5,13,None,,-2\n'
    ',NaN,inf,,.5,1.0x,"two\twords",nan,\n'
)


@pytest.fixture
def odd(tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text(ODD)
    return str(path)


def test_cells_keep_their_values_and_types(spark, odd, tmp_path):
    landed = land_csv(spark, odd, str(tmp_path / "landed"))
    assert landed.row_count == 4 and landed.not_numbers == {"MAC": 1, "MOC": 1}
    assert landed.kinds == {
        "Policy_Number": "text", "MAC": "number", "MOC": "number", "Duration": "whole", "Rate": "number",
        "Code": "text", "Note": "text", "Empty": "number", "Big": "whole",
    }
    rows = read_landed_inforce(spark, landed).collect()
    columns = {c: [r[c] for r in rows] for c in landed.columns}
    assert columns["Duration"] == [7, 8, 9, None] and columns["Rate"] == [0.1, 1000.0, 5.0, 0.5]
    # Text that could be numbers is given back as written.
    assert columns["Code"] == ["007", "12", "13", "1.0x"] and columns["Note"] == ['x, "y"', None, None, "two\twords"]
    assert columns["MAC"] == [1.0, None, None, None] and columns["MOC"] == [0.5, None, 1.0, float("inf")]
    assert columns["Policy_Number"] == ["P1", "P2", "8", None] and columns["Empty"] == [None] * 4
    assert columns["Big"] == [2**63 - 1, 1, -2, None]


def test_landed_counts_are_those_of_the_text_view(spark, odd, tmp_path):
    landed = land_csv(spark, odd, str(tmp_path / "landed"))
    raw = read_raw_strings(spark, odd)
    want = check_rows(raw, raw_checks(raw)).collect()
    assert counted_raw_report(spark, landed.not_numbers).collect() == want
    df = read_landed_inforce(spark, landed)
    assert sorted(dq_report(df, raw).collect()) == sorted(dq_report(df, raw_counts=landed.not_numbers).collect())


def test_digest_is_that_of_the_cells(spark, odd, tmp_path):
    landed = land_csv(spark, odd, str(tmp_path / "a"))
    text = spark.read.csv(odd, header=True, escape='"')
    assert landed.content_hash(spark) == table_fingerprint(text).first()["content_hash"]
    lines = ODD.splitlines()
    (tmp_path / "turned.csv").write_text("\n".join([lines[0], *reversed(lines[1:])]) + "\n")
    turned = land_csv(spark, str(tmp_path / "turned.csv"), str(tmp_path / "b"))
    assert turned.content_hash(spark) == landed.content_hash(spark)
    (tmp_path / "other.csv").write_text(ODD.replace("0.10", "0.1"))
    assert land_csv(spark, str(tmp_path / "other.csv"), str(tmp_path / "c")).content_hash(spark) != landed.content_hash(spark)


def test_landed_again_from_its_folder_without_the_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("Policy_Number,MAC,Duration\n" + "".join(f"P{i},{i % 2},{i}\n" for i in range(500)))
    landed = land_csv(spark, str(path), str(tmp_path / "landed"))
    path.unlink()
    assert landed_at(spark, landed.path) == landed
    df = read_landed(spark, landed_at(spark, landed.path))
    assert df.count() == 500 and df.schema["Duration"].dataType == T.LongType()
    plan = df.where("Duration > 490")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(w2), GreaterThan(w2,490)]" in plan


def test_header_only_and_odd_names(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("Policy_Number,MAC,a.b,w0\n")
    landed = land_csv(spark, str(path), str(tmp_path / "landed"))
    df = read_landed_inforce(spark, landed)
    assert df.columns == ["Policy_Number", "MAC", "a.b", "w0"] and df.collect() == [] and landed.row_count == 0
    path.write_text("Policy_Number,MAC,a.b,w0\nP,1,2,x\n")
    (row,) = read_inforce(spark, str(path)).collect()
    assert tuple(row) == ("P", 1.0, 2, "x")


def test_broken_records_leave_nothing_landed(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("Policy_Number,MAC\nP1,1\nP2,2,extra\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        land_csv(spark, str(path), str(tmp_path / "landed"))
    assert not (tmp_path / "landed" / "facts").exists()


def test_a_study_parses_its_csv_once(spark, sample_csv, tmp_path):
    source = tmp_path / "once.csv"
    with open(sample_csv) as text:
        source.write_text(text.read().replace("0.80,0.15", "0.80,n.a."))
    study = Study(spark, str(tmp_path / "study"))
    study.profile(str(source))
    source.unlink()  # whatever follows cannot read it
    report = {(r["check_id"], r["column_name"]): r["issue_count"] for r in study.validate().collect()}
    assert report["dq_raw_non_numeric", "MEC"] == 1 and report["dq_raw_non_numeric", "MAC"] == 0
    assert study.prepared().count() == 8 and "Issue_Age_Band" in study.prepared().columns


def test_a_csv_read_without_its_digest_has_the_same_facts(spark, tmp_path):
    text = spark.createDataFrame([("P1", "1", "x"), ("P2", "0", "")], "Policy_Number string, MAC string, Gender string")
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    bare = land(text, str(tmp_path / "bare"), digest=False)
    whole = land(text, str(tmp_path / "whole"))
    assert (bare.kinds, bare.not_numbers, bare.row_count) == (whole.kinds, whole.not_numbers, 2)
    assert bare.state == {"row_count": 2}
    with pytest.raises(ValueError, match="without a digest"):
        bare.content_hash(spark)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == limit
