import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortwise.functions.ratios import clip, safe_ratio
from cohortwise.functions.values import missing_text, parse_integer, parse_number


def _texts(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def test_numbers_are_read_and_look_alikes_are_not(spark):
    good = {"1": 1.0, " 2.5 ": 2.5, "-.5": -0.5, "+3.": 3.0, "1e3": 1000.0, "1E-2": 0.01,
            "inf": math.inf, "-Infinity": -math.inf, "\t7\n": 7.0, " 8　": 8.0}
    bad = ["", "1d", "2f", "0x10", "1,000", "one", "--5", "nan", "1 2", "1e", ".", "٣x"]
    df = _texts(spark, [*good, *bad]).select("t", parse_number(F.col("t")).alias("n"))
    read = {r["t"]: r["n"] for r in df.collect()}
    assert {t: read[t] for t in good} == good
    assert all(read[t] is None for t in bad)


def test_missing_tokens(spark):
    gone = [None, "", "  ", "NA", "nan", " Null ", "NONE", "n/a", "N/A\t"]
    kept = ["0", "nay", "n a", "none of these"]
    df = _texts(spark, [*gone, *kept]).select("i", missing_text(F.col("t")).alias("m"))
    flags = [r["m"] for r in df.orderBy("i").collect()]
    assert flags == [True] * len(gone) + [False] * len(kept)


def test_safe_ratio_and_clip(spark):
    inf, nan = math.inf, math.nan
    rows = [(1.0, 2.0, 0.5), (1.0, 0.0, None), (1.0, -1.0, None), (None, 1.0, None),
            (1.0, None, None), (nan, 1.0, None), (1.0, inf, None), (inf, 1.0, None),
            (1e300, 1e-300, None), (0.0, 3.0, 0.0), (1.0, nan, None)]
    df = spark.createDataFrame(rows, "n double, d double, want double")
    got = df.select(safe_ratio(F.col("n"), F.col("d")).alias("r"), "want").collect()
    assert [r["r"] for r in got] == [r["want"] for r in got]
    clipped = spark.createDataFrame([(-1.0,), (1.5,), (9.0,), (None,)], "x double").select(
        clip(F.col("x"), 0.0, 3.0).alias("c")
    )
    assert [r["c"] for r in clipped.collect()] == [0.0, 1.5, 3.0, None]


@settings(max_examples=5, deadline=None)
@given(numbers=st.lists(st.floats(allow_nan=False), min_size=1, max_size=50))
def test_every_python_float_text_is_read_back(spark, numbers):
    df = _texts(spark, [repr(n) for n in numbers])
    got = df.select("i", parse_number(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == pytest.approx(numbers, rel=0, abs=0)


def test_numbers_of_a_row_make_a_method_that_the_jvm_compiles(spark, tmp_path):
    texts = spark.range(3).select(*[F.col("id").cast("string").alias(c) for c in "abcdefghijklmn"])
    texts.write.parquet(str(tmp_path / "texts"))
    cells = spark.read.parquet(str(tmp_path / "texts"))
    parsed = cells.select(*[parse_number(F.col(c)).alias(c) for c in cells.columns])
    stage = parsed._jdf.queryExecution().debug().codegenToSeq().head()
    assert stage._3().maxMethodCodeSize() < 8000


def test_white_space_of_any_kind_stands_around_numbers(spark):
    texts = ["　1.5\x85", " +.5e1\n", "\t-Inf ", "1 2", "1d", "0x1", "\x011", " 7", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    number, whole = parse_number(F.col("t")), parse_integer(F.col("t"))
    found = [tuple(r) for r in df.select(number, whole).collect()]
    none = (None, None)
    assert found == [(1.5, None), (5.0, None), (-math.inf, None), none, none, none, none, (7.0, 7), none]
