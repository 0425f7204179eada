import zlib

import pytest
from pyspark.sql import functions as F

from cohortwise.llm import sharding


def check(rows, got, shards=24):
    """Law, sizes and slots of the result, against the input's (doc_id, text) rows."""
    size = [len((t or "").encode()) + 8 for _, t in rows]
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(i), n, zlib.crc32((t or "").encode())) for (i, t), n in zip(rows, size, strict=True)
    )
    total, largest = sum(size), max(size)
    for s in range(shards):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / shards) <= largest
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and {r.shard for r in got} <= set(range(shards))


def brute(rows, shards):
    """The same shards by one running sum over all rows in key order."""
    import hashlib

    def order(row):
        i, t = row
        return (t is not None, hashlib.md5((t or "").encode()).hexdigest(), i is not None, i or 0)

    total, before, out = sum(len((t or "").encode()) + 8 for _, t in rows), 0, []
    for i, t in sorted(rows, key=order):
        n = len((t or "").encode()) + 8
        out.append((i, n, min(shards - 1, shards * (2 * before + n) // (2 * total))))
        before += n
    return sorted(out, key=str)


def test_small_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sharding.shard_documents(docs).collect()
    check(rows, got)
    assert sorted(((r.doc_id, r.size, r.shard) for r in got), key=str) == brute(rows, 24)


EDGES = [(1, None), (2, ""), (None, "a b"), (3, "é😀\x00\n"), (4, "x" * 5000), (5, "x" * 5000), (5, "x" * 5000), (6, None)]


def test_edges(documents):
    rows = EDGES + [(100 + k, f"word{k} " * (k % 7)) for k in range(200)]
    for extra in ("shard", "slot", "size", "text_key"):
        got = sharding.shard_documents(documents(rows, extra=extra), shards=4).collect()
        check(rows, got, shards=4)
    assert sorted(((r.doc_id, r.size, r.shard) for r in got), key=str) == brute(rows, 4)


def test_no_documents_and_one(documents):
    assert sharding.shard_documents(documents([])).collect() == []
    (row,) = sharding.shard_documents(documents([(7, "alone")])).collect()
    assert (row.slot, row.shard) == (0, 12)  # its middle byte is the middle of all


def test_a_third_of_all_rows_are_one_row_repeated(documents):
    rows = [(1, "the same text again")] * 400 + [(k, f"text {k * 7919}") for k in range(2, 800)]
    got = sharding.shard_documents(documents(rows)).collect()
    check(rows, got)
    assert len({r.shard for r in got if r.doc_id == 1}) > 5  # the hot key is cut


def test_overfull_ranges_are_subdivided(documents, monkeypatch):
    monkeypatch.setattr(sharding, "POINTS", 1)  # splitters of a poor sample
    rows = [(k, f"{k}" * (1 + k % 9)) for k in range(3000)]
    df = documents(rows)
    keyed = df.select(
        F.struct("*").alias("record"),
        sharding.size_of(F.col("text")).alias("size"),
        F.monotonically_increasing_id().alias("row"),
        F.struct(sharding.text_key(F.col("text")).alias("p0"), F.monotonically_increasing_id().alias("p1")).alias("key"),
    ).cache()
    sizes = {}
    for turns in (1, 4):
        monkeypatch.setattr(sharding, "TURNS", turns)
        ranged, measured, total = sharding.ranges(keyed, 4)
        sizes[turns] = [r["bytes"] for r in measured.collect()]
        assert sum(sizes[turns]) == total == sum(r["size"] for r in keyed.collect())
    count = min(4 * sharding.RANGES_PER_SHARD, 3000 // sharding.LEAST_RECORDS + 1)
    assert max(sizes[1]) > sharding.OVERFULL * total / count >= max(sizes[4])
    check(rows, sharding.shard_documents(df).collect())


def test_sample_points_follow_size(spark):
    df = spark.range(4000).select(
        F.col("id").alias("row"), F.when(F.col("id") % 4 == 0, 97).otherwise(1).cast("long").alias("size")
    )
    points = df.select("size", sharding._points(F.col("size"), F.lit(100_000), F.lit(2000), 0).alias("n")).groupBy("size").sum("n")
    got = {r["size"]: r["sum(n)"] for r in points.collect()}
    assert got[97] == pytest.approx(1940, abs=60) and got[1] == pytest.approx(60, abs=40)


def test_whole_documents_in_files(spark, documents, tmp_path):
    rows = [(k, f"text {k} " * 5, "en", "s") for k in range(300)]
    sharding.write_shards(documents(rows, extra="slot"), f"{tmp_path}/out", shards=3, rows_per_file=40)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.doc_id, r.text, r.lang, r.source) for r in got) == rows
    assert {r.shard for r in got} == {0, 1, 2} and all(isinstance(r.slot, int) for r in got)
    one = spark.read.parquet(f"{tmp_path}/out/shard=1").count()
    assert abs(one - 100) < 3


def test_plan_has_no_python(documents):
    plan = sharding.shard_documents(documents(EDGES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
