import hashlib
import json
import os
import random

from pyspark.sql import functions as F

from cohortwise.operators.audit import (
    artifact_latest,
    canonical_json,
    lineage_edges,
    stale_downstream,
    stale_summaries,
    state_fingerprint,
    state_inputs,
    table_fingerprint,
)
from cohortwise.sources import digests
from cohortwise.sources.logs import append_batch

ENTRY = ("entry_id long, entry_ts timestamp, artifact_type string, path string, "
         "content_hash string, "
         "source_artifacts array<struct<artifact_type:string,path:string,content_hash:string>>")


def _log(spark):
    def made(h):
        return [("prepared_dataset", "p", h)]

    rows = [
        (1, "prepared_dataset", "p", "h1", None),
        (2, "ae_summary", "s1", "x", made("h1")),
        (3, "prepared_dataset", "p", "h2", [("prepared_dataset_prior", "p", "h1")]),
        (4, "ae_summary", "s2", "y", made("h2")),
        (5, "ae_summary", "s2", "z", made("h2")),
        (6, "ai_ae_packet", "k", "w", [("latest_ae_summary", "s1", "x")]),
    ]
    fields = ENTRY.replace("entry_ts timestamp, ", "")
    return spark.createDataFrame(rows, fields).withColumn(
        "entry_ts", F.timestamp_seconds(F.floor(F.col("entry_id") / 2))
    )


def test_latest_keeps_the_first_creation_time(spark):
    rows = {(r["artifact_type"], r["path"]): r for r in artifact_latest(_log(spark)).collect()}
    assert len(rows) == 4
    summary = rows[("ae_summary", "s2")]
    assert summary["content_hash"] == "z" and summary["created_ts"] == summary["updated_ts"]
    prepared = rows[("prepared_dataset", "p")]
    assert prepared["content_hash"] == "h2" and prepared["created_ts"] < prepared["updated_ts"]


def test_lineage_and_staleness(spark):
    edges = {(r["source_path"], r["target_path"]) for r in lineage_edges(_log(spark)).collect()}
    assert edges == {("p", "s1"), ("p", "p"), ("p", "s2"), ("s1", "k")}
    stale = stale_summaries(_log(spark)).collect()
    assert [(r["path"], r["source_hash"], r["current_hash"]) for r in stale] == [("s1", "h1", "h2")]


def test_table_fingerprint_ignores_order_but_not_content(spark, sample):
    first = table_fingerprint(sample).first()
    assert table_fingerprint(sample.repartition(5).orderBy("Issue_Age")).first() == first
    assert table_fingerprint(sample.select(*reversed(sample.columns))).first() == first
    for other in (sample.limit(7), sample.union(sample), sample.withColumn("MAC", F.col("MAC") + 1),
                  sample.withColumnRenamed("Gender", "Sex")):
        assert table_fingerprint(other).first()["content_hash"] != first["content_hash"]
    assert table_fingerprint(sample.limit(0)).first()["row_count"] == 0


def test_table_fingerprint_sums_four_runs_of_every_rows_hash(spark):
    df = spark.createDataFrame([("a", 1), ("bc", None)], "k string, n int")
    digests = [hashlib.sha256(text.encode()).hexdigest() for text in ("1:a|1:1", "2:bc|-")]
    sums = [str(sum(int(d[at : at + 15], 16) for d in digests)) for at in (0, 15, 30, 45)]
    content = hashlib.sha256("|".join(["k:string,n:int", "2", *sums]).encode()).hexdigest()
    assert table_fingerprint(df).first() == (2, content)


def test_state_fingerprint_is_the_hash_of_canonical_json(spark):
    inputs = state_inputs(group_by=["Gender"], filters=[{"column": "a", "operator": "=", "value": 'q"'}],
                          min_claims=3)
    sources = {"prepared_data_path": F.lit("abc"), "latest_ae_path": F.lit(None).cast("string")}
    got = spark.range(1).select(state_fingerprint(sources, inputs).alias("h")).first()["h"]
    whole = {**inputs, "source_hashes": {"prepared_data_path": "abc", "latest_ae_path": None}}
    want = json.dumps(whole, sort_keys=True, separators=(",", ":"))
    assert canonical_json(whole) == want
    assert got == hashlib.sha256(want.encode()).hexdigest()


def test_table_fingerprint_sees_moves_types_and_repeats(spark):
    def mark(rows, schema="a double, b double, c string"):
        return table_fingerprint(spark.createDataFrame(rows, schema)).first()["content_hash"]

    base = mark([(None, 5.0, "x"), (1.0, 2.0, "y")])
    assert mark([(1.0, 2.0, "y"), (None, 5.0, "x")]) == base
    assert len({
        base,
        mark([(5.0, None, "x"), (1.0, 2.0, "y")]),
        mark([(None, 5.0, "y"), (1.0, 2.0, "x")]),
        mark([(None, 5.0, "x"), (None, 5.0, "x")]),
        mark([(None, 5.0, "x"), (1.0, 2.0, "y"), (1.0, 2.0, "y")]),
        mark([(None, 5.0, "x"), (1.0, 2.0, None)]),
        mark([(None, 5.0, "x"), (1.0, 2.0, "")]),
    }) == 7
    assert mark([("1",)], "a string") != mark([(1,)], "a int")
    assert mark([("1|1:2", "3")], "a string, b string") != mark([("1", "1:2|3")], "a string, b string")


def _entries(spark, rows):
    """Log rows (id, name, content, [(source, content it had)]) as artifact entries."""
    made = [(i, "node", name, h, [("node", n, was) for n, was in sources]) for i, name, h, sources in rows]
    return spark.createDataFrame(made, ENTRY.replace("entry_ts timestamp, ", "")).withColumn(
        "entry_ts", F.timestamp_seconds(F.col("entry_id"))
    )


def _reached(spark, rows):
    return {r["path"]: r["steps"] for r in stale_downstream(_entries(spark, rows)).collect()}


def test_staleness_reaches_every_later_step(spark):
    chain = [(1, "p", "h1", []), (2, "s", "x", [("p", "h1")]), (3, "k", "y", [("s", "x")]), (4, "e", "z", [("k", "y")])]
    assert _reached(spark, chain) == {}
    assert _reached(spark, [*chain, (5, "p", "h2", [])]) == {"s": 1, "k": 2, "e": 3}
    # Made again from the changed one, a summary is current; what was made from the old one is not.
    assert _reached(spark, [*chain, (5, "p", "h2", []), (6, "s", "x2", [("p", "h2")])]) == {"k": 1, "e": 2}
    assert _reached(spark, []) == {}


def test_staleness_in_diamonds_cycles_and_of_unknown_sources(spark):
    diamond = [
        (1, "p", "h1", []), (2, "a", "a1", [("p", "h1")]), (3, "b", "b1", [("a", "a1")]),
        (4, "c", "c1", [("p", "h1"), ("b", "b1")]), (5, "p", "h2", []),
    ]
    assert _reached(spark, diamond) == {"a": 1, "c": 1, "b": 2}
    ring = [(1, "p", "h1", []), (2, "a", "a1", [("c", "c1"), ("p", "h1")]), (3, "b", "b1", [("a", "a1")]), (4, "c", "c1", [("b", "b1")])]
    assert _reached(spark, ring) == {}
    assert _reached(spark, [*ring, (5, "p", "h2", [])]) == {"a": 1, "b": 2, "c": 3}
    assert _reached(spark, [(1, "a", "a1", [("gone", "x")]), (2, "self", "s1", [("self", "s0")])]) == {"self": 1}


def test_staleness_against_a_walk_of_random_graphs(spark):
    rng = random.Random(3)
    for _ in range(3):
        names = [f"n{i}" for i in range(40)]
        content = {n: f"{n}-{rng.randint(0, 9)}" for n in names}
        rows = [
            (i, n, content[n], [(m, content[m] if rng.random() < 0.9 else "old") for m in rng.sample(names, rng.randint(0, 3))])
            for i, n in enumerate(names)
        ]
        want = {n: 1 for _, n, _, made in rows if any(content[m] != was for m, was in made)}
        front = set(want)
        steps = 1
        while front:
            steps += 1
            front = {n for _, n, _, made in rows if n not in want and any(m in front for m, _ in made)}
            want |= {n: steps for n in front}
        assert _reached(spark, rows) == want


def test_manifest_hashes_new_files_only(spark, sample, tmp_path):
    path, manifest = str(tmp_path / "t"), str(tmp_path / "m")
    rows = sample.repartition(3)

    def fingerprint():
        return digests.manifest_fingerprint(spark, path, manifest, sample.schema).first()

    rows.where("Issue_Age < 45").write.partitionBy("Study_Year").parquet(path)
    first = digests.refresh_manifest(spark, path, manifest, sample.schema)
    assert first == len([f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")])
    assert digests.refresh_manifest(spark, path, manifest, sample.schema) == 0
    assert fingerprint() == table_fingerprint(sample.where("Issue_Age < 45")).first()
    rows.where("Issue_Age >= 45").write.mode("append").partitionBy("Study_Year").parquet(path)
    assert 0 < digests.refresh_manifest(spark, path, manifest, sample.schema) <= 8
    assert fingerprint() == table_fingerprint(sample).first()
    # Two refreshes at once may both log a file.
    append_batch(digests.read_manifest(spark, manifest).limit(2), manifest)
    assert fingerprint() == table_fingerprint(sample).first()
    # A file that is gone, or was written anew, no longer counts.
    gone = sorted(str(p) for p in (tmp_path / "t").rglob("*.parquet"))[0]
    left = spark.read.schema(sample.schema).parquet(path).where(~F.col("_metadata.file_path").endswith("/".join(gone.rsplit("/", 2)[1:])))
    want = table_fingerprint(left.select(*sample.columns)).first()
    os.remove(gone)
    assert fingerprint() == want


def test_no_fingerprint_depends_on_files_or_partitions(spark, sample, tmp_path):
    path, manifest = str(tmp_path / "t"), str(tmp_path / "m")
    sample.limit(0).write.parquet(path)
    digests.refresh_manifest(spark, path, manifest, sample.schema)
    assert digests.manifest_fingerprint(spark, path, manifest, sample.schema).first() == table_fingerprint(sample.limit(0)).first()
    for n in (1, 4):
        sample.repartition(n).write.mode("append").parquet(path)
        digests.refresh_manifest(spark, path, manifest, sample.schema)
    twice = sample.union(sample)
    assert digests.manifest_fingerprint(spark, path, manifest, sample.schema).first() == table_fingerprint(twice).first()


def test_row_text_tells_cells_apart(spark):
    def mark(rows, schema):
        return table_fingerprint(spark.createDataFrame(rows, schema)).first()["content_hash"]

    assert mark([("-", 1)], "a string, b int") != mark([(None, 1)], "a string, b int")
    assert mark([(1, None)], "a int, b int") != mark([(None, 1)], "a int, b int")
    assert mark([("1", "2|1:3")], "a string, b string") != mark([("1|1:2", "3")], "a string, b string")
    assert mark([(-1,)], "a int") != mark([(1,)], "a int")


def test_sketches_of_any_choice_of_partitions(spark, tmp_path):
    path, store = str(tmp_path / "t"), str(tmp_path / "s")
    df = spark.range(60_000).selectExpr("concat('P', id % 20000) as Policy_Number", "cast(id % 3 as int) as part")

    def near(folders, want):
        got = digests.sketched_summary(spark, path, store, folders).first()["unique_policy_count"]
        return abs(got - want) <= 0.02 * want

    df.where("part < 2").write.partitionBy("part").parquet(path)
    assert digests.refresh_sketches(spark, path, store, df.schema) > 0
    df.where("part = 2").write.mode("append").partitionBy("part").parquet(path)
    new = digests.refresh_sketches(spark, path, store, df.schema)
    assert new == len([f for _, _, names in os.walk(tmp_path / "t" / "part=2") for f in names if f.endswith(".parquet")])
    for part in range(3):
        one = df.where(f"part = {part}")
        assert near({"part": part}, one.select("Policy_Number").distinct().count())
        assert digests.sketched_summary(spark, path, store, {"part": part}).first()["total_rows"] == one.count()
    assert near(None, 20_000) and near({}, 20_000)
    assert tuple(digests.sketched_summary(spark, path, store, {"part": 9}).first()) == (0, 0)
