import hashlib
import math
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from cohortwise.llm import resampling


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def grams(text, order):
    own = words(text)
    return [" ".join(own[i : i + n]) for n in range(1, order + 1) for i in range(len(own) - n + 1)]


def brute(docs, target, order=1, buckets=10_000, seed=2024, least=20, percent=10):
    def bucket(gram):
        return zlib.crc32(gram.encode()) % buckets

    s = Counter(bucket(g) for _, t in docs for g in grams(t, order))
    t = Counter(bucket(g) for text in target for g in grams(text, order))
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for k, (i, text) in enumerate(docs):
        own = grams(text, order)
        weight = sum(gain[bucket(g)] for g in own)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [k for k, (_, text) in enumerate(docs) if len(words(text)) >= least]
    able.sort(key=lambda k: (-rows[k][3], rows[k][0] is not None, rows[k][0] or 0))
    for place, k in enumerate(able[: percent * len(able) // 100], 1):
        rows[k][4] = place
    return sorted(map(tuple, rows), key=str)


def collected(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_small_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").repartition(3)
    target = spark.read.parquet(f"{small_dir}/benchmark.parquet")
    rows, texts = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()]
    assert collected(resampling.resample(docs, target)) == brute(rows, texts)
    for order in (2, 3):
        got = resampling.resample(docs, target, order=order, buckets=500, seed=7, percent=25)
        assert collected(got) == brute(rows, texts, order, 500, 7, percent=25)


EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (None, "a b " * 20), (4, "Don't STOP-now 42x É É日本 \x00\x7fk"), (5, "one " * 19), (6, "one " * 20),
    (7, "same words " * 15), (7, "same words " * 15), (8, "x" * 3000), (9, "ſ K İ ß A_B-C"),
]


def test_edges(documents, monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 16)
    target = documents([(1, "same words one"), (2, None), (3, "")])
    for order in (1, 2, 4):
        got = resampling.resample(documents(EDGES, extra="rank"), target, order=order, percent=60)
        assert collected(got) == brute(EDGES, ["same words one", None, ""], order, percent=60)


def test_no_documents_and_no_target(documents):
    none = documents([])
    assert resampling.resample(none, documents([(1, "a b")])).collect() == []
    assert collected(resampling.resample(documents(EDGES), none, percent=50)) == brute(EDGES, [], percent=50)


def test_ties_go_to_smaller_ids_and_repeated_rows_count(documents):
    rows = [(5, "word " * 25)] * 300 + [(k, f"other{k} " * 30) for k in range(100, 400)]
    got = resampling.resample(documents(rows), documents([(1, "word " * 50)]), percent=50)
    assert collected(got) == brute(rows, ["word " * 50], percent=50)
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"])
    assert ranks == list(range(1, 301))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZ9 _é\n日", max_size=40), st.integers(1, 4), st.integers(1, 12))
def test_pieces_lose_no_gram(text, order, piece):
    whole, resampling.PIECE = resampling.PIECE, piece
    try:
        parts = list(resampling.checksums(text, order))
    finally:
        resampling.PIECE = whole
    assert sum(n for n, _ in parts) == len(words(text))
    assert Counter(c for _, own in parts for c in own) == Counter(zlib.crc32(g.encode()) for g in grams(text, order))


def test_target_texts_are_drawn(documents):
    rows = [(k, f"plain{k % 50} talk " * 20) for k in range(200)] + [(900 + k, "quantum field theory " * 10) for k in range(15)]
    got = resampling.resample(documents(rows), documents([(1, "quantum field theory " * 50)]))
    assert sum(r["rank"] is not None for r in got.collect() if r.doc_id >= 900) == 15
