import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortwise.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole_ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, pieces, window=2048):
    docs = defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
    want = {i: whole_ids(t) for i, t in rows}
    assert set(docs) == set(want)
    for i, ids in want.items():
        at = 0
        for p in sorted(docs[i], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and at & (at - 1) == 0  # nothing is padded
    return sequences


def test_small_table(spark, small_dir):
    df = spark.read.parquet(f"{small_dir}/documents.parquet").repartition(3)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    check(rows, packing.pack(df, PATH).collect())


EDGES = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n", None, None),
    (4, "don't  stop now 123 ÀÉ é İ ΟΔΟΣ  x\x1cy\x85z", None, "b"),
    (5, "word " * 9000, None, "b"),
    (6, "x" * 5000, None, None),
    (7, "日本語 テキスト 😀😀", None, "c"),
]


def test_edges(spark, documents):
    df = documents(EDGES, extra="lane")
    check([(r[0], r[1]) for r in EDGES], packing.pack(df, PATH).collect())


def test_no_documents(documents):
    assert packing.pack(documents([]), PATH).collect() == []


def test_repeated_rows_and_null_ids(documents):
    got = packing.pack(documents([(None, "a b"), (1, "a b"), (1, "a b")]).coalesce(1), PATH).collect()
    assert sum(p.length for p in got) == 3 * len(whole_ids("a b"))


def test_windows_keep_to_the_mixture(documents):
    rows = [(i, "alpha beta gamma delta " * 40, None, "a" if i % 3 else "b") for i in range(300)]
    pieces = packing.pack(documents(rows).coalesce(4), PATH).collect()
    sequences = check([(r[0], r[1]) for r in rows], pieces)
    share = sum(p.length for p in pieces if p.source == "a") / sum(p.length for p in pieces)
    full = [own for own in sequences.values() if sum(p.length for p in own) == 2048]
    assert len(full) > 20
    for own in full:
        assert abs(sum(p.length for p in own if p.source == "a") - share * 2048) < 400
    # Deficits are carried, so the error does not grow with the number of windows.
    at = np.cumsum([sum(p.length for p in sequences[k] if p.source == "a") - share * sum(p.length for p in sequences[k]) for k in sorted(sequences)])
    assert abs(at).max() < 600


@pytest.mark.parametrize("targets", [None, {"a": 2.0, "b": 1.0, "c": 1.0}])
def test_order_by_source_keeps_the_mixture(documents, monkeypatch, targets):
    monkeypatch.setattr(packing, "LANE", 1 << 14)
    # Partitions of one source each; the sources are as frequent as the weights ask.
    rows = [(i, "alpha beta gamma delta " * 40, None, "a" if i < 200 else "b" if i < 300 else "c") for i in range(400)]
    df = documents(rows).coalesce(4)
    assert max(len({r.source for r in part}) for part in df.rdd.glom().collect()) == 1
    pieces = packing.pack(df, PATH, targets=targets).collect()
    sequences = check([(r[0], r[1]) for r in rows], pieces)
    full = [own for own in sequences.values() if sum(p.length for p in own) == 2048]
    assert len(full) > 20
    for own in full:
        for source, share in (("a", 0.5), ("b", 0.25), ("c", 0.25)):
            assert abs(sum(p.length for p in own if p.source == source) - share * 2048) < 8


def test_targets(documents):
    rows = [(i, "alpha beta " * 300, None, "ab"[i % 2]) for i in range(60)]
    pieces = packing.pack(documents(rows).coalesce(1), PATH, targets={"a": 3.0, "b": 1.0}).collect()
    first = [p for p in pieces if p.sequence_id < 3]
    assert sum(p.length for p in first if p.source == "a") == pytest.approx(3 * 1536, abs=2)


def test_fill_gives_everything_once():
    rng = np.random.default_rng(7)
    for _ in range(50):
        totals = rng.integers(0, 5000, rng.integers(1, 8))
        if not totals.sum():
            continue
        given = packing.fill(totals, rng.normal(0, 900, len(totals)), rng.random(len(totals)), 256)
        assert (given[-1] == totals).all() and (np.diff(given, axis=0) >= 0).all()
        assert (np.diff(given.sum(axis=1)) == packing.window_sizes(int(totals.sum()), 256)).all()
