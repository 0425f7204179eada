import hashlib
import random
from collections import Counter

import pytest

from cohortwise.llm import repeats


def brute(rows, length=400):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + length] for _, b in bodies for k in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11, 13, 17])
def test_covers(q):
    v, cover = repeats.difference_cover(q)
    assert v == q * q + q + 1 and len(cover) == q + 1
    for shift in range(v):
        assert any((k + shift) % v in cover and k in cover for k in range(v))


def test_cover_leaves_names():
    assert repeats.cover_for(400)[0] == 307
    assert repeats.cover_for(50) == (1, (0,))


def corpus(seed, length, n=24):
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choice("abcdé ") for _ in range(k))
    passages = [noise(rng.randrange(length // 2, 3 * length)) for _ in range(5)]
    # A passage that differs only at its ends, one with period, and near misses of the length.
    passages += ["ab" * length, passages[0][3:], passages[1][:-5]]
    rows = []
    for k in range(n):
        parts = [noise(rng.randrange(3 * length))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), noise(rng.randrange(60))]
        if rng.random() < 0.3:
            text = list(parts[0])
            if text:
                text[rng.randrange(len(text))] = "#"
            rows.append((100 + k, "".join(text)))
        rows.append((k, "".join(parts)))
    return rows


@pytest.mark.parametrize(("seed", "length"), [(1, 400), (2, 100), (3, 150)])
def test_matches_brute_force(documents, seed, length):
    rows = corpus(seed, length)
    assert got(repeats.remove_repeats(documents(rows, extra="spans"), length)) == brute(rows, length)


def test_frequent_names_are_dealt_out(documents, monkeypatch):
    monkeypatch.setattr(repeats, "ONE_NAME", 3)
    monkeypatch.setattr(repeats, "TOGETHER", 2)
    rng = random.Random(9)
    noise = lambda k: "".join(rng.choice("abcdef") for _ in range(k))
    common = noise(700)
    rows = [(k, noise(rng.randrange(200)) + common[rng.randrange(250) :] + noise(50)) for k in range(12)]
    assert got(repeats.remove_repeats(documents(rows), 200)) == brute(rows, 200)


def test_small_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(repeats.remove_repeats(docs)) == want and sum(w[2] for w in want) > 0


def test_odd_rows(documents):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh") for _ in range(90_000))
    rows = [(1, None), (2, ""), (3, "a" * 399), (4, "a" * 400), (5, "b" * 401), (6, long), (7, "x" + long[:50_000]), (8, "y" * 500), (8, "y" * 500), (None, "z" * 450 + long[60_000:60_399])]
    assert got(repeats.remove_repeats(documents(rows))) == brute(rows)
    assert repeats.remove_repeats(documents([])).collect() == []
    kept = {r.doc_id: r for r in repeats.remove_repeats(documents(rows), with_kept=True).collect()}
    assert bytes(kept[7].kept) == b"x" and bytes(kept[8].kept) == b"" and kept[1].kept is None
