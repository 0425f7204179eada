import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortwise.llm import lm


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    count = Counter(t for i, text in rows if not held[i] for t in tokens(text))
    n, v = sum(count.values()), len(count)
    out = []
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        out.append((i, held[i], len(own), sum(count[t] > 0 for t in own), n, base))
    return out


def check(rows, got):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    want = sorted(brute(rows), key=key)
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    assert [w[:5] for w in want] == [h[:5] for h in have]
    assert [w[5] for w in want] == pytest.approx([h[5] for h in have], abs=1e-6)
    assert all(r.score < 0 or r.train_tokens == 0 for r in got)


@pytest.mark.parametrize("sizes", [(2048, 1 << 18), (50, 300)])
def test_small_table(spark, small_dir, sizes):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").repartition(3)
    got = lm.score(docs, *sizes).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got)
    unseen = [r for r in got if r.held_out]
    # The model predicts texts it has not seen better than counts of single words do.
    if sizes == (2048, 1 << 18):
        assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


ODD = [(0, "a b c"), (1, None), (2, ""), (3, "A B a"), (3, "A B a"), (None, "é é x"), (4, "b " * 150_000), (5, "new words here"), (6, " \t")]


def test_odd_rows(documents):
    check(ODD, lm.score(documents(ODD, extra="fold"), 4, 6).collect())


def test_no_training_and_no_rows(documents):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = [(i, "some words") for i in held]
    check(rows, lm.score(documents(rows)).collect())
    assert lm.score(documents([])).collect() == []


def test_classes_are_a_distribution():
    rng = np.random.default_rng(1)
    classes = 9
    pairs = np.array([(f, a, b, rng.integers(1, 40)) for f in range(4) for a in range(8) for b in range(9) if rng.random() < 0.5])
    weights = lm.learn_weights(pairs, classes)
    assert weights.sum(axis=1) == pytest.approx(np.ones(65))
    total = (10.0 ** lm.transition_table(pairs, classes, weights)).sum(axis=1)
    assert total == pytest.approx(np.ones(classes), abs=1e-5)


def test_words_of_a_class_share_its_mass(documents):
    rows = [(i, f"a b c d{i % 3} e{i}") for i in range(30)]
    counts = lm.count_words(lm.folded(documents(rows)))
    known = lm.lexicon(counts, 3, 8)
    assert known.tokens == 180 and known.distinct == 37 and len(known.word) == 8
    assert sorted(known.cls.tolist()) == [0, 1, 2, 3, 3, 3, 4, 4] and known.rare == 5


def test_em_prefers_what_explains(spark):
    # Context 0 foretells class 1 in every fold; context 2 foretells nothing.
    rng = np.random.default_rng(3)
    pairs = [(f, 0, 1, 5000) for f in range(4)]
    pairs += [(f, 2, c, int(rng.integers(90, 110))) for f in range(4) for c in range(5)]
    weights = lm.learn_weights(np.array(pairs), 6)
    assert weights[lm.bucket(np.array([15000]))[0], 0] > 0.8


def test_every_pair_of_words_has_its_own_count(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(40).repartition(3)
    rows = lm.folded(docs).cache()
    training = rows.where("fold != 1")
    known = lm.lexicon(lm.count_words(training), 4, 6)  # almost all words are beyond both limits
    shared = spark.sparkContext.broadcast(known)
    model = spark.sparkContext.broadcast(lm.Model(known, np.zeros((known.classes,) * 2, np.float32), np.ones(known.classes), 1.0))
    blocks = lm.blocks_of(rows).cache()
    seen = lm.resolve(blocks, lm.answer(lm.ask(blocks, shared, 7), 7), model, training.count()).collect()
    texts = {r.doc_id: tokens(r.text) for r in rows.collect()}
    trained = [texts[r.doc_id] for r in training.collect()]
    words = Counter(t for own in trained for t in own)
    pairs = Counter(p for own in trained for p in zip([None, *own], own))
    met = 0
    for row in seen:
        counts = lm.unpack_block(row.counts)
        own = [texts[i] for i in lm.unpack_block(row.body).column("doc_id").to_pylist()]
        assert counts.column("word").to_pylist() == [words[t] for text in own for t in text]
        assert counts.column("pair").to_pylist() == [pairs[p] for text in own for p in zip([None, *text], text)]
        met += len(own)
    assert met == len(texts) and len(seen) > 1


def test_words_beyond_the_vocabulary_foretell(documents):
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 1]
    train = [i for i in range(1000) if i not in held]
    rows = [(i, f"p{k % 40} q{k % 40}") for k, i in enumerate(train)]
    rows += [(i, f"p{k % 40} q{(k + k // 40) % 40}") for k, i in enumerate(held[:80])]
    got = {r.doc_id: r.score for r in lm.score(documents(rows), 2, 4).collect()}
    for right, wrong in zip(held[:40], held[40:80]):
        assert got[right] > got[wrong] + 1


def test_weights_of_words_before():
    far, near, none = 40 * lm.STEPS // 20, -lm.STEPS, None
    cell = lambda b, step: b * lm.CELLS + (0 if step is none else lm.CELLS // 2 + step)
    weight = lm.learn_mixture(np.array([cell(3, far), cell(5, near), cell(6, none)]), np.array([900, 900, 900]))
    assert weight[3] > 0.9 and weight[5] < 0.2 and weight[6] < 0.01 and weight[0] == 0 and (weight < 1).all()
