import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from cohortwise.llm import jaccard
from cohortwise.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def variants(seed, n=160):
    """Families of texts with chains of edits, common passages and copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    common = [word() for _ in range(30)]
    rows, pool = [], []
    for k in range(n):
        if pool and rng.random() < 0.7:
            own = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = [word()]
        else:
            own = [word() for _ in range(rng.choice([3, 6, 20, 50, 90]))]
            if rng.random() < 0.6:
                own = own[:20] + common + own[20:]
        pool.append(own)
        rows.append((k, " ".join(own)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(documents, monkeypatch, seed):
    rows = variants(seed)
    if seed == 3:
        monkeypatch.setattr(jaccard, "TURNS", 0)  # the last step alone finds every link
    assert got(jaccard.classify(documents(rows, extra="set_key"))) == brute(rows)


def test_small_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    assert got(jaccard.classify(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(documents):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A\tb"), (6, "a b c"), (6, "a b"), (None, "a b c"), (None, "only null"), (7, long), (8, long + " y"), (9, long), (9, long)]
    assert got(jaccard.classify(documents(rows))) == brute(rows)
    assert jaccard.classify(documents([])).collect() == []


def test_threshold_is_exact():
    for a in range(1, 60):
        for b in range(a, 60):
            need = jaccard.needed_overlap(a, b, 85)
            assert 100 * need >= 85 * (a + b - need) and 100 * (need - 1) < 85 * (a + b - need + 1)
        n = jaccard.prefix_length(a, 85)
        assert a - n + 1 == -(-85 * a // 100) and n >= 1


def test_block_list_skips_nothing_that_links():
    rng = np.random.default_rng(4)
    for _ in range(40):
        rows = sorted((int(n), int(rng.integers(0, n)), k) for k, n in enumerate(rng.integers(5, 40, 60)))
        block, found, want = jaccard.BlockList(85), set(), set()
        for n, pos, key in rows:
            found |= {tuple(sorted(p)) for p in block.probe(key, n, pos, key).tolist()}
            block.add(key, n, pos, key)
        for i, (n, pos, key) in enumerate(rows):
            for m, at, other in rows[:i]:
                if 100 * m >= 85 * n and min(at, pos) + min(m - at, n - pos) >= jaccard.needed_overlap(m, n, 85):
                    want.add(tuple(sorted((key, other))))
        assert found == want


def near_copies(n, seed=7, size=150):
    """Texts of one group, of one or two words changed."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        own = [f"b{i}" for i in range(size)]
        for at in rng.sample(range(size), 1 + k % 2):
            own[at] = f"e{rng.randrange(10**9)}"
        out.append((k, " ".join(own)))
    return out


def test_a_pair_leaves_from_its_first_list(documents, monkeypatch):
    held = jaccard.prefixes(documents(near_copies(60)), 4, 85, np.zeros((2, 0), np.uint64))
    lists, known = jaccard.index_lists(held), held.where("mark is not null")
    alone = known.selectExpr("set_key", "set_key as class")
    monkeypatch.setattr(type(held), "distinct", lambda rows: rows)  # as they leave the lists
    pairs = [(r.a, r.b) for r in jaccard.remaining_pairs(lists, alone, known.select("set_key", "mark"), 85).collect()]
    assert len(set(pairs)) > 200 and len(pairs) < 1.3 * len(set(pairs))


def test_tasks_hold_the_words_of_few_texts():
    texts = pa.array([" ".join(f"w{k}x{i}" for i in range(500)) for k in range(1000)])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    list(jaccard._sets(batch.slice(0, 100), 5))  # tables that stay
    tracemalloc.start()
    try:
        n = sum(len(own) for part in jaccard._parts(batch) for own in jaccard._sets(part, 5))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 496 * 1000 and peak < 24 << 20


def test_a_turn_joins_the_lists_with_their_sets_once(documents):
    held = jaccard.prefixes(documents(near_copies(5)), 4, 85, np.zeros((2, 0), np.uint64))
    alone = held.where("mark is not null").selectExpr("set_key", "set_key as class", "mark")
    pairs = jaccard.neighbours_pairs(jaccard.index_lists(held), alone, 1, 85)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1200)]
    label = {}
    for a, b in links:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(len(label)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    want = {n: c for n, c in label.items() if any(n in p and p[0] != p[1] for p in links)}
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(6)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
        x, y = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        a, b = (np.frombuffer(jaccard.sketch(v), np.uint64) for v in (x, y))
        apart = len(np.setxor1d(x, y))
        assert np.bitwise_count(a ^ b).sum() <= apart
        a, b = (int.from_bytes(jaccard.mark(jaccard.sketch(v)), "little") for v in (x, y))
        assert (a ^ b).bit_count() <= apart


def test_long_texts_with_a_passage_in_common_do_not_meet_in_pairs(documents, monkeypatch):
    passage = " ".join(f"p{k}" for k in range(300))
    rows = [(i, passage + " " + " ".join(f"t{i}w{k}" for k in range(900))) for i in range(10)]
    found = []
    last = jaccard.remaining_pairs

    def counted(*args):
        pairs = last(*args)
        found.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "remaining_pairs", counted)
    got = jaccard.classify(documents(rows), 5, 80).collect()
    assert {r.component_id for r in got} == set(range(10)) and found == [0]
