import random
import re
from itertools import combinations

import pytest

from cohortwise.llm import decontamination as d


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(documents, items):
    """(doc_id, item_id) -> words covered by runs with few exchanges."""
    found = {}
    for doc_id, text in documents:
        own = split(text)
        for item_id, other in items:
            item = split(other)
            run = min(13, len(item))
            if not run:
                continue
            for i in range(len(own) - run + 1):
                for j in range(len(item) - run + 1):
                    if sum(a != b for a, b in zip(own[i : i + run], item[j : j + run])) <= 2 * run // 13:
                        found.setdefault((doc_id, item_id), set()).update(range(i, i + run))
    return {k: (min(v), max(v)) for k, v in found.items()}


def tables(spark, documents, items):
    docs = spark.createDataFrame([(*r, 1) for r in documents], "doc_id long, text string, item_id int")
    return docs, spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")


def found(df):
    return {(r.doc_id, r.item_id): (r.first_word, r.last_word) for r in df.collect()}


@pytest.mark.parametrize("n", range(1, 41))
def test_masks_miss_no_run(n):
    run, exchanges = d.allowed(n)
    for mask in d.masks(n)[:1]:
        for bad in combinations(range(run), exchanges):
            assert any(not set(bad) & {o + i for i in mask} for o in range(run - mask[-1]))


def corpus(seed, vocabulary=12):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(vocabulary)
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 6, 8, 12, 13, 20, 40])))) for k in range(12)]
    docs = []
    for k in range(40):
        own = [word() for _ in range(rng.choice([0, 2, 10, 60]))]
        part = rng.choice(items)[1].split()
        for _ in range(rng.randrange(4)):
            part[rng.randrange(len(part))] = "new"
        at = rng.randrange(len(own) + 1)
        docs.append((k, " ".join(own[:at] + part + own[at:])))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [10, 500_000])
def test_matches_brute_force(spark, seed, block):
    docs, items = corpus(seed, 40)
    docs_df, items_df = tables(spark, docs, items)
    got = {}
    for r in d.matches(docs_df, items_df, block).collect():
        a, b = got.get((r.doc_id, r.item_id), (r.first_word, r.last_word))
        got[r.doc_id, r.item_id] = (min(a, r.first_word), max(b, r.last_word))
    assert got == brute(docs, items)


def test_small_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{small_dir}/benchmark.parquet")
    held = [(r.doc_id, r.text) for r in docs.collect()]
    wanted = [(r.item_id, r.text) for r in items.collect()]
    # Brute force over documents that share any four words in a row with any item.
    grams = {tuple(w[i : i + 4]) for _, t in wanted for w in [split(t)] for i in range(len(w) - 3)}
    near = [r for r in held if any(tuple(split(r[1])[i : i + 4]) in grams for i in range(len(split(r[1])) - 3))]
    got = found(d.contaminated(docs, items))
    assert got == brute(near, wanted) and got


def test_odd_rows(spark):
    text = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [(1, None), (2, ""), (3, text.upper()), (3, text), (None, "x " * 90000 + text), (5, "é  " * 20)]
    items = [(None, text), (7, None), (8, " "), (9, text), (9, text)]
    docs_df, items_df = tables(spark, docs, items)
    spans = found(d.contaminated(docs_df, items_df))
    assert spans == {(k, i): s for k, s in ((3, (0, 13)), (None, (90000, 90013))) for i in (None, 9)}
    kept = d.without_contaminated(docs_df, items_df)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5] and kept.columns == docs_df.columns


def test_empty_tables(spark):
    docs, items = tables(spark, [(1, "a b")], [])
    assert d.contaminated(docs, items).collect() == []
    assert d.without_contaminated(docs, items).count() == 1
    docs, items = tables(spark, [], [(1, "a b")])
    assert d.contaminated(docs, items).collect() == []
