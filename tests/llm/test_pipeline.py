import random
import re
from collections import defaultdict

import test_decontamination
import test_jaccard
import test_packing
import test_pii

import __spark_entry__
import corpus_pipeline


def brute_redact(text):
    out, done = [], 0
    for start, kind, end in test_pii.brute(text):
        if start >= done:
            out += [text[done:start], f"<{test_pii.PATTERNS[kind][0].upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def test_stages_match_brute_force(spark, small_dir):
    source = spark.read.parquet(f"{small_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    docs = {r.doc_id: r for r in source.collect()}
    # Every text of the table has letters and one of its languages.
    assert all(re.search(r"[^\W\d_]", r.text) for r in docs.values())
    parts = test_jaccard.brute([(i, r.text) for i, r in docs.items()])
    stay = {i for i, n, component in parts if i == component}
    grams = {tuple(w[i : i + 4]) for _, t in items for w in [test_decontamination.split(t)] for i in range(len(w) - 3)}
    near = []
    for i in sorted(stay):
        own = test_decontamination.split(docs[i].text)
        if any(tuple(own[k : k + 4]) in grams for k in range(len(own) - 3)):
            near.append((i, docs[i].text))
    clean = stay - {i for i, _ in test_decontamination.brute(near, items)}
    want = {i: brute_redact(docs[i].text) for i in clean}

    frame, after = source, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, small_dir).cache()
        assert frame.columns == source.columns
        after[name] = {r.doc_id: r for r in frame.collect()}
    assert len(after["language_id"]) >= 0.99 * len(docs)
    lost = set(docs) - set(after["language_id"])
    if not lost:
        assert set(after["jaccard_join"]) == stay
        assert set(after["decontamination"]) == clean
        assert {i: r.text for i, r in after["pii"].items()} == want
    for i, r in after["pii"].items():
        assert (r.lang, r.source, r.n_chars) == (docs[i].lang, docs[i].source, docs[i].n_chars)

    pieces = corpus_pipeline.run(spark, small_dir).collect()
    test_packing.check([(i, r.text) for i, r in after["pii"].items()], pieces)
    body = defaultdict(bytes)
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        body[p.doc_id] += bytes(p.ids)
    assert all(len(body[i]) == 4 * len(test_packing.whole_ids(r.text)) for i, r in after["pii"].items())


def test_one_of_equal_rows_stays(spark, documents):
    text = "one two three four five six seven eight"
    rows = [(1, text), (1, text), (None, text), (2, text + " "), (3, None), (3, ""), (None, "x y z w"), (None, "x y z w"), (4, "other words"), (1, "another text")]
    kept = corpus_pipeline.one_of_near_copies(spark, documents(rows, extra="class"), "").collect()
    found = sorted(((r.doc_id or 0, r.text or "") for r in kept))
    assert found == sorted([(1, text), (3, ""), (3, ""), (0, "x y z w"), (4, "other words"), (1, "another text")])


def five_word_classes(rows, percent=80):
    """The ids that stay: the least one of each class on sets of five-word shingles."""
    sets = {}
    for i, t in rows:
        w = test_decontamination.split(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= percent * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if c == old else c for i, c in label.items()}
    return {i for i, c in label.items() if i == c}


def test_near_copies_take_five_words_and_80_percent(spark, documents):
    base = [f"a{k}" for k in range(200)]
    changed = [f"x{k}" if k in (30, 70, 110, 150) else w for k, w in enumerate(base)]
    short = [f"b{k}" for k in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join(changed)), (3, " ".join(short)), (4, " ".join([*short, *(f"y{k}" for k in range(22))]))]
    rng = random.Random(8)
    for family in range(12):
        own = [f"f{family}w{k}" for k in range(rng.randrange(40, 160))]
        for _ in range(6):
            edited = list(own)
            for _ in range(rng.randrange(8)):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(edited)))
    kept = {r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, documents(rows), "").collect()}
    assert kept == five_word_classes(rows) and not kept & {2, 4}


def test_registered():
    queries = __spark_entry__.queries()
    assert "pipeline" in queries
    assert sorted(int(n[2:].split("_")[0]) for n in queries if re.match(r"op\d+_", n)) == list(range(1, 11))


def test_nothing_else_needs_these_operators():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in [*root.glob("cohortwise/**/*.py"), root / "bench.py", *root.glob("tests/*.py")]:
        if "llm" not in path.relative_to(root).parts:
            assert "cohortwise.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()
