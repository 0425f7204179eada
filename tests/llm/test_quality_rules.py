import re
from collections import Counter

from cohortwise.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def columns(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


TEXTS = [
    None, "", " \n\t ", "a", "a b", "a b c", "a a a a", "a b c a b c", "x\ny\nx\n\n \nx", "é😀 b\x0bc\x0cd\r\ne",
    "a\x1cb\xa0c d", "# * $ % & | < > @", "p q r s p q r t u p q r", "w " * 60, "spam $$$ " * 4000,
    " ".join(f"w{i}" for i in range(20000)) + " w5 w6 w7 w8", "A b c\na B c\nA b c\n" * 3,
]


def test_counts_match_brute_force(documents):
    df = quality.judge(documents([(i, t, "en", "s") for i, t in enumerate(TEXTS)], extra="n_words"))
    got = {r.doc_id: r for r in df.collect()}
    for i, text in enumerate(TEXTS):
        assert columns(got[i]) == brute(text), text
        assert not (got[i].base_failed and got[i].kept)


def test_small_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and all(columns(got[r.doc_id]) == brute(r.text) for r in rows)


def clean(k, lang):
    return " ".join(f"{lang}{(k * 31 + i * i * 7 + i) % 997}" for i in range(80 + k % 50))


def test_limits_follow_language_and_source(documents):
    rows = [(k, clean(k, lang), lang, "web") for lang in ("aa", "bbbbbb") for k in range(300)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    junk = [(9000 + k, "### " + " ### ".join(clean(k, "aa").split()), "aa", "web") for k in range(20)]
    long_words = [(9100, clean(1, "bbbbbb"), "aa", "web")]
    got = {r.doc_id: r for r in quality.judge(documents(rows + junk + long_words)).collect()}
    assert all(got[r[0]].kept for r in rows)
    assert not any(got[r[0]].kept for r in junk)
    # The same words are usual in one language and far out in the other.
    assert not got[9100].kept and got[9100].failed_rules == ["word_length"]


def test_quartiles_decide_in_both_directions(documents):
    def lines(k, repeated, signs):
        words = clean(k, "aa").split()
        own = [" ".join(words[i : i + 4]) for i in range(0, 80, 4)]
        own = [*own, *(own[0] for _ in range(repeated))]
        return "\n".join([*own, "#" * signs])

    # One source is clean, the other has repeated lines and symbols in every text.
    rows = [(k, lines(k, 0, 0), "aa", "clean") for k in range(300)]
    rows += [(k, lines(k, k % 8 + 2, k % 40 + 5), "aa", "forum") for k in range(300, 600)]
    odd = [(9000, lines(1, 12, 0)), (9001, lines(2, 0, 34))]
    odd = [(i + at, t, "aa", source) for at, source in ((0, "clean"), (10, "forum")) for i, t in odd]
    got = {r.doc_id: r for r in quality.judge(documents(rows + odd)).collect()}
    assert 0.35 < got[9000].n_dup_lines / 32 < 0.4 and 0.06 < got[9001].n_symbols / got[9001].word_chars < 0.08
    assert all(got[r[0]].kept for r in rows)
    assert not got[9000].kept and "dup_line_share" in got[9000].failed_rules
    assert not got[9001].kept and got[9001].failed_rules == ["symbol_share"]
    assert got[9011].kept and "dup_line_share" not in got[9010].failed_rules


def test_small_groups_use_merged_sketches(documents):
    rows = [(k, clean(k, "aa"), "aa", f"s{k % 30}") for k in range(300)]
    df = documents(rows + [(999, clean(3, "aa"), None, None)])
    measured = quality.with_measures(quality.features(df))
    limits = quality.thresholds(measured).collect()
    assert len(limits) == 31 and len({round(r.high_word_length, 9) for r in limits if r.lang == "aa"}) == 1
    assert all(r.kept for r in quality.judge(df).collect())


def test_odd_tables(documents):
    assert quality.judge(documents([])).collect() == []
    got = quality.judge(documents([(None, None), (1, None), (1, None)])).collect()
    assert [(r.kept, r.base_failed) for r in got] == [(False, True)] * 3


def test_plan_is_native(documents):
    plan = quality.judge(documents([(1, "a b c", "en", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian", plan)
