import zlib

import numpy as np
import pytest

from cohortwise.llm import languages


def test_held_out_accuracy(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    got = {r.doc_id: r for r in languages.identify(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    right = []
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= got[r.doc_id].score <= 1
        if got[r.doc_id].held_out:
            right.append(got[r.doc_id].lang_pred == r.lang)
    assert len(right) > 20 and np.mean(right) > 0.95


def test_prediction_sees_text_only(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(60).cache()
    model = languages.fit(docs)
    plain = {(r.doc_id, r.lang_pred, r.score) for r in languages.predict(docs, model).collect()}
    blind = docs.selectExpr("doc_id", "text", "'zz' as lang", "null as source")
    assert plain == {(r.doc_id, r.lang_pred, r.score) for r in languages.predict(blind, model).collect()}


DE, EN, FR = "der hund und die katze ist nicht auf dem tisch ", "the dog and the cat are not on the table ", "le chien et le chat ne sont pas sur la table "


def test_odd_rows(documents):
    rows = [(k, t * (k % 5 + 1), lang) for k in range(40) for t, lang in ((DE, "de"), (EN, "en"), (FR, "fr"))]
    rows = [(3 * i + j, t, lang) for i in range(40) for j, (_, t, lang) in enumerate(rows[3 * i : 3 * i + 3])]
    odd = [(1000, None, "de"), (1001, "", None), (1002, "12 .. 34", "fr"), (None, DE, None), (1003, EN * 3000, None), (1003, EN * 3000, None), (1004, DE.upper(), None)]
    got = languages.identify(documents(rows + odd, extra="held_out")).collect()
    assert len(got) == len(rows) + len(odd)
    seen = {r.doc_id: r for r in got}
    for k in (1000, 1001, 1002):
        assert (seen[k].lang_pred, seen[k].score) == ("und", 0.0)
    assert seen[1003].lang_pred == "en" and seen[1004].lang_pred == "de" and seen[None].lang_pred == "de"
    assert not seen[None].held_out
    truth = {r[0]: r[2] for r in rows}
    assert all(seen[k].lang_pred == v for k, v in truth.items())
    assert {r.family for r in got if r.lang_pred == "fr"} == {"romance"}


@pytest.mark.parametrize("langs", [[], ["xx"]])
def test_few_languages(documents, langs):
    rows = [(k, DE, lang) for k in range(12) for lang in langs] + [(50, "abc def", None), (51, None, None)]
    seen = {r.doc_id: (r.lang_pred, r.score) for r in languages.identify(documents(rows)).collect()}
    assert seen[50] == (("xx", 1.0) if langs else ("und", 0.0)) and seen[51] == ("und", 0.0)


def test_no_rows_and_filter(documents):
    assert languages.identify(documents([])).collect() == []
    rows = [(k, t, lang) for k in range(30) for t, lang in ((DE, "de"), (FR, "fr"))] + [(99, "...", "de")]
    kept = languages.keep_identified(documents(rows, extra="score"))
    assert kept.count() == 60 and "score" in kept.columns


def test_texts_of_no_learned_language_are_rejected(spark, documents):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in source.collect()]
    rng = np.random.default_rng(9)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    junk = [" ".join("".join(rng.choice(letters, rng.integers(3, 10))) for _ in range(n)) for n in (8, 20, 60, 300)]
    foreign = [
        "koira juoksee nopeasti metsän läpi ja kissa nukkuu ikkunalla koko pitkän talvipäivän ajan",
        "pies biegnie szybko przez las a kot śpi na oknie przez cały długi zimowy dzień",
        "собака быстро бежит через лес а кошка спит на окне весь день",
    ]
    short = [" ".join(t.split()[:n]) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2 for n in (4, 8) if len(t.split()) > 8]
    odd = [(10**6 + k, t, None) for k, t in enumerate(junk + foreign)]
    clean = [(2 * 10**6 + k, t, None) for k, t in enumerate(short)]
    kept = {r.doc_id for r in languages.keep_identified(documents(rows + odd + clean)).select("doc_id").collect()}
    assert not kept & {r[0] for r in odd}
    assert len(kept & {r[0] for r in rows}) >= 0.99 * len(rows)
    assert len(clean) > 100 and len(kept & {r[0] for r in clean}) >= 0.99 * len(clean)


def test_limits_do_not_depend_on_other_families(documents):
    fi = "koira ja kissa eivät ole pöydällä vaan talossa "
    rows = [(4 * k + j, t * (k % 5 + 1), lang) for k in range(40) for j, (t, lang) in enumerate(((DE, "de"), (EN, "en"), (FR, "fr"), (fi, "fi")))]
    junk = [(1001, "xqzv wkjp qqhg zzbk vvxw jjqk xwzq kkvj " * 3, None)]
    for some in (rows, [r for r in rows if r[2] != "fi"]):
        kept = {r.doc_id for r in languages.keep_identified(documents(some + junk)).collect()}
        assert {r[0] for r in some} <= kept and 1001 not in kept


def test_sample_is_bounded(documents):
    df = documents([(k, DE, "de") for k in range(500)])
    assert 20 <= languages._sample(df, 50, 100).count() <= 50


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(1, 0.3, (40, 5)), rng.normal(-1, 0.3, (90, 5))])
    y = np.array([1.0] * 40 + [-1.0] * 90)
    w, b = languages.train_svm(x, y)
    assert ((x @ w + b) * y > 0).all()
