import re

import pytest

from cohortwise.llm import licenses

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None,
    "",
    " ,.; ",
    "MIT License",
    "the mit-license, mit license mit licenses",
    "mit license mit license",
    "Licensed under the Apache License, Version 2.0 (the x)",
    "This work is licensed under the GNU General Public License, version 3.",
    "é mit\x00license ünter Kelvin K MIT\nLICENSE",
    "SPDX-License-Identifier: MPL-2.0",
    "permission is granted? no license",
    "word " * 3000 + "general public license",
]


def test_base_columns_match_brute_force(documents):
    df = licenses.scan(documents([(i, t) for i, t in enumerate(TEXTS)], extra="label"))
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert got[9].labels == "mpl" and got[9].score == 1.0


def test_small_table_matches_brute_force(spark, small_dir):
    source = spark.read.parquet(f"{small_dir}/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in source.collect()}
    got = licenses.scan(source).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == want


def test_contained_detections_are_suppressed(documents):
    df = licenses.detections(documents([(1, "Licensed under the GNU General Public License, version 3.")]))
    found = {r.rule_id: r for r in df.collect()}
    assert found["licensed-gpl"].kept and (found["licensed-gpl"].first_word, found["licensed-gpl"].last_word) == (0, 8)
    assert not found["named-gpl"].kept and not found["versioned-gpl"].kept


def test_detections_in_order_of_place(documents):
    text = "x isc license y isc license isc license"
    df = licenses.detections(documents([(1, text), (1, text), (None, text)])).where("rule_id = 'named-isc'")
    found = sorted((r.doc_id or 0, r.first_word, r.last_word) for r in df.collect())
    assert found == [(i, a, a + 1) for i in (0, 1) for a in (1, 4, 6)]


@pytest.mark.parametrize("rule", licenses.rules(), ids=lambda r: r.rule_id)
def test_rules_compile_and_are_gated(rule):
    re.compile(rule.pattern)
    plain = re.sub(r"\(\?:|\)|\?|\[|\]", " ", rule.pattern)
    assert rule.keyword in plain and any(a in rule.pattern for a in licenses.ANCHORS + ("licen[sc]e",))


def test_no_rows(documents):
    assert licenses.scan(documents([])).collect() == []


def test_repeated_rows(documents):
    df = licenses.scan(documents([(1, "mit license"), (1, "mit license"), (None, None), (1, "other")]))
    assert sorted((r.doc_id or 0, r.labels) for r in df.collect()) == [(0, ""), (1, ""), (1, "mit"), (1, "mit")]
