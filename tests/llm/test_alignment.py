import bisect
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortwise.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
_a = Tokenizer.from_file(A)
_a.encode_special_tokens = True
_b = sentencepiece.SentencePieceProcessor(model_file=B)
_of = {c: b for c, b in alignment.byte_characters().items()}


def spelt_b(i):
    piece = _b.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()


def brute(text):
    """Ids on both sides, groups and links of a whole text, by comparing byte ranges."""
    if not text:
        return [], [], [], []
    a, b = _a.encode(" " + text, add_special_tokens=False).ids, _b.encode(text)
    bytes_a, bytes_b = [bytes(_of[c] for c in _a.id_to_token(i)) for i in a], [spelt_b(i) for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], [], []
    spans = []
    for parts in (bytes_a, bytes_b):
        at, own = 0, []
        for part in parts:
            own.append((at, at + len(part)))
            at += len(part)
        spans.append(own)
    common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups = [([], []) for _ in common]
    for side, (ids, own) in enumerate(((a, spans[0]), (b, spans[1]))):
        for i, (_, end) in zip(ids, own, strict=True):
            groups[bisect.bisect_left(common, end)][side].append(i)
    starts = [s for s, _ in spans[1]]
    links = []
    for i, (s, e) in zip(a, spans[0], strict=True):
        k = bisect.bisect_right(starts, s) - 1
        while k < len(b) and spans[1][k][0] < e:
            links.append((i, b[k]))
            k += 1
    return a, b, groups, links


def expected(texts):
    found = [brute(t) for t in texts]
    counts = Counter(p for *_, links in found for p in set(links))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for a, b, groups, links in found:
        spelt = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(spelt.encode()).hexdigest() if a else ""
        n_best = sum(counts[p] == best[p[0]] for p in links)
        out.append((len(a), len(b), len(groups), len(links), n_best, sum(counts[p] for p in links), digest))
    return out


def collected(df):
    return [(r.doc_id, *r[1:]) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]


def test_small_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [(i, *e) for (i, _), e in zip(rows, expected([t for _, t in rows]), strict=True)]
    for frequent in (alignment.FREQUENT, 50, 0):  # the join of the rest gives the same
        assert sorted(collected(alignment.link_counts(docs, A, B, frequent))) == sorted(want)


TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b ", "x\n y", "x \n y\tz", "don't  stop", "▁", "a ▁b", "a▁ b", "é😀日本語 テキスト", "\x00 \x01a",
    "<|endoftext|> <s> </s> <unk>", "x" * 3000, "word " * 4000, "a b  c", "a  b", "a \x1cb", "a \x85b ᠎c ​d", "ﬁ ﬁ", "1 22 333 4444", "\r\n\r\n x",
    "a {\r\n  return;\r\n}", "    four", "tail    ", "é ü", "﻿a ﻿b", "<0x41> <0x0A>", "a" * 41 + " " + "b" * 39, "Ünïcödé straße ŒUVRE",
]


def test_edges(documents):
    rows = [*enumerate(TEXTS), (None, "a null id"), (500, "said twice"), (500, "said twice")]
    want = [(i, *e) for (i, _), e in zip(rows, expected([t for _, t in rows]), strict=True)]
    for extra in ("row", "pair", "pairs"):
        got = collected(alignment.link_counts(documents(rows, extra=extra), A, B))
        assert sorted(got, key=str) == sorted(want, key=str)


def test_no_documents(documents):
    assert alignment.link_counts(documents([]), A, B).collect() == []


ALPHABET = [" ", "  ", "\n", "\t", "a", "the", "Zürich", "'s", "1999", "日", "😀", "▁", " ", "　", "\x1f", ".", "({", "\r", "ing", "<s>", "-"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join))
def test_parts_give_the_ids_of_whole_texts(text):
    both = alignment.tokenizers(A, B)
    a, b = both.encode([text, "between", text])
    want_a, want_b, *_ = brute(text)
    for k in (0, 2):
        assert a.ids[a.bounds[k] : a.bounds[k + 1]].tolist() == want_a
        assert b.ids[b.bounds[k] : b.bounds[k + 1]].tolist() == want_b


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 300), unique=True, max_size=60).map(sorted), st.lists(st.integers(0, 320), max_size=30), st.integers(0, 5))
def test_gallop_finds_the_first_end_not_below(ends, targets, start):
    start = min(start, len(ends))
    n = len(targets)
    got = alignment.gallop(np.array(ends, np.int64), np.array(targets, np.int64), np.full(n, start), np.full(n, len(ends)))
    assert got.tolist() == [bisect.bisect_left(ends, t, start) for t in targets]


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_either_side_may_drive(data):
    total = data.draw(st.integers(1, 40))
    cuts = st.lists(st.integers(1, total), max_size=20).map(lambda x: sorted({*x, total}))
    docs = [(data.draw(cuts), data.draw(cuts)) for _ in range(3)]
    size = [np.diff([0, *own]).tolist() for own in (x for pair in docs for x in pair)]
    lengths = np.arange(total + 1)
    a = alignment.Side(np.array(sum(size[0::2], []), np.int64), np.cumsum([0, *map(len, size[0::2])]))
    b = alignment.Side(np.array(sum(size[1::2], []), np.int64), np.cumsum([0, *map(len, size[1::2])]))
    got = alignment.align(a, b, lengths, lengths)
    want = set()
    for k, (x, y) in enumerate(docs):
        want |= {
            (k, int(a.bounds[k]) + i, int(b.bounds[k]) + j)
            for i, (s, e) in enumerate(zip([0, *x], x))
            for j, (u, v) in enumerate(zip([0, *y], y))
            if s < v and u < e
        }
        assert [c for c, f in zip(x, got.closes_a[a.bounds[k] : a.bounds[k + 1]]) if f] == sorted({*x} & {*y})
    links = list(zip(got.doc.tolist(), got.a.tolist(), got.b.tolist(), strict=True))
    assert len(links) == len(set(links)) and set(links) == want
