"""Alignment of two tokenizers over the same bytes.

Each text is tokenized twice; the byte offsets where tokens end form two rising lists. The shorter
list of a document drives: each of its ends gallops through the longer one, first in steps that
double and then by halving the last step, so a search costs the logarithm of the distance it goes.
Ends found in both lists slice the tokens into groups. The rank of an end in the other list, less the
rank of the end before it, is the range of tokens of the other side that overlap it, which gives all
links without comparing tokens. Searches of many documents run side by side as numpy steps.

Links are counted over the corpus: each document hands on its distinct id pairs, Spark sums them, and
the sums are joined back to the pairs of each document. Frequent pairs, ``FREQUENT`` at most, are
broadcast; all others are joined by a shuffle.

Both tokenizers are free to be called on parts of a text that are cut before a single blank between
other characters: neither has tokens over such a place. Each worker remembers the ids of short parts.

Defined results: null and empty texts, and texts whose tokens do not spell the blank and the text on
both sides (such as texts with U+2581), have no tokens and zeros; repeated rows are documents of
their own; a null id passes through; further columns are ignored; no documents give no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.llm.text import slices
from cohortwise.scratch import cut_lineage

#: Pairs that may be broadcast, by a limit on counts; a pair and its count take 17 bytes.
FREQUENT = 400_000
#: Parts that a worker remembers, the first it meets, and their characters at most.
REMEMBERED, SHORT = 300_000, 40
#: Bytes of text aligned together.
TOGETHER = 1 << 20

ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<long>, times array<int>"
)

# A blank between characters that are neither blanks nor marks whose class the tokenizers may see otherwise.
_CUT = re.compile("(?<=[^ ▁]) (?=[^\\s᠎​-‍⁠﻿▁])")


@dataclass
class Side:
    """Token ids of several texts, and where each text's begin and the last ends."""

    ids: np.ndarray
    bounds: np.ndarray


class Tokenizers:
    """Both tokenizers with the bytes of their tokens; one per worker process."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = byte_characters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        spelt_a = [b""] * (1 + max(vocabulary.values()))
        for entry, i in vocabulary.items():
            spelt_a[i] = bytes(byte_of[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        spelt_b = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(pieces)
        ]
        self.spelt = [pa.array(spelt, pa.large_binary()) for spelt in (spelt_a, spelt_b)]
        self.length_a, self.length_b = (np.array([len(s) for s in spelt], np.int64) for spelt in (spelt_a, spelt_b))
        self.names = Names(len(spelt_a), len(spelt_b))
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def spells(self, side: int, ids: list[list[int]], wanted: list[bytes]) -> list[bool]:
        """Whether the tokens of each part spell what is wanted."""
        whole = self.spelt[side].take(pa.array(np.fromiter(itertools.chain.from_iterable(ids), np.int64)))
        _, offsets, data = whole.buffers()
        at = np.frombuffer(offsets, np.int64)[np.cumsum([0, *map(len, ids)])].tolist()
        body = data.to_pybytes()[: at[-1]] if data is not None else b""
        if body == b"".join(wanted) and at == np.cumsum([0, *map(len, wanted)]).tolist():
            return [True] * len(ids)
        return [body[x:y] == w for x, y, w in zip(at, at[1:], wanted, strict=False)]

    def look_up(self, parts: list[str]) -> list[tuple[bytes, bytes]]:
        """Both sides' ids (32 bits each) of a blank and each of distinct parts; none where the
        tokens do not spell that."""
        found = list(map(self.known.get, parts))
        new = [k for k, ids in enumerate(found) if ids is None]
        for some in itertools.batched(new, 4096):
            own = [parts[k] for k in some]
            ids_a = [e.ids for e in self.a.encode_batch([" " + part for part in own], add_special_tokens=False)]
            ids_b = self.b.encode(own, num_threads=1)
            wanted = [b" " + part.encode() for part in own]
            good = zip(self.spells(0, ids_a, wanted), self.spells(1, ids_b, wanted), strict=True)
            for k, part, x, y, (good_a, good_b) in zip(some, own, ids_a, ids_b, good, strict=True):
                found[k] = (array("I", x).tobytes(), array("I", y).tobytes()) if good_a and good_b else (b"", b"")
                if len(part) <= SHORT and len(self.known) < REMEMBERED:
                    self.known[part] = found[k]
        return found

    def encode(self, texts: list[str | None]) -> tuple[Side, Side]:
        """Ids of all texts on both sides; texts that are empty or not spelt have none."""
        split = [_CUT.split(" " + text) if text else [] for text in texts]
        for parts in split:
            if parts:
                parts[0] = parts[0][1:]
        coded = pa.array(itertools.chain.from_iterable(split), pa.large_string()).dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        found = self.look_up(coded.dictionary.to_pylist())
        first = np.cumsum([0, *map(len, split)])
        # A text is left out as a whole where one part is not spelt.
        unspelt = np.array([not ids for ids, _ in found], bool)
        wrong = np.concatenate([[0], np.cumsum(unspelt[at])])
        good = np.repeat(wrong[first[1:]] == wrong[first[:-1]], np.diff(first))
        sides = []
        for own in ([a for a, _ in found], [b for _, b in found]):
            size = np.fromiter(map(len, own), np.int64, len(own)) // 4
            start = np.cumsum(size) - size
            count = np.where(good, size[at], 0)
            ends = np.concatenate([[0], np.cumsum(count)])
            source = np.repeat(start[at] - ends[:-1], count) + np.arange(ends[-1])
            sides.append(Side(np.frombuffer(b"".join(own), np.uint32)[source].astype(np.int64), ends[first]))
        return sides[0], sides[1]


def byte_characters() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable bytes stand for themselves, the others in
    order for the characters from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Names:
    """Decimal ids with the sign that follows them: , inside a side, | between sides, ; after a group."""

    def __init__(self, n_a: int, n_b: int):
        signs = [(n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")]
        self.texts = pa.array([f"{i}{sign}" for n, sign in signs for i in range(n)], pa.large_binary())
        self.n_a, self.n_b = n_a, n_b

    def codes_a(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        return ids + np.where(last, self.n_a, 0)

    def codes_b(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        return 2 * self.n_a + ids + np.where(last, self.n_b, 0)


@lru_cache(maxsize=1)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def gallop(ends: np.ndarray, targets: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The first place from ``start`` on, below ``stop``, whose end is at least the target; else ``stop``.

    Doubling steps pass all ends below the target, then the last step is halved. All targets go on
    together, those that have arrived drop out.
    """
    low, step = start.copy(), np.ones(len(start), np.int64)
    going = np.arange(len(start))
    while len(going):  # low: all places before it lie below the target
        reach = low[going] + step[going] - 1
        inside = reach < stop[going]
        passed = inside.copy()
        passed[inside] = ends[reach[inside]] < targets[going[inside]]
        going = going[passed]
        low[going] = reach[passed] + 1
        step[going] *= 2
    high = np.minimum(low + step - 1, stop)
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) // 2
        below = ends[middle] < targets[going]
        low[going[below]] = middle[below] + 1
        high[going[~below]] = middle[~below]
        going = going[low[going] < high[going]]
    return low


def meet(drive: np.ndarray, drive_at: np.ndarray, other: np.ndarray, other_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the ends of the driving documents' tokens: the first and last token of the other side that
    overlap each, and whether its end is common. ``*_at``: bounds of the documents on both sides."""
    size = np.diff(drive_at)
    start, stop = np.repeat(other_at[:-1], size), np.repeat(other_at[1:], size)
    rank = gallop(other, drive, start, stop)
    common = np.zeros(len(drive), bool)
    inside = rank < stop
    common[inside] = other[rank[inside]] == drive[inside]
    after = rank + common  # the first token that begins at or spans the end
    first = np.concatenate([[0], after[:-1]])
    heads = drive_at[:-1][size > 0]
    first[heads] = other_at[:-1][size > 0]
    return first, rank, common


@dataclass
class Aligned:
    """Per token pair that overlaps: the document, and the places of both tokens; per token: whether
    it closes a group."""

    doc: np.ndarray
    a: np.ndarray
    b: np.ndarray
    closes_a: np.ndarray
    closes_b: np.ndarray


def _pick(bounds: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the chosen documents' tokens, and their bounds among these."""
    size = np.where(chosen, np.diff(bounds), 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(bounds[:-1] - ends[:-1], size) + np.arange(ends[-1]), ends


def align(a: Side, b: Side, length_a: np.ndarray, length_b: np.ndarray) -> Aligned:
    """All links and groups of several documents; in each the side with fewer tokens drives."""
    ends_a, ends_b = np.cumsum(length_a[a.ids]), np.cumsum(length_b[b.ids])
    closes_a, closes_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
    a_drives = np.diff(a.bounds) <= np.diff(b.bounds)
    found = []
    for chosen, own, own_ends, other, other_ends, own_closes, other_closes in (
        (a_drives, a, ends_a, b, ends_b, closes_a, closes_b),
        (~a_drives, b, ends_b, a, ends_a, closes_b, closes_a),
    ):
        at, own_at = _pick(own.bounds, chosen)
        lists, list_at = _pick(other.bounds, chosen)
        first, last, common = meet(own_ends[at], own_at, other_ends[lists], list_at)
        own_closes[at[common]] = True
        other_closes[lists[last[common]]] = True
        count = last - first + 1
        shift = np.cumsum(count) - count
        partner = lists[np.repeat(first - shift, count) + np.arange(count.sum())]
        doc = np.repeat(np.arange(len(own.bounds) - 1), np.where(chosen, np.diff(own.bounds), 0))
        found.append((np.repeat(doc, count), np.repeat(at, count), partner))
    (doc, left, right), (doc_b, own_b, partner_a) = found
    return Aligned(np.concatenate([doc, doc_b]), np.concatenate([left, partner_a]), np.concatenate([right, own_b]), closes_a, closes_b)


def spell_groups(a: Side, b: Side, aligned: Aligned, names: Names) -> list[str]:
    """SHA-256 of each document's groups as a1,a2|b1;...; empty without tokens."""
    group_a = np.cumsum(aligned.closes_a) - aligned.closes_a
    group_b = np.cumsum(aligned.closes_b) - aligned.closes_b
    # In the text a group's A tokens come before its B tokens.
    a_upto = np.concatenate([np.flatnonzero(aligned.closes_a) + 1, [len(a.ids)]])
    b_upto = np.concatenate([[0], np.flatnonzero(aligned.closes_b) + 1])
    codes = np.zeros(len(a.ids) + len(b.ids), np.int64)
    codes[np.arange(len(a.ids)) + b_upto[group_a]] = names.codes_a(a.ids, aligned.closes_a)
    codes[np.arange(len(b.ids)) + a_upto[group_b]] = names.codes_b(b.ids, aligned.closes_b)
    spelt = names.texts.take(pa.array(codes))
    _, offsets, data = spelt.buffers()
    at = np.frombuffer(offsets, np.int64)[: len(codes) + 1][a.bounds + b.bounds].tolist()
    body = memoryview(data) if data is not None else memoryview(b"")
    return [hashlib.sha256(body[x : y - 1]).hexdigest() if y > x else "" for x, y in itertools.pairwise(at)]


def aligned_documents(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Each document's counts, the hash of its groups, and its distinct id pairs (A id times the size
    of B's vocabulary, plus B id) with how often they are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(path_a, path_b)
        width = len(both.length_b)
        for batch in batches:
            for part in slices(batch, "text", TOGETHER):
                a, b = both.encode(part.column("text").to_pylist())
                got = align(a, b, both.length_a, both.length_b)
                pair = a.ids[got.a].astype(np.int64) * width + b.ids[got.b]
                order = np.lexsort((pair, got.doc))
                doc, pair = got.doc[order], pair[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
                heads = np.flatnonzero(new)
                times = np.diff(np.concatenate([heads, [len(doc)]]))
                n = part.num_rows
                offsets = pa.array(np.searchsorted(doc[heads], np.arange(n + 1)), pa.int32())
                groups = np.concatenate([[0], np.cumsum(got.closes_a)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(a.bounds)),
                        pa.array(np.diff(b.bounds)),
                        pa.array(np.diff(groups[a.bounds])),
                        pa.array(np.bincount(got.doc, minlength=n).astype(np.int64)),
                        pa.array(spell_groups(a, b, got, both.names), pa.string()),
                        pa.ListArray.from_arrays(offsets, pa.array(pair[heads])),
                        pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                    ],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ALIGNED)


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """pair, documents that hold it linked, and whether no other pair of its A id has more."""
    counts = links.groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    # At most as many rows as B has ids.
    of_a = Window.partitionBy(F.expr(f"pair div {width}L"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_a))


def frequent_from(counts: DataFrame, most: int = FREQUENT) -> int:
    """The least power of two that at most ``most`` pairs reach."""
    bits = F.floor(F.log2(F.col("count"))).cast("int")
    held = {r["bit"]: r["count"] for r in counts.groupBy(bits.alias("bit")).count().collect()}  # below 64 rows
    limit = max(held, default=0) + 1
    total = 0
    while limit > 0 and total + held.get(limit - 1, 0) <= most:
        limit -= 1
        total += held.get(limit, 0)
    return 1 << limit


def link_counts(documents: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT) -> DataFrame:
    """Each document's counts and hash, ``n_best`` (links that no other of their A id exceed in the
    corpus) and ``count_sum`` (over links, the documents that hold the pair)."""
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    own = cut_lineage(aligned_documents(documents, path_a, path_b).withColumn("row", F.monotonically_increasing_id()))
    links = own.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", "link.pairs", "link.times")
    links = links.withColumnRenamed("pairs", "pair")
    counts = cut_lineage(pair_counts(links, width))
    limit = frequent_from(counts, frequent)
    often = counts.where(F.col("count") >= limit)
    rarely = counts.where(F.col("count") < limit)
    tried = links.join(F.broadcast(often), "pair", "left")  # ``frequent`` rows at most
    rest = tried.where("count is null").select("row", "pair", "times").join(rarely, "pair")
    joined = tried.where("count is not null").select("row", "times", "count", "best").unionAll(rest.select("row", "times", "count", "best"))
    sums = joined.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    )
    narrow = own.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("long")
    return narrow.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
