"""Benchmark decontamination by spaced seeds.

Words are runs of characters other than blanks, with A-Z in lower case. A document holds part of a
benchmark item if some run of WINDOW words of the item stands in the document with at most
SUBSTITUTIONS words exchanged; an item shorter than that is one run, with proportionally fewer
exchanges (none below seven words). Fixed masks choose positions of a run and ignore the others;
hashes of the chosen words of items and documents are joined, and the alignment around each hit is
compared word by word. The mask for full runs is complete: wherever the exchanges fall, one
placement of it avoids them all (a test tries every case); halves of shorter runs are complete by
counting.

Items are the query set: they go to the tasks in blocks of bounded size, and every block meets
every whole document. Nothing is shuffled but the matches.

Defined results: null or empty texts of documents match nothing; null or empty items have no runs;
equal items match each under their own id (a null id is allowed); repeated documents match each;
further columns are ignored; no items or no documents give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.text import mix, raw, slices, words

WINDOW = 13
SUBSTITUTIONS = 2
#: Complete for two exchanges in thirteen words, and its mirror image.
MASKS = ((0, 1, 3, 6, 7), (0, 1, 4, 6, 7))
#: Words of items that one pass over the documents looks for.
BLOCK_WORDS = 500_000

MATCHES = "doc_id long, item_id long, first_word long, last_word long, n_words long"
_FACTORS = np.random.default_rng(40_000_003).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def allowed(n: int) -> tuple[int, int]:
    """Length of the runs of an item of n words, and the exchanges that they may have."""
    run = min(n, WINDOW)
    return run, SUBSTITUTIONS * run // WINDOW


def masks(n: int) -> tuple[tuple[int, ...], ...]:
    """Masks for an item of n words that miss no run."""
    if n >= WINDOW:
        return MASKS
    run, exchanges = allowed(n)
    return (tuple(range(run // (exchanges + 1))),) if n else ()


def seeds(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The mask's hash at each place where it fits."""
    places = len(hashes) - mask[-1]
    if places <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(places, sum(1 << i for i in mask), dtype=np.uint64)
    for k, i in enumerate(mask):
        total += hashes[i : i + places] * _FACTORS[k]
    return mix(total)


class Index:
    """Seeds of a block of items: per mask sorted hashes with item and place."""

    BITS = 20

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        data, bounds = raw(pa.array(texts, pa.string()))
        hashes, first = words(data, bounds)
        self.ids = ids
        self.items = [hashes[first[k] : first[k + 1]] for k in range(len(ids))]
        made: dict[tuple[int, ...], list] = {}
        for k, item in enumerate(self.items):
            for mask in masks(len(item)):
                found = seeds(item, mask)
                made.setdefault(mask, []).append((found, np.full(len(found), k), np.arange(len(found))))
        self.tables = {}
        for mask, parts in made.items():
            value, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(value, kind="stable")
            gate = np.zeros(1 << self.BITS, dtype=bool)
            gate[value >> np.uint64(64 - self.BITS)] = True
            self.tables[mask] = (value[order], item[order], place[order], gate)

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Rows (item, start of the item in ``hashes``) of all distinct seeded alignments, and a
        place where each was hit, sorted; the words may be those of many texts in a row."""
        found = []
        for mask, (value, item, place, gate) in self.tables.items():
            own = seeds(hashes, mask)
            at = np.flatnonzero(gate[own >> np.uint64(64 - self.BITS)])
            own = own[at]
            lo, hi = np.searchsorted(value, own, "left"), np.searchsorted(value, own, "right")
            count = hi - lo
            entry = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
            at = np.repeat(at, count)
            found.append(np.stack([item[entry], at - place[entry], at], axis=1))
        return np.concatenate(found) if found else np.zeros((0, 3), np.int64)

    def matched(self, text: np.ndarray, item: int, start: int) -> list[tuple[int, int]]:
        """Maximal spans of words of ``text`` covered by runs of the item placed at ``start``."""
        own = self.items[item]
        run, exchanges = allowed(len(own))
        lo, hi = max(0, -start), min(len(own), len(text) - start)
        if hi - lo < run:
            return []
        total = np.concatenate([[0], np.cumsum(own[lo:hi] == text[start + lo : start + hi])])
        good = np.flatnonzero(total[run:] - total[:-run] >= run - exchanges) + start + lo
        if not len(good):
            return []
        cut = np.flatnonzero(np.diff(good) > run)
        firsts, lasts = good[np.concatenate([[0], cut + 1])], good[np.concatenate([cut, [len(good) - 1]])]
        return [(int(a), int(b) + run - 1) for a, b in zip(firsts, lasts, strict=True)]


def blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Index]:
    """Indexes over disjoint blocks of the items, dealt by a hash of id and text."""
    text = F.coalesce("text", F.lit(""))
    size = items.agg(F.sum(F.size(F.split(text, r"[\x20\x09-\x0D]+"))).alias("n")).first()["n"] or 0
    count = -(-size // block_words)
    dealt = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", text), F.lit(max(1, count))).alias("block"))
    for block in range(count):
        rows = dealt.where(F.col("block") == block).select("item_id", "text").collect()
        yield Index([r.item_id for r in rows], [r.text for r in rows])


def _found(part: pa.RecordBatch, items: Index) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, first word, last word) of all matches in a batch."""
    hashes, first = words(*raw(part.column("text")))
    hit = items.hits(hashes)
    if not len(hit):
        return
    # The text of a hit is that of the seed's first word; seeds across texts fail the comparison,
    # which sees one text only.
    text = np.searchsorted(first, hit[:, 2], "right") - 1
    for k, item, start in np.unique(np.stack([text, hit[:, 0], hit[:, 1]], axis=1), axis=0).tolist():
        for a, b in items.matched(hashes[first[k] : first[k + 1]], item, start - int(first[k])):
            yield k, item, a, b


def _scan(documents: DataFrame, index: Index) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(index)  # of at most a block's words

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("doc_id")
                out = [(ids[k].as_py(), items.ids[item], a, b, b - a + 1) for k, item, a, b in _found(part, items)]
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in columns],
                        names=["doc_id", "item_id", "first_word", "last_word", "n_words"],
                    )

    return documents.select("doc_id", "text").mapInArrow(search, MATCHES)


def _without(documents: DataFrame, index: Index) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                clean = np.ones(part.num_rows, dtype=bool)
                clean[[k for k, *_ in _found(part, shared.value)]] = False
                yield part.filter(pa.array(clean))

    return documents.mapInArrow(select, documents.schema)


def matches(documents: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every alignment of an item in a document: doc_id, item_id, first_word, last_word (of the
    document, both included), n_words."""
    found = None
    for index in blocks(items, block_words):
        part = _scan(documents, index)
        found = part if found is None else found.unionAll(part)
    return found if found is not None else documents.sparkSession.createDataFrame([], MATCHES)


def contaminated(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per document and item that it holds: the words from the first to the last, and how many."""
    return (
        matches(documents, items)
        .groupBy("doc_id", "item_id")
        .agg(
            F.min("first_word").alias("first_word"),
            F.max("last_word").alias("last_word"),
            F.max("n_words").alias("n_words"),
        )
    )


def without_contaminated(documents: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that hold no part of any item, with all their columns; nothing is shuffled."""
    for index in blocks(items, block_words):
        documents = _without(documents, index)
    return documents
