"""Drawing the documents whose hashed n-grams look most like a target set.

A 256-byte table lower-cases A-Z and blanks separators in the UTF-8 bytes of a text, and
``bytes.split`` yields its words. The checksum of a word is the seed of the checksum of the n-gram
that continues it, so n-grams are never joined. Counters reduce the checksums of a run of text, and
each task sums its counters to one row per bucket; the buckets of both sides give every bucket a
gain, the logarithm of its target and source shares. A document's weight is the sum of the gains of
its features, and the highest weights with Gumbel noise are drawn, which samples without replacement
in proportion to the likelihood ratio.

Counts hold a row per bucket; weights need no shuffle; places are running counts over ranges of
scores, so that no task holds all candidates.

Defined results: a null or empty text has no words, no features and weight 0, and is never drawn
where ``least_words`` is above 0; a null id hashes as empty text and comes before other ids in ties;
repeated rows count, score and are drawn each; further columns are ignored; without a target the
gains favour rare buckets; no documents give no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.text import slices
from cohortwise.plans.ordered import running_total
from cohortwise.scratch import cut_lineage

ORDER, BUCKETS, SEED = 1, 10_000, 2024
LEAST_WORDS, PERCENT = 20, 10
#: Bytes of a text whose words are taken together.
PIECE = 1 << 20

SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def _word_bytes() -> bytes:
    """Digits, letters and all bytes of longer characters stand for themselves, A-Z for a-z."""
    kept = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(b if b in kept else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


TABLE = _word_bytes()


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, a bounded run of it at a time."""
    data = (text or "").encode().translate(TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def checksums(text: str | None, order: int) -> Iterator[tuple[int, list[int]]]:
    """Per run of a text: its number of words, and the crc32 of all n-grams that end in it."""
    before: list[bytes] = []
    for own in pieces(text):
        words = before + own
        found: list[int] = []
        seeds = list(map(zlib.crc32, words))
        for n in range(order):
            found += seeds[max(0, len(before) - n) :]
            seeds = [zlib.crc32(b" " + word, seed) for seed, word in zip(seeds, words[n + 1 :])]
        yield len(own), found
        before = words[max(0, len(words) - order + 1) :]


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all ``texts`` per bucket; a task hands on a row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                found: Counter[int] = Counter()
                for text in part.column("text"):
                    for _, sums in checksums(text.as_py(), order):
                        found.update(sums)
                at = np.fromiter(found.keys(), np.int64, len(found)) % buckets
                np.add.at(total, at, np.fromiter(found.values(), np.int64, len(found)))
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["bucket", "n"])

    parts = texts.select("text").mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's shares, with one added to every count; the
    driver sees a row per bucket."""
    counts = []
    for side in (source, target):
        own = [0] * buckets
        for row in side.collect():
            own[row["bucket"]] = row["n"]
        counts.append(own)
    s, t = counts
    whole_s, whole_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array(
        [math.floor(1000 * math.log((b + 1.0) * whole_s / ((a + 1.0) * whole_t))) for a, b in zip(s, t, strict=True)],
        np.int64,
    )


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel variate that the id and the seed decide."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(documents: DataFrame, gain: np.ndarray, order: int = ORDER, seed: int = SEED) -> DataFrame:
    """Each document's words, features, weight and score; ``gain`` has an entry per bucket."""
    shared = documents.sparkSession.sparkContext.broadcast(gain)  # as many entries as buckets

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    n_words = n_features = weight = 0
                    for words, sums in checksums(text.as_py(), order):
                        n_words += words
                        n_features += len(sums)
                        weight += int(own[np.array(sums, np.int64) % len(own)].sum())
                    out.append((doc_id, n_words, n_features, weight, weight + noise(doc_id, seed)))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "n_words", "n_features", "weight", "score"]
                )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(weigh, SCORED)


def resample(
    documents: DataFrame,
    target: DataFrame,
    *,
    order: int = ORDER,
    buckets: int = BUCKETS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """Every document with its weight, score and rank among the drawn ones (null: not drawn).

    ``percent`` of the documents with at least ``least_words`` words are drawn.
    """
    gain = gains(bucket_counts(documents, order, buckets), bucket_counts(target, order, buckets), buckets)
    # The row number tells repeated rows apart and stays as written.
    table = cut_lineage(scored(documents, gain, order, seed).withColumn("row", F.monotonically_increasing_id()))
    can = F.col("n_words") >= least_words
    draws = percent * table.where(can).count() // 100
    placed = running_total(
        table.where(can).withColumn("one", F.lit(1).cast("long")),
        "one",
        order=[F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row").asc()],
        name="before",
    )
    rank = F.when(F.col("before") < draws, F.col("before") + 1)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    drawn = placed.select(*columns, rank.alias("rank"))
    return drawn.unionAll(table.where(~can).select(*columns, F.lit(None).cast("long").alias("rank")))
