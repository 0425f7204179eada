"""Packing documents into fixed windows whose sources keep to target proportions.

The documents of a source form one queue, in the order of the input's partitions. A lane is a like
part of every queue, cut where it ends, so each lane holds all sources in the corpus's proportions,
however the input is ordered. Deficit round-robin fills a lane's windows one after the other: every
window adds to each source's credit its share of the window, takes whole tokens from the queues by
credit, and carries what a source is owed to the next window; what the cut of a queue rounds off is
carried to the next lane. A document's place in its source's queue follows from token counts of the
partitions, and a lane's plan from the token counts of the sources, so each task derives the plans
of the lanes that its documents reach and cuts them there, without any shuffle of tokens.

The last tokens of a lane go to windows of powers of two, so nothing is padded.

Defined results: null text is empty and gives the closing id only; a null source is a queue of
its own; repeated rows are packed each; a null id passes through; further columns are ignored; no
documents give no pieces.
"""

from __future__ import annotations

import itertools
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.llm.text import slices
from cohortwise.scratch import cut_lineage

WINDOW = 2048
CLOSING_ID = 1
#: Tokens of a lane, about; and entries of plans that a task remembers.
LANE, PLANNED = 1 << 22, 1 << 22
#: Words whose ids a worker remembers, the first it meets; most of the frequent ones are among them.
REMEMBERED = 800_000
#: Bytes of text whose words are looked up together, and documents whose ids are laid out together.
LOOKED_UP, LAID_OUT = 32 << 20, 500

TOKENS = "part int, doc_id long, source string, before long, n_tokens long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, source string, ids binary"
)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@dataclass
class Coded:
    """Texts as indices of distinct words, and the ids of each."""

    flat: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray
    words: np.ndarray
    first: np.ndarray

    def ids(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts a to b, and where each text begins and the last ends."""
        at = self.words[self.first[a] : self.first[b]]
        length = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.repeat(self.starts[at] - ends[:-1], length) + np.arange(ends[-1])]
        return ids, ends[self.first[a : b + 1] - self.first[a]]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per worker process, for all its tasks."""
    return WordIds(path)


class WordIds:
    """Ids of texts as the ids of their blank-separated parts, each tokenized once.

    Right for tokenizers that drop white space and never join tokens across it.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.known: dict[str, bytes] = {}

    def code(self, column: pa.Array) -> Coded:
        parts = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        offsets = parts.offsets.to_numpy()
        coded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        bits = list(map(self.known.get, distinct))
        new = [k for k, found in enumerate(bits) if found is None]
        for some in itertools.batched(new, 8192):
            encoded = self.tokenizer.encode_batch([distinct[k] for k in some], add_special_tokens=False)
            for k, got in zip(some, encoded, strict=True):
                bits[k] = array("I", got.ids).tobytes()
                if len(self.known) < REMEMBERED:
                    self.known[distinct[k]] = bits[k]
        sizes = np.fromiter(map(len, bits), np.int64, len(bits)) // 4
        flat = np.frombuffer(b"".join(bits), dtype="<u4")
        return Coded(flat, sizes, np.cumsum(sizes) - sizes, coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0])


def tokens(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Ids of each document (16 bits each where the vocabulary allows), with its partition and
    the tokens of its source that stand before it in there."""
    narrow = _tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_part = TaskContext.get().partitionId()
        encoder, queued = word_ids(tokenizer_path), {}
        kind = "<u2" if narrow else "<u4"
        closing = np.array([CLOSING_ID], kind).tobytes()
        for batch in batches:
            for some in slices(batch, "text", LOOKED_UP):
                coded = encoder.code(some.column("text"))
                for at in range(0, some.num_rows, LAID_OUT):
                    part = some.slice(at, LAID_OUT)
                    ids, bounds = coded.ids(at, at + part.num_rows)
                    source, body = part.column("source").to_pylist(), memoryview(ids.astype(kind).tobytes())
                    width = len(closing)
                    own = [bytes(body[width * a : width * b]) + closing for a, b in itertools.pairwise(bounds.tolist())]
                    sizes = np.diff(bounds) + 1
                    before = []
                    for name, size in zip(source, sizes.tolist(), strict=True):
                        before.append(queued.get(name, 0))
                        queued[name] = before[-1] + size
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([own_part] * len(own), pa.int32()),
                            part.column("doc_id").cast(pa.int64()),
                            pa.array(source, pa.string()),
                            pa.array(before, pa.int64()),
                            pa.array(sizes, pa.int64()),
                            pa.array(own, pa.binary()),
                        ],
                        names=["part", "doc_id", "source", "before", "n_tokens", "ids"],
                    )

    return documents.select("doc_id", "source", "text").mapInArrow(encode, TOKENS)


def window_sizes(total: int, window: int) -> np.ndarray:
    rest = total % window
    return np.array([window] * (total // window) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1], np.int64)


def fill(totals: np.ndarray, credit: np.ndarray, shares: np.ndarray, window: int) -> np.ndarray:
    """Tokens that each source has given before each window: (windows + 1) x sources."""
    left, credit = totals.copy(), credit.astype(float).copy()
    sizes = window_sizes(int(totals.sum()), window)
    given = np.zeros((len(sizes) + 1, len(totals)), np.int64)
    for w, size in enumerate(sizes):
        weight = np.where(left > 0, shares, 0.0)
        total = weight.sum()
        weight = weight / total if total > 0 else (left > 0) / (left > 0).sum()
        credit += weight * size
        take = np.clip(np.floor(credit), 0, left).astype(np.int64)
        order = np.argsort(-credit, kind="stable")
        short = size - int(take.sum())
        if short < 0:  # the most owed come first
            take[order] = np.diff(np.minimum(np.cumsum(take[order]), size), prepend=0)
        while short > 0:
            for s in order:
                more = min(short, int(left[s] - take[s]), max(1, int(np.ceil(short * weight[s]))))
                take[s] += more
                short -= more
                if not short:
                    break
        credit -= take
        left -= take
        given[w + 1] = given[w] + take
    return given


def borders(total: int, n_lanes: int) -> np.ndarray:
    """Where the lanes' parts of a queue begin, and the end of the last one."""
    lane = np.arange(n_lanes + 1, dtype=np.int64)
    return total // n_lanes * lane + total % n_lanes * lane // n_lanes


@dataclass
class Lanes:
    """The sources with all their tokens and shares, and what the lanes take of each."""

    names: dict[str | None, int]
    totals: np.ndarray
    shares: np.ndarray
    window: int
    n_lanes: int

    def __post_init__(self):
        self.cuts = np.array([borders(int(t), self.n_lanes) for t in self.totals], np.int64).reshape(len(self.totals), self.n_lanes + 1)
        packed = self.cuts.sum(axis=0)
        own = np.diff(packed)
        sequences = own // self.window + np.bitwise_count(own % self.window)
        self.packed, self.first_sequence = packed, np.cumsum(sequences) - sequences

    def plan(self, lane: int) -> tuple[np.ndarray, np.ndarray]:
        """Per source: tokens given before each window, and where its own begin in the window."""
        had = self.cuts[:, lane]
        credit = self.totals / self.totals.sum() * self.packed[lane] - had
        given = fill(self.cuts[:, lane + 1] - had, credit, self.shares, self.window)
        taken = np.diff(given, axis=0)
        return np.ascontiguousarray(given.T), np.ascontiguousarray((np.cumsum(taken, axis=1) - taken).T)


def lanes(queue: DataFrame, window: int, targets: dict[str, float] | None) -> Lanes:
    """From the tokens per partition and source; a row per source reaches the driver."""
    found = queue.groupBy("source").agg(F.sum("queued").alias("total")).orderBy("source").collect()
    totals = np.array([r["total"] for r in found], np.int64)
    if targets is None:
        shares = totals / max(1, totals.sum())
    else:
        shares = np.array([targets.get(r["source"] or "", 0.0) for r in found]) / sum(targets.values())
    names = {r["source"]: k for k, r in enumerate(found)}
    return Lanes(names, totals, shares, window, max(1, int(totals.sum()) // LANE))


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    window: int = WINDOW,
    targets: dict[str, float] | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of documents with their place in sequences of at most ``window`` ids.

    ``targets``: weights of sources; by default the corpus's own proportions, so that every window
    is a like mixture and all queues run out together. A source without a weight is taken when the
    others are used up. ``with_ids``: the pieces carry their ids (little-endian 32 bits each).
    """
    if window & (window - 1):
        raise ValueError("a window is a power of two")
    coded = cut_lineage(tokens(documents, tokenizer_path))
    queue = cut_lineage(coded.groupBy("part", "source").agg(F.sum("n_tokens").alias("queued")))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = queue.select(
        F.col("part").alias("of_part"),
        F.col("source").alias("of_source"),
        F.coalesce(F.sum("queued").over(earlier), F.lit(0)).alias("start"),
    )
    # A row per partition and source: Spark broadcasts it only below its own size limit.
    placed = coded.join(cut_lineage(start), (F.col("part") == F.col("of_part")) & F.col("source").eqNullSafe(F.col("of_source")))
    shared = documents.sparkSession.sparkContext.broadcast(lanes(queue, window, targets))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = shared.value
        plans: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for batch in slices(whole, "ids"):
                out: list[tuple] = []
                names = batch.column("source").to_pylist()
                ids = batch.column("ids").to_pylist()
                sizes = batch.column("n_tokens").to_pylist()
                begins = (batch.column("start").to_numpy() + batch.column("before").to_numpy()).tolist()
                docs = batch.column("doc_id").to_pylist()
                for k, name in enumerate(names):
                    s, a, n = dealt.names[name], begins[k], sizes[k]
                    cuts = dealt.cuts[s]
                    body = np.frombuffer(ids[k], "<u2" if len(ids[k]) == 2 * n else "<u4").astype("<u4").tobytes()
                    for lane in range(int(np.searchsorted(cuts, a, "right")) - 1, int(np.searchsorted(cuts, a + n, "left"))):
                        if lane not in plans:
                            made = dealt.plan(lane)
                            if (len(plans) + 1) * made[0].size > PLANNED:
                                plans.clear()
                            plans[lane] = made
                        given, offsets = plans[lane]
                        at, end = int(cuts[lane]), int(cuts[lane + 1])
                        x0, x1, queue = max(a, at) - at, min(a + n, end) - at, given[s]
                        w = np.arange(np.searchsorted(queue, x0, "right") - 1, np.searchsorted(queue, x1, "left"))
                        w = w[queue[w + 1] > queue[w]]
                        lo, hi = np.maximum(queue[w], x0), np.minimum(queue[w + 1], x1)
                        first, back = int(dealt.first_sequence[lane]), at - a
                        for x, y, v, o in zip(
                            (lo + back).tolist(), (hi + back).tolist(), w.tolist(), (offsets[s, w] + lo - queue[w]).tolist(), strict=True
                        ):
                            piece = body[4 * x : 4 * y]
                            out.append((docs[k], x, y - x, zlib.crc32(piece), n, first + v, o, name, piece if with_ids else None))
                if out:
                    columns = list(zip(*out, strict=True))
                    kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"],
                    )

    return placed.select("doc_id", "source", "start", "before", "n_tokens", "ids").mapInArrow(cut, PIECES)
