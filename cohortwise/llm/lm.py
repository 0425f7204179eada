"""Language-model scores by deleted interpolation.

Tokens are a text's words (runs other than blanks, A-Z in lower case) and one end. Every training
token and every pair of neighbouring tokens is counted; a text follows the end of another. The
probability of a token is a mixture of its share after the very token before it, by the exact count
of the pair, and of a model over classes. There the VOCABULARY most frequent tokens are classes of
their own, further ones share a class with tokens of like frequency, a token's probability within
its class comes from its own count, and a class follows the class before it with a mixture of
bigram, unigram and uniform estimates. All weights depend on how often the context was seen, by
powers of two, and are learned by expectation-maximisation from deleted texts: for the classes each
fold of the training texts is deleted in turn, for the tokens each text.

Class pairs are at most (VOCABULARY + bands)^2 numbers, so tasks get them as a table. Words and
pairs of words grow with the corpus and stay distributed: documents are packed into blocks, a block
asks for the counts of its distinct pairs, and of words beyond the FREQUENT most frequent ones, the
counts are added up by ranges of hashes and go back to the blocks. A pair that all texts hold is one
entry a block. Pairs are known by 64-bit hashes, as words are.

Defined results: null text is empty and is one end; a null id is in no fold: it trains and is not
held out; repeated rows count and score each; without training texts every count is 0; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.text import mix, raw, slices, words
from cohortwise.scratch import cut_lineage, shuffles_dropped

FOLDS, HELD_OUT_FOLD = 5, 1
VOCABULARY = 2_048
FREQUENT = 1 << 18
#: Distinct words a task gathers before it hands them on.
GATHERED = 1 << 20
EM_ROUNDS = 30
END = np.uint64(0x5851F42D4C957F2D)  # stands for the end, as words' hashes do for words

ROWS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Bytes of text of a block, and tokens for each bucket of items.
BLOCK = 1 << 22
BUCKET = 1 << 21
#: Cells for the logarithm of a ratio, and how many of them a factor of ten has.
CELLS, STEPS = 1 << 10, 16
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def folded(documents: DataFrame) -> DataFrame:
    """doc_id, text, fold (-1 for a null id)."""
    return documents.select(F.col("doc_id").cast("long"), F.coalesce(fold(F.col("doc_id")), F.lit(-1)).alias("fold"), "text")


def _texts(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, each closed by the end, and where each text begins and the last ends."""
    hashes, first = words(*raw(part.column("text")))
    rows = np.arange(1, len(first))
    tokens = np.insert(hashes, first[1:], END)
    return tokens, np.concatenate([[0], first[1:] + rows])


def count_words(training: DataFrame) -> DataFrame:
    """word (hash), n: every token of the texts, the end included."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts):
            word, where = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
            return word, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)

        def rows(word, n):
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

        parts, held = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                parts.append(np.unique(_texts(part)[0], return_counts=True))
                held += len(parts[-1][0])
                if held > GATHERED:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > GATHERED // 2:
                        yield rows(*parts[0])
                        parts, held = [], 0
        if parts:
            yield rows(*merged(parts))

    return training.select("text").mapInArrow(gather, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Lexicon:
    """The most frequent words by hash, their counts and classes, and totals of all words."""

    word: np.ndarray
    count: np.ndarray
    cls: np.ndarray
    classes: int
    tokens: int
    distinct: int

    @property
    def rare(self) -> int:
        return self.classes - 1

    def look_up(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and class of each token; a word that is not listed has count 0 and the rare class."""
        if not len(self.word):
            return np.zeros(len(tokens), np.int64), np.full(len(tokens), self.rare, np.int32)
        at = np.minimum(np.searchsorted(self.word, tokens), len(self.word) - 1)
        listed = self.word[at] == tokens
        return np.where(listed, self.count[at], 0), np.where(listed, self.cls[at], self.rare)


def lexicon(counts: DataFrame, vocabulary: int = VOCABULARY, frequent: int = FREQUENT) -> Lexicon:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).toArrow()
    word = top.column("word").to_numpy().view(np.uint64)
    count = top.column("n").to_numpy()
    # By rank: each of the first a class, then classes of as many words as all before them.
    rank = np.arange(len(word))
    band = vocabulary + np.floor(np.log2(np.maximum(rank, vocabulary) / vocabulary)).astype(np.int64)
    cls = np.where(rank < vocabulary, rank, band).astype(np.int32)
    classes = int(cls.max()) + 2 if len(cls) else 1
    order = np.argsort(word)
    return Lexicon(word[order], count[order], cls[order], classes, int(total.n), int(total.v))


def count_pairs(training: DataFrame, known: Lexicon) -> np.ndarray:
    """Rows (fold, class before, class, n) over all training texts."""
    shared = training.sparkSession.sparkContext.broadcast(known)  # of at most FREQUENT words

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        size = own.classes**2
        held: dict[int, np.ndarray] = {}
        end = int(own.look_up(np.array([END]))[1][0])
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, first = _texts(part)
                cls = own.look_up(tokens)[1].astype(np.int64)
                before = np.concatenate([[end], cls[:-1]])  # a text follows the end of another
                code = before * own.classes + cls
                folds = np.repeat(part.column("fold").to_numpy(), np.diff(first))
                for f in np.unique(folds).tolist():
                    pair, n = np.unique(code[folds == f], return_counts=True)
                    held.setdefault(f, np.zeros(size, np.int32))[pair] += n.astype(np.int32)
        for f, n in held.items():
            pair = np.flatnonzero(n)
            for k in range(0, len(pair), 1 << 18):
                some = pair[k : k + (1 << 18)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), f, np.int32)), pa.array(some.astype(np.int64)), pa.array(n[some].astype(np.int64))],
                    names=["fold", "pair", "n"],
                )

    found = training.select("fold", "text").mapInArrow(gather, "fold int, pair long, n long")
    table = cut_lineage(found.groupBy("fold", "pair").agg(F.sum("n").alias("n"))).toArrow()  # bounded by classes and folds
    pair = table.column("pair").to_numpy()
    return np.stack([table.column("fold").to_numpy().astype(np.int64), pair // known.classes, pair % known.classes, table.column("n").to_numpy()], axis=1)


def bucket(seen: np.ndarray) -> np.ndarray:
    """Frequency bucket of a context: 0 if unseen, else 1 + the power of two."""
    return np.where(seen > 0, 1 + np.floor(np.log2(np.maximum(seen, 1))), 0).astype(np.int64)


def learn_weights(pairs: np.ndarray, classes: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (bucket x bigram, unigram, uniform) that best explain deleted folds by the others."""
    weights = np.full((65, 3), 1 / 3)
    if not len(pairs):
        return weights
    code = pairs[:, 1] * classes + pairs[:, 2]
    distinct, place = np.unique(code, return_inverse=True)
    whole = np.bincount(place, pairs[:, 3])[place]
    context = np.bincount(pairs[:, 1], pairs[:, 3], classes)
    single = np.bincount(pairs[:, 2], pairs[:, 3], classes)
    estimates, buckets = np.zeros((len(pairs), 3)), np.zeros(len(pairs), np.int64)
    for f in np.unique(pairs[:, 0]):
        own = pairs[:, 0] == f
        p = pairs[own]
        left_context = context - np.bincount(p[:, 1], p[:, 3], classes)
        left_single = single - np.bincount(p[:, 2], p[:, 3], classes)
        estimates[own, 0] = (whole[own] - p[:, 3]) / np.maximum(1, left_context[p[:, 1]])
        estimates[own, 1] = left_single[p[:, 2]] / max(1, left_single.sum())
        buckets[own] = bucket(left_context[p[:, 1]])
    estimates[:, 2] = 1 / classes
    for _ in range(rounds):
        share = estimates * weights[buckets]
        share *= (pairs[:, 3] / share.sum(axis=1))[:, None]
        # A thousandth of an event each keeps every weight above zero.
        gain = np.stack([np.bincount(buckets, share[:, k], 65) for k in range(3)], axis=1) + 1e-3
        weights = gain / gain.sum(axis=1, keepdims=True)
    return weights


def transition_table(pairs: np.ndarray, classes: int, weights: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), classes x classes."""
    n = np.zeros((classes, classes))
    np.add.at(n, (pairs[:, 1], pairs[:, 2]), pairs[:, 3])
    context, single = n.sum(axis=1), n.sum(axis=0)
    w = weights[bucket(context)]
    unseen = context == 0
    n *= (w[:, 0] / np.maximum(1, context))[:, None]
    total = single.sum()
    back = single / total if total else np.full(classes, 1 / classes)
    # An unseen context has no bigram estimate; its share goes to the unigrams.
    n += np.outer(w[:, 1] + np.where(unseen, w[:, 0], 0.0), back)
    n += (w[:, 2] / classes)[:, None]
    return np.log10(n, out=n).astype(np.float32)


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """Hashes of each token with the one before it; a text follows the end of another."""
    before = np.concatenate([[END], tokens[:-1]])
    return mix(mix(before) * _SPREAD + tokens)


def pack_block(part: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(part)
    return sink.getvalue().to_pybytes()


def unpack_block(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(body) as stream:
        return stream.read_next_batch()


def blocks_of(rows: DataFrame) -> DataFrame:
    """block, body: rows packed together, about BLOCK bytes of text in each."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        parts, size = [], 0

        def row():
            body = pack_block(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([body], pa.binary())], names=["block", "body"])

        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                own = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if parts and size + own > BLOCK:
                    yield row()
                    block, parts, size = block + 1, [], 0
                parts.append(part)
                size += own
        if parts:
            yield row()

    return rows.mapInArrow(gather, "block long, body binary")


def to_planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte, the low bytes of all first; as many bytes as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T[:width]
    return bytes([width]) + planes.tobytes()


def from_planes(held: bytes) -> np.ndarray:
    planes = np.frombuffer(held, np.uint8, offset=1).reshape(held[0], -1)
    values = np.zeros((planes.shape[1], 8), np.uint8)
    values[:, : held[0]] = planes.T
    return values.reshape(-1).view("<u8")


def ask(blocks: DataFrame, shared, buckets: int) -> DataFrame:
    """block, bucket, items, n: distinct items of a block in order, and how often its training
    texts hold them. Items are pairs of tokens, and words that the tasks can't look up. A bucket is
    a range of hashes; each block asks for a hot item once."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body"), strict=True):
                part = unpack_block(body.as_py())
                tokens, first = _texts(part)
                trains = np.repeat(part.column("fold").to_numpy() != HELD_OUT_FOLD, np.diff(first))
                unlisted = known.look_up(tokens)[0] == 0
                both = np.concatenate([tokens[unlisted], _pairs(tokens)])
                trained = np.sort(both[np.concatenate([trains[unlisted], trains])])
                item = np.unique(both)
                n = np.searchsorted(trained, item, "right") - np.searchsorted(trained, item, "left")
                at = np.concatenate([[0], np.searchsorted(item, edges), [len(item)]])
                filled = [k for k in range(buckets) if at[k] < at[k + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(filled), block)),
                        pa.array(np.array(filled, np.int32)),
                        pa.array([to_planes(np.diff(item[at[k] : at[k + 1]], prepend=np.uint64(0))) for k in filled], pa.binary()),
                        pa.array([to_planes(n[at[k] : at[k + 1]]) for k in filled], pa.binary()),
                    ],
                    names=["block", "bucket", "items", "n"],
                )

    return blocks.mapInArrow(items, "block long, bucket int, items binary, n binary")


def answer(asked: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, total: how often all training texts hold each item asked for, in its order."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            item = [np.cumsum(from_planes(x), dtype=np.uint64) for _, x, _ in held]
            found, place = np.unique(np.concatenate(item), return_inverse=True)
            n = np.concatenate([from_planes(x) for _, _, x in held])
            total = np.bincount(place, n, len(found)).astype(np.uint64)  # exact below 2**53
            ends = np.cumsum([len(x) for x in item])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _, _ in held], pa.int64()),
                    pa.array(np.full(len(held), bucket, np.int32)),
                    pa.array([to_planes(x) for x in np.split(total[place], ends[:-1])], pa.binary()),
                ],
                names=["block", "bucket", "total"],
            )

        held, bucket = [], None
        for batch in batches:
            for block, own, items, n in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "items", "n")), strict=True):
                if own != bucket and held:
                    yield rows()
                    held = []
                bucket = own
                held.append((block, items, n))
        if held:
            yield rows()

    dealt = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(add, "block long, bucket int, total binary")


@dataclass(frozen=True)
class Model:
    """What the tasks know: the lexicon, log10 P(class | class before), tokens of each class, and the
    number of all tokens beyond the lexicon, smoothed."""

    known: Lexicon
    moves: np.ndarray
    mass: np.ndarray
    rare_tokens: float

    def by_class(self, cls: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 probability of tokens by the classes before them and their own counts."""
        end = int(self.known.look_up(np.array([END]))[1][0])
        before = np.concatenate([[end], cls[:-1]])
        rare = cls == self.known.rare
        share = np.where(rare, (count + 0.5) / self.rare_tokens, np.maximum(count, 0.5) / np.maximum(self.mass[cls], 1))
        return self.moves[before, cls].astype(np.float64) + np.log10(share)


def _before(tokens: np.ndarray, count: np.ndarray, of_end: int) -> np.ndarray:
    return np.concatenate([[of_end], count[:-1]])


def resolve(blocks: DataFrame, answers: DataFrame, shared, held_end: int) -> DataFrame:
    """block, body, word, pair and cells: each token's count and that of its pair, in the training
    texts, and what the block's training texts tell about weights (see learn_mixture)."""
    whole = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "total"))).alias("totals"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                block, body, totals = (batch.column(c)[row].as_py() for c in ("block", "body", "totals"))
                part = unpack_block(body)
                tokens, first = _texts(part)
                count, cls = model.known.look_up(tokens)
                unlisted = count == 0
                place = np.unique(np.concatenate([tokens[unlisted], _pairs(tokens)]), return_inverse=True)[1]
                found = np.concatenate([from_planes(x["total"]) for x in totals]).astype(np.int64)[place]
                more = int(unlisted.sum())
                count[unlisted] = found[:more]
                pair = found[more:]
                trains = part.column("fold").to_numpy() != HELD_OUT_FOLD
                cell, n = evidence(model, tokens, first, trains, cls, count, pair, held_end)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([body], pa.binary()),
                        pa.array([pack_block(pa.RecordBatch.from_arrays([pa.array(count), pa.array(pair)], names=["word", "pair"]))], pa.binary()),
                        pa.array([cell], pa.list_(pa.int64())),
                        pa.array([n], pa.list_(pa.int64())),
                    ],
                    names=["body", "counts", "cell", "n"],
                )

    both = blocks.join(whole, "block").select("block", "body", "totals")
    return both.mapInArrow(look, "body binary, counts binary, cell array<long>, n array<long>")


def evidence(model: Model, tokens, first, trains, cls, count, pair, held_end: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (bucket of the context, ratio of the two estimates) of the training tokens and their
    numbers. A document's own counts are deleted before its tokens are estimated."""
    context = _before(tokens, count, held_end)
    before = np.concatenate([[END], tokens[:-1]])
    pairs = _pairs(tokens)
    left = [np.zeros(len(tokens), np.int64) for _ in range(3)]
    for a, b in zip(first[:-1][trains].tolist(), first[1:][trains].tolist(), strict=True):
        for out, all_of, names in ((left[0], pair, pairs), (left[1], context, before), (left[2], count, tokens)):
            _, at, own = np.unique(names[a:b], return_inverse=True, return_counts=True)
            out[a:b] = all_of[a:b] - own[at]
    kept = np.repeat(trains, np.diff(first)) & (left[1] > 0)
    by_class = model.by_class(cls, np.maximum(left[2], 0))[kept]
    seen = left[0][kept] > 0
    ratio = np.log10(np.maximum(left[0][kept], 1) / left[1][kept]) - by_class
    step = np.where(seen, np.clip(np.round(ratio * STEPS) + CELLS // 2, 1, CELLS - 1), 0).astype(np.int64)
    return np.unique(bucket(left[1][kept]) * CELLS + step, return_counts=True)


def learn_mixture(cells: np.ndarray, n: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """The weight of the word before, by bucket of its count, that best explains deleted documents.

    The rest is the weight of the class before. A cell holds tokens whose estimates have about the
    same ratio, the word's to the class's; without evidence the word has no weight.
    """
    which, step = cells // CELLS, cells % CELLS
    ratio = np.where(step > 0, 10.0 ** ((step - CELLS // 2) / STEPS), 0.0)
    total = np.bincount(which, n, 65)
    weight = np.where(total > 0, 0.5, 0.0)
    for _ in range(rounds):
        own = weight[which] * ratio
        gain = np.bincount(which, n * own / (own + 1 - weight[which]), 65)
        # A thousandth of an event each keeps both weights above zero.
        weight = np.where(total > 0, (gain + 1e-3) / (total + 2e-3), 0.0)
    return weight


def score(documents: DataFrame, vocabulary: int = VOCABULARY, frequent: int = FREQUENT) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    with shuffles_dropped(documents.sparkSession):
        return _score(folded(documents), vocabulary, frequent)


def _score(rows: DataFrame, vocabulary: int, frequent: int) -> DataFrame:
    training = rows.where(F.col("fold") != HELD_OUT_FOLD)
    known = lexicon(cut_lineage(count_words(training)), vocabulary, frequent)
    pairs = count_pairs(training, known)
    table = transition_table(pairs, known.classes, learn_weights(pairs, known.classes))
    in_class = np.bincount(known.cls, known.count, known.classes)
    in_class[known.rare] = known.tokens - known.count.sum()
    rare_tokens = float(in_class[known.rare]) + 0.5 * (known.distinct - len(known.word) + 1)
    context = rows.sparkSession.sparkContext
    words_only, shared = context.broadcast(known), context.broadcast(Model(known, table, in_class, rare_tokens))
    held_end = training.count()  # each training text has one end
    blocks = cut_lineage(blocks_of(rows))
    buckets = known.tokens // BUCKET + 1
    answers = cut_lineage(answer(ask(blocks, words_only, buckets), buckets))
    seen = cut_lineage(resolve(blocks, answers, shared, held_end))
    # At most 65 * CELLS rows.
    told = seen.select(F.explode(F.arrays_zip("cell", "n")).alias("x")).groupBy("x.cell").agg(F.sum("x.n").alias("n")).toArrow()
    weight = learn_mixture(told.column("cell").to_numpy(), told.column("n").to_numpy())
    all_tokens = known.tokens + 0.5 * (known.distinct + 1)
    train_tokens = known.tokens

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for body, counts in zip(batch.column("body"), batch.column("counts"), strict=True):
                part, held = unpack_block(body.as_py()), unpack_block(counts.as_py())
                tokens, first = _texts(part)
                count, pair = held.column("word").to_numpy(), held.column("pair").to_numpy()
                cls = model.known.look_up(tokens)[1]
                before = _before(tokens, count, held_end)
                own = weight[bucket(before)]
                by_class = model.by_class(cls, count)
                # own * P(word | word before) + (1 - own) * P(word | class before)
                both = by_class + np.log10(1 - own + own * pair / np.maximum(before, 1) * 10.0**-by_class)
                add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every text has a token
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(part.column("fold").to_numpy() == HELD_OUT_FOLD),
                        pa.array(np.diff(first).astype(np.int64)), pa.array(add((count > 0).astype(np.int64))),
                        pa.array(np.full(part.num_rows, train_tokens, np.int64)),
                        pa.array(add(np.log10((count + 0.5) / all_tokens))), pa.array(add(both)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return seen.select("body", "counts").mapInArrow(add_up, ROWS)
