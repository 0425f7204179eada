"""Removal of long repeated byte strings by a distributed difference cover.

A difference cover modulo v is a set of residues such that any two places have a common distance,
less than v, to places whose residues are in the set. So if the same string of ``length`` bytes
starts at two places, then within its first v places both copies have a sampled place at the same
distance, and the bytes from there agree. For a prime q there is a perfect cover of q + 1 residues
modulo v = q*q + q + 1; q is the largest whose v leaves sampled places names of MIN_NAME bytes.

1. Sampled places get a name, the hash of the bytes that follow, as far as all copies must agree.
   Names are sorted across the cluster; a place whose name occurs once is done, which replaces the
   recursion on names: what is left holds long repeats or is near one.
2. The other starts are merged in through their sampled place: a start is told by its distance to
   it, and each place left brings the bytes around it, v - 1 before and ``length`` after.
3. Within a name, starts of each distance are sorted by their whole ``length``-byte prefix, and
   neighbours are compared. Equal neighbours are repeats.

Texts are known by a 64-bit hash of their bytes, so copies of a text are one text, and a text of
``length`` bytes or more that occurs twice is removed as a whole. A name that very many different
surroundings share is dealt out anew by the hashes of whole prefixes, so no name needs one task.

Defined results: null text is empty; a text shorter than ``length`` loses nothing; null ids pass
through; rows with equal texts get equal results; further columns are ignored; matches never cross
documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.text import mix, raw, slices
from cohortwise.scratch import cut_lineage

LENGTH = 400
MIN_NAME = 64
#: Places compared at once, and places of one name beyond which it is dealt out by prefix hashes.
TOGETHER, ONE_NAME = 4_096, 32_768

_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(60_000_007).integers(1, 1 << 63, 256, dtype=np.uint64)


@cache
def difference_cover(q: int) -> tuple[int, tuple[int, ...]]:
    """v and a perfect difference cover modulo v of q + 1 residues, q a prime.

    The zeros of a sequence with a recurrence of degree three over the field of q elements lie at
    such residues if the sequence has full period.
    """
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, zeros = (0, 0, 1), []
                for i in range(v):
                    if x[0] == 0:
                        zeros.append(i)
                    x = (x[1], x[2], (a * x[2] + b * x[1] + c * x[0]) % q)
                if len(zeros) == q + 1 and len({(s - t) % v for s in zeros for t in zeros}) == v:
                    return v, tuple(zeros)
    raise ValueError(f"no cover for {q}")


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The widest cover whose names keep MIN_NAME bytes; for short strings every place."""
    primes = [q for q in range(2, 100) if all(q % p for p in range(2, q)) and length - (q * q + q + 1) + 1 >= MIN_NAME]
    return difference_cover(primes[-1]) if primes else (1, (0,))


@cache
def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.full(size, _BASE)
    steps[0] = 1
    powers = np.cumprod(steps, dtype=np.uint64)
    steps[1:] = _INVERSE
    return powers, np.cumprod(steps, dtype=np.uint64)


def window_hashes(data: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` bytes from each place (sorted), in parts of bounded size."""
    found, step = np.zeros(len(places), np.uint64), 1 << 20
    powers, inverses = _tables(step + width + 1)
    for lo in range(0, len(data), step):
        a, b = np.searchsorted(places, [lo, lo + step])
        if a == b:
            continue
        part = data[lo : lo + step + width]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[part] * powers[: len(part)], dtype=np.uint64)])
        at = places[a:b] - lo
        found[a:b] = (total[at + width] - total[at]) * inverses[at]
    return mix(found)


def texts(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, n_bytes and sha256 of each document's bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        "doc_id",
        F.xxhash64(text).alias("text_key"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text.cast("binary"), 256).alias("sha256"),
    )


def sampled_names(documents: DataFrame, length: int) -> DataFrame:
    """name, text_key, pos of the sampled places of all texts that are long enough."""
    v, cover = cover_for(length)
    width = length - v + 1

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()  # a task names each text once
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = raw(part.column("text"))
                keys, starts, owner = part.column("text_key").to_numpy(), [], []
                for k, key in enumerate(keys.tolist()):
                    n = int(bounds[k + 1] - bounds[k])
                    if n >= length and key not in met:
                        met.add(key)
                        periods = np.arange(0, n - width + 1, v)
                        places = (periods[:, None] + np.array(cover)[None, :]).ravel()
                        places = places[places <= n - width]
                        starts.append(places)
                        owner.append(np.full(len(places), k))
                if starts:
                    pos, k = np.concatenate(starts), np.concatenate(owner)
                    names = window_hashes(data, pos + bounds[k], width)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names.view(np.int64)), pa.array(keys[k]), pa.array(pos.astype(np.int32))],
                        names=["name", "text_key", "pos"],
                    )

    text = F.coalesce(F.col("text"), F.lit(""))
    long = documents.select(F.xxhash64(text).alias("text_key"), text.alias("text")).where(F.octet_length("text") >= length)
    return long.mapInArrow(sample, "name long, text_key long, pos int")


def repeated_names(names: DataFrame, length: int) -> DataFrame:
    """The places whose name stands at another place too.

    Places whose distance is a multiple of v share a name at every residue; one residue is enough
    for these, so names of one residue alone are kept for the first residue only.
    """
    v, cover = cover_for(length)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)  # the last name's places, which may go on
        open_name = None  # a name so frequent that its places go out as they come

        def out(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int32))], names=["name", "text_key", "pos"]
            )

        def chosen(rows: np.ndarray) -> np.ndarray:
            if not rows.shape[1]:
                return rows
            first = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
            size = np.diff(np.concatenate([first, [rows.shape[1]]]))
            residue = rows[2] % v
            low, high = np.minimum.reduceat(residue, first), np.maximum.reduceat(residue, first)
            return rows[:, np.repeat((size > 1) & ((low != high) | (low == cover[0])), size)]

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("name", "text_key", "pos")])
            rows = np.concatenate([held, rows], axis=1)
            same = (rows[:, 1:] == rows[:, :-1]).all(axis=0)
            rows = rows[:, np.concatenate([[True], ~same])] if rows.shape[1] else rows  # copies of a text
            if open_name is not None:
                going = int(np.searchsorted(rows[0], open_name, "right"))
                if going:
                    yield out(rows[:, :going])
                rows = rows[:, going:]
            if not rows.shape[1]:
                held = rows
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            done, held = chosen(rows[:, :last]), rows[:, last:]
            if done.shape[1]:
                yield out(done)
            if held.shape[1] > 1 << 20:
                open_name = held[0][0]
                yield out(held[:, :-1])
                held = held[:, -1:]
        if open_name is not None and held.shape[1] and held[0][0] == open_name:
            yield out(held)
        else:
            done = chosen(held)
            if done.shape[1]:
                yield out(done)

    dealt = names.repartition("name").sortWithinPartitions("name", "text_key", "pos")
    return dealt.mapInArrow(keep, "name long, text_key long, pos int")


def surroundings(held: DataFrame, length: int) -> DataFrame:
    """name, text_key, pos and the bytes around each place left."""
    v, _ = cover_for(length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for key, text, places in zip(
                    part.column("text_key").to_pylist(), part.column("text"), part.column("places").to_pylist(), strict=True
                ):
                    body = text.as_buffer().to_pybytes()
                    for place in places:
                        p = place["pos"]
                        out.append((place["name"], key, p, body[max(0, p - v + 1) : p], body[p : p + length]))
                for k in range(0, len(out), TOGETHER):
                    columns = list(zip(*out[k : k + TOGETHER], strict=True))
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                        names=["name", "text_key", "pos", "left", "right"],
                    )

    wanted = held.select("text_key", F.col("text").cast("binary").alias("text"), "places")
    return wanted.mapInArrow(cut, "name long, text_key long, pos int, left binary, right binary")


def _prefix_hashes(left: list[bytes], right: list[bytes], v: int, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each distance k: the places where a start k bytes before is inside its text and has
    ``length`` bytes, and the hash of these bytes."""
    n = len(left)
    before = np.frombuffer(b"".join(x.rjust(v - 1, b"\0") for x in left), np.uint8).reshape(n, v - 1)
    after = np.frombuffer(b"".join(x.ljust(length, b"\0") for x in right), np.uint8).reshape(n, length)
    powers, _ = _tables(length)
    value = np.zeros(n, np.uint64)
    for i in range(length):
        value += _VALUES[after[:, i]] * powers[i]
    room = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    for k in range(v):
        if k:
            value = (value - _VALUES[after[:, length - k]] * powers[length - 1]) * _BASE + _VALUES[before[:, v - 1 - k]]
        yield k, (room[0] >= k) & (room[1] >= length - k), mix(value)


def _repeated_starts(names: np.ndarray, left: list[bytes], right: list[bytes], v: int, length: int) -> np.ndarray:
    """places x distances: whether the start's prefix equals that of another place of its name."""
    n = len(names)
    found = np.zeros((n, v), dtype=bool)
    salt = mix(names.view(np.uint64))
    single = mix(np.arange(n, dtype=np.uint64) + np.uint64(0xABCDEF))
    for k, valid, value in _prefix_hashes(left, right, v, length):
        value = np.where(valid, value ^ salt, single)
        order = np.argsort(value)
        ordered = value[order]
        equal = ordered[1:] == ordered[:-1]  # adjacent prefixes
        found[order[1:][equal], k] = True
        found[order[:-1][equal], k] = True
    return found


def repeated_starts(around: DataFrame, length: int) -> DataFrame:
    """text_key, low, high: ranges of starts whose ``length`` bytes stand elsewhere too."""
    v, _ = cover_for(length)
    schema = "text_key long, low long, high long, prefix long"

    def ranges(keys, pos, found):
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, a = np.nonzero(edge == 1)
        _, b = np.nonzero(edge == -1)
        columns = [keys[row], pos[row] - b + 1, pos[row] - a]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c.astype(np.int64)) for c in columns), pa.nulls(len(row), pa.int64())],
            names=["text_key", "low", "high", "prefix"],
        )

    def every(keys, pos, left, right):
        for k, valid, value in _prefix_hashes(left, right, v, length):
            start = (pos - k)[valid].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[valid]), pa.array(start), pa.array(start), pa.array(value[valid].view(np.int64))],
                names=["text_key", "low", "high", "prefix"],
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None

        def work(batch):
            keys, pos = batch.column("text_key").to_numpy(), batch.column("pos").to_numpy().astype(np.int64)
            return keys, pos, batch.column("left").to_pylist(), batch.column("right").to_pylist()

        for batch in batches:
            batch = batch if held is None else pa.concat_batches([held, batch])
            # A text of many rows may bring a place several times.
            fields = [batch.column(c).to_numpy().astype(np.int64) for c in ("name", "text_key", "pos")]
            again = np.logical_and.reduce([f[1:] == f[:-1] for f in fields])
            batch = batch.filter(pa.array(np.concatenate([[True], ~again])[: batch.num_rows]))
            names = batch.column("name").to_numpy()
            if large is not None:  # a frequent name goes on
                going = int(np.searchsorted(names, large, "right"))
                for some in range(0, going, TOGETHER):
                    yield from every(*work(batch.slice(some, min(TOGETHER, going - some))))
                batch, names = batch.slice(going), names[going:]
            if not len(names):
                held = None
                continue
            at, last = 0, int(np.searchsorted(names, names[-1], "left"))
            while at < last:
                upto = int(np.searchsorted(names, names[min(at + TOGETHER, last) - 1], "right"))
                part = batch.slice(at, upto - at)
                keys, pos, left, right = work(part)
                yield ranges(keys, pos, _repeated_starts(names[at:upto], left, right, v, length))
                at = upto
            held = batch.slice(last)
            if held.num_rows > ONE_NAME:
                large = names[-1]
                for some in range(0, held.num_rows, TOGETHER):
                    yield from every(*work(held.slice(some, TOGETHER)))
                held = None
        if held is not None and held.num_rows:
            keys, pos, left, right = work(held)
            yield ranges(keys, pos, _repeated_starts(held.column("name").to_numpy(), left, right, v, length))

    dealt = around.repartition("name").sortWithinPartitions("name", "text_key", "pos")
    found = cut_lineage(dealt.mapInArrow(compare, schema))
    by_prefix = found.where("prefix is not null")
    place = F.struct("text_key", "low")
    twice = by_prefix.groupBy("prefix").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b").select("prefix")
    return (
        found.where("prefix is null")
        .select("text_key", "low", "high")
        .unionAll(by_prefix.join(twice, "prefix", "left_semi").select("text_key", "low", "high"))
    )


def _runs(low: np.ndarray, high: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that start within the ranges."""
    order = np.argsort(low)
    runs: list[list[int]] = []
    for a, b in zip(low[order].tolist(), (high[order] + length).tolist(), strict=True):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


def remove_repeats(documents: DataFrame, length: int = LENGTH, with_kept: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end), and
    with ``with_kept`` the bytes kept (null where the text loses nothing)."""
    known = cut_lineage(texts(documents))
    left = cut_lineage(repeated_names(sampled_names(documents, length), length))
    places = left.groupBy("text_key").agg(F.collect_list(F.struct("name", "pos")).alias("places"))
    one = known.groupBy("text_key").agg(F.min("doc_id").alias("one_id")).join(places, "text_key")
    one = one.withColumnRenamed("text_key", "one_key")
    text = F.coalesce(F.col("text"), F.lit(""))
    bodies = documents.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
    # One document of each text that has places left; ids spread the copies of a text.
    held = cut_lineage(
        bodies.join(one, (F.col("text_key") == F.col("one_key")) & F.col("doc_id").eqNullSafe(F.col("one_id"))).select(
            "text_key", "text", "places"
        )
    )
    starts = (
        repeated_starts(surroundings(held, length), length)
        .groupBy("text_key")
        .agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        schema = pa.schema(
            [("of_key", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", span), ("kept", pa.binary())]
        )
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for key, text, ranges in zip(
                    part.column("text_key").to_pylist(), part.column("text"), part.column("ranges").to_pylist(), strict=True
                ):
                    body = text.as_buffer().to_pybytes()
                    runs = _runs(np.array([r["low"] for r in ranges]), np.array([r["high"] for r in ranges]), length)
                    kept, at = [], 0
                    for a, b in runs:
                        kept.append(body[at:a])
                        at = b
                    rest = b"".join([*kept, body[at:]])
                    out.append(
                        {
                            "of_key": key,
                            "n_removed": len(body) - len(rest),
                            "n_spans": len(runs),
                            "kept_sha256": hashlib.sha256(rest).hexdigest(),
                            "spans": [{"start": a, "end": b} for a, b in runs],
                            "kept": rest if with_kept else None,
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, schema)

    body = held.select("text_key", F.col("text").cast("binary").alias("text")).join(starts, "text_key")
    result = body.select("text_key", "text", "ranges").mapInArrow(
        cut,
        "of_key long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary",
    )
    result = result.dropDuplicates(["of_key"])
    copies = (
        known.where(F.col("n_bytes") >= length).groupBy(F.col("text_key").alias("copied")).count().where("count > 1").select("copied")
    )
    joined = known.join(copies, F.col("text_key") == F.col("copied"), "left").join(
        result, F.col("text_key") == F.col("of_key"), "left"
    )
    whole = F.col("copied").isNotNull()
    zero = F.lit(0).cast("long")
    all_of_it = F.array(F.struct(zero.alias("start"), F.col("n_bytes").alias("end")))
    columns = [
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(whole, all_of_it).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>"))).alias("spans"),
    ]
    if with_kept:
        columns.append(F.when(whole, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept"))
    return joined.select(*columns)
