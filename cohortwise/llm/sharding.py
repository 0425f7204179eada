"""Shards of near-equal bytes by sampled splitters.

Every record draws sample points in proportion to its size: one for each whole part of the total that
it fills, and one more with the chance of what is left over. Quantiles of the points, in key order,
are the splitters; they cut the records into ranges of about equal bytes, several for each shard.
Ranges are then measured, and the overfull ones draw points of their own and are subdivided, until
none is overfull that holds more than one record. The last part of a key is the number of the record,
so a key that a third of all records share is cut as well.

Ranges lie in key order, so a record's bytes before it are those of the ranges before, a table of a
row per range, and of the records before it in its own range. They put it in the shard where its
middle byte falls, which leaves shards apart by one record at most; places in a shard follow in the
same way from counts. All of it is built-in functions, and what travels is the key and two numbers.

Defined results: a null text has no bytes and a key of its own before all others; empty texts have
size ``OVERHEAD``; repeated rows have a slot each; a null id comes first among equal texts; further
columns are ignored by ``shard_documents`` and kept by ``place``; no records give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.scratch import cut_lineage

SHARDS = 24
#: Bytes that a record takes besides its text.
OVERHEAD = 8
#: Ranges: some for each shard, more with the records, fewer for few records, and a bound for the plan.
RANGES_PER_SHARD, RECORDS_PER_RANGE, LEAST_RECORDS, MOST_RANGES = 16, 100_000, 16, 4096
#: Sample points for each range.
POINTS = 32
#: A range is overfull with more than this many times its share of the bytes or records.
OVERFULL = 2
#: Turns of subdividing; what is left after them is no more than uneven work for tasks.
TURNS = 4


def _points(size: Column, whole: Column, points: Column, turn: int) -> Column:
    """Sample points of a record: its size in shares of a point, rounded by a hash of its number."""
    share = size / whole * points
    chance = F.pmod(F.xxhash64(F.lit(turn), "row"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.floor(share + chance).cast("long")


def _search(borders: Sequence[tuple], key: T.StructType) -> Column:
    """How many of the sorted borders are at most the key, by halving steps over a literal array."""
    if not borders:
        return F.lit(0)
    written = json.dumps([dict(zip(key.names, border, strict=True)) for border in borders])
    array = F.from_json(F.lit(written), T.ArrayType(key))  # a literal once the plan is folded
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(borders).bit_length()))])

    def step(at: Column, width: Column) -> Column:
        reach = at + width
        return F.when((reach <= len(borders)) & (F.get(array, reach - 1) <= F.col("key")), reach).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _splitters(points: DataFrame, group: Sequence[str] = ()) -> set[tuple]:
    """Every POINTS-th sample point in key order, per group; a record of several is one splitter."""
    order = Window.partitionBy(*(group or [F.lit(0)])).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    upto = points.withColumn("upto", F.sum("n").over(order))
    chosen = upto.where(F.floor(F.col("upto") / POINTS) > F.floor((F.col("upto") - F.col("n")) / POINTS))
    return {tuple(r["key"]) for r in chosen.select("key").collect()}


def _sorted(borders: set[tuple]) -> list[tuple]:
    """Nulls first, as Spark orders them."""
    return sorted(borders, key=lambda border: [(part is not None, 0 if part is None else part) for part in border])


def ranges(keyed: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, int]:
    """Records with their range, the measured ranges, and all bytes.

    Splitters and overfull ranges reach the driver, ``MOST_RANGES`` and a few times that at most; so
    many ranges times ``POINTS`` sampled keys are ordered in one task.
    """
    whole = keyed.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records")).first()
    total, records = whole["bytes"] or 0, whole["records"]
    count = min(MOST_RANGES, max(shards * RANGES_PER_SHARD, records // RECORDS_PER_RANGE), records // LEAST_RECORDS + 1)
    limits = [max(1, -(-OVERFULL * n // count)) for n in (total, records)]
    borders: set[tuple] = set()
    sample = keyed.select("key", _points(F.col("size"), F.lit(max(1, total)), F.lit(count * POINTS), 0).alias("n"))
    found = _splitters(sample.where("n > 0"))
    for turn in range(1, TURNS + 1):
        borders |= found
        ranged = keyed.withColumn("range", _search(_sorted(borders), keyed.schema["key"].dataType))
        measured = cut_lineage(ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records")))
        fill = F.greatest(F.col("bytes") / limits[0], F.col("records") / limits[1])
        over = measured.where((fill > 1) & (F.col("records") > 1)).select("range", "bytes", F.ceil(fill * OVERFULL).alias("parts"))
        if turn == TURNS or over.isEmpty():
            break
        # A row per overfull range.
        sized = ranged.join(F.broadcast(over), "range")
        sample = sized.select("range", "key", _points(F.col("size"), F.col("bytes"), F.col("parts") * POINTS, turn).alias("n"))
        found = _splitters(sample.where("n > 0"), ["range"])
        if found <= borders:
            break
    return ranged, measured, total


def place(records: DataFrame, key: Sequence[Column], size: Column, shards: int = SHARDS) -> DataFrame:
    """The records with ``shard`` and ``slot``: shards follow the key's order, have near-equal sums
    of ``size`` (whole numbers above 0), and slots count from 0 in each. Columns of these two names
    are replaced, all others kept. The key's columns are text or whole numbers.
    """
    numbered = records.select(F.struct("*").alias("record"), *[k.alias(f"p{i}") for i, k in enumerate(key)], size.cast("long").alias("size"))
    parts = [f"p{i}" for i in range(len(key))]
    row = F.monotonically_increasing_id()
    # Written once: a record's number holds from here on.
    keyed = cut_lineage(numbered.select("record", "size", row.alias("row"), F.struct(*parts, row.alias(f"p{len(key)}")).alias("key")))
    ranged, measured, total = ranges(keyed, shards)
    # A row per range, some thousand at most, so one task may order them.
    earlier = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = measured.select(
        "range",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("records").over(earlier), F.lit(0)).alias("records_before"),
    )
    inside = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.select(
        "record",
        "size",
        "range",
        F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("own_bytes"),
        F.count(F.lit(1)).over(inside).alias("own_records"),
    ).join(F.broadcast(starts), "range")
    middle = (F.col("own_bytes") + F.col("bytes_before")) * 2 + F.col("size")
    ranked = cut_lineage(
        summed.select("record", middle.alias("middle"), (F.col("own_records") + F.col("records_before")).alias("rank")).select(
            "record", "rank", F.least(F.lit(shards - 1), F.expr(f"({shards} * middle) div {2 * max(1, total)}")).cast("int").alias("shard")
        )
    )
    first = ranked.groupBy("shard").agg(F.min("rank").alias("first"))  # a row per shard
    kept = [F.col("record").getField(c).alias(c) for c in records.columns if c.lower() not in ("shard", "slot")]
    return ranked.join(F.broadcast(first), "shard").select(*kept, "shard", (F.col("rank") - F.col("first")).alias("slot"))


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def text_key(text: Column) -> Column:
    """Equal texts lie together, and different ones in no order that a source could skew."""
    return F.md5(text.cast("binary"))


def shard_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Each document's size, checksum, shard and slot, without its text."""
    text = F.col("text")
    narrow = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        text_key(text).alias("text_key"),
    )
    placed = place(narrow, [F.col("text_key"), F.col("doc_id")], F.col("size"), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS, rows_per_file: int = 1_000_000) -> None:
    """Whole documents in folders shard=0, 1, ...; a file holds a run of slots in order."""
    placed = place(documents, [text_key(F.col("text")), F.col("doc_id")], size_of(F.col("text")), shards)
    run = F.expr(f"slot div {rows_per_file}")
    dealt = placed.withColumn("__run", run).repartition("shard", "__run").sortWithinPartitions("shard", "slot")
    dealt.drop("__run").write.partitionBy("shard").parquet(path)
