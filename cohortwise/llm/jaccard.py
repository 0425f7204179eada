"""Exact n-gram Jaccard join by set relations, and the classes of linked documents.

A document is the set of its distinct word shingles; two link when their sets' Jaccard similarity
reaches a threshold. Equal sets are one set from the start. Sets are ordered by one global order
of shingles (rarest first, as far as counted, then by hash), and a set's first shingles, its
prefix, index it: two sets that link share one of them. An index list keeps its entries by size
and position, so that whole blocks whose position rules out the needed overlap are skipped.

Answers come from similar sets' answers before any list is joined within itself: in each turn
every list names a leader, its other entries are compared with the leader alone, and those that
reach the threshold join the leader's class. From then on they inherit the leader's links: entries
of one class are never compared with each other, and a list all of whose entries are in one class
is skipped as a whole. A leader reaches what is close to it; so in further turns every list is put
in an order of its own by the bits of its entries' sketches, where similar sets come to lie side by
side, and neighbours of different classes are compared, as long as such turns find links. The last
step compares what the lists still hold of different classes, pair by pair, so no link between two
classes is lost. A group of near copies costs as many comparisons as it has members, not pairs, and
a pair of the last step leaves from the first list that both its sets are in: entries carry the
shingles just before theirs, and two entries that have one of these in common have met before.

Pairs are first held against parity sketches: the number of bits in which two sketches differ is
never more than the number of shingles in which the sets do, so a pair whose sketches differ too
much cannot link. Whole sets are read from the documents again for the pairs left.

Shingles are 64-bit hashes, and so are the keys of sets: two different sets have the same key with
probability 2**-64.

Defined results: without words the set is empty and linked with nothing, the component is the
document's own id; a text of fewer words than a shingle is one shingle; null ids are members of
their component but never its name, which is null if it has no other; documents with equal ids
and different texts are different sets; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cohortwise.llm.components import components
from cohortwise.llm.text import mix, raw, shingles, slices, words
from cohortwise.scratch import cut_lineage, shuffles_dropped

SHINGLE = 4
PERCENT = 85
#: Shingles that this many prefixes hold move to the end of the order, the most frequent ones up
#: to FREQUENT of them. The order decides the work, never the result.
OFTEN = 12
FREQUENT = 1 << 17
#: Turns before the last step, and those of them that name leaders; those of neighbours end early
#: where less than one in LINKING pairs links. This decides the work, never the result.
TURNS = 6
LEADERS = 1
LINKING = 20
#: Shingles before its own that an entry of the last step carries.
BEFORE = 2
#: Bytes of text whose words and sets a task holds at a time, one text at least.
SLICE = 1 << 18
#: Bytes of a mark that order a list.
ORDERING = 8
#: Bits of a sketch, a power of two.
SKETCH = 1 << 10
#: Ids that may be broadcast to pick documents; more are joined by a shuffle.
PICKED = 1 << 20


def needed_overlap(size_a, size_b, percent: int):
    """Least intersection of linked sets: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def set_key(hashes: np.ndarray) -> int:
    return int(mix(np.array([mix(hashes).sum(dtype=np.uint64) + np.uint64(len(hashes))]))[0].view(np.int64))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return slices(batch, "text", SLICE)


def _sets(part: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    hashes, first = words(*raw(part.column("text")))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(shingles(hashes[a:b], size))


def sketch(own: np.ndarray) -> bytes:
    """Parities of the numbers of shingles per bucket."""
    bucket = (own >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=SKETCH) & 1).astype(bool)).tobytes()


def mark(whole: bytes) -> bytes:
    """A sketch of a quarter of the bits, by which neighbours in a list are found."""
    return np.bitwise_xor.reduce(np.frombuffer(whole, np.uint64).reshape(4, -1)).tobytes()


def prefixes(documents: DataFrame, size: int, percent: int, often: np.ndarray) -> DataFrame:
    """doc_id, set_key, n_shingles, sketch, mark, prefix: the set's first shingles in the order.

    Sketch, mark and prefix are null where the task has given them for an equal set before.
    ``often``: rows (shingle, place), sorted by shingle; the place is the order among them.
    """
    shared = documents.sparkSession.sparkContext.broadcast(often)  # at most FREQUENT rows

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, place = shared.value
        met: set[int] = set()
        for batch in batches:
            for part in _parts(batch):
                keys, sizes, sketches, firsts = [], [], [], []
                for own in _sets(part, size):
                    key = set_key(own)
                    keys.append(key)
                    sizes.append(len(own))
                    if key in met or not len(own):
                        sketches.append(None)
                        firsts.append(None)
                        continue
                    met.add(key)
                    sketches.append(sketch(own))
                    if len(late):
                        at = np.minimum(np.searchsorted(late, own), len(late) - 1)
                        listed = late[at] == own
                        if listed.any():
                            own_late = np.flatnonzero(listed)
                            own_late = own_late[np.argsort(place[at[own_late]])]
                            own = np.concatenate([own[~listed], own[own_late]])
                    firsts.append(own[: prefix_length(len(own), percent)].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(keys, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(sketches, pa.binary()),
                        pa.array([x and mark(x) for x in sketches], pa.binary()),
                        pa.array(firsts, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "set_key", "n_shingles", "sketch", "mark", "prefix"],
                )

    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(index, "doc_id long, set_key long, n_shingles long, sketch binary, mark binary, prefix array<long>")


def frequent_shingles(documents: DataFrame, size: int, percent: int) -> np.ndarray:
    """The FREQUENT shingles that most prefixes by hash hold, at least OFTEN, with their place by
    count. A task counts equal sets once."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for part in _parts(batch):
                found = []
                for own in _sets(part, size):
                    key = set_key(own)
                    if len(own) and key not in met:
                        met.add(key)
                        found.append(own[: prefix_length(len(own), percent)])
                if found:
                    shingle, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    counts = documents.select("text").mapInArrow(first, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = cut_lineage(counts.where(F.col("n") >= OFTEN)).orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    shingle = top.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shingle)
    place = len(shingle) - order  # the most frequent last
    return np.stack([shingle[order], place.astype(np.uint64)])


def index_lists(held: DataFrame) -> DataFrame:
    """Entries (shingle, set_key, n, pos) of all lists with two sets or more."""
    entries = held.where("prefix is not null").select(
        "set_key", F.col("n_shingles").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "shingle")
    )

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the previous batch's last entry and whether it went out
        for batch in batches:
            shingle, key = batch.column("shingle").to_numpy(), batch.column("set_key").to_numpy()
            new = np.ones(len(shingle), dtype=bool)
            new[1:] = (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1])
            if last is not None and len(new):
                new[0] = (last[0].column("shingle")[0].as_py(), last[0].column("set_key")[0].as_py()) != (shingle[0], key[0])
            batch = batch.filter(pa.array(new))  # sets that several tasks have met
            if not batch.num_rows:
                continue
            shingle = shingle[new]
            same = shingle[1:] == shingle[:-1]
            keep = np.zeros(len(shingle), dtype=bool)
            keep[1:] |= same
            keep[:-1] |= same
            if last is not None and last[0].column("shingle")[0].as_py() == shingle[0]:
                keep[0] = True
                if not last[1]:
                    yield last[0]
            last = (batch.slice(batch.num_rows - 1), bool(keep[-1]))
            yield batch.filter(pa.array(keep))

    dealt = entries.repartition("shingle").sortWithinPartitions("shingle", "set_key")
    return dealt.select("shingle", "set_key", "n", "pos").mapInArrow(shared, "shingle long, set_key long, n int, pos int")


def may_link(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column, percent: int) -> Column:
    """Whether sizes and positions of a shared shingle leave room for the overlap."""
    small, large = F.least(n_a, n_b), F.greatest(n_a, n_b)
    need = F.ceil(F.lit(percent) * (n_a + n_b) / F.lit(100 + percent))
    return (100 * small >= percent * large) & (F.least(pos_a, pos_b) + F.least(n_a - pos_a, n_b - pos_b) >= need)


def leaders_pairs(lists: DataFrame, classes: DataFrame, turn: int, percent: int) -> DataFrame:
    """Entries with their list's leader of this turn, where their classes differ."""
    # Lists fall into ranges of sizes, so a leader's size is close to those of its entries.
    span = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 0.5 * (turn % 2)).cast("int")
    entries = lists.join(classes, "set_key").withColumn("span", span)
    lead = (
        entries.groupBy("shingle", "span")
        .agg(
            F.min_by(
                F.struct(F.col("set_key").alias("lead"), F.col("n").alias("lead_n"), F.col("pos").alias("lead_pos"), F.col("class").alias("lead_class")),
                F.xxhash64(F.lit(turn), "class", "set_key"),
            ).alias("l"),
            F.min("class").alias("low"),
            F.max("class").alias("high"),
        )
        .where("low < high")
        .select("shingle", "span", "l.*")
    )
    met = entries.join(lead, ["shingle", "span"]).where(F.col("class") != F.col("lead_class"))
    met = met.where(may_link(F.col("n"), F.col("pos"), F.col("lead_n"), F.col("lead_pos"), percent))
    return met.select(F.least("set_key", "lead").alias("a"), F.greatest("set_key", "lead").alias("b")).distinct()


def neighbours_pairs(lists: DataFrame, classes: DataFrame, turn: int, percent: int) -> DataFrame:
    """Entries with the entry before them in their list, where their classes differ. A list has an
    order of its own in each turn: by some bytes of the marks, from one on that hashing names.
    ``classes``: set_key, class, mark."""
    entries = lists.join(classes, "set_key")
    first = F.pmod(F.xxhash64(F.lit(turn), "shingle"), F.lit(SKETCH // 32)).cast("int") + 1
    turned = entries.select("shingle", "set_key", "n", "pos", "class", F.substr(F.concat("mark", "mark"), first, F.lit(ORDERING)).alias("bits"))
    order = Window.partitionBy("shingle").orderBy("bits", "set_key")
    own = F.struct(F.col("set_key").alias("near"), F.col("n").alias("near_n"), F.col("pos").alias("near_pos"), F.col("class").alias("near_class"))
    met = turned.select("set_key", "n", "pos", "class", F.lag(own).over(order).alias("l")).select("*", "l.*")
    met = met.where(F.col("class") != F.col("near_class"))
    met = met.where(may_link(F.col("n"), F.col("pos"), F.col("near_n"), F.col("near_pos"), percent))
    return met.select(F.least("set_key", "near").alias("a"), F.greatest("set_key", "near").alias("b")).distinct()


def remaining_pairs(lists: DataFrame, classes: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """All pairs of different classes that lists of several classes still hold and whose marks
    are close enough. ``marks``: set_key, mark. A quarter of a sketch has fewer bits than large sets
    that link may differ in, so every pair of such sets would leave; whole sketches tell them apart.

    Entries of different classes that meet in a list meet in every list they share, as no such
    list is of one class. So one that finds a shingle before its own in both leaves the pair to
    that list, and the first list of all that they share finds none.
    """
    entries = lists.join(classes.select("set_key", "class"), "set_key")
    mixed = entries.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    left = entries.join(mixed.select("shingle"), "shingle")
    just_before = Window.partitionBy("set_key").orderBy("pos").rowsBetween(-BEFORE, -1)
    left = left.withColumn("before", F.collect_list("shingle").over(just_before)).join(marks, "set_key")
    left = left.repartition("shingle").sortWithinPartitions("shingle", "n", "pos")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # entries of the open list that later, larger ones may link with
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("shingle", "set_key", "n", "pos", "class")])
            found = []
            for column, bits, before in zip(own.T, batch.column("mark").to_pylist(), batch.column("before").to_pylist(), strict=True):
                shingle, key, n, pos, cls = column
                bits, before = int.from_bytes(bits, "little"), frozenset(before)
                if held is None or held[0] != shingle:
                    held = (shingle, BlockList(percent))
                found.append(held[1].probe(key, n, pos, cls, bits, before))
                held[1].add(key, n, pos, cls, bits, before)
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            if len(pairs):
                pairs = np.unique(np.sort(pairs, axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    wanted = left.select("shingle", "set_key", "n", "pos", "class", "mark", "before")
    return wanted.mapInArrow(meet, "a long, b long")


class BlockList:
    """A list's entries in blocks of one size and class, by position: a probe takes the sizes in
    reach, leaves out its own class as a whole, and of each block reads the entries up to the
    position that still leaves the needed overlap. Entries with one of ``before`` in common have
    met in another list."""

    def __init__(self, percent: int):
        self.percent = percent
        self.blocks: dict[int, dict[int, list[tuple[int, int, int, frozenset[int]]]]] = {}

    def add(self, key: int, n: int, pos: int, cls: int, bits: int = 0, before: frozenset[int] = frozenset()) -> None:
        self.blocks.setdefault(int(n), {}).setdefault(int(cls), []).append((int(pos), int(key), bits, before))

    def probe(self, key: int, n: int, pos: int, cls: int, bits: int = 0, before: frozenset[int] = frozenset()) -> np.ndarray:
        key, n, pos, cls = int(key), int(n), int(pos), int(cls)
        found = []
        for size in [s for s in self.blocks if 100 * s < self.percent * n]:
            del self.blocks[size]  # entries come by size, so these are too small for all to come
        for size, classes in self.blocks.items():
            need = needed_overlap(size, n, self.percent)
            apart = size + n - 2 * need
            for other_class, block in classes.items():
                if other_class == cls:
                    continue
                for at, other, its, earlier in block:  # by position, as they came
                    if min(at, pos) + min(size - at, n - pos) < need:
                        if at > pos:
                            break  # further ones leave even less
                        continue
                    if other != key and (bits ^ its).bit_count() <= apart and before.isdisjoint(earlier):
                        found.append((other, key))
        return np.array(found, np.int64).reshape(len(found), 2)


def close_sketches(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches differ in no more bits than linked sets may differ in shingles."""
    own = sketches.select("set_key", "n_shingles", "sketch")
    left = own.withColumnsRenamed({"set_key": "a", "n_shingles": "n_a", "sketch": "s_a"})
    right = own.withColumnsRenamed({"set_key": "b", "n_shingles": "n_b", "sketch": "s_b"})

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64) for c in ("s_a", "s_b"))
                apart = np.bitwise_count(x ^ y).reshape(batch.num_rows, -1).sum(axis=1, dtype=np.int64)
                n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                close = apart <= n_a + n_b - 2 * needed_overlap(n_a, n_b, percent)
                yield batch.select(["a", "b"]).filter(pa.array(close))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return both.mapInArrow(test, "a long, b long")


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact test of pairs: a, b of those that link. ``sets``: set_key, shingles."""
    left = pairs.join(sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("left")), "a")
    both = left.join(sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("right")), "b")
    shared = F.size(F.array_intersect("left", "right"))
    apart = F.size("left") + F.size("right")
    return both.where(100 * shared >= percent * (apart - shared)).select("a", "b").distinct()


def whole_sets(documents: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The shingles of wanted sets (set_key, one_id of a document that has the set).

    A repeated id may bring a set twice, or one that is not wanted.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                own = list(_sets(part, size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_key(x) for x in own], pa.int64()), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))],
                    names=["set_key", "shingles"],
                )

    ids = cut_lineage(wanted.select("one_id").distinct())
    if ids.count() <= PICKED:
        ids = F.broadcast(ids)
    few = documents.select(F.col("doc_id").cast("long"), "text").join(ids, F.col("doc_id").eqNullSafe(F.col("one_id")), "left_semi")
    return few.select("text").mapInArrow(read, "set_key long, shingles array<long>")


def linked_sets(documents: DataFrame, held: DataFrame, size: int, percent: int) -> DataFrame:
    """set_key, class: the least set key that links reach, for sets that share any prefix."""
    lists = cut_lineage(index_lists(held))
    known = (
        held.where("n_shingles > 0")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("one_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch", ignorenulls=True).alias("sketch"), F.first("mark", ignorenulls=True).alias("mark"))
    )
    known = cut_lineage(known.join(lists.select("set_key").distinct(), "set_key", "left_semi"))
    classes = cut_lineage(known.select("set_key", F.col("set_key").alias("class"), "mark"))
    tried = None
    turn = 0
    while turn <= TURNS:
        last = turn == TURNS
        if last:
            pairs = remaining_pairs(lists, classes, known.select("set_key", F.col("sketch").alias("mark")), percent).distinct()
        elif turn < LEADERS:
            pairs = leaders_pairs(lists, classes, turn, percent)
        else:
            pairs = neighbours_pairs(lists, classes, turn, percent)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs)
        close = cut_lineage(close_sketches(pairs, known, percent))
        ends = close.select(F.col("a").alias("set_key")).unionAll(close.select(F.col("b").alias("set_key"))).distinct()
        bodies = cut_lineage(whole_sets(documents, known.join(ends, "set_key"), size))
        links = cut_lineage(compare(close, bodies, percent))
        between = (
            links.join(classes.select(F.col("set_key").alias("a"), F.col("class").alias("class_a")), "a")
            .join(classes.select(F.col("set_key").alias("b"), F.col("class").alias("class_b")), "b")
            .select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
        )
        joined = components(between)
        classes = cut_lineage(
            classes.join(joined.withColumnsRenamed({"node": "class", "component": "merged"}), "class", "left").select(
                "set_key", F.coalesce("merged", "class").alias("class"), "mark"
            )
        )
        tried = pairs if tried is None else tried.unionAll(pairs)
        few = LEADERS <= turn < TURNS and links.count() * LINKING < pairs.count()
        turn = TURNS if few else turn + 1
    return classes.drop("mark")


def classify(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, set_key (equal sets have equal keys)."""
    with shuffles_dropped(documents.sparkSession):
        often = frequent_shingles(documents, size, percent)
        held = cut_lineage(prefixes(documents, size, percent, often))
        classes = linked_sets(documents, held, size, percent)
    members = held.select("doc_id", "set_key", "n_shingles")
    named = members.join(classes, "set_key", "left").withColumn(
        "class", F.when(F.col("n_shingles") > 0, F.coalesce("class", "set_key"))
    )
    names = named.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return named.join(names, "class", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "set_key",
        "class",
    )


def one_per_class(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents without all but one of each class, with all their columns.

    The least id stays, any id before none; of rows equal in id and set one stays. Documents
    without words are in no class and stay.
    """
    rows = cut_lineage(classify(documents, size, percent).where("n_shingles > 0"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "set_key")
    stays = rows.groupBy("class").agg(F.min(order).alias("s")).select(F.col("s.doc_id").alias("doc_id"), F.col("s.set_key").alias("set_key"))
    stays = stays.withColumnsRenamed({"doc_id": "stay_id", "set_key": "stay_key"})
    same = (F.col("set_key") == F.col("stay_key")) & F.col("doc_id").eqNullSafe(F.col("stay_id"))
    marked = rows.join(stays, same, "left")
    gone = marked.where("stay_key is null").select(F.col("doc_id").alias("gone_id"), F.col("set_key").alias("gone_key")).distinct()
    twins = (
        marked.where("stay_key is not null")
        .groupBy(F.col("doc_id").alias("twin_id"), F.col("set_key").alias("twin_key"))
        .count()
        .where("count > 1")
        .drop("count")
    )
    name = "_set_key"
    keyed = with_set_keys(documents, size, name)
    left = keyed.join(gone, (F.col(name) == F.col("gone_key")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
    is_twin = (F.col(name) == F.col("twin_key")) & F.col("doc_id").eqNullSafe(F.col("twin_id"))
    # Equal rows that stay are few; only these are told apart by a shuffle of their own.
    twin = left.join(twins, is_twin, "left_semi").dropDuplicates(["doc_id", name])
    return left.join(twins, is_twin, "left_anti").unionAll(twin).drop(name)


def with_set_keys(documents: DataFrame, size: int, name: str) -> DataFrame:
    schema = StructType([*documents.schema.fields, StructField(name, LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                keys = pa.array([set_key(x) if len(x) else None for x in _sets(part, size)], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, keys], names=[*part.schema.names, name])

    return documents.mapInArrow(add, schema)
