"""Personal data: base patterns, and identifiers that bootstrapped contexts discover.

Base matches are e-mail and IP addresses, payment cards and phone numbers, found by rules alone.
They seed the bootstrapping: each one's neighbouring words form lexical patterns, and every other
token that looks like an identifier (holds a digit or @) and stands in such a context is an
instance. Patterns and instances make a graph that Spark scores in turns: a pattern is as good as
the share of its instances that are known, an instance as good as the patterns it stands in (noisy
or). What ends above a limit is an identifier of its pattern's kind, and all its places are added.
Base matches always stay.

The graph's edges are distinct (pattern, instance) rows, aggregated before they are shuffled, so a
pattern or an instance in a third of all documents is one row per task. Places of one document
meet in one row, as its text does.

Defined results: null text counts as empty; a null id is an id of its own; rows equal in id and
text get equal results; spans of different kinds may overlap; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.llm.text import SEGMENT, slices
from cohortwise.scratch import cut_lineage

# Kinds in the order that results list them, and their patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Longest token that can be an identifier, and the shortest.
LONGEST, SHORTEST = 64, 5
#: Distinct seeds a pattern needs, and what counts as good.
SUPPORT = 4
PATTERN_SCORE, INSTANCE_SCORE = 0.6, 0.8
TURNS = 3

MARK = re.compile(r"[0-9@]")
EDGE = "\"'`.,;:!?()[]{}<>«»“”‘’|*#$%&="
FOUND = (
    "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "base array<struct<start:int,kind:int,end:int>>, "
    "seen array<struct<start:int,end:int,kind:int,instance:string,patterns:array<string>>>"
)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, found from each @ so that long runs cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        match = DOMAIN.match(text, at + 1)
        if match:
            start = at
            while start > done and LOCAL.match(text, start - 1, start):
                start -= 1
            if start < at:
                yield start, match.end()
                done = match.end()
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all base matches in order."""
    if not MARK.search(text):
        return []
    spans = [(a, 0, b) for a, b in emails(text)]
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            spans.append((m.start(), 2, m.end()))
    spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(spans)


def _word(token: str) -> str:
    return re.sub("[0-9]+", "0", token.strip(EDGE).lower())


def _context(text: str, start: int, end: int) -> list[str]:
    """Patterns of a place: its two words before, and the word on either side."""
    left = [_word(w) for w in text[max(0, start - 100) : start].split()[-2:]]
    right = [_word(w) for w in text[end : end + 50].split()[:1]]
    found = []
    if len(left) == 2 and all(left):
        found.append(f"{left[0]} {left[1]} _")
    if left and right and left[-1] and right[0]:
        found.append(f"{left[-1]} _ {right[0]}")
    return found


def _tokens(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like tokens clear of the base spans."""
    at, k, reach = 0, 0, 0
    while match := MARK.search(text, at):
        place = match.start()
        start = place
        while start > at and place - start <= LONGEST and not text[start - 1].isspace():
            start -= 1
        end = place + 1
        while end < len(text) and end - place <= LONGEST and not text[end].isspace():
            end += 1
        at = end
        token = text[start:end]
        lead = len(token) - len(token.lstrip(EDGE))
        start, end = start + lead, start + len(token.rstrip(EDGE))
        while k < len(spans) and spans[k][0] < end:
            reach = max(reach, spans[k][2])
            k += 1
        if SHORTEST <= end - start <= LONGEST and reach <= start:
            yield start, end


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def mentions(documents: DataFrame) -> DataFrame:
    """Per row: base spans, their counts and digest, and all places with their patterns."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), ("row", pa.int64())]
            + [(f"n_{k}", pa.int64()) for k in KINDS]
            + [
                ("base_sha256", pa.string()),
                ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))),
                (
                    "seen",
                    pa.list_(
                        pa.struct(
                            [
                                ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()),
                                ("instance", pa.string()), ("patterns", pa.list_(pa.string())),
                            ]
                        )
                    ),
                ),
            ]
        )
        for batch in batches:
            for part in slices(batch, "text", SEGMENT):
                out = []
                for doc_id, key, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    spans = base_spans(text)
                    made = {"doc_id": doc_id, "row": key, "base_sha256": hashlib.sha256(render(spans).encode()).hexdigest()}
                    made["base"] = [{"start": a, "kind": k, "end": b} for a, k, b in spans]
                    for number, kind in enumerate(KINDS):
                        made[f"n_{kind}"] = sum(k == number for _, k, _ in spans)
                    places = [(a, b, k) for a, k, b in spans] + [(a, b, None) for a, b in _tokens(text, spans)]
                    made["seen"] = [
                        {"start": a, "end": b, "kind": k, "instance": text[a:b].lower(), "patterns": _context(text, a, b)}
                        for a, b, k in places
                    ]
                    out.append(made)
                yield pa.RecordBatch.from_pylist(out, schema)

    return keyed(documents).mapInArrow(search, FOUND)


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long"), row_key(F.col("doc_id"), text).alias("row"), text.alias("text"))


def bootstrap(edges: DataFrame, turns: int = TURNS) -> DataFrame:
    """Instances found beside the seeds: instance, kind, score.

    ``edges``: distinct (pattern, instance, kind), the kind null for what is not a seed.
    """
    seeds = edges.where("kind is not null").select("instance", "kind").distinct()
    # Patterns with enough seeds, and instances that stand in one of them, make the whole graph.
    lexical = edges.where("kind is not null").groupBy("pattern").agg(F.countDistinct("instance").alias("n")).where(F.col("n") >= SUPPORT)
    graph = cut_lineage(edges.join(lexical.select("pattern"), "pattern", "left_semi"))
    known = cut_lineage(seeds.withColumn("score", F.lit(1.0)))
    unseen = graph.where("kind is null").select("pattern", "instance").distinct()
    unseen = unseen.join(seeds.select("instance").distinct(), "instance", "left_anti")
    size = graph.groupBy("pattern").agg(F.countDistinct("instance").alias("size"))
    found = None
    best_kind = Window.partitionBy("instance").orderBy(F.desc("score"), "kind")
    for _ in range(turns):
        trust = graph.select("pattern", "instance").distinct().join(known, "instance")
        patterns = (
            trust.groupBy("pattern", "kind")
            .agg(F.sum("score").alias("right"), F.count(F.lit(1)).alias("n"))
            .join(size, "pattern")
            .withColumn("trust", F.col("right") / (F.col("size") + 1))
            .where((F.col("trust") >= PATTERN_SCORE) & (F.col("n") >= SUPPORT))
        )
        scored = (
            unseen.join(patterns.select("pattern", "kind", "trust"), "pattern")
            .groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score"))
        )
        # An instance in patterns of several kinds is what they trust most; few rows each.
        found = cut_lineage(
            scored.where(F.col("score") >= INSTANCE_SCORE)
            .withColumn("place", F.row_number().over(best_kind))
            .where("place = 1")
            .select("instance", "kind", "score")
        )
        known = seeds.withColumn("score", F.lit(1.0)).unionByName(found)
    return found


def discovered(held: DataFrame, turns: int = TURNS) -> DataFrame:
    """Places that the bootstrapping adds, per row: doc_id, row, added (start, kind, end)."""
    places = held.select("doc_id", "row", F.explode("seen").alias("p")).select("doc_id", "row", "p.*")
    edges = places.select(F.explode("patterns").alias("pattern"), "instance", "kind").distinct()
    found = bootstrap(edges, turns).select(F.col("instance"), F.col("kind").alias("as_kind"))
    spans = places.where("kind is null").join(found, "instance")
    return spans.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", F.col("as_kind").alias("kind"), "end")).alias("added"))


def _as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def find(documents: DataFrame, turns: int = TURNS) -> DataFrame:
    """Per document: counts and digest of the base matches, and all spans as text."""
    held = cut_lineage(mentions(documents))
    more = discovered(held, turns).withColumnsRenamed({"doc_id": "of_doc", "row": "of_row"})
    joined = held.join(more, (F.col("row") == F.col("of_row")) & F.col("doc_id").eqNullSafe(F.col("of_doc")), "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.array_union("base", "added")))
    return joined.select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256",
        _as_text(spans).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"),
    )


def redact(documents: DataFrame, turns: int = TURNS) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; all other columns stay.

    A null text stays null. Overlapping spans are replaced as one, by the kind of the first.
    """
    held = cut_lineage(mentions(documents).select("doc_id", "row", "seen"))
    more = discovered(held, turns).select(F.col("doc_id").alias("_pii_doc"), F.col("row").alias("_pii_row"), F.col("added").alias("_pii_added"))
    text = F.coalesce(F.col("text"), F.lit(""))
    same = (row_key(F.col("doc_id").cast("long"), text) == F.col("_pii_row")) & F.col("doc_id").eqNullSafe(F.col("_pii_doc"))
    joined = documents.join(more, same, "left").drop("_pii_doc", "_pii_row")
    schema = documents.schema

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SEGMENT):
                texts, added, at = part.column("text").to_pylist(), part.column("_pii_added").to_pylist(), part.schema.get_field_index("text")
                for k, body in enumerate(texts):
                    if body is not None:
                        more = [(s["start"], s["kind"], s["end"]) for s in added[k] or ()]
                        texts[k] = _masked(body, sorted(base_spans(body) + more))
                part = part.set_column(at, part.schema.field(at), pa.array(texts, part.column(at).type))
                yield part.select([f.name for f in schema.fields])

    return joined.mapInArrow(replace, schema)


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]]) if spans else text
