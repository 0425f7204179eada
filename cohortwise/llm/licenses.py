"""License scan: ordered signature rules over normalised words, in built-in functions only.

A document's words are the runs of characters outside ASCII punctuation, blanks and controls,
with A-Z in lower case. Rules are regular expressions over those words joined by single spaces.
A rule runs only on documents that hold its keyword. Every detection has an interval of words; a
detection inside another one of higher priority (or of equal priority and greater length, or the
same interval with an earlier rule) is suppressed, so the most specific statement names the
license.

Defined results: null text counts as empty text and has no detection; rows that are equal in id
and text get equal results; a null id is an id of its own; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What parts words, and the phrases and labels that results must carry.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}


#: Every match of every rule holds one of these; other texts are not normalised at all.
ANCHORS = ("licen", "permission", "redistribut", "unencumbered", "warranty")


@dataclass(frozen=True)
class Rule:
    """A signature; the pattern sees lower-case words parted by one space."""

    rule_id: str
    label: str
    priority: int
    keyword: str
    pattern: str
    confidence: float


#: label, the license's name as words, a keyword every match holds, and the name's form in tags.
FAMILIES = (
    ("mit", "(?:mit|expat)(?: x11)?", "mit", "mit"),
    ("apache", "apache(?: software)?", "apache", "apache 2 0"),
    ("gpl", "gnu (?:general public|gpl)", "gnu", "gpl [123] 0(?: only| or later)?"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public", "general", "lgpl [23] [01](?: only| or later)?"),
    ("agpl", "(?:gnu )?affero general public", "affero", "agpl [13] 0(?: only| or later)?"),
    ("fdl", "gnu free documentation", "documentation", "gfdl 1 [123](?: only| or later)?"),
    ("bsd", "(?:(?:new|modified|simplified|revised|original|[234] clause) )?bsd", "bsd", "bsd [0234] clause"),
    ("mpl", "mozilla public", "mozilla", "mpl [12] [01]"),
    ("epl", "eclipse public", "eclipse", "epl [12] 0"),
    ("eupl", "european union public", "european", "eupl 1 [012]"),
    ("cddl", "common development and distribution", "distribution", "cddl 1 [01]"),
    ("cpl", "common public", "common", "cpl 1 0"),
    ("cpal", "common public attribution", "attribution", "cpal 1 0"),
    ("isc", "isc", "isc", "isc"),
    ("zlib", "zlib(?: libpng)?", "zlib", "zlib"),
    ("boost", "boost software", "boost", "bsl 1 0"),
    ("artistic", "(?:clarified )?artistic", "artistic", "artistic [12] 0"),
    ("cc-by", "creative commons attribution(?: international)?", "commons", "cc by [1234] [05]"),
    ("cc-by-sa", "creative commons attribution share ?alike", "commons", "cc by sa [1234] [05]"),
    ("cc-by-nc", "creative commons attribution non ?commercial", "commons", "cc by nc [1234] [05]"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s?", "commons", "cc by nd [1234] [05]"),
    ("cc0", "creative commons (?:zero|cc0)", "commons", "cc0 1 0"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "do what the fuck you want to public", "fuck", "wtfpl"),
    ("odbl", "open database", "database", "odbl 1 0"),
    ("psf", "python software foundation", "python", "psf 2 0"),
    ("php", "php", "php", "php 3 0[01]?"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("ofl", "(?:sil )?open font", "font", "ofl 1 [01]"),
    ("ms-pl", "microsoft public", "microsoft", "ms pl"),
    ("ms-rl", "microsoft reciprocal", "microsoft", "ms rl"),
    ("upl", "universal permissive", "universal", "upl 1 0"),
    ("ncsa", "university of illinois(?: ncsa)?(?: open source)?", "illinois", "ncsa"),
    ("w3c", "w3c(?: software)?", "w3c", "w3c"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("bsl", "business source", "business", "busl 1 1"),
    ("elastic", "elastic", "elastic", "elastic 2 0"),
    ("sspl", "server side public", "server", "sspl 1 0"),
)
VERSION = "(?: (?:v|version) ?[0-9](?: [0-9])?| [0-9] [0-9])?"
LICENSE = "(?:licen[sc]e|licence)"
#: form, priority, confidence, pattern around a family's name
FORMS = (
    ("grant", 5, 0.99, "permission is (?:hereby )?granted under the (?:terms of the )?{name} {license}{version}"),
    ("terms", 5, 0.98, "under the terms (?:and conditions )?of the {name} {license}{version}"),
    ("licensed", 4, 0.97, "(?:licensed|released|distributed|available|published) under (?:the |an? )?{name} {license}{version}"),
    ("subject", 4, 0.95, "(?:subject to|governed by|covered by|according to) (?:the )?{name} {license}{version}"),
    ("copy", 3, 0.9, "copy of the {name} {license}{version}"),
    ("versioned", 2, 0.85, "{name} {license} (?:v|version) ?[0-9](?: [0-9])?"),
    ("named", 1, 0.7, "{name} {license}"),
)
NOTICES = (
    Rule("notice-mit", "mit", 6, "charge", "permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    Rule("notice-bsd", "bsd", 6, "redistributions", "redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice", 1.0),
    Rule("notice-isc", "isc", 6, "permission", "permission to use copy modify and or distribute this software for any purpose", 1.0),
    Rule("notice-zlib", "zlib", 6, "implied", "this software is provided as is without any express or implied warranty in no event", 1.0),
    Rule("notice-gpl", "gpl", 6, "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    Rule("notice-lgpl", "lgpl", 6, "redistribute", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 1.0),
    Rule("notice-unlicense", "unlicense", 6, "unencumbered", "this is free and unencumbered software released into the public domain", 1.0),
)


def rules() -> tuple[Rule, ...]:
    """The signature rules: notices, tags, and each family in each form of statement."""
    made = list(NOTICES)
    for label, name, keyword, tag in FAMILIES:
        made.append(Rule(f"tag-{label}", label, 6, "spdx", f"spdx license identifier {tag}", 1.0))
        for form, priority, confidence, shape in FORMS:
            pattern = shape.format(name=name, license=LICENSE, version=VERSION)
            made.append(Rule(f"{form}-{label}", label, priority, keyword, pattern, confidence))
    return tuple(made)


def normal(text: Column) -> Column:
    """Lower-case words with one space before, between and after them; one space for none."""
    words = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), SEPARATORS, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def detections(documents: DataFrame, signatures: tuple[Rule, ...] | None = None) -> DataFrame:
    """Every detection: doc_id, row (hash of id and text), rule_id, label, priority, confidence,
    first_word, last_word, kept (not suppressed by a containing detection).

    Matches of the rules given must hold one of ANCHORS.
    """
    signatures = signatures or rules()
    gate = "(?i)" + "|".join(ANCHORS)
    body = F.coalesce("text", F.lit(""))
    gated = (
        documents.select("doc_id", body.alias("text"))
        .where(F.col("text").rlike(gate))
        .select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"), normal(F.col("text")).alias("words"))
        .dropDuplicates(["doc_id", "row"])
    )
    table = F.array(
        *[
            F.struct(
                F.lit(r.rule_id).alias("rule_id"),
                F.lit(r.label).alias("label"),
                F.lit(r.priority).alias("priority"),
                F.lit(r.confidence).alias("confidence"),
                F.lit(r.keyword).alias("keyword"),
                F.lit(f"(?<= ){r.pattern}(?= )").alias("pattern"),
            )
            for r in signatures
        ]
    )
    tried = gated.withColumn("rule", F.explode(F.filter(table, lambda r: F.contains(F.col("words"), r["keyword"]))))
    pattern = F.col("rule.pattern")
    hit = (
        tried.withColumn("hits", F.regexp_extract_all("words", pattern, F.lit(0)))
        .where(F.size("hits") > 0)
        .withColumn("gaps", F.split("words", pattern))
        .select("doc_id", "row", "rule", F.posexplode(F.arrays_zip("gaps", "hits")).alias("at", "part"))
        .where(F.col("part.hits").isNotNull())
        .select(
            "doc_id", "row", "rule.rule_id", "rule.label", "rule.priority", "rule.confidence", "at",
            spaces(F.col("part.gaps")).alias("gap"),
            spaces(F.col("part.hits")).alias("more"),
        )
    )
    in_order = Window.partitionBy("doc_id", "row", "rule_id").orderBy("at")
    # A hit's first word: the spaces of all gaps so far and of the hits before it, less the leading one.
    spans = hit.withColumn(
        "first_word", F.sum(F.col("gap") + F.col("more")).over(in_order) - F.col("more") - 1
    ).withColumn("last_word", F.col("first_word") + F.col("more"))
    outer = Window.partitionBy("doc_id", "row").orderBy(
        "first_word", F.desc("last_word"), F.desc("priority"), "rule_id"
    )
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    # Containers stand before what they hold in this order; one pass per priority finds them.
    levels = sorted({r.priority for r in signatures})
    inside = F.lit(False)
    for level in levels:
        reach = F.max(F.when(F.col("priority") >= level, F.col("last_word"))).over(before)
        inside = inside | ((F.col("priority") == level) & F.coalesce(reach >= F.col("last_word"), F.lit(False)))
    return spans.withColumn("kept", ~inside).drop("at", "gap", "more")


def base_places(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, row, n_words, n_base, first_word, last_word, base_labels (array)."""
    text = F.coalesce("text", F.lit(""))
    parted = documents.select(
        "doc_id",
        text.alias("text"),
        F.regexp_replace(F.concat(text, F.lit(" ")), SEPARATORS, " ").alias("parted"),
    )
    start = parted.select(
        "doc_id",
        row_key(F.col("doc_id"), F.col("text")).alias("row"),
        # One space follows each word; a text that starts with separators has one more.
        (spaces(F.col("parted")) - F.startswith("parted", F.lit(" ")).cast("int")).cast("long").alias("n_words"),
        # Only texts with a phrase's last word are normalised.
        F.when(F.col("text").rlike("(?i)license"), normal(F.col("text"))).alias("words"),
    )
    found = {p: F.regexp_count("words", F.lit(f" {p}(?= )")) for p in BASE}
    firsts = [F.when(n > 0, spaces(F.substring_index("words", f" {p} ", 1))) for p, n in found.items()]
    lasts = [
        F.when(n > 0, spaces(F.col("words")) - spaces(F.substring_index("words", f" {p} ", -1)) - p.count(" ") - 2)
        for p, n in found.items()
    ]
    labels = [F.when(n > 0, F.lit(BASE[p])) for p, n in found.items()]
    return start.select(
        "doc_id",
        "row",
        "n_words",
        F.coalesce(sum(found.values()), F.lit(0)).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base_labels"),
    )


def scan(documents: DataFrame, signatures: tuple[Rule, ...] | None = None) -> DataFrame:
    """Per document: base places, the labels of all detections kept, and the best confidence."""
    kept = (
        detections(documents, signatures)
        .where("kept")
        .groupBy("doc_id", "row")
        .agg(
            F.collect_set("label").alias("found"),
            F.max("confidence").alias("best"),
            F.count(F.lit(1)).alias("n_detections"),
        )
        .withColumnRenamed("doc_id", "of")
        .withColumnRenamed("row", "of_row")
    )
    base = base_places(documents)
    joined = base.join(kept, (F.col("row") == F.col("of_row")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("found", none)))
    has_base = F.when(F.col("n_base") > 0, F.lit(0.7)).otherwise(F.lit(0.0))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base_labels")), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), has_base).alias("score"),
        F.coalesce("n_detections", F.lit(0)).cast("long").alias("n_detections"),
    )
