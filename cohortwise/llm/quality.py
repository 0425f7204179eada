"""Quality rules with thresholds learned per language and source, in built-in functions only.

Words are runs of characters other than blank, tab and line ends. Fixed base rules fail texts
that are too short or repeat themselves. The other limits come from the corpus: KLL sketches of
each measure are built per language and source, merged into a language's and the whole corpus's
sketch, and a limit lies a number of interquartile ranges outside the quartiles of the most
specific sketch with enough documents. Sketches are partial sums, so a source with a third of all
rows costs no more than others.

Defined results: null text counts as empty text (no words, base_failed); a null language or
source is a group of its own; a null id passes through; repeated rows get equal results; further
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.scratch import cut_lineage

BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Documents that a group's sketch needs to speak for itself.
GROUP_ROWS = 200
#: Interquartile ranges beyond a quartile, and the least width counted as such a range.
RANGES = 6.0
#: measure: (sides that are bad, least interquartile range)
MEASURES = {
    "symbol_share": ("high", 0.01),
    "dup_line_share": ("high", 0.02),
    "repeat_excess": ("high", 0.02),
    "word_length": ("both", 0.4),
}


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def features(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each row."""
    text = F.coalesce("text", F.lit(""))
    split = documents.select(
        "doc_id",
        "lang",
        "source",
        F.length(F.translate(text, BLANK_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.filter(F.split(text, BLANKS, -1), lambda x: x != "").alias("words"),
    )
    word = F.col("words")
    windows = split.select(
        "doc_id",
        "lang",
        "source",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("words").cast("long").alias("n_words"),
        F.when(
            F.size("words") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("words") - 3),
                lambda i: F.xxhash64(word[i], word[i + 1], word[i + 2]),
            ),
        ).alias("hashes"),
    )
    # Texts without a repeated window end here; the others sort (hash, place) pairs.
    repeated = windows.withColumn(
        "pairs",
        F.when(
            F.size(F.array_distinct("hashes")) < F.size("hashes"),
            F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("hashes")
    # A pair whose neighbour has its hash is a window found twice or more.
    size = F.size("pairs")
    follows = F.zip_with(
        F.slice("pairs", F.lit(1), size - 1),
        F.slice("pairs", F.lit(2), size - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    places = F.sort_array(F.array_distinct(F.flatten(F.array_compact(follows))))
    placed = repeated.withColumn("places", F.when(F.col("pairs").isNotNull(), places)).drop("pairs")
    # A window adds the words that the next one does not hold, three at most.
    size = F.size("places")
    added = F.zip_with(
        F.slice("places", F.lit(1), size - 1),
        F.slice("places", F.lit(2), size - 1),
        lambda a, b: F.least(b - a, F.lit(3)),
    )
    covered = F.when(size > 0, F.aggregate(added, F.lit(3), lambda total, x: total + x)).otherwise(F.lit(0))
    return placed.withColumn("n_repeat_words", covered.cast("long")).drop("places")


def with_measures(counts: DataFrame) -> DataFrame:
    """Base verdict and the measures that get learned limits.

    Longer texts repeat more word windows by chance, so the repeat measure is what exceeds a
    share that grows with the logarithm of the text's length.
    """
    n = F.col("n_words")
    chance = 0.03 * F.log2(F.greatest(n / 100.0, F.lit(1.0)))
    return counts.withColumns(
        {
            "base_failed": (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n),
            "symbol_share": _share(F.col("n_symbols"), F.col("word_chars")),
            "dup_line_share": _share(F.col("n_dup_lines"), F.col("n_lines")),
            "repeat_excess": F.greatest(_share(F.col("n_repeat_words"), n) - chance, F.lit(0.0)),
            "word_length": _share(F.col("word_chars"), n),
        }
    )


def thresholds(measured: DataFrame) -> DataFrame:
    """Limits per language and source from mergeable sketches of documents that pass the base
    rules: lang, source, and low_* / high_* for each measure."""
    passed = measured.where(~F.col("base_failed"))
    cell = cut_lineage(
        passed.groupBy("lang", "source").agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.kll_sketch_agg_double(m).alias(m) for m in MEASURES],
        )
    )
    merged = [F.sum("rows").alias("rows"), *[F.kll_merge_agg_double(m).alias(m) for m in MEASURES]]

    def quartiles(sketches: DataFrame, prefix: str) -> DataFrame:
        ranks = F.array(F.lit(0.25), F.lit(0.75))
        found = {
            f"{prefix}_{m}": F.when(F.col("rows") > 0, F.kll_sketch_get_quantile_double(F.col(m), ranks))
            for m in MEASURES
        }
        return sketches.withColumns(found).withColumnRenamed("rows", f"{prefix}_rows").drop(*MEASURES)

    by_cell = quartiles(cell, "cell")
    by_lang = quartiles(cell.groupBy("lang").agg(*merged), "lang").withColumnRenamed("lang", "of_lang")
    overall = quartiles(cell.agg(*merged), "all").first()  # one row of quartiles
    levels = by_cell.join(by_lang, F.col("lang").eqNullSafe(F.col("of_lang")), "left")
    limits = {}
    for m, (sides, width) in MEASURES.items():
        q = (
            F.when(F.col("cell_rows") >= GROUP_ROWS, F.col(f"cell_{m}"))
            .when(F.col("lang_rows") >= GROUP_ROWS, F.col(f"lang_{m}"))
            .otherwise(F.array(*[F.lit(x).cast("double") for x in overall[f"all_{m}"] or (None, None)]))
        )
        reach = RANGES * F.greatest(q[1] - q[0], F.lit(width))
        limits[f"high_{m}"] = q[1] + reach
        if sides == "both":
            limits[f"low_{m}"] = q[0] - reach
    return levels.select("lang", "source", *[c.alias(k) for k, c in limits.items()])


def judge(documents: DataFrame) -> DataFrame:
    """One row per document: counts, base verdict, learned verdict (kept), and failed_rules."""
    measured = cut_lineage(with_measures(features(documents)))
    limits = thresholds(measured).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = measured.join(
        limits,
        F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")),
        "left",
    )
    fails = []
    for m, (sides, _) in MEASURES.items():
        fails.append(F.when(F.col(m) > F.col(f"high_{m}"), F.lit(m)))
        if sides == "both":
            fails.append(F.when(F.col(m) < F.col(f"low_{m}"), F.lit(m)))
    bad = [f.isNotNull() for f in fails]
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~reduce(lambda a, b: a | b, bad)).alias("kept"),
        F.array_compact(F.array(*fails)).alias("failed_rules"),
    )
