"""Language identification in two steps: the family first, then the language within it.

A text is its letters in lower case, with anything else as single blanks; its features are the
shares of its byte trigrams, folded into DIMENSIONS. One linear support vector machine per family
separates it from the others; the languages of the chosen family then vote by one machine per
pair. The machines learn from a bounded sample of the labelled rows, drawn by hash per language;
prediction goes over all texts, each whole, without a shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every
text if no labelled text can be learned from; with one language learned that one gets the score 1;
a language outside the table of families is a family of its own; rows without label, text or id
teach nothing; repeated rows get equal results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.llm.text import SEGMENT, raw, slices

DIMENSIONS = 1 << 13
#: Labelled rows learned from, per language and of all languages together.
SAMPLE_PER_LANGUAGE = 250
SAMPLE_ROWS = 2_000
FOLDS, HELD_OUT_FOLD = 4, 2
#: A text fits a language if the mean log share of its trigrams lies no more than REACH deviations
#: of one trigram below the language's own mean, and SHORT more by the root of its length.
REACH, SHORT = 2.0, 6.0
#: Least deviation, what is added to each trigram's count, places that count of one text, and
#: texts that a language needs for a limit of its own.
LEAST_DEVIATION, ADDED, LONGEST, LIMIT_TEXTS = 1.0, 0.1, 4096, 8
UNDETERMINED = "und"
# Languages by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fo", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "semitic": ("ar", "he", "mt", "am"),
    "indic": ("hi", "bn", "ur", "mr", "gu", "pa", "ne"),
    "sinitic": ("zh", "yue", "wuu"),
}

_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, family string"


def family(lang: str) -> str:
    return next((name for name, own in FAMILIES.items() if lang.split("-")[0].lower() in own), lang)


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT_FOLD) -> Column:
    """Whether the checksum of the id as text falls into a fold; null ids are in none."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each trigram place of all texts, and where each text's places begin and end."""
    data, bounds = raw(pc.utf8_lower(pc.fill_null(column, "")))
    lo = int(bounds[0])
    data, bounds = _LETTERS[data[lo : int(bounds[-1])]], bounds - lo
    blank = data == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    data = data[keep]
    bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
    if len(data) < 3:
        return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
    wide = data.astype(np.uint32)
    mixed = (wide[:-2] * np.uint32(0x01000193) ^ wide[1:-1] * np.uint32(0x9E3779B1) ^ wide[2:] * np.uint32(0x85EBCA6B))
    feature = ((mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)).astype(np.int32)
    # Trigrams across the border of two texts belong to neither.
    own = np.ones(len(feature), dtype=bool)
    for back in (1, 2):
        edge = bounds[1:-1] - back
        own[edge[(edge >= 0) & (edge < len(own))]] = False
    inside = np.concatenate([[0], np.cumsum(own)])
    return feature[own], inside[np.minimum(bounds, len(feature))]


def _sample(labelled: DataFrame, per_language: int, rows: int) -> DataFrame:
    """At most ``per_language`` rows of each language and ``rows`` in all, by a hash of the id."""
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()
    if not counts:
        return labelled
    cap = max(1, min(per_language, rows // len(counts)))
    place = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 40))
    # A little more than the cap passes by hash; the rest is ranked, so ranks see few rows.
    limit = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, 1.5 * cap / r["count"]) * (1 << 40)))])
    few = labelled.where(place < limit[F.col("lang")]).withColumn("place", place)
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    return few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def _shares(sample: DataFrame) -> list:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                feature, bounds = trigrams(part.column("text"))
                made = [
                    np.bincount(feature[a:b], minlength=DIMENSIONS).astype(np.float32) / np.float32(max(1, b - a))
                    for a, b in zip(bounds[:-1], bounds[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), pa.array([m.tobytes() for m in made], pa.binary()), pa.array(np.diff(bounds), pa.int64())],
                    names=["lang", "shares", "places"],
                )

    return sample.select("lang", "text").mapInArrow(count, "lang string, shares binary, places long").collect()


def learn_fit(shares: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Log shares of one language's trigrams, and for texts not learned from the usual mean of
    theirs and the usual deviation within a text; not a number with too few texts.

    Each half of the texts is held against the other half. Rows are in order of their shares, so
    copies of a text are in the same half.
    """
    weight = np.minimum(places, LONGEST).astype(np.float32)

    def logs(rows: slice) -> np.ndarray:
        count = (weight[rows] @ shares[rows]).astype(np.float64)
        return np.log((count + ADDED) / (count.sum() + ADDED * DIMENSIONS))

    half, mean, deviation = len(shares) // 2, [], []
    for learned, held in ((slice(0, half), slice(half, None)), (slice(half, None), slice(0, half))):
        own = logs(learned)
        first = shares[held] @ own.astype(np.float32)
        second = shares[held] @ np.square(own).astype(np.float32)
        some = places[held] > 0
        mean += first[some].tolist()
        deviation += np.sqrt(np.maximum(0, second - first * first))[some].tolist()
    if len(mean) < LIMIT_TEXTS:
        return logs(slice(None)), float("nan"), float("nan")
    return logs(slice(None)), float(np.median(mean)), max(LEAST_DEVIATION, float(np.median(deviation)))


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by dual coordinate descent; labels are +1 and -1,
    and 0 for rows of neither class. Classes weigh alike."""
    rows = np.flatnonzero(y)
    weight = {side: cost * len(rows) / (2 * max(1, (y == side).sum())) for side in (1, -1)}
    diagonal = np.where(y > 0, 0.5 / weight[1], 0.5 / weight[-1])
    norm = np.einsum("ij,ij->i", x, x) + 1.0 + diagonal
    alpha, w, bias = np.zeros(len(x)), np.zeros(x.shape[1]), 0.0
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(rows):
            gradient = y[i] * (x[i] @ w + bias) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - gradient / norm[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += step * x[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, float(bias)


@dataclass(frozen=True)
class Model:
    """Families against the rest and languages against each other, as columns of one matrix."""

    families: tuple[str, ...]
    languages: tuple[tuple[str, ...], ...]
    pairs: tuple[tuple[int, int, int], ...]
    weights: np.ndarray
    bias: np.ndarray
    #: Per language, in the order of ``languages``: log shares of trigrams, usual mean and deviation.
    logs: np.ndarray
    means: np.ndarray
    deviations: np.ndarray

    def fits(self, names: list[str], feature: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether each text is as likely as texts of the language named for it usually are."""
        at = {name: k for k, name in enumerate(name for own in self.languages for name in own)}
        if not at:
            return np.zeros(len(names), dtype=bool)
        own, places = np.array([at.get(name, -1) for name in names], np.int64), np.diff(bounds)
        total = np.concatenate([[0.0], np.cumsum(self.logs[np.repeat(own, places), feature], dtype=np.float64)])
        mean = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(1, places)
        least = self.means[own] - self.deviations[own] * (REACH + SHORT / np.sqrt(np.maximum(1, places)))
        return (own >= 0) & ((places == 0) | ~(mean < least))

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, list[str | None]]:
        return self.label(column, *trigrams(column))

    def label(self, column: pa.Array, feature: np.ndarray, bounds: np.ndarray) -> tuple[list[str], np.ndarray, list[str | None]]:
        n = len(bounds) - 1
        margin = np.zeros((n, len(self.bias)))
        for c in range(len(self.bias)):
            total = np.concatenate([[0.0], np.cumsum(self.weights[c][feature], dtype=np.float64)])
            margin[:, c] = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(1, np.diff(bounds))
        sure = 1 / (1 + np.exp(-2 * (margin + self.bias)))
        letters = pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)
        names, score, kin = [UNDETERMINED] * n, np.zeros(n), [None] * n
        if not self.families:
            return names, score, kin
        single = len(self.families) == 1
        best = np.zeros(n, int) if single else np.argmax(sure[:, : len(self.families)], axis=1)
        for f, own in enumerate(self.languages):
            rows = np.flatnonzero(letters & (best == f))
            votes, trust = np.zeros((len(rows), len(own))), np.ones((len(rows), len(own)))
            for column_at, (g, a, b) in enumerate(self.pairs, 0 if single else len(self.families)):
                if g == f:
                    p = sure[rows, column_at]
                    votes[:, a] += (p >= 0.5) + 1e-3 * p
                    votes[:, b] += (p < 0.5) + 1e-3 * (1 - p)
                    trust[:, a], trust[:, b] = np.minimum(trust[:, a], p), np.minimum(trust[:, b], 1 - p)
            chosen = np.argmax(votes, axis=1)
            certain = trust[np.arange(len(rows)), chosen]
            score[rows] = certain if single else np.minimum(certain, sure[rows, f])
            for row, k in zip(rows.tolist(), chosen.tolist(), strict=True):
                names[row], kin[row] = own[k], self.families[f]
        return names, score, kin


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from (doc_id, text, lang); at most ``rows`` feature rows reach the driver."""
    usable = labelled.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    got = _shares(_sample(usable, per_language, rows))
    got.sort(key=lambda r: (r["lang"], bytes(r["shares"])))  # the same model whatever the order
    lang = np.array([r["lang"] for r in got], dtype=object)
    x = np.frombuffer(b"".join(r["shares"] for r in got), np.float32).reshape(len(got), DIMENSIONS)
    places = np.array([r["places"] for r in got], np.int64)
    del got
    scale = 1.0 / max(1e-12, float(np.sqrt(np.einsum("ij,ij->i", x, x)).mean())) if len(x) else 1.0
    kin = np.array([family(v) for v in lang], dtype=object)
    families = tuple(sorted(set(kin)))
    languages = tuple(tuple(sorted(set(lang[kin == f]))) for f in families)
    found = [learn_fit(x[lang == name], places[lang == name]) for own in languages for name in own]
    logs = np.array([own for own, _, _ in found], dtype=np.float32).reshape(len(found), DIMENSIONS)
    means, deviations = np.array([m for _, m, _ in found]), np.array([d for _, _, d in found])
    x = x * np.float32(scale)
    columns: list[tuple[np.ndarray, float]] = []
    if len(families) > 1:
        columns += [train_svm(x, np.where(kin == f, 1.0, -1.0)) for f in families]
    pairs = []
    for f, own in enumerate(languages):
        for a, b in combinations(range(len(own)), 2):
            columns.append(train_svm(x, (lang == own[a]) * 1.0 - (lang == own[b]) * 1.0))
            pairs.append((f, a, b))
    weights = np.array([w * scale for w, _ in columns], dtype=np.float32).reshape(len(columns), DIMENSIONS)
    bias = np.array([b for _, b in columns], dtype=np.float64)
    return Model(families, languages, tuple(pairs), weights, bias, logs, means, deviations)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and family of every document, by its text alone."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS per machine

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                names, score, kin = shared.value.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(kin, pa.string())],
                    names=["doc_id", "held_out", "lang_pred", "score", "family"],
                )

    rows = documents.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(label, PREDICTED)


def identify(documents: DataFrame) -> DataFrame:
    """Learn from the folds that are not held out, then label every document."""
    return predict(documents, fit(documents.where(~held_out(F.col("doc_id")))))


def keep_identified(documents: DataFrame) -> DataFrame:
    """The documents whose language is recognised, with all their columns.

    Rejected: texts without letters, and texts whose trigrams are far less likely in the language
    chosen for them than those of its labelled texts. The limit is each language's own, whatever
    the others are. Texts too short for a trigram stay, and so do those of a language with fewer
    than LIMIT_TEXTS labelled texts in the sample.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(documents.where(~held_out(F.col("doc_id")))))
    schema = documents.schema

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SEGMENT):
                feature, bounds = trigrams(part.column("text"))
                names, _, _ = model.value.label(part.column("text"), feature, bounds)
                good = np.array([name != UNDETERMINED for name in names], dtype=bool)
                yield part.filter(pa.array(good & model.value.fits(names, feature, bounds)))

    return documents.mapInArrow(select, schema)
