"""Cohort labels and names: building, splitting, and spotting personal data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortwise.contracts import LABEL_SEPARATOR, NULL_KEY_TEXT
from cohortwise.functions.values import strip

# ---- Fixed values: what counts as personal data, and the masks put in its place. ----
SENSITIVE_TERMS = (
    "policy",
    "policy_number",
    "name",
    "dob",
    "birth",
    "ssn",
    "email",
    "phone",
    "address",
    "zip",
    "postal",
    "member",
    "applicant",
    "insured",
    "id",
    "number",
    "account",
    "certificate",
)
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE_PATTERN = r"^\+?[\d\s().-]{7,}$"
SSN_PATTERN = r"^\d{3}-?\d{2}-?\d{4}$"

#: What every such value holds: the sign of an address, or seven characters of a number in a row.
SENSITIVE_TRACE = r"@|[\d\s().-]{7}"

WORD_BORDER = "(?<=[a-z0-9])(?=[A-Z])"
NO_WORD = "[^A-Za-z0-9]+"

MASKED_LABEL = "[masked cohort label]"
MASKED_DIMENSION = "[masked dimension]"
MASKED_COLUMN = "[masked column]"
MASKED_VALUE = "[masked value]"

PARSE_WARNING = "dimension_parse_warning"
SENSITIVE_REASON = "sensitive_or_disallowed_dimension"
LOW_VOLUME_REASON = "low_volume"
FILTER_WARNING = "sensitive_filter_masked"
# ---- End of fixed values. ----

# Java classes such as \d and \s cover all of Unicode only with this flag.
UNICODE = "(?U)"


def summary_slug(columns: Sequence[str]) -> str:
    """File-system safe name of a grouping, in the order given."""
    words = ("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in c.lower()) for c in columns)
    return "_".join(" ".join(words).split()) or "all"


def dimension_tokens(name: Column) -> Column:
    """Lower-case words of a column name, plus all of them joined by underscores."""
    spaced = F.regexp_replace(name, WORD_BORDER, "_")
    words = F.transform(
        F.filter(F.split(spaced, NO_WORD), lambda w: w != ""), lambda w: F.lower(w)
    )
    joined = F.when(F.size(words) > 0, F.array(F.array_join(words, "_"))).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_union(words, joined)


def sensitive_dimension(name: Column) -> Column:
    """True for a column name that holds one of the sensitive words."""
    terms = F.array(*[F.lit(t) for t in SENSITIVE_TERMS])
    return F.arrays_overlap(dimension_tokens(name), terms)


def sensitive_value(text: Column) -> Column:
    """True for text that looks like an e-mail address, a phone or a social security number."""
    bare = strip(text)
    email = F.contains(bare, F.lit("@")) & bare.rlike(UNICODE + EMAIL_PATTERN)
    # A number needs seven characters; every SSN_PATTERN text also meets PHONE_PATTERN.
    number = (F.length(bare) >= 7) & bare.rlike(UNICODE + PHONE_PATTERN)
    return F.coalesce(email | number, F.lit(False))


def may_hold_sensitive_value(text: Column) -> Column:
    """False only for a text none of whose words is a ``sensitive_value``: one search that spares
    most long texts a look at each word."""
    return F.coalesce(text.rlike(UNICODE + SENSITIVE_TRACE), F.lit(False))


def _label_pieces(label: Column) -> Column:
    text = F.coalesce(label, F.lit(NULL_KEY_TEXT))
    separator = "".join("\\" + ch if ch == "|" else ch for ch in LABEL_SEPARATOR)
    return F.split(text, separator, -1)


def _piece(piece: Column) -> Column:
    split_at = F.instr(piece, "=")
    return F.struct(
        strip(F.substring(piece, F.lit(1), split_at - 1)).alias("column"),
        strip(F.substring(piece, split_at + 1, F.length(piece))).alias("value"),
        (split_at > 0).alias("split"),
    )


def _usable(piece: Column) -> Column:
    return piece["split"] & (piece["column"] != "")


def parse_label(label: Column) -> Column:
    """The (column, value) pairs of a cohort label; parts without a column name are left out."""
    pieces = F.transform(_label_pieces(label), _piece)
    return F.transform(
        F.filter(pieces, _usable),
        lambda p: F.struct(p["column"].alias("column"), p["value"].alias("value")),
    )


def parse_warnings(label: Column) -> Column:
    """Number of label parts that name no column."""
    pieces = F.transform(_label_pieces(label), _piece)
    return F.size(F.filter(pieces, lambda p: ~_usable(p)))
