"""Reading numbers and missing values out of typed or text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- Fixed values: texts that mean "no value". ----
# Compared after trimming and lower-casing.
MISSING_TOKENS = ("", "na", "nan", "null", "none", "n/a")
# Exact cell texts that a CSV reader takes as missing.
CSV_MISSING_CELLS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
# ---- End of fixed values. ----

# Unicode white space, as one trim set: a set trim stays cheaper than a regular expression.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

_PADDING = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*+"
_INTEGER = "[+-]?[0-9]+"
_DECIMAL = r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))"


def named(column: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def data_type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _starts_in(text: Column, characters: str) -> Column:
    return F.contains(F.lit(characters), F.substring(text, 1, 1))


def _ends_in(text: Column, characters: str) -> Column:
    return F.contains(F.lit(characters), F.substring(text, -1, 1))


def strip(text: Column) -> Column:
    """Text without white space around it; a look at both ends spares most texts the trim."""
    padded = _starts_in(text, WHITESPACE) | _ends_in(text, WHITESPACE)
    return F.when(padded, F.btrim(text, F.lit(WHITESPACE))).otherwise(text)


def nan_to_null(number: Column) -> Column:
    return F.when(~F.isnan(number), number)


def finite(number: Column) -> Column:
    """True for an ordinary number; NaN sorts above infinity, and null stays null."""
    return F.abs(number) < F.lit(float("inf"))


def _parse(text: Column, pattern: str, kind: str) -> Column:
    """A text of the pattern, with or without white space around it, as the type, else null.

    Patterns keep the code of a parse short: a table's columns make one method of them, and the JVM
    does not compile a method that is too long. Most texts are bare and spared the trim.
    """
    padded = F.btrim(text, F.lit(WHITESPACE)).try_cast(kind)
    return F.when(text.rlike(rf"\A{pattern}\z"), text.try_cast(kind)).when(
        text.rlike(rf"\A{_PADDING}{pattern}{_PADDING}\z"), padded
    )


def parse_number(text: Column) -> Column:
    """Double written in a text, else null.

    try_cast alone would also take Java forms such as "1d" or "0x1p3", and is slow on texts
    that are no numbers. The pattern rules both out.
    """
    return _parse(text, _DECIMAL, "double")


def parse_integer(text: Column) -> Column:
    """64-bit integer written in a text, else null."""
    return _parse(text, _INTEGER, "bigint")


def missing_text(text: Column) -> Column:
    """True for null or a token that means missing."""
    return text.isNull() | F.lower(strip(text)).isin(*MISSING_TOKENS)


def missing(df: DataFrame, column: str) -> Column:
    """True where a column of any type holds no value."""
    value, kind = named(column), data_type(df, column)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return value.isNull() | F.isnan(value)
    if is_numeric(kind) or isinstance(kind, T.BooleanType):
        return value.isNull()
    return missing_text(value.cast("string"))


def as_number(df: DataFrame, column: str) -> Column:
    """Double view of a column; text that is no number, and NaN, become null."""
    value, kind = named(column), data_type(df, column)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return nan_to_null(value.cast("double"))
    if is_numeric(kind) or isinstance(kind, T.BooleanType):
        return value.cast("double")
    return parse_number(value.cast("string"))


def as_key_text(df: DataFrame, column: str) -> Column:
    """Text of a grouping key as it appears in cohort labels."""
    text = named(column).cast("string")
    return F.initcap(text) if isinstance(data_type(df, column), T.BooleanType) else text
