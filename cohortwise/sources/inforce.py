"""In-force sources: CSV and Parquet in, typed columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.contracts import MEASURES
from cohortwise.functions.values import (
    CSV_MISSING_CELLS,
    as_number,
    data_type,
    named,
    nan_to_null,
)
from cohortwise.scratch import new_table_path
from cohortwise.sources.landing import Landed, land, read_landed

FORMATS = ("csv", "parquet")


def source_format(path: str) -> str:
    """Format that a path's suffix names."""
    tail = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = tail.rsplit(".", 1)[-1].lower() if "." in tail else ""
    if suffix not in FORMATS:
        raise ValueError(f"Cannot read {path!r}: the suffix must be .csv or .parquet.")
    return suffix


BAD_RECORD = "_bad_record"


def _csv_text(spark: SparkSession, path: str, *, multi_line: bool = False, strict: bool = True) -> DataFrame:
    """Cells as text. A record with more or fewer cells than the header stops the read, and so
    does a file whose header differs; ``strict=False`` keeps such records in BAD_RECORD instead.
    """
    plain = {"header": True, "quote": '"', "escape": '"', "multiLine": multi_line}
    names = spark.read.csv(path, inferSchema=False, **plain).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    reader = spark.read.options(**plain).option("columnPruning", False).option("enforceSchema", False)
    if strict:
        return reader.option("mode", "FAILFAST").schema(schema).csv(path)
    schema = schema.add(BAD_RECORD, T.StringType())
    return reader.option("columnNameOfCorruptRecord", BAD_RECORD).schema(schema).csv(path)


def malformed_records(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """The records of a CSV whose number of cells differs from the header's, as text."""
    rows = _csv_text(spark, path, multi_line=multi_line, strict=False)
    # Spark parses the cells only if one of them is asked for.
    parsed = F.length(F.coalesce(named(rows.columns[0]), F.lit(""))) >= 0
    return rows.where(F.col(BAD_RECORD).isNotNull() & parsed).select(F.col(BAD_RECORD).alias("record"))


def coerce_core_numeric(df: DataFrame) -> DataFrame:
    """The five measures as doubles; what is no number becomes null."""
    present = [m for m in MEASURES if m in df.columns]
    return df.withColumns({m: as_number(df, m) for m in present})


def policy_key_string(df: DataFrame) -> DataFrame:
    """Policy_Number as text."""
    if "Policy_Number" not in df.columns:
        return df
    return df.withColumn("Policy_Number", F.col("Policy_Number").cast("string"))


def _nan_free(df: DataFrame) -> DataFrame:
    floats = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    ]
    return df.withColumns({c: nan_to_null(named(c)) for c in floats})


def land_csv(spark: SparkSession, path: str, folder: str, *, multi_line: bool = False) -> Landed:
    """Parse a CSV once into Parquet below ``folder``, and observe its types, raw counts and digest."""
    return land(_csv_text(spark, path, multi_line=multi_line), folder)


def read_landed_inforce(spark: SparkSession, landed: Landed) -> DataFrame:
    """``read_inforce`` of a landed CSV."""
    return policy_key_string(coerce_core_numeric(_nan_free(read_landed(spark, landed))))


def read_inforce(
    spark: SparkSession,
    path: str,
    *,
    fmt: str | None = None,
    schema: T.StructType | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """In-force table with double measures, a text policy key, and NaN turned into null.

    A CSV with records of too many or too few cells is refused; ``multi_line`` reads quoted
    line breaks, at the price of one task per file.

    A CSV without ``schema`` is landed in the shared folder first, since all cells decide the
    types; from there on it is read as Parquet. With ``schema`` it is read when rows are asked for.
    """
    kind = fmt or source_format(path)
    if kind == "parquet":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        df = reader.parquet(path)
    else:
        if schema is None:
            text = _csv_text(spark, path, multi_line=multi_line)
            landed = land(text, new_table_path(spark, "landed"), digest=False)
            return read_landed_inforce(spark, landed)
        text = _csv_text(spark, path, multi_line=multi_line)
        cells = text.select(
            *[
                F.when(~named(f.name).isin(*CSV_MISSING_CELLS), named(f.name)).alias(f.name)
                for f in schema.fields
            ]
        )
        df = cells.withColumns(
            {
                f.name: named(f.name).cast(f.dataType)
                for f in schema.fields
                if f.name not in MEASURES and not isinstance(f.dataType, T.StringType)
            }
        )
    return policy_key_string(coerce_core_numeric(_nan_free(df)))


def read_raw_strings(
    spark: SparkSession, path: str, *, fmt: str | None = None, multi_line: bool = False
) -> DataFrame:
    """Every cell as text, missing cells as empty text."""
    if (fmt or source_format(path)) == "csv":
        return raw_strings(_csv_text(spark, path, multi_line=multi_line))
    return raw_strings(spark.read.parquet(path))


def raw_strings(df: DataFrame) -> DataFrame:
    """Text view of a loaded table."""

    def text(column: str):
        value = named(column)
        if isinstance(data_type(df, column), (T.FloatType, T.DoubleType)):
            value = nan_to_null(value)
        return F.coalesce(value.cast("string"), F.lit("")).alias(column)

    return df.select(*[text(c) for c in df.columns])
