"""Prepared tables and cohort summaries kept as Parquet, one new folder per write.

A write never replaces the files a running query may be reading. Which version counts is
recorded in the audit log, after the write has succeeded.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.contracts import RATIOS, SUMMARY_COLUMNS
from cohortwise.functions.values import named, nan_to_null, parse_number
from cohortwise.operators.cohorts import KEYS
from cohortwise.operators.ranking import rank_cohorts
from cohortwise.plans.ordered import running_total
from cohortwise.sources.versions import version_name


BUCKET_KEY, BUCKET_ORDER = "Policy_Number", "Duration"
#: Rows of a bucket, since one task sorts it, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 500_000, 8


def bucket_number(df: DataFrame) -> int:
    """Buckets for a table: as many as keep each about as large, however large the table."""
    return max(LEAST_BUCKETS, -(-df.count() // BUCKET_ROWS))


def write_prepared(
    df: DataFrame, root: str, *, partition_by: Sequence[str] = (), buckets: int = 0
) -> str:
    """Save a prepared table as a new version and return its path.

    Partitioning by a low-cardinality column such as Study_Year lets filters skip files. The
    rows are first gathered by that column, with each value split over several tasks, so a
    write leaves few files per folder even when one value holds most rows. A folder's name cannot
    tell empty text from a missing value, so partitioning by empty text is refused.

    With ``buckets``, rows lie by policy in so many files, sorted by policy and duration: checks
    and counts by policy then read them where they are. All rows of a policy are in one file, so a
    table with a policy of very many rows is better left without.
    """
    version = version_name()
    path = f"{root.rstrip('/')}/prepared/version={version}"
    _keep_schema(df, _schema_path(path), buckets)
    if buckets and partition_by:
        raise ValueError("Choose folders or buckets, not both.")
    if buckets:
        dealt = df.repartition(buckets, named(BUCKET_KEY))
        writer = dealt.write.format("parquet").mode("errorifexists").option("path", path)
        order = [c for c in (BUCKET_KEY, BUCKET_ORDER) if c in df.columns]
        writer.bucketBy(buckets, BUCKET_KEY).sortBy(*order).saveAsTable(_table_name(path))
    elif partition_by:
        named_folders = {
            c: F.when(F.col(c) == "", F.raise_error(F.lit(f"Empty text in {c} names no folder."))).otherwise(F.col(c))
            for c in partition_by
            if isinstance(df.schema[c].dataType, T.StringType)
        }
        df = df.withColumns(named_folders)
        df = df.hint("rebalance", *partition_by)
        df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("errorifexists").parquet(path)
    return path


def _schema_path(path: str) -> str:
    root, _, version = path.rpartition("/prepared/version=")
    return f"{root}/prepared_schema/version={version}"


def _table_name(path: str) -> str:
    """Name of a bucketed version in the session's catalog."""
    return "prepared_" + path.rpartition("/prepared/version=")[2].replace("-", "_")


def _keep_schema(df: DataFrame, path: str, buckets: int) -> None:
    facts = json.dumps({"schema": df.schema.jsonValue(), "buckets": buckets})
    text = df.sparkSession.createDataFrame([(facts,)], "value string")
    text.coalesce(1).write.mode("errorifexists").text(path, lineSep="\n")


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """A prepared table as written: its own types and order of columns, also of those that name
    folders, and no casts, so filters reach the Parquet scan. A bucketed version is known to the
    session's catalog by its own name, as only tables of a catalog have buckets."""
    written = json.loads(spark.read.text(_schema_path(path), wholetext=True).first()["value"])
    schema, buckets = T.StructType.fromJson(written.get("schema", written)), written.get("buckets", 0)
    if not buckets:
        return spark.read.schema(schema).parquet(path).select(*[named(c) for c in schema.names])
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        quoted = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields]
        order = ", ".join(c for c in (BUCKET_KEY, BUCKET_ORDER) if c in schema.names)
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({', '.join(quoted)}) USING parquet CLUSTERED BY ({BUCKET_KEY}) "
            f"SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
    return spark.table(name).select(*[named(c) for c in schema.names])


def write_ae_summary(summary: DataFrame, root: str, run_id: str) -> str:
    """Add the ranked summaries of a run, in a folder of its own with one per scenario.

    Runs share no files, so they may be written at once, and a run that is written again replaces
    itself. ``summary`` carries the columns scenario, way, grouping, group_columns, group_values and
    cohort_rank beside the twelve summary columns. A scenario only names a folder: groupings
    whose names agree share it and are told apart by grouping.
    """
    path = f"{root.rstrip('/')}/ae_summary"
    summary.write.mode("overwrite").partitionBy("scenario").parquet(f"{path}/run_id={run_id}")
    return path


def read_ae_summary(
    spark: SparkSession, path: str, *, fmt: str = "parquet", allow_empty: bool = True
) -> DataFrame:
    """Stored summary; see ``check_ae_summary``.

    A summary made elsewhere, without cohort_rank, is ranked by the order of its rows in the
    files.
    """
    if fmt == "csv":
        df = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"')
        # Cells that are no number, such as NA or nan, are undefined values.
        numbers = {c: nan_to_null(parse_number(F.col(c))) for c in SUMMARY_COLUMNS[1:] if c in df.columns}
        if "cohort_rank" in df.columns:
            numbers["cohort_rank"] = parse_number(F.col("cohort_rank")).cast("bigint")
        df = df.withColumns(numbers)
    else:
        df = spark.read.parquet(path)
    if "cohort_rank" not in df.columns:
        df = _with_file_rank(df)
    return check_ae_summary(df, allow_empty=allow_empty)


def _with_file_rank(df: DataFrame) -> DataFrame:
    """cohort_rank by position in the files: file, then split, then row within the split."""
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row"),
        F.lit(1).cast("bigint").alias("_one"),
    )
    order = [F.col("_file"), F.col("_split"), F.col("_row")]
    counted = running_total(placed, "_one", order=order, name="_before")
    return counted.withColumn("cohort_rank", F.col("_before") + 1)


def check_ae_summary(df: DataFrame, *, allow_empty: bool = True) -> DataFrame:
    """Keep the twelve columns and the rank; refuse a table that lacks one of them.

    A table without cohort_rank is ranked by its amount ratio.
    """
    absent = [c for c in SUMMARY_COLUMNS if c not in df.columns]
    if absent:
        raise ValueError(f"Not a cohort summary; columns absent: {absent}.")
    if not allow_empty and df.isEmpty():
        raise ValueError("The summary holds no cohorts to exhibit.")
    if "cohort_rank" not in df.columns:
        keep = [*SUMMARY_COLUMNS, *[c for c in KEYS[1:] if c in df.columns]]
        df = rank_cohorts(df.select(*keep), RATIOS[1])
    keys = [c for c in KEYS[1:] if c in df.columns]
    return df.select(*SUMMARY_COLUMNS, "cohort_rank", *keys)


def latest_by_way(summaries: DataFrame) -> DataFrame:
    """Rows of the last grouping of the newest run of each way (number of grouping columns)."""
    newest = summaries.groupBy("way").agg(F.max(F.struct("run_id", "grouping")).alias("newest"))
    newest = newest.select("way", "newest.run_id", "newest.grouping")
    return summaries.join(newest, ["way", "run_id", "grouping"], "left_semi")
