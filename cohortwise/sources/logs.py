"""Append-only logs that many writers share.

A batch of rows is a folder of its own below the log, so writers never share temporary files, and a
batch counts once its folder is marked as finished. Each row keeps the name of its batch and its
number there. A batch under a name that the log holds already is not written again, so an append
can be retried; copies that a broken compaction leaves behind are one row to readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.functions.values import named
from cohortwise.sources.versions import version_name

BATCH, NUMBER = "_batch", "_number"


def _folders(spark: SparkSession, log: str) -> list[str]:
    """The finished batches, by one listing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{log.rstrip('/')}/batch=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [str(status.getPath().getParent().toString()) for status in found or ()]


def _schema(schema: str | T.StructType) -> T.StructType:
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return T.StructType([*fields.fields, T.StructField(BATCH, T.StringType()), T.StructField(NUMBER, T.LongType())])


def _read(spark: SparkSession, folders: list[str], schema: T.StructType) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def append_batch(rows: DataFrame, log: str, batch: str | None = None) -> str:
    """Add rows to a log as one batch and return its name. With the name of an earlier batch
    nothing is added."""
    spark, given = rows.sparkSession, batch is not None
    batch = batch or version_name()
    log = log.rstrip("/")
    if given:
        own = T.StructType([T.StructField(BATCH, T.StringType())])
        if not _read(spark, _folders(spark, log), own).where(F.col(BATCH) == batch).isEmpty():
            return batch
    marked = rows.withColumns({BATCH: F.lit(batch), NUMBER: F.monotonically_increasing_id()})
    # What an attempt has left unfinished under this name goes.
    marked.write.mode("overwrite").parquet(f"{log}/batch={batch}")
    return batch


def read_log(spark: SparkSession, log: str, schema: str | T.StructType) -> DataFrame:
    """All rows of the finished batches, once each; a log without any is empty."""
    whole = _schema(schema)
    names = whole.names[:-2]
    return _read(spark, _folders(spark, log), whole).dropDuplicates([BATCH, NUMBER]).select(*[named(c) for c in names])


def compact_log(spark: SparkSession, log: str, schema: str | T.StructType) -> int:
    """Put the finished batches into one, then remove them; returns how many there were.

    Batches that are added meanwhile stay. A query that began before and still reads the removed
    files has to be run again.
    """
    folders = _folders(spark, log)
    if len(folders) < 2:
        return 0
    rows = _read(spark, folders, _schema(schema)).dropDuplicates([BATCH, NUMBER])
    target = f"{log.rstrip('/')}/batch=compact-{version_name()}"
    rows.write.mode("errorifexists").parquet(target)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in folders:
        files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)
    return len(folders)
