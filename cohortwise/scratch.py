"""Shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach; the cluster names it in ``spark.checkpoint.dir``.

    A session without the setting uses its warehouse, which all executors share as well.
    """
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


@contextmanager
def owned_scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables written inside the block go to a folder that ends with it.

    For work whose results are saved or counted inside the block: what still reads the tables
    afterwards finds them gone.
    """
    outer = spark.conf.get(SETTING, None)
    own = new_table_path(spark, "work")
    spark.conf.set(SETTING, own)
    try:
        yield own
    finally:
        if outer is None:
            spark.conf.unset(SETTING)
        else:
            spark.conf.set(SETTING, outer)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of the longest method that the JVM compiles.
LONGEST_COMPILED = 8000


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """For jobs of very many expressions run inside the block: a stage whose one method would be too
    long for the JVM to compile is run by Spark in many short ones instead."""
    setting = "spark.sql.codegen.hugeMethodLimit"
    outer = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(outer), LONGEST_COMPILED)))
    try:
        yield
    finally:
        spark.conf.set(setting, outer)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside the block, the shuffle files of a job go as soon as its table is written. Without it
    they stay until the driver happens to collect its garbage, whatever their size."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    outer = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if outer is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, outer)


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier write has used."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows out of a table in the shared folder, written once.

    A lost executor then rereads files instead of recomputing (and repartitioning) the input.
    """
    spark = df.sparkSession
    path = new_table_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
