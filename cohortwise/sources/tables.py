"""In-force and audit views over an order-entry star schema.

Both views are plain projections and equi-joins: Catalyst prunes the columns a query does not
use, and adaptive execution picks broadcast joins by measured size and splits hot join keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Schemas by path, as a catalog would keep them: finding one costs a job per table.
_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def inforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One in-force row per order line."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    parts = table(spark, sf_dir, "part")
    joined = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
    )
    claim = F.col("l_returnflag") == "R"
    rate = (F.col("l_discount") + F.lit(0.01)) * F.lit(5.0)
    return joined.select(
        F.concat(F.lit("P"), F.col("l_orderkey").cast("string")).alias("Policy_Number"),
        F.col("l_linenumber").alias("Duration"),
        F.when(claim, 1.0).otherwise(0.0).alias("MAC"),
        F.when(claim, 1.0).otherwise(F.col("l_quantity") / 50.0).alias("MOC"),
        rate.alias("MEC"),
        F.when(claim, F.col("l_extendedprice")).otherwise(0.0).alias("MAF"),
        (rate * F.col("l_extendedprice")).alias("MEF"),
        F.when(claim, F.col("l_extendedprice")).alias("COLA"),
        F.col("l_extendedprice").alias("Face_Amount"),
        (F.lit(19) + F.col("p_size")).alias("Issue_Age"),
        F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("Gender"),
        F.when(F.col("l_orderkey") % 5 == 0, "Yes").otherwise("No").alias("Smoker"),
        F.col("o_orderpriority").alias("Risk_Class"),
        F.col("c_mktsegment").alias("Product_Group"),
        F.year("l_shipdate").alias("Study_Year"),
    )


def flawed_inforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The in-force columns as text, with the faults that quality checks look for.

    The faults follow from the row's own values, so their number grows with the tables.
    """
    lines = table(spark, sf_dir, "lineitem")
    quantity, price = F.col("l_quantity"), F.col("l_extendedprice")
    claim = F.col("l_returnflag") == "R"
    cents = F.floor(price).cast("bigint").cast("string")
    return lines.select(
        F.when(quantity == 50, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("P"), F.col("l_orderkey").cast("string")))
        .alias("Policy_Number"),
        F.when(quantity == 49, "n/a")
        .when(quantity == 48, F.concat(F.col("l_linenumber").cast("string"), F.lit(".5")))
        .otherwise(F.col("l_linenumber").cast("string"))
        .alias("Duration"),
        F.when(quantity == 1, "n/a")
        .when(quantity == 2, "one")
        .when(quantity == 3, "2")
        .when(claim, " 1 ")
        .otherwise("0")
        .alias("MAC"),
        F.when(quantity == 4, "")
        .when(quantity == 5, "1d")
        .when(quantity == 6, "0")
        .when(quantity == 7, "1.25")
        .when(claim & (quantity == 8), "0.5")
        .when(claim, "1.0")
        .otherwise("0.75")
        .alias("MOC"),
        F.when(quantity == 9, "NULL")
        .when(quantity == 10, "0,2")
        .when(quantity == 11, "inf")
        .when(quantity == 12, "0")
        .when(quantity == 13, "1")
        .otherwise("2e-1")
        .alias("MEC"),
        F.when(quantity == 14, "--5").when(claim, cents).otherwise("0").alias("MAF"),
        F.when(quantity == 15, " NaN ").when(quantity == 16, "$7").otherwise(cents).alias("MEF"),
        F.when(claim & (quantity == 17), "").when(claim | (quantity == 18), cents).alias("COLA"),
        F.when(quantity == 19, "-1").when(quantity == 20, "none").otherwise(cents).alias(
            "Face_Amount"
        ),
        F.when(quantity == 21, "0")
        .when(quantity == 22, "inf")
        .otherwise((F.col("l_suppkey") % 60 + 20).cast("string"))
        .alias("Issue_Age"),
        F.when(quantity == 23, "NA")
        .when(quantity == 24, "  ")
        .otherwise(F.col("l_linestatus"))
        .alias("Gender"),
    )


def artifact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifact entries of many study runs, one per event.

    Each user is a study. Page views prepare its table; the other events are summaries and
    packets made from the table as it stood on the day of the event.
    """
    events = table(spark, sf_dir, "events")
    study = F.concat(F.lit("study_"), F.col("user_id").cast("string"))
    day = F.date_format("ts", "yyyy-MM-dd")
    is_prepared = F.col("event_type") == "view"
    kind = (
        F.when(is_prepared, "prepared_dataset")
        .when(F.col("event_type") == "click", "ae_summary")
        .when(F.col("event_type") == "purchase", "ai_ae_packet")
        .otherwise(F.concat(F.lit("ae_visual_"), F.col("event_type")))
    )
    prepared_path = F.concat(study, F.lit("/prepared"))
    prepared_hash = F.sha2(F.concat(study, F.lit("|"), day), 256)
    return events.select(
        F.col("event_id").alias("entry_id"),
        F.col("ts").alias("entry_ts"),
        kind.alias("artifact_type"),
        F.when(is_prepared, prepared_path)
        .otherwise(F.concat(study, F.lit("/"), kind))
        .alias("path"),
        F.when(is_prepared, prepared_hash)
        .otherwise(F.sha2(F.concat(study, F.lit("#"), F.col("event_id").cast("string")), 256))
        .alias("content_hash"),
        F.when(
            ~is_prepared,
            F.array(
                F.struct(
                    F.lit("prepared_dataset").alias("artifact_type"),
                    prepared_path.alias("path"),
                    prepared_hash.alias("content_hash"),
                )
            ),
        ).alias("source_artifacts"),
        F.when(is_prepared, "band")
        .when(kind == "ae_summary", "ae")
        .when(kind == "ai_ae_packet", "packet")
        .otherwise("visualize")
        .alias("generating_tool"),
        F.col("props").alias("parameters"),
    )


def lineage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifact entries of studies that build on each other, one per event.

    Each user is a study. Its prepared table draws on that of the study of half its number, a
    summary on the prepared table, a packet on its own summary and that of the other study, and an
    exhibit on the packet, each as it stood on the day of the event.
    """
    events = table(spark, sf_dir, "events")
    own, other = F.col("user_id"), F.expr("user_id div 2")
    day = F.date_format("ts", "yyyy-MM-dd")
    kind = (
        F.when(F.col("event_type") == "view", "prepared_dataset")
        .when(F.col("event_type") == "click", "ae_summary")
        .when(F.col("event_type") == "purchase", "ai_ae_packet")
        .otherwise(F.concat(F.lit("ae_visual_"), F.col("event_type")))
    )

    def path(study, of_kind):
        tail = F.when(of_kind == "prepared_dataset", "prepared").otherwise(of_kind)
        return F.concat(F.lit("study_"), study.cast("string"), F.lit("/"), tail)

    def content(study, of_kind):
        return F.sha2(F.concat_ws("|", path(study, of_kind), day), 256)

    def source(study, name):
        return F.struct(
            F.lit(name).alias("artifact_type"),
            path(study, F.lit(name)).alias("path"),
            content(study, F.lit(name)).alias("content_hash"),
        )

    made_from = (
        F.when((kind == "prepared_dataset") & (own > 1), F.array(source(other, "prepared_dataset")))
        .when(kind == "ae_summary", F.array(source(own, "prepared_dataset")))
        .when((kind == "ai_ae_packet") & (own > 1), F.array(source(own, "ae_summary"), source(other, "ae_summary")))
        .when(kind == "ai_ae_packet", F.array(source(own, "ae_summary")))
        .when(kind != "prepared_dataset", F.array(source(own, "ai_ae_packet")))
    )
    return events.select(
        F.col("event_id").alias("entry_id"),
        F.col("ts").alias("entry_ts"),
        kind.alias("artifact_type"),
        path(own, kind).alias("path"),
        content(own, kind).alias("content_hash"),
        made_from.alias("source_artifacts"),
    )
