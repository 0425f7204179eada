"""A corpus from raw documents to packed training sequences.

Every stage works on what the stage before has kept, as a Parquet table read anew; all but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortwise.llm import decontamination, jaccard, languages, packing, pii
from cohortwise.llm.queries import table, tokenizer
from cohortwise.scratch import new_table_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Documents that Spark hands to a Python worker at a time. They may be long, so few of them: the
#: work of a stage does not depend on it, the memory of a worker does.
TOGETHER = 250
#: The same for the stage whose other tables have far more rows, and small ones.
TOGETHER_IN_LISTS = 1000


def few_at_a_time(stage: Stage, together: int = TOGETHER) -> Stage:
    """The stage with Python workers that hold so many documents at a time; the setting stays for
    the run of what the stage returns."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(together))
        return stage(spark, docs, sf_dir)

    return run_stage


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach."""
    return languages.keep_identified(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of sets of five-word shingles, linked from 80 percent on."""
    return jaccard.one_per_class(docs, size=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no part of a benchmark item."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids."""
    return packing.pack(docs, tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", few_at_a_time(identified)),
    ("jaccard_join", few_at_a_time(one_of_near_copies, TOGETHER_IN_LISTS)),
    ("decontamination", few_at_a_time(decontaminated)),
    ("pii", few_at_a_time(redacted)),
    ("packing", few_at_a_time(packed)),
]

#: Bootstrapped patterns, learned languages and tokenizers are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_table_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
