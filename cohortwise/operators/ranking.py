"""Order, ranks and top-n of cohort summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.contracts import DEFAULT_TOP_N, check_sort, row_limit
from cohortwise.plans.ordered import running_total


def summary_order(sort_by: str) -> list[Column]:
    """Largest first, undefined last, equal values by label."""
    return [F.col(check_sort(sort_by)).desc_nulls_last(), F.col("Dimensions").asc()]


def ae_sort(summary: DataFrame, sort_by: str) -> DataFrame:
    return summary.orderBy(*summary_order(sort_by))


def ae_top_n(summary: DataFrame, sort_by: str, n: int = DEFAULT_TOP_N) -> DataFrame:
    """The first n cohorts with their rank, as many as asked for; planned as a top-k."""
    top = ae_sort(summary, sort_by).limit(row_limit(n))
    place = Window.partitionBy(F.lit(0)).orderBy(*summary_order(sort_by))
    return top.withColumn("cohort_rank", F.row_number().over(place).cast("bigint"))


def rank_cohorts(
    summary: DataFrame, sort_by: str, *, within: Sequence[str] = (), slices: int | None = None
) -> DataFrame:
    """Add cohort_rank (1, 2, ...), the place a stored summary keeps for each cohort.

    A grouping may have more cohorts than one task should sort, so ranks are running counts
    over range slices.
    """
    counted = summary.withColumn("_one", F.lit(1).cast("bigint"))
    placed = running_total(
        counted,
        "_one",
        order=summary_order(sort_by),
        segment=within,
        name="_before",
        slices=slices,
    )
    return placed.withColumn("cohort_rank", F.col("_before") + 1).drop("_one", "_before")


def evidence_ref(rank: Column | str = "cohort_rank") -> Column:
    """Stable reference of a cohort in a summary, ``row_0001`` for the first."""
    digits = F.col(rank).cast("string") if isinstance(rank, str) else rank.cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.concat(F.lit("row_"), padded)
