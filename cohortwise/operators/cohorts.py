"""Actual and expected claims summed by cohort."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.contracts import (
    INTERVALS,
    LABEL_SEPARATOR,
    MEASURE_CHOICES,
    MEASURES,
    NEVER_GROUPED,
    NULL_KEY_TEXT,
    RAW_NUMERICS,
    SUMMARY_COLUMNS,
    SUMS,
)
from cohortwise.functions.labels import summary_slug
from cohortwise.functions.ratios import safe_ratio
from cohortwise.functions.values import as_key_text, finite, named
from cohortwise.operators.filters import RowFilter, apply_filters
from cohortwise.operators.intervals import with_intervals
from cohortwise.operators.ranking import rank_cohorts

Filters = Iterable[RowFilter | dict[str, Any]]

#: Place of a row's grouping among those of its run, and the cohort's key as columns and values.
KEYS = ("grouping", "group_columns", "group_values")


def check_grouping(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """One or two existing columns that may form cohorts."""
    chosen = [columns] if isinstance(columns, str) else list(columns)
    if len(chosen) not in (1, 2):
        raise ValueError("Group by one or two columns.")
    for column in chosen:
        if column not in df.columns:
            raise KeyError(f"Column `{column}` is not in the table.")
        if column in NEVER_GROUPED or column in RAW_NUMERICS:
            raise ValueError(f"Column `{column}` cannot form cohorts; band it first.")
    if len(set(chosen)) != len(chosen):
        raise ValueError("Group by two different columns.")
    return chosen


def check_measures(df: DataFrame) -> None:
    absent = [m for m in MEASURES if m not in df.columns]
    if absent:
        raise ValueError(f"The table lacks the measure columns {absent}.")


def cohort_label(df: DataFrame, columns: Sequence[str]) -> Column:
    """Text such as ``Gender=F | Smoker=No``; a missing key prints as ``nan``."""
    parts = [
        F.concat(F.lit(f"{c}="), F.coalesce(as_key_text(df, c), F.lit(NULL_KEY_TEXT)))
        for c in columns
    ]
    return F.concat_ws(LABEL_SEPARATOR, *parts)


def _sums() -> list[Column]:
    return [F.coalesce(F.sum(m), F.lit(0.0)).alias(s) for m, s in zip(MEASURES, SUMS)]


def _enough_claims(min_claims: float) -> Column:
    return (F.col("Sum_MAC") >= F.lit(float(min_claims))) & ~F.isnan("Sum_MAC")


def cohort_totals(
    df: DataFrame, group_by: Sequence[str], *, filters: Filters = (), min_claims: float = 0
) -> DataFrame:
    """Sums of the five measures per cohort, for cohorts with at least ``min_claims`` claims.

    Rows collapse to one partial sum per cohort and task before the only shuffle, so a cohort
    that holds most rows costs no more than a small one.
    """
    check_measures(df)
    keys = check_grouping(df, group_by)
    grouped = apply_filters(df, filters).groupBy(*[named(k) for k in keys]).agg(*_sums())
    return grouped.where(_enough_claims(min_claims))


def with_ratios(totals: DataFrame) -> DataFrame:
    return totals.withColumns(
        {
            "AE_Ratio_Count": safe_ratio(F.col("Sum_MAC"), F.col("Sum_MEC")),
            "AE_Ratio_Amount": safe_ratio(F.col("Sum_MAF"), F.col("Sum_MEF")),
        }
    )


def _labelled(
    df: DataFrame, groupings: Sequence[Sequence[str]], filters: Filters, min_claims: float
) -> DataFrame:
    """Sums and ratios of one or more groupings, told apart by their place and columns.

    Several groupings share one scan. grouping_id, not a null test, decides which grouping a
    row belongs to, since keys may be missing themselves.
    """
    check_measures(df)
    chosen = list(dict.fromkeys(tuple(check_grouping(df, g)) for g in groupings))
    if not chosen:
        raise ValueError("Give at least one grouping.")
    if len(chosen) == 1:
        totals = cohort_totals(df, chosen[0], filters=filters, min_claims=min_claims)
        return with_ratios(totals.select("*", *_scenario(totals, 1, chosen[0])))
    columns = list(dict.fromkeys(c for g in chosen for c in g))
    sets = list(dict.fromkeys(tuple(c for c in columns if c in g) for g in chosen))
    totals = (
        apply_filters(df, filters)
        .groupingSets([[named(c) for c in s] for s in sets], *[named(c) for c in columns])
        .agg(*_sums(), F.grouping_id().alias("_set"))
        .where(_enough_claims(min_claims))
    )

    def set_number(grouping: Sequence[str]) -> int:
        return sum(1 << i for i, c in enumerate(reversed(columns)) if c not in grouping)

    # Groupings that differ only in column order share a set but not their labels.
    scenarios = [
        F.when(F.col("_set") == set_number(g), F.struct(*_scenario(totals, place, g)))
        for place, g in enumerate(chosen, 1)
    ]
    found = totals.select("*", F.inline(F.array_compact(F.array(*scenarios))))
    return with_ratios(found)


def _scenario(totals: DataFrame, place: int, group_by: Sequence[str]) -> list[Column]:
    """The scenario is a name that groupings may share; grouping and group_columns tell them apart."""
    return [
        F.lit(summary_slug(group_by)).alias("scenario"),
        F.lit(len(group_by)).alias("way"),
        F.lit(place).alias("grouping"),
        F.array(*[F.lit(c) for c in group_by]).alias("group_columns"),
        F.array(*[as_key_text(totals, c) for c in group_by]).alias("group_values"),
        cohort_label(totals, group_by).alias("Dimensions"),
    ]


def _finish(labelled: DataFrame, level: float, *extra: str) -> DataFrame:
    whole_claims = F.when(finite(F.col("Sum_MAC")), F.col("Sum_MAC")).cast("bigint")
    full = with_intervals(labelled, level).withColumn("Sum_MAC", whole_claims)
    return full.select(*extra, *SUMMARY_COLUMNS)


def ae_summary(
    df: DataFrame,
    group_by: Sequence[str],
    *,
    filters: Filters = (),
    min_claims: float = 0,
    level: float = 0.95,
) -> DataFrame:
    """The twelve-column cohort summary of one grouping."""
    keys = [group_by] if isinstance(group_by, str) else group_by
    return _finish(_labelled(df, [keys], filters, min_claims), level)


def ae_multi_grouping(
    df: DataFrame,
    groupings: Sequence[Sequence[str]],
    *,
    filters: Filters = (),
    min_claims: float = 0,
    level: float = 0.95,
) -> DataFrame:
    """Summaries of several groupings out of one scan, told apart by grouping and its columns."""
    return _finish(_labelled(df, groupings, filters, min_claims), level, "scenario", "way", *KEYS)


def ranked_summary(
    df: DataFrame,
    groupings: Sequence[Sequence[str]],
    sort_by: str,
    *,
    within: Sequence[str] = ("grouping",),
    filters: Filters = (),
    min_claims: float = 0,
    level: float = 0.95,
) -> DataFrame:
    """Summaries with cohort_rank, as they are stored.

    Ranking comes before the intervals, so that its two passes over the cohorts stay cheap.
    """
    ranked = rank_cohorts(_labelled(df, groupings, filters, min_claims), sort_by, within=within)
    return _finish(ranked, level, "scenario", "way", *KEYS, "cohort_rank")


# ---- Fixed values: columns behind each measure. ----
MEASURE_COLUMNS = {
    "count": ("Sum_MAC", "Sum_MEC", "AE_Ratio_Count", *INTERVALS[:2]),
    "amount": ("Sum_MAF", "Sum_MEF", "AE_Ratio_Amount", *INTERVALS[2:]),
}
# ---- End of fixed values. ----


def ae_measure_view(summary: DataFrame, measure: str) -> DataFrame:
    """Actual, expected, ratio and interval per cohort for count, amount, or both.

    The sums never change with the measure. One pass emits the one or two rows per cohort.
    """
    if measure not in MEASURE_CHOICES:
        raise ValueError(f"Unknown measure {measure!r}; choose one of {MEASURE_CHOICES}.")
    shown = ("count", "amount") if measure == "both" else (measure,)
    names = ("actual", "expected", "ratio", "ci_lower", "ci_upper")
    rows = [
        F.struct(
            F.lit(m).alias("measure"),
            *[F.col(c).cast("double").alias(n) for n, c in zip(names, MEASURE_COLUMNS[m])],
        )
        for m in shown
    ]
    return summary.select("Dimensions", F.inline(F.array(*rows)))
