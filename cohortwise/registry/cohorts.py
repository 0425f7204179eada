"""Filters, cohort sums, ratios, intervals, order and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortwise.operators.cohorts import (
    ae_measure_view,
    ae_multi_grouping,
    ae_summary,
    cohort_label,
    cohort_totals,
    with_ratios,
)
from cohortwise.operators.intervals import amount_ci, count_ci, with_rate_ci
from cohortwise.operators.ranking import ae_sort, ae_top_n, evidence_ref, rank_cohorts
from cohortwise.registry.common import (
    INFORCE,
    SQL_RATIOS,
    SQL_SUMMARY,
    SQL_SUMS,
    TYPED,
    rounded,
    sql_intervals,
    sql_label,
    sql_totals,
    typed_flaws,
)
from cohortwise.sources.tables import inforce

# name: filters, the same as SQL
FILTERS = {
    "filter_eq": ([("Product_Group", "==", "BUILDING")], "\"Product_Group\" = 'BUILDING'"),
    "filter_ne": ([("COLA", "!=", 90000.0)], '"COLA" is distinct from 90000.0'),
    "filter_gt": ([("Face_Amount", ">", 30000.0)], '"Face_Amount" > 30000.0'),
    "filter_ge": (
        [("Study_Year", ">=", 1997), ("Smoker", "=", "No")],
        '"Study_Year" >= 1997 and "Smoker" = \'No\'',
    ),
    "filter_lt": ([("COLA", "<", 50000.0)], '"COLA" < 50000.0'),
    "filter_le": ([("Duration", "<=", 3)], '"Duration" <= 3'),
}
MULTI = [["Gender"], ["Gender", "Smoker"], ["Risk_Class"], ["Smoker", "Gender"]]
PAIR = ["Risk_Class", "Product_Group"]


def _totals(df):
    return df.withColumn("Sum_MAC", F.col("Sum_MAC").cast("bigint"))


def _filtered(name):
    filters = [dict(zip(("column", "op", "value"), f)) for f in FILTERS[name][0]]

    def query(spark, sf_dir):
        totals = cohort_totals(inforce(spark, sf_dir), ["Gender"], filters=filters)
        return rounded(_totals(totals))

    return query


def query_ae_one_way(spark, sf_dir):
    return rounded(_totals(cohort_totals(inforce(spark, sf_dir), ["Study_Year"])))


def query_ae_two_way(spark, sf_dir):
    return rounded(_totals(cohort_totals(inforce(spark, sf_dir), PAIR)))


def query_ae_multi_grouping(spark, sf_dir):
    found = ae_multi_grouping(inforce(spark, sf_dir), MULTI)
    return rounded(found).drop("group_values").withColumn("group_columns", F.array_join("group_columns", ","))


def query_ae_min_claims(spark, sf_dir):
    """Policies with several claims: many small cohorts, few of which remain."""
    df = inforce(spark, sf_dir).withColumnRenamed("Policy_Number", "Plan_Code")
    totals = cohort_totals(df, ["Plan_Code", "Study_Year"], min_claims=2)
    return rounded(_totals(totals))


def query_cohort_label(spark, sf_dir):
    """Labels over keys with missing values; a missing key prints as nan."""
    df = typed_flaws(spark, sf_dir)
    df = df.withColumn("Gender", F.when(F.trim("Gender") != "", F.col("Gender")))
    known = F.when(F.abs("Issue_Age") < float("inf"), F.col("Issue_Age"))
    df = df.withColumn("Plan_Year", known.cast("int") % 5)
    counts = df.groupBy("Gender", "Plan_Year").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.select(cohort_label(counts, ["Gender", "Plan_Year"]).alias("label"), "n_rows")


def query_ae_ratio_count(spark, sf_dir):
    df = with_ratios(cohort_totals(inforce(spark, sf_dir), PAIR))
    return rounded(df).select(*PAIR, "AE_Ratio_Count")


def query_ae_ratio_amount(spark, sf_dir):
    """Also over flawed rows, whose infinite expected claims leave no count ratio."""
    df = with_ratios(cohort_totals(typed_flaws(spark, sf_dir), ["Gender"]))
    return rounded(df).select("Gender", "AE_Ratio_Count", "AE_Ratio_Amount")


def query_rate_ci(spark, sf_dir):
    bounded = with_rate_ci(cohort_totals(inforce(spark, sf_dir), PAIR))
    return rounded(bounded, {"Rate_CI_Lower": 4, "Rate_CI_Upper": 4}).select(
        *PAIR, "Rate_CI_Lower", "Rate_CI_Upper"
    )


def query_ae_ci_count(spark, sf_dir):
    bounded = with_rate_ci(cohort_totals(inforce(spark, sf_dir), PAIR))
    return rounded(
        bounded.select(
            *PAIR,
            count_ci(F.col("Rate_CI_Lower")).alias("AE_Count_CI_Lower"),
            count_ci(F.col("Rate_CI_Upper")).alias("AE_Count_CI_Upper"),
        )
    )


def query_ae_ci_amount(spark, sf_dir):
    bounded = with_rate_ci(cohort_totals(inforce(spark, sf_dir), PAIR))
    return rounded(
        bounded.select(
            *PAIR,
            amount_ci(F.col("Rate_CI_Lower")).alias("AE_Amount_CI_Lower"),
            amount_ci(F.col("Rate_CI_Upper")).alias("AE_Amount_CI_Upper"),
        )
    )


def query_ae_summary(spark, sf_dir):
    return rounded(ae_summary(inforce(spark, sf_dir), ["Gender", "Study_Year"]))


def query_ae_measure_view(spark, sf_dir):
    view = ae_measure_view(ae_summary(inforce(spark, sf_dir), ["Risk_Class"]), "both")
    return rounded(
        view, {"actual": 0, "expected": 0, "ratio": 6, "ci_lower": 4, "ci_upper": 4}
    )


def query_ae_sort(spark, sf_dir):
    """Flagship: a two-way summary in its default order, with its place in that order."""
    totals = cohort_totals(inforce(spark, sf_dir), PAIR, min_claims=10)
    labelled = with_ratios(totals.withColumn("Dimensions", cohort_label(totals, PAIR)))
    ordered = ae_sort(labelled, "AE_Ratio_Count")
    return rounded(_totals(ordered)).drop(*PAIR)


def query_ae_top_n(spark, sf_dir):
    totals = cohort_totals(inforce(spark, sf_dir), PAIR)
    labelled = with_ratios(totals.withColumn("Dimensions", cohort_label(totals, PAIR)))
    return rounded(_totals(ae_top_n(labelled, "AE_Ratio_Amount", 50))).drop(*PAIR)


def query_cohort_rank(spark, sf_dir):
    """Rank among all policies' first durations: many cohorts, many of them tied."""
    df = inforce(spark, sf_dir).withColumn("Plan_Code", F.col("Policy_Number"))
    totals = cohort_totals(df, ["Plan_Code", "Smoker"])
    label = cohort_label(totals, ["Plan_Code", "Smoker"])
    labelled = with_ratios(totals.withColumn("Dimensions", label))
    # Equal ratios must tie on both engines, so the order uses the rounded ratio.
    ranked = rank_cohorts(rounded(labelled), "AE_Ratio_Count")
    return ranked.select(
        evidence_ref().alias("evidence_ref"), "cohort_rank", "Dimensions", "AE_Ratio_Count"
    )


QUERIES = {
    **{name: _filtered(name) for name in FILTERS},
    **{
        name.removeprefix("query_"): value
        for name, value in list(globals().items())
        if name.startswith("query_")
    },
}

_PAIR_KEYS = ", ".join(f'"{c}"' for c in PAIR)
_BOUNDED = f"with {INFORCE}, cohorts as ({sql_totals(PAIR)}), {sql_intervals('cohorts')}"


def _multi() -> str:
    rows = []
    for place, group in enumerate(MULTI, 1):
        slug = "_".join(c.lower() for c in group)
        keys = ", ".join(f'"{c}"' for c in group)
        rows.append(
            f"select '{slug}' as scenario, {len(group)} as way, {place} as \"grouping\", "
            f"'{','.join(group)}' as group_columns, * exclude ({keys}) "
            f"from ({sql_totals(group)})"
        )
    return " union all ".join(rows)


def _multi_bounded() -> str:
    # Two scenarios share labels only if their columns and order agree, so labels are unique.
    return f"""with {INFORCE}, cohorts as ({_multi()}), {sql_intervals("cohorts")}
select scenario, way, "grouping", group_columns, {SQL_SUMMARY} from bounded"""


def _measure_rows() -> str:
    return f"""with {INFORCE}, cohorts as ({sql_totals(["Risk_Class"])}), {sql_intervals("cohorts")}
select "Dimensions", 'count' as measure, round("Sum_MAC", 0) as actual,
  round("Sum_MEC", 0) as expected, round("AE_Ratio_Count", 6) as ratio,
  round("AE_Count_CI_Lower", 4) as ci_lower, round("AE_Count_CI_Upper", 4) as ci_upper
from bounded
union all
select "Dimensions", 'amount', round("Sum_MAF", 0), round("Sum_MEF", 0),
  round("AE_Ratio_Amount", 6), round("AE_Amount_CI_Lower", 4), round("AE_Amount_CI_Upper", 4)
from bounded"""


SQL = {
    **{
        name: f"""with {INFORCE} select "Gender", {SQL_SUMS}
from ({sql_totals(["Gender"], where=where)})"""
        for name, (_, where) in FILTERS.items()
    },
    "ae_one_way": f"""with {INFORCE} select "Study_Year", {SQL_SUMS}
from ({sql_totals(["Study_Year"])})""",
    "ae_two_way": f"with {INFORCE} select {_PAIR_KEYS}, {SQL_SUMS} from ({sql_totals(PAIR)})",
    "ae_multi_grouping": _multi_bounded(),
    "ae_min_claims": f"""with {INFORCE},
coded as (select *, "Policy_Number" as "Plan_Code" from inforce)
select "Plan_Code", "Study_Year", {SQL_SUMS}
from ({sql_totals(["Plan_Code", "Study_Year"], source="coded", min_claims=2)})""",
    "cohort_label": f"""with {TYPED},
keyed as (
  select case when trim("Gender") <> '' then "Gender" end as "Gender",
    cast(case when not isinf("Issue_Age") then "Issue_Age" end as int) % 5 as "Plan_Year"
  from typed)
select {sql_label(["Gender", "Plan_Year"])} as label, count(*) as n_rows
from keyed group by 1""",
    "ae_ratio_count": f"""with {INFORCE} select {_PAIR_KEYS},
  round("AE_Ratio_Count", 6) as "AE_Ratio_Count" from ({sql_totals(PAIR)})""",
    "ae_ratio_amount": f"""with {TYPED}
select "Gender", case when isinf("Sum_MEC") then null else round("AE_Ratio_Count", 6) end
  as "AE_Ratio_Count", round("AE_Ratio_Amount", 6) as "AE_Ratio_Amount"
from ({sql_totals(["Gender"], source="typed")})""",
    "rate_ci": f"""{_BOUNDED} select {_PAIR_KEYS}, round(lo, 4) as "Rate_CI_Lower",
  round(hi, 4) as "Rate_CI_Upper" from bounded""",
    "ae_ci_count": f"""{_BOUNDED} select {_PAIR_KEYS},
  round("AE_Count_CI_Lower", 4) as "AE_Count_CI_Lower",
  round("AE_Count_CI_Upper", 4) as "AE_Count_CI_Upper" from bounded""",
    "ae_ci_amount": f"""{_BOUNDED} select {_PAIR_KEYS},
  round("AE_Amount_CI_Lower", 4) as "AE_Amount_CI_Lower",
  round("AE_Amount_CI_Upper", 4) as "AE_Amount_CI_Upper" from bounded""",
    "ae_summary": f"""with {INFORCE}, cohorts as ({sql_totals(["Gender", "Study_Year"])}),
{sql_intervals("cohorts")} select {SQL_SUMMARY} from bounded""",
    "ae_measure_view": _measure_rows(),
    "ae_sort": f"""with {INFORCE} select "Dimensions", {SQL_SUMS}, {SQL_RATIOS}
from ({sql_totals(PAIR, min_claims=10)}) order by "AE_Ratio_Count" desc nulls last, "Dimensions" """,
    "ae_top_n": f"""with {INFORCE}, ranked as (
  select *, row_number() over (order by "AE_Ratio_Amount" desc nulls last, "Dimensions")
    as cohort_rank from ({sql_totals(PAIR)}))
select "Dimensions", {SQL_SUMS}, {SQL_RATIOS}, cohort_rank from ranked where cohort_rank <= 50""",
    "cohort_rank": f"""with {INFORCE},
coded as (select *, "Policy_Number" as "Plan_Code" from inforce),
cohorts as (
  select "Dimensions", round("AE_Ratio_Count", 6) as "AE_Ratio_Count"
  from ({sql_totals(["Plan_Code", "Smoker"], source="coded")})),
ranked as (
  select *, row_number() over (order by "AE_Ratio_Count" desc nulls last, "Dimensions")
    as cohort_rank from cohorts)
select 'row_' || lpad(cast(cohort_rank as varchar),
  cast(greatest(4, len(cast(cohort_rank as varchar))) as int), '0') as evidence_ref, cohort_rank, "Dimensions", "AE_Ratio_Count" from ranked""",
}
