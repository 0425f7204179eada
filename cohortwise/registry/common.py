"""Views, rounding and SQL fragments that several queries share.

Sums of doubles depend on the order of addition, so both sides round them: counts to four
decimals, amounts to cents or units, ratios to six decimals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.functions.values import as_number
from cohortwise.sources.inforce import coerce_core_numeric
from cohortwise.sources.tables import flawed_inforce

DIGITS = {
    "Sum_MOC": 4,
    "Sum_MEC": 4,
    "Sum_MAF": 2,
    "Sum_MEF": 0,
    "AE_Ratio_Count": 6,
    "AE_Ratio_Amount": 6,
    "AE_Count_CI_Lower": 4,
    "AE_Count_CI_Upper": 4,
    "AE_Amount_CI_Lower": 4,
    "AE_Amount_CI_Upper": 4,
}


def rounded(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    places = DIGITS if digits is None else digits
    return df.withColumns(
        {c: F.round(F.col(c), n) for c, n in places.items() if c in df.columns}
    )


def typed_flaws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flawed view as a prepared table would hold it: unreadable numbers are gone."""
    df = coerce_core_numeric(flawed_inforce(spark, sf_dir))
    numbers = ("Duration", "Face_Amount", "Issue_Age")
    return df.withColumns({c: as_number(df, c) for c in numbers})


# ---- SQL side ----

INFORCE = """inforce as (
  select 'P' || cast(l_orderkey as varchar) as "Policy_Number",
    l_linenumber as "Duration",
    case when l_returnflag = 'R' then 1.0e0 else 0.0e0 end as "MAC",
    case when l_returnflag = 'R' then 1.0e0 else l_quantity / 50.0e0 end as "MOC",
    (l_discount + 0.01e0) * 5.0e0 as "MEC",
    case when l_returnflag = 'R' then l_extendedprice else 0.0e0 end as "MAF",
    (l_discount + 0.01e0) * 5.0e0 * l_extendedprice as "MEF",
    case when l_returnflag = 'R' then l_extendedprice end as "COLA",
    l_extendedprice as "Face_Amount",
    19 + p_size as "Issue_Age",
    case when c_custkey % 2 = 0 then 'F' else 'M' end as "Gender",
    case when l_orderkey % 5 = 0 then 'Yes' else 'No' end as "Smoker",
    o_orderpriority as "Risk_Class",
    c_mktsegment as "Product_Group",
    cast(year(l_shipdate) as int) as "Study_Year"
  from lineitem
  join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey
  join part on l_partkey = p_partkey)"""

_CENTS = "cast(cast(floor(l_extendedprice) as bigint) as varchar)"

FLAWED = f"""flawed as (
  select case when l_quantity = 50 then null else 'P' || cast(l_orderkey as varchar) end
      as "Policy_Number",
    case when l_quantity = 49 then 'n/a'
      when l_quantity = 48 then cast(l_linenumber as varchar) || '.5'
      else cast(l_linenumber as varchar) end as "Duration",
    case when l_quantity = 1 then 'n/a' when l_quantity = 2 then 'one'
      when l_quantity = 3 then '2' when l_returnflag = 'R' then ' 1 ' else '0' end as "MAC",
    case when l_quantity = 4 then '' when l_quantity = 5 then '1d' when l_quantity = 6 then '0'
      when l_quantity = 7 then '1.25' when l_returnflag = 'R' and l_quantity = 8 then '0.5'
      when l_returnflag = 'R' then '1.0' else '0.75' end as "MOC",
    case when l_quantity = 9 then 'NULL' when l_quantity = 10 then '0,2'
      when l_quantity = 11 then 'inf' when l_quantity = 12 then '0'
      when l_quantity = 13 then '1' else '2e-1' end as "MEC",
    case when l_quantity = 14 then '--5' when l_returnflag = 'R' then {_CENTS} else '0' end
      as "MAF",
    case when l_quantity = 15 then ' NaN ' when l_quantity = 16 then '$7' else {_CENTS} end
      as "MEF",
    case when l_returnflag = 'R' and l_quantity = 17 then ''
      when l_returnflag = 'R' or l_quantity = 18 then {_CENTS} end as "COLA",
    case when l_quantity = 19 then '-1' when l_quantity = 20 then 'none' else {_CENTS} end
      as "Face_Amount",
    case when l_quantity = 21 then '0' when l_quantity = 22 then 'inf'
      else cast(l_suppkey % 60 + 20 as varchar) end as "Issue_Age",
    case when l_quantity = 23 then 'NA' when l_quantity = 24 then '  ' else l_linestatus end
      as "Gender"
  from lineitem)"""


NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$"


def sql_number(text: str) -> str:
    return (
        f"case when regexp_matches(trim({text}), '{NUMBER_PATTERN}') "
        f"then try_cast(trim({text}) as double) end"
    )


def sql_missing(text: str) -> str:
    return (
        f"({text} is null or lower(trim({text})) in ('', 'na', 'nan', 'null', 'none', 'n/a'))"
    )


TYPED = f"""{FLAWED}, typed as (
  select "Policy_Number", {sql_number('"Duration"')} as "Duration",
    {sql_number('"MAC"')} as "MAC", {sql_number('"MOC"')} as "MOC",
    {sql_number('"MEC"')} as "MEC", {sql_number('"MAF"')} as "MAF",
    {sql_number('"MEF"')} as "MEF", "COLA", {sql_number('"Face_Amount"')} as "Face_Amount",
    {sql_number('"Issue_Age"')} as "Issue_Age", "Gender"
  from flawed)"""


def sql_label(columns: Sequence[str]) -> str:
    parts = [f"'{c}=' || coalesce(cast(\"{c}\" as varchar), 'nan')" for c in columns]
    return " || ' | ' || ".join(parts)


def sql_totals(
    columns: Sequence[str], *, source: str = "inforce", where: str = "true", min_claims: float = 0
) -> str:
    """SELECT of unrounded sums and ratios by cohort."""
    keys = ", ".join(f'"{c}"' for c in columns)
    return f"""select {keys}, {sql_label(columns)} as "Dimensions",
    coalesce(sum("MAC"), 0.0) as "Sum_MAC", coalesce(sum("MOC"), 0.0) as "Sum_MOC",
    coalesce(sum("MEC"), 0.0) as "Sum_MEC", coalesce(sum("MAF"), 0.0) as "Sum_MAF",
    coalesce(sum("MEF"), 0.0) as "Sum_MEF",
    case when coalesce(sum("MEC"), 0.0) > 0 then sum("MAC") / sum("MEC") end as "AE_Ratio_Count",
    case when coalesce(sum("MEF"), 0.0) > 0 then sum("MAF") / sum("MEF") end as "AE_Ratio_Amount"
  from {source} where {where}
  group by {keys} having coalesce(sum("MAC"), 0.0) >= {min_claims}"""


SQL_SUMS = """cast("Sum_MAC" as bigint) as "Sum_MAC", round("Sum_MOC", 4) as "Sum_MOC",
  round("Sum_MEC", 4) as "Sum_MEC", round("Sum_MAF", 2) as "Sum_MAF",
  round("Sum_MEF", 0) as "Sum_MEF" """

SQL_RATIOS = """round("AE_Ratio_Count", 6) as "AE_Ratio_Count",
  round("AE_Ratio_Amount", 6) as "AE_Ratio_Amount" """


def sql_intervals(cohorts: str) -> str:
    """CTEs that end in ``bounded``: the cohorts plus rate and ratio bounds.

    The beta quantiles come from a fine grid over the logit of the rate: the density is summed
    by the trapezoid rule and the cell that holds the quantile is interpolated. Needs unique
    Dimensions.
    """
    return f"""params as (
    select "Dimensions", "Sum_MAC" + 0.5e0 as a, "Sum_MOC" - "Sum_MAC" + 0.5e0 as b
    from {cohorts} where "Sum_MOC" > 0 and "Sum_MAC" >= 0 and "Sum_MAC" <= "Sum_MOC"),
  grid as (
    select "Dimensions", a, b, a / (a + b) as m,
      unnest(generate_series(-8000, 8000)) as i from params),
  bump as (
    select *, i * sqrt(1 / a + 1 / b) / 800.0e0 as u,
      exp(a * (i * sqrt(1 / a + 1 / b) / 800.0e0)
        - (a + b) * ln(1 + m * (exp(i * sqrt(1 / a + 1 / b) / 800.0e0) - 1))) as h
    from grid),
  mass as (
    select *, sum(h) over (partition by "Dimensions" order by i) - h / 2 as t from bump),
  cells as (
    select *, lead(t) over (partition by "Dimensions" order by i) as t1,
      lead(u) over (partition by "Dimensions" order by i) as u1,
      max(t) over (partition by "Dimensions") as whole from mass),
  found as (
    select "Dimensions", p, m, u + (u1 - u) * (p * whole - t) / (t1 - t) as u
    from cells, (values (0.025e0), (0.975e0)) as tails(p)
    where t <= p * whole and p * whole < t1),
  bounds as (
    select "Dimensions",
      max(case when p < 0.5 then m * exp(u) / (1 + m * (exp(u) - 1)) end) as lo,
      max(case when p > 0.5 then m * exp(u) / (1 + m * (exp(u) - 1)) end) as hi
    from found group by "Dimensions"),
  bounded as (
    select c.*, lo, hi,
      case when "Sum_MEC" > 0 then lo * "Sum_MOC" / "Sum_MEC" end as "AE_Count_CI_Lower",
      case when "Sum_MEC" > 0 then hi * "Sum_MOC" / "Sum_MEC" end as "AE_Count_CI_Upper",
      case when "Sum_MEC" > 0 and "Sum_MEF" > 0 then lo * "Sum_MOC" / "Sum_MEF" * (case
        when "Sum_MAC" > 0 then "Sum_MAF" / "Sum_MAC" else "Sum_MEF" / "Sum_MEC" end) end
        as "AE_Amount_CI_Lower",
      case when "Sum_MEC" > 0 and "Sum_MEF" > 0 then hi * "Sum_MOC" / "Sum_MEF" * (case
        when "Sum_MAC" > 0 then "Sum_MAF" / "Sum_MAC" else "Sum_MEF" / "Sum_MEC" end) end
        as "AE_Amount_CI_Upper"
    from {cohorts} c left join bounds using ("Dimensions"))"""


SQL_INTERVALS = """round("AE_Count_CI_Lower", 4) as "AE_Count_CI_Lower",
  round("AE_Count_CI_Upper", 4) as "AE_Count_CI_Upper",
  round("AE_Amount_CI_Lower", 4) as "AE_Amount_CI_Lower",
  round("AE_Amount_CI_Upper", 4) as "AE_Amount_CI_Upper" """

SQL_SUMMARY = f'"Dimensions", {SQL_SUMS}, {SQL_RATIOS}, {SQL_INTERVALS}'


def sql_edge(edge: str) -> str:
    """Label text of a band edge."""
    return (
        f"case when {edge} = floor({edge}) then cast(cast({edge} as bigint) as varchar) "
        f"else rtrim(rtrim(printf('%.2f', {edge}), '0'), '.') end"
    )
