"""Sources, sinks, and profiling."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from cohortwise.contracts import INTERVALS
from cohortwise.operators.cohorts import ae_summary, ranked_summary
from cohortwise.operators.dimensions import default_age_band
from cohortwise.operators.profile import (
    profile_feature_types,
    profile_nulls,
    profile_summary,
)
from cohortwise.operators.ranking import ae_sort
from cohortwise.registry.common import (
    FLAWED,
    INFORCE,
    SQL_INTERVALS,
    SQL_RATIOS,
    SQL_SUMMARY,
    SQL_SUMS,
    rounded,
    sql_edge,
    sql_intervals,
    sql_missing,
    sql_number,
    sql_totals,
)
from cohortwise.scratch import new_table_path
from cohortwise.sources.digests import refresh_sketches, sketched_summary
from cohortwise.sources.inforce import (
    coerce_core_numeric,
    land_csv,
    malformed_records,
    policy_key_string,
    read_inforce,
    read_raw_strings,
)
from cohortwise.sources.stores import (
    latest_by_way,
    read_ae_summary,
    read_prepared,
    version_name,
    write_ae_summary,
    write_prepared,
)
from cohortwise.sources.tables import flawed_inforce, inforce, table


def _as_csv(df, name):
    path = new_table_path(df.sparkSession, name)
    df.write.csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return path


def query_read_inforce(spark, sf_dir):
    path = _as_csv(inforce(spark, sf_dir), "inforce-csv")
    return read_inforce(spark, path, fmt="csv")


def query_read_raw_strings(spark, sf_dir):
    path = _as_csv(flawed_inforce(spark, sf_dir), "flawed-csv")
    return read_raw_strings(spark, path, fmt="csv")


def query_land_source(spark, sf_dir):
    """What landing the flawed CSV has observed: failing cells per measure, kinds of the others."""
    path = _as_csv(flawed_inforce(spark, sf_dir), "flawed-csv")
    landed = land_csv(spark, path, new_table_path(spark, "landed"))
    rows = [(c, kind, landed.not_numbers.get(c), landed.row_count) for c, kind in landed.kinds.items()]
    return spark.createDataFrame(rows, "column string, kind string, not_numbers bigint, row_count bigint")


def query_read_malformed(spark, sf_dir):
    """Records with a cell too many or too few, out of a CSV that holds some of either."""
    quantity = F.col("l_quantity")
    whole = F.concat_ws(",", F.concat(F.lit("P"), "l_orderkey"), "l_linenumber", "l_returnflag")
    line = (
        F.when(quantity == 50, F.concat(whole, F.lit(",extra")))
        .when(quantity == 49, F.concat(F.lit("P"), "l_orderkey"))
        .otherwise(whole)
    )
    path = new_table_path(spark, "malformed-csv")
    lines = table(spark, sf_dir, "lineitem").select(line.alias("Policy_Number,Duration,MAC"))
    lines.write.csv(path, header=True, sep="\x01", quote="")
    return malformed_records(spark, path)


def query_coerce_core_numeric(spark, sf_dir):
    df = coerce_core_numeric(flawed_inforce(spark, sf_dir))
    return df.select("Policy_Number", "MAC", "MOC", "MEC", "MAF", "MEF")


def query_policy_key_string(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_quantity") != 50, F.col("l_orderkey")).alias("Policy_Number"),
        F.col("l_linenumber").alias("Duration"),
    )
    return policy_key_string(lines)


def query_write_prepared(spark, sf_dir):
    """Folders named by a number and by text with leading zeros, read back as they were."""
    root = new_table_path(spark, "study")
    number = F.col("Duration").cast("string")
    coded = inforce(spark, sf_dir).withColumn(
        "Plan_Code", F.when(F.col("Duration") % 3 != 0, F.concat(F.lit("00"), number)).otherwise(number)
    )
    path = write_prepared(coded, root, partition_by=["Study_Year", "Plan_Code"])
    return read_prepared(spark, path)


def query_write_ae_summary(spark, sf_dir):
    """Two runs of several summaries a way, two of them with one name; the last of each way in
    the newest run is read back."""
    root = new_table_path(spark, "study")
    data = inforce(spark, sf_dir).withColumn("Smoker_Study_Year", F.col("Study_Year"))
    runs = (
        [["Smoker", "Gender"], ["Gender"]],
        [["Smoker"], ["Smoker_Study_Year"], ["Smoker", "Gender"], ["Smoker", "Study_Year"]],
    )
    for groupings in runs:
        ranked = ranked_summary(data, groupings, "AE_Ratio_Amount")
        path = write_ae_summary(ranked, root, version_name())
    latest = latest_by_way(spark.read.parquet(path))
    return rounded(latest).select(
        "scenario",
        "way",
        "cohort_rank",
        "Dimensions",
        "Sum_MAC",
        "Sum_MOC",
        "Sum_MEC",
        "Sum_MAF",
        "Sum_MEF",
        "AE_Ratio_Count",
        "AE_Ratio_Amount",
        *INTERVALS,
    )


def query_read_ae_summary(spark, sf_dir):
    """A summary kept as CSV with a column too many is read back with the twelve it needs."""
    summary = ae_summary(inforce(spark, sf_dir), ["Risk_Class", "Product_Group"])
    ordered = ae_sort(summary.withColumn("Analyst_Name", F.lit("x")), "AE_Ratio_Amount")
    path = _as_csv(ordered, "summary-csv")
    df = read_ae_summary(spark, path, fmt="csv", allow_empty=False)
    return rounded(df).withColumn("Sum_MAC", F.col("Sum_MAC").cast("bigint"))


def query_profile_summary(spark, sf_dir):
    return profile_summary(inforce(spark, sf_dir))


def query_profile_nulls(spark, sf_dir):
    return profile_nulls(coerce_core_numeric(flawed_inforce(spark, sf_dir)))


def query_profile_feature_types(spark, sf_dir):
    return profile_feature_types(inforce(spark, sf_dir))


def query_default_age_band(spark, sf_dir):
    banded = default_age_band(inforce(spark, sf_dir))
    return banded.groupBy("Issue_Age_Band").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("Issue_Age").alias("youngest"),
        F.max("Issue_Age").alias("oldest"),
    )


def query_profile_sketches(spark, sf_dir):
    """Rows and distinct policies per study year out of stored sketches, against the exact count."""
    df = inforce(spark, sf_dir).select("Policy_Number", "Duration", "Study_Year")
    path, store = new_table_path(spark, "sketched"), new_table_path(spark, "sketches")
    df.write.partitionBy("Study_Year").parquet(path)
    refresh_sketches(spark, path, store, df.schema)
    years = [r["Study_Year"] for r in df.select("Study_Year").distinct().collect()]
    parts = [
        sketched_summary(spark, path, store, {"Study_Year": year}).withColumn("Study_Year", F.lit(year)) for year in sorted(years)
    ]
    found = functools.reduce(lambda a, b: a.unionAll(b), parts)
    exact = df.groupBy("Study_Year").agg(F.count_distinct("Policy_Number").alias("exact"))
    near = F.abs(F.col("unique_policy_count") - F.col("exact")) <= 0.02 * F.col("exact")
    return found.join(exact, "Study_Year").select("Study_Year", "total_rows", near.alias("within_two_percent"))


QUERIES = {
    name.removeprefix("query_"): value
    for name, value in list(globals().items())
    if name.startswith("query_")
}

_COLUMNS = (
    "Policy_Number Duration MAC MOC MEC MAF MEF COLA Face_Amount Issue_Age Gender Smoker "
    "Risk_Class Product_Group Study_Year"
).split()
_FLAWED_COLUMNS = (
    "Policy_Number Duration MAC MOC MEC MAF MEF COLA Face_Amount Issue_Age Gender"
).split()
_NUMERIC = [c for c in _COLUMNS if c not in (
    "Policy_Number", "Gender", "Smoker", "Risk_Class", "Product_Group"
)]
_ALWAYS = ("MAC", "MOC", "MEC", "MAF", "MEF", "Face_Amount", "Issue_Age")


def _feature_type(column: str) -> str:
    if column in _ALWAYS:
        kind = "'numerical'"
    elif column in _NUMERIC:
        kind = "case when n > 20 then 'numerical' else 'categorical' end"
    else:
        kind = "'categorical'"
    counted = f'(select count(distinct "{column}") as n from inforce)'
    return f"select '{column}' as column_name, {kind} as feature_type from {counted}"


def _null_count(column: str) -> str:
    value = f'"{column}"'
    if column in ("MAC", "MOC", "MEC", "MAF", "MEF"):
        value = f"({sql_number(value)})"
    return (
        f"select '{column}' as column_name, cast(count(*) - count({value}) as bigint) "
        "as null_count from flawed"
    )


_EDGE = "lo + (hi - lo) / 4 * {0}"

_MEASURED = ("MAC", "MOC", "MEC", "MAF", "MEF")
_NO_CELL = "('', 'n/a', 'NA', 'NULL', 'NaN', 'nan', 'null', 'None', 'N/A')"


def _landed(column: str) -> str:
    text = f'"{column}"'
    cell = f"{text} is not null and {text} not in {_NO_CELL}"
    no_number = f"count(*) filter (where {cell} and ({sql_number(text)}) is null)"
    whole = f"bool_and(regexp_matches(trim({text}), '^[+-]?\\d+$')) filter (where {cell})"
    kind = f"case when {no_number} > 0 then 'text' when {whole} then 'whole' else 'number' end"
    bad = "null"
    if column in _MEASURED:
        bad = f"count(*) filter (where not {sql_missing(text)} and ({sql_number(text)}) is null)"
        kind = "'number'"
    if column == "Policy_Number":
        kind = "'text'"
    return f"""select '{column}' as "column", {kind} as kind, cast({bad} as bigint) as not_numbers,
  count(*) as row_count from flawed"""


SQL = {
    "profile_sketches": f"""with {INFORCE} select "Study_Year", count(*) as total_rows, true as within_two_percent
from inforce group by 1""",
    "land_source": f"with {FLAWED} " + " union all ".join(map(_landed, _FLAWED_COLUMNS)),
    "read_inforce": f"with {INFORCE} select * from inforce",
    "read_raw_strings": f"with {FLAWED} select "
    + ", ".join(f"coalesce(\"{c}\", '') as \"{c}\"" for c in _FLAWED_COLUMNS)
    + " from flawed",
    "read_malformed": """select 'P' || cast(l_orderkey as varchar) || case when l_quantity = 50
  then ',' || cast(l_linenumber as varchar) || ',' || l_returnflag || ',extra' else '' end as record
from lineitem where l_quantity in (49, 50)""",
    "coerce_core_numeric": f'with {FLAWED} select "Policy_Number", '
    + ", ".join(
        f"{sql_number(chr(34) + c + chr(34))} as \"{c}\"" for c in ("MAC", "MOC", "MEC", "MAF", "MEF")
    )
    + " from flawed",
    "policy_key_string": "select cast(case when l_quantity <> 50 then l_orderkey end as varchar) "
    'as "Policy_Number", l_linenumber as "Duration" from lineitem',
    "write_prepared": f"""with {INFORCE} select *, case when "Duration" % 3 <> 0 then '00' else '' end
  || cast("Duration" as varchar) as "Plan_Code" from inforce""",
    "write_ae_summary": f"""with {INFORCE},
named as (select *, "Study_Year" as "Smoker_Study_Year" from inforce),
one as ({sql_totals(["Smoker_Study_Year"], source="named")}),
two as ({sql_totals(["Smoker", "Study_Year"])}),
summaries as (
  select 1 as way, * exclude ("Smoker_Study_Year") from one
  union all
  select 2, * exclude ("Smoker", "Study_Year") from two),
{sql_intervals("summaries")}
select 'smoker_study_year' as scenario, way, row_number() over (partition by way
    order by "AE_Ratio_Amount" desc nulls last, "Dimensions") as cohort_rank,
  "Dimensions", {SQL_SUMS}, {SQL_RATIOS}, {SQL_INTERVALS} from bounded""",
    "read_ae_summary": f"""with {INFORCE}, cohorts as ({sql_totals(["Risk_Class", "Product_Group"])}),
{sql_intervals("cohorts")}
select {SQL_SUMMARY}, row_number() over (
  order by "AE_Ratio_Amount" desc nulls last, "Dimensions") as cohort_rank from bounded""",
    "profile_summary": f"""with {INFORCE} select count(*) as total_rows,
  count(distinct "Policy_Number") as unique_policy_count from inforce""",
    "profile_nulls": f"with {FLAWED} " + " union all ".join(map(_null_count, _FLAWED_COLUMNS)),
    "profile_feature_types": f"with {INFORCE} " + " union all ".join(map(_feature_type, _COLUMNS)),
    "default_age_band": f"""with {INFORCE},
ends as (select cast(min("Issue_Age") as double) as lo, cast(max("Issue_Age") as double) as hi
  from inforce),
bands as (
  select i, case when i = 0 then lo else {_EDGE.format("i")} end as low_edge,
    case when i = 3 then hi else {_EDGE.format("(i + 1)")} end as high_edge
  from ends, (values (0), (1), (2), (3)) as t(i))
select {sql_edge("low_edge")} || ' to ' || {sql_edge("high_edge")} as "Issue_Age_Band",
  count(*) as n_rows, min("Issue_Age") as youngest, max("Issue_Age") as oldest
from inforce join bands
  on "Issue_Age" <= high_edge and ("Issue_Age" > low_edge or (i = 0 and "Issue_Age" >= low_edge))
group by 1""",
}
