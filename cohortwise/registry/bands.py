"""Cohort dimensions: missing values, bands and regroups."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortwise.functions.values import as_number, missing
from cohortwise.operators.dimensions import (
    band_custom,
    band_equal_width,
    band_quantile,
    check_band_source,
    dimension_values,
    regroup,
)
from cohortwise.registry.common import (
    FLAWED,
    INFORCE,
    sql_edge,
    sql_missing,
    sql_number,
    typed_flaws,
)
from cohortwise.sources.tables import flawed_inforce, inforce

MAPPING = {
    "Preferred": ["1-URGENT", "2-HIGH"],
    "Standard": ["3-MEDIUM", "4-NOT SPECIFIED"],
}
CUSTOM_EDGES = [1000, 25000, 50000.5, None]
CUSTOM_LABELS = ["up to 25K", "25K to 50K", "50K+"]


def _counted(df, band, value="Face_Amount"):
    return df.groupBy(band).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
    )


def query_missing_mask(spark, sf_dir):
    df = flawed_inforce(spark, sf_dir)
    masks = {c: missing(df, c) for c in ("MAC", "MOC", "MEC", "MEF", "Face_Amount", "Gender")}
    return df.agg(*[F.count_if(m).alias(f"missing_{c}") for c, m in masks.items()])


def query_coerce_band_source(spark, sf_dir):
    """Unreadable values of every text column, and the values of one that can be banded."""
    df = flawed_inforce(spark, sf_dir)
    number = as_number(df, "Face_Amount")
    bad = check_band_source(df, "MEF")
    return df.agg(
        F.lit(bad).alias("unreadable_mef"),
        F.count_if(~missing(df, "Face_Amount") & number.isNull()).alias("unreadable_face"),
        F.count(number).alias("numbers"),
        F.min(number).alias("lowest"),
        F.max(number).alias("highest"),
    )


def query_band_equal_width(spark, sf_dir):
    df = inforce(spark, sf_dir)
    return _counted(band_equal_width(df, "Face_Amount", "Face_Amount_Band", 4), "Face_Amount_Band")


def query_band_quantile(spark, sf_dir):
    df = inforce(spark, sf_dir)
    return _counted(band_quantile(df, "Face_Amount", "Face_Amount_Band", 4), "Face_Amount_Band")


def query_band_custom(spark, sf_dir):
    df = typed_flaws(spark, sf_dir)
    banded = band_custom(df, "Face_Amount", "Face_Amount_Band", CUSTOM_EDGES, CUSTOM_LABELS)
    return _counted(banded, "Face_Amount_Band")


def query_regroup(spark, sf_dir):
    df = inforce(spark, sf_dir)
    grouped = regroup(df, "Risk_Class", "Risk_Class_Group", MAPPING)
    return grouped.groupBy("Risk_Class", "Risk_Class_Group").agg(F.count(F.lit(1)).alias("n_rows"))


def query_regroup_keep_unmapped(spark, sf_dir):
    df = flawed_inforce(spark, sf_dir)
    grouped = regroup(df, "Gender", "Gender_Group", {"Open": ["O"]}, keep_unmapped=True)
    return grouped.groupBy("Gender_Group").agg(F.count(F.lit(1)).alias("n_rows"))


def query_dimension_values(spark, sf_dir):
    df = inforce(spark, sf_dir)
    return dimension_values(
        band_equal_width(df, "Issue_Age", "Age_Band", 6), "Age_Band"
    )


QUERIES = {
    name.removeprefix("query_"): value
    for name, value in list(globals().items())
    if name.startswith("query_")
}


def _equal_width(column: str, bins: int) -> str:
    edge = f"lo + (hi - lo) / {bins} * "
    return f"""ends as (
  select cast(min("{column}") as double) as lo, cast(max("{column}") as double) as hi
  from inforce),
edges as (
  select i, lo as least, case when i = 0 then lo else {edge} i end as low_edge,
    case when i = {bins - 1} then hi else {edge} (i + 1) end as high_edge
  from ends, (select unnest(generate_series(0, {bins - 1})) as i))"""


_IN_BAND = """"{0}" <= high_edge and ("{0}" > low_edge or "{0}" = least)
  and (i = 0 or "{0}" > low_edge)"""
_BAND_LABEL = f"{sql_edge('low_edge')} || ' to ' || {sql_edge('high_edge')}"

_QUANTILES = """cuts as (
  select quantile_cont("Face_Amount", [0.0, 0.25, 0.5, 0.75, 1.0]) as q from inforce),
edges as (
  select i, q[1] as least, q[i + 1] as low_edge, q[i + 2] as high_edge
  from cuts, (select unnest(generate_series(0, 3)) as i))"""

_FACE_BANDS = f"""select {_BAND_LABEL} as "Face_Amount_Band", count(*) as n_rows,
  min("Face_Amount") as lowest, max("Face_Amount") as highest
from inforce join edges on {_IN_BAND.format("Face_Amount")}
group by 1"""

_FACE = sql_number('"Face_Amount"')

SQL = {
    "missing_mask": f"with {FLAWED} select "
    + ", ".join(
        f"cast(count(*) filter (where {sql_missing(chr(34) + c + chr(34))}) as bigint) "
        f'as "missing_{c}"'
        for c in ("MAC", "MOC", "MEC", "MEF", "Face_Amount", "Gender")
    )
    + " from flawed",
    "coerce_band_source": f"""with {FLAWED},
read as (select {sql_missing('"MEF"')} as mef_gone, {sql_number('"MEF"')} as mef,
  {sql_missing('"Face_Amount"')} as face_gone, {_FACE} as face from flawed)
select cast(count(*) filter (where not mef_gone and mef is null) as bigint) as unreadable_mef,
  cast(count(*) filter (where not face_gone and face is null) as bigint) as unreadable_face,
  count(face) as numbers, min(face) as lowest, max(face) as highest from read""",
    "band_equal_width": f"with {INFORCE}, {_equal_width('Face_Amount', 4)} {_FACE_BANDS}",
    "band_quantile": f"with {INFORCE}, {_QUANTILES} {_FACE_BANDS}",
    "band_custom": f"""with {FLAWED}, read as (select {_FACE} as face from flawed)
select case when face is null then 'Missing' when face < 1000 then 'Out of Range'
    when face <= 25000 then 'up to 25K' when face <= 50000.5e0 then '25K to 50K'
    else '50K+' end as "Face_Amount_Band",
  count(*) as n_rows, min(face) as lowest, max(face) as highest
from read group by 1""",
    "regroup": f"""with {INFORCE} select "Risk_Class",
  case when "Risk_Class" in ('1-URGENT', '2-HIGH') then 'Preferred'
    when "Risk_Class" in ('3-MEDIUM', '4-NOT SPECIFIED') then 'Standard'
    else 'Other' end as "Risk_Class_Group", count(*) as n_rows
from inforce group by all""",
    "regroup_keep_unmapped": f"""with {FLAWED}
select case when {sql_missing('"Gender"')} then 'Missing' when "Gender" = 'O' then 'Open'
  else "Gender" end as "Gender_Group", count(*) as n_rows from flawed group by 1""",
    "dimension_values": f"""with {INFORCE}, {_equal_width('Issue_Age', 6)}
select distinct {_BAND_LABEL} as value
from inforce join edges on {_IN_BAND.format("Issue_Age")}""",
}
