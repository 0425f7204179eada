"""Tables behind the exhibits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortwise.operators.exhibits import (
    exhibit_mask,
    exhibit_rows,
    exhibit_top_n,
    hierarchy_layout,
    hierarchy_rollup,
    hierarchy_share,
    metric_view,
)
from cohortwise.registry.common import rounded, sql_intervals
from cohortwise.registry.masks import SHARED_SQL, shared_summary

DIGITS = {
    "metric_actual_true": 2,
    "metric_expected_true": 0,
    "metric_ratio_true": 6,
    "metric_ci_lower_true": 4,
    "metric_ci_upper_true": 4,
    "treemap_size_true": 0,
    "metric_ratio_display": 6,
    "metric_ci_lower_display": 4,
    "metric_ci_upper_display": 4,
    "color_value_display": 6,
}


def _flat(df, *lists):
    return rounded(df.withColumns({c: F.array_join(c, "|") for c in lists}), DIGITS)


def query_metric_view(spark, sf_dir):
    keyless = shared_summary(spark, sf_dir).drop("group_columns", "group_values")
    return rounded(metric_view(keyless, "amount"), DIGITS)


def query_exhibit_rows(spark, sf_dir):
    rows = exhibit_rows(shared_summary(spark, sf_dir), "count")
    rows = rows.drop("dimension_columns", "hierarchy_parts", "caution_flags")
    return rounded(rows, DIGITS)


def query_exhibit_mask(spark, sf_dir):
    masked = exhibit_mask(shared_summary(spark, sf_dir).select("cohort_rank", "Dimensions"))
    return _flat(masked, "dimension_columns", "hierarchy_parts", "caution_flags")


def query_exhibit_top_n(spark, sf_dir):
    return rounded(exhibit_top_n(exhibit_rows(shared_summary(spark, sf_dir), "amount"), 7), DIGITS)


def _nodes(spark, sf_dir):
    return hierarchy_rollup(exhibit_rows(shared_summary(spark, sf_dir), "count"))


def query_hierarchy_rollup(spark, sf_dir):
    digits = {"size": 4, "actual": 4, "expected": 4, "ratio": 6}
    return rounded(_flat(_nodes(spark, sf_dir), "path", "parent"), digits)


def query_hierarchy_share(spark, sf_dir):
    placed = hierarchy_share(_nodes(spark, sf_dir))
    flat = _flat(placed, "path", "parent").select(
        "path", "depth", "parent", "first_rank", "share", "offset", "axis"
    )
    return rounded(flat, {"share": 6, "offset": 6})


def query_hierarchy_layout(spark, sf_dir):
    """Leaf rectangles of the tree, on a drawing of 1,000 by 600."""
    drawn = hierarchy_layout(_nodes(spark, sf_dir), area=(0.0, 0.0, 1000.0, 600.0))
    digits = dict.fromkeys(("x", "y", "width", "height", "size"), 3)
    return rounded(_flat(drawn, "path"), {**digits, "ratio": 6})


QUERIES = {
    name.removeprefix("query_"): value
    for name, value in list(globals().items())
    if name.startswith("query_")
}

_REF = "'row_' || lpad(cast(cohort_rank as varchar), 4, '0')"
_SHOWN = f"""case when sensitive then '[masked cohort label]' else "Dimensions" end
    as sanitized_dimensions"""
_REASON = "case when sensitive then 'sensitive_or_disallowed_dimension' end as masking_reason"


def _clipped(value: str, name: str) -> str:
    return f"""round(least(greatest({value}, 0), 3), 4) as metric_{name}_display,
  coalesce({value} < 0 or {value} > 3, false) as metric_{name}_clipped"""


def _metric(kind: str, size: str, actual: str) -> str:
    ratio, low, high = f'"AE_Ratio_{kind}"', f'"AE_{kind}_CI_Lower"', f'"AE_{kind}_CI_Upper"'
    return f"""round("{actual}", 2) as metric_actual_true,
  round("{size}", 0) as metric_expected_true, round({ratio}, 6) as metric_ratio_true,
  round({low}, 4) as metric_ci_lower_true, round({high}, 4) as metric_ci_upper_true,
  round(least(greatest({ratio}, 0), 3), 6) as metric_ratio_display,
  coalesce({ratio} < 0 or {ratio} > 3, false) as metric_ratio_clipped,
  {_clipped(low, "ci_lower")}, {_clipped(high, "ci_upper")},
  {low} is not null and {high} is not null as metric_ci_available"""


_BOUNDED = f"with {SHARED_SQL}, {sql_intervals('ranked')}"

_TREE = f"""with {SHARED_SQL},
pathed as (
  select cohort_rank, "Sum_MAC", "Sum_MEC", "AE_Ratio_Count",
    case when sensitive then [{_REF}] else string_split("Dimensions", ' | ') end as parts
  from ranked),
exploded as (
  select *, unnest(generate_series(1, len(parts))) as depth from pathed),
nodes as (
  select array_to_string(parts[1:depth], '|') as path, depth, parts[depth] as label,
    array_to_string(parts[1:depth - 1], '|') as parent, min(cohort_rank) as first_rank,
    sum(greatest("Sum_MEC", 0)) as size, sum("Sum_MAC") as actual, sum("Sum_MEC") as expected,
    case when sum("Sum_MEC") > 0 then sum("Sum_MAC") / sum("Sum_MEC")
      else avg("AE_Ratio_Count") end as ratio
  from (select * from exploded) group by all)"""

SQL = {
    "metric_view": f"""{_BOUNDED}
select cohort_rank, "Dimensions", round("Sum_MAF", 2) as metric_actual_true,
  round("Sum_MEF", 0) as metric_expected_true, round("AE_Ratio_Amount", 6) as metric_ratio_true,
  round("AE_Amount_CI_Lower", 4) as metric_ci_lower_true,
  round("AE_Amount_CI_Upper", 4) as metric_ci_upper_true,
  round("Sum_MEF", 0) as treemap_size_true from bounded""",
    "exhibit_rows": f"""{_BOUNDED}
select cohort_rank as source_row_number, {_REF} as evidence_ref, {_SHOWN},
  case when sensitive then {_REF} else "Dimensions" end as display_label, {_REASON},
  {_metric("Count", "Sum_MEC", "Sum_MAC")},
  round("Sum_MEC", 0) as treemap_size_true,
  round(least(greatest("AE_Ratio_Count", 0), 2), 6) as color_value_display,
  coalesce("AE_Ratio_Count" < 0 or "AE_Ratio_Count" > 2, false) as color_value_saturated
from bounded""",
    "exhibit_mask": f"""with {SHARED_SQL}
select cohort_rank, {_REF} as evidence_ref, {_SHOWN},
  case when sensitive then {_REF} else "Dimensions" end as display_label,
  case when sensitive then '[masked dimension]' else replace(dims, ',', '|') end
    as dimension_columns,
  case when sensitive then {_REF} else replace("Dimensions", ' | ', '|') end as hierarchy_parts,
  {_REASON},
  case when sensitive then 'sensitive_or_disallowed_dimension' else '' end as caution_flags
from ranked""",
    "exhibit_top_n": f"""{_BOUNDED}
select {_REF} as evidence_ref, cohort_rank as source_row_number, cohort_rank as visual_rank,
  {_SHOWN}, case when sensitive then '[masked dimension]' else replace(dims, ',', ' | ') end
    as dimension_columns,
  {_metric("Amount", "Sum_MEF", "Sum_MAF")}, {_REASON},
  case when sensitive then 'sensitive_or_disallowed_dimension' else '' end as caution_flags
from bounded where cohort_rank <= 7""",
    "hierarchy_rollup": f"""{_TREE}
select path, cast(depth as int) as depth, label, parent, first_rank, round(size, 4) as size,
  round(actual, 4) as actual, round(expected, 4) as expected, round(ratio, 6) as ratio
from nodes""",
    "hierarchy_share": f"""{_TREE}
select path, cast(depth as int) as depth, parent, first_rank,
  round(size / sum(size) over (partition by parent), 6) as share,
  round(coalesce(sum(size) over (partition by parent order by first_rank
      rows between unbounded preceding and 1 preceding), 0)
    / sum(size) over (partition by parent), 6) as "offset",
  case when depth % 2 = 1 then 'width' else 'height' end as axis
from nodes""",
    "hierarchy_layout": f"""{_TREE.replace("with ", "with recursive ", 1)},
shares as (
  select *, size / sum(size) over (partition by parent) as share,
    coalesce(sum(size) over (partition by parent order by first_rank
      rows between unbounded preceding and 1 preceding), 0)
      / sum(size) over (partition by parent) as start
  from nodes),
laid as (
  select path, label, depth, size, ratio, 1000.0e0 * start as x, 0.0e0 as y,
    1000.0e0 * share as width, 600.0e0 as height from shares where depth = 1
  union all
  select s.path, s.label, s.depth, s.size, s.ratio,
    case when s.depth % 2 = 1 then x + width * start else x end,
    case when s.depth % 2 = 0 then y + height * start else y end,
    case when s.depth % 2 = 1 then width * share else width end,
    case when s.depth % 2 = 0 then height * share else height end
  from shares s join laid p on s.parent = p.path and s.depth = p.depth + 1)
select path, label, round(x, 3) as x, round(y, 3) as y, round(width, 3) as width,
  round(height, 3) as height, round(size, 3) as size, round(ratio, 6) as ratio
from laid where path not in (select parent from nodes)""",
}
