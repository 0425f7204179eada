"""Masking of labels, filters and small cohorts, and the packet."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortwise.functions.labels import (
    EMAIL_PATTERN,
    PHONE_PATTERN,
    SENSITIVE_TERMS,
    SSN_PATTERN,
    dimension_tokens,
    may_hold_sensitive_value,
    parse_label,
    parse_warnings,
    sensitive_dimension,
    sensitive_value,
)
from cohortwise.operators.cohorts import ae_summary, ranked_summary
from cohortwise.operators.masking import (
    mask_cohorts,
    mask_filters,
    packet_rows,
    packet_warnings,
)
from cohortwise.registry.common import (
    INFORCE,
    SQL_INTERVALS,
    SQL_RATIOS,
    SQL_SUMS,
    rounded,
    sql_intervals,
    sql_totals,
)
from cohortwise.sources.tables import inforce, table

# Groupings of the shared summary; two of them use columns that may not be shown.
SHARED = [["Gender"], ["Smoker", "Study_Year"], ["Gender", "Member_Group"], ["riskId"]]
MIN_SHARED_CLAIMS = 900


def shared_view(spark, sf_dir):
    return inforce(spark, sf_dir).withColumnsRenamed(
        {"Product_Group": "Member_Group", "Risk_Class": "riskId"}
    )


def shared_summary(spark, sf_dir):
    """A stored summary of several groupings, ranked by its amount ratio."""
    return ranked_summary(shared_view(spark, sf_dir), SHARED, "AE_Ratio_Amount", within=())


def _names(spark, sf_dir):
    """Column names of every style, one per part."""
    size = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_size") % 7 == 0, F.concat("p_brand", F.lit("Id")))
        .when(F.col("p_size") % 7 == 1, F.concat(F.lit("customerEmail_"), "p_type"))
        .when(F.col("p_size") % 7 == 2, F.concat(F.lit("Zip Code "), "p_brand"))
        .when(F.col("p_size") % 7 == 3, F.col("p_name"))
        .when(F.col("p_size") % 7 == 4, F.concat(F.lit("policyNumber"), size))
        .when(F.col("p_size") % 7 == 5, F.lit("--"))
        .otherwise(F.concat("p_type", F.lit("-identity2X"), size))
        .alias("name"),
    )


def _labels(spark, sf_dir):
    """Cohort labels of every shape, one per customer."""
    key, group = F.col("c_custkey") % 6, F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(key == 0, F.concat(F.lit("Gender=M | Group="), group))
        .when(key == 1, F.concat(F.lit("malformed "), "c_name"))
        .when(key == 2, F.concat(F.lit(" Plan = a=b | =x | "), group))
        .when(key == 3, F.concat(F.lit("Policy_Number="), "c_name", F.lit(" | Smoker=")))
        .when(key == 4, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Band=0 to 5| Group="), group, F.lit(" |  | x=1")))
        .alias("label"),
    )


def _filter_specs(spark, sf_dir):
    """Filters that runs were made with, one per event."""
    user = F.col("user_id").cast("string")
    kind, key = F.col("event_type"), F.col("event_id") % 5
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "click", "Gender")
        .when(kind == "view", "Policy_Number")
        .when(kind == "purchase", "memberZip")
        .when(kind == "error", "Smoker")
        .otherwise("Product_Group")
        .alias("column"),
        F.when(key == 0, "!=").otherwise("=").alias("operator"),
        F.when(key == 0, F.concat(F.lit("user"), user, F.lit("@mail.example.com")))
        .when(key == 1, F.concat(F.lit(" +1 (555) 010-"), user))
        .when(key == 2, F.concat(F.lit("123-45-"), F.lpad(user, 4, "0")))
        .when(key == 3, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Term "), user))
        .alias("value"),
    )


def query_dimension_tokens(spark, sf_dir):
    tokens = dimension_tokens(F.col("name"))
    return _names(spark, sf_dir).withColumn("tokens", F.array_join(tokens, ","))


def query_sensitive_dimension(spark, sf_dir):
    return _names(spark, sf_dir).withColumn("sensitive", sensitive_dimension(F.col("name")))


def query_parse_label(spark, sf_dir):
    pairs = parse_label(F.col("label"))
    return _labels(spark, sf_dir).select(
        "c_custkey",
        F.array_join(F.transform(pairs, lambda p: p["column"]), ";").alias("columns"),
        F.array_join(F.transform(pairs, lambda p: p["value"]), ";").alias("values"),
        parse_warnings(F.col("label")).alias("warnings"),
    )


def query_sensitive_value(spark, sf_dir):
    """Words of every document that look like personal data."""
    words = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.split("text", "[ \\t\\r\\n]+").alias("words")
    )
    found = F.size(F.filter("words", sensitive_value))
    return words.select(
        "doc_id",
        F.size("words").cast("bigint").alias("words"),
        F.when(may_hold_sensitive_value(F.col("text")), found).otherwise(0).cast("bigint").alias("sensitive_words"),
    )


def query_mask_filters(spark, sf_dir):
    return mask_filters(_filter_specs(spark, sf_dir))


def query_mask_sensitive_cohorts(spark, sf_dir):
    masked = mask_cohorts(shared_summary(spark, sf_dir), 0)
    return masked.select(
        "cohort_rank",
        "Dimensions",
        F.array_join("Dimension_Columns", ",").alias("dimension_columns"),
        "low_credibility",
        "masking_reason",
    )


def query_mask_low_volume(spark, sf_dir):
    df = ae_summary(inforce(spark, sf_dir), ["Risk_Class", "Product_Group"])
    masked = mask_cohorts(df, MIN_SHARED_CLAIMS)
    return masked.select("Dimensions", "Sum_MAC", "low_credibility", "masking_reason")


def query_packet_rows(spark, sf_dir):
    rows = packet_rows(shared_summary(spark, sf_dir), masking_min_claims=MIN_SHARED_CLAIMS)
    return rounded(rows).select(
        "evidence_ref",
        "Dimensions",
        F.array_join("Dimension_Columns", ",").alias("dimension_columns"),
        F.col("Sum_MAC").cast("bigint").alias("Sum_MAC"),
        "Sum_MOC",
        "Sum_MEC",
        "Sum_MAF",
        "Sum_MEF",
        "AE_Ratio_Count",
        "AE_Ratio_Amount",
        "AE_Count_CI_Lower",
        "AE_Count_CI_Upper",
        "AE_Amount_CI_Lower",
        "AE_Amount_CI_Upper",
        "low_credibility",
        "masking_reason",
        F.array_join("caution_flags", ",").alias("caution_flags"),
    )


def query_packet_warnings(spark, sf_dir):
    found = packet_warnings(shared_summary(spark, sf_dir), filters=_filter_specs(spark, sf_dir))
    return found.select(
        "code", "message", F.array_join("evidence_refs", ",").alias("evidence_refs")
    )


QUERIES = {
    name.removeprefix("query_"): value
    for name, value in list(globals().items())
    if name.startswith("query_")
}

_NAMES = """names as (
  select p_partkey, case p_size % 7 when 0 then p_brand || 'Id'
    when 1 then 'customerEmail_' || p_type when 2 then 'Zip Code ' || p_brand when 3 then p_name
    when 4 then 'policyNumber' || cast(p_size as varchar) when 5 then '--'
    else p_type || '-identity2X' || cast(p_size as varchar) end as name
  from part),
split as (
  select *, list_filter(regexp_split_to_array(lower(
      regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+'),
    lambda w: w <> '') as words
  from names),
joined as (
  select *, array_to_string(words, '_') as whole from split),
tokens as (
  select *, case when len(words) = 0 then words
    when list_contains(words, whole) then words
    else list_append(words, whole) end as tokens from joined)"""

_TERMS = "[" + ", ".join(f"'{t}'" for t in SENSITIVE_TERMS) + "]"


def _looks_sensitive(value: str) -> str:
    patterns = (EMAIL_PATTERN, PHONE_PATTERN, SSN_PATTERN)
    return " or ".join(f"regexp_matches(trim({value}), '{p}')" for p in patterns)


_LABELS = """labels_made as (
  select c_custkey, coalesce(case c_custkey % 6 when 0 then 'Gender=M | Group=' || c_mktsegment
    when 1 then 'malformed ' || c_name when 2 then ' Plan = a=b | =x | ' || c_mktsegment
    when 3 then 'Policy_Number=' || c_name || ' | Smoker=' when 4 then null
    else 'Band=0 to 5| Group=' || c_mktsegment || ' |  | x=1' end, 'nan') as label
  from customer),
pieces as (
  select c_custkey, i, string_split(label, ' | ')[i] as piece
  from labels_made, unnest(generate_series(1, len(string_split(label, ' | ')))) as t(i)),
parsed as (
  select *, trim(split_part(piece, '=', 1)) as name,
    trim(substr(piece, strpos(piece, '=') + 1)) as value,
    strpos(piece, '=') > 0 and trim(split_part(piece, '=', 1)) <> '' as usable from pieces)"""

_SPECS = """specs as (
  select event_id, case event_type when 'click' then 'Gender' when 'view' then 'Policy_Number'
      when 'purchase' then 'memberZip' when 'error' then 'Smoker' else 'Product_Group' end as col,
    case when event_id % 5 = 0 then '!=' else '=' end as operator,
    case event_id % 5 when 0 then 'user' || user_id || '@mail.example.com'
      when 1 then ' +1 (555) 010-' || user_id
      when 2 then '123-45-' || lpad(substr(cast(user_id as varchar), 1, 4), 4, '0')
      when 3 then null else 'Term ' || user_id end as val
  from events),
judged as (
  select *, col in ('Policy_Number', 'memberZip') or coalesce(
    """ + _looks_sensitive("val") + """, false) as masked
  from specs)"""


def _shared_sql() -> str:
    rows = []
    for group in SHARED:
        keys = ", ".join(f'"{c}"' for c in group)
        sensitive = "Member_Group" in group or "riskId" in group
        rows.append(
            f"select * exclude ({keys}), '{','.join(group)}' as dims, "
            f"{str(sensitive).lower()} as sensitive from ({sql_totals(group, source='shared')})"
        )
    return f"""{INFORCE}, shared as (
  select *, "Product_Group" as "Member_Group", "Risk_Class" as "riskId" from inforce),
cohorts as ({" union all ".join(rows)}),
ranked as (
  select *, row_number() over (order by "AE_Ratio_Amount" desc nulls last, "Dimensions")
    as cohort_rank from cohorts)"""


_REF = "'row_' || lpad(cast(cohort_rank as varchar), 4, '0')"
_REASON = f"""case when sensitive then 'sensitive_or_disallowed_dimension'
    when "Sum_MAC" < {MIN_SHARED_CLAIMS} then 'low_volume' end"""
SHARED_SQL = _shared_sql()

SQL = {
    "dimension_tokens": f"""with {_NAMES}
select p_partkey, name, array_to_string(tokens, ',') as tokens from tokens""",
    "sensitive_dimension": f"""with {_NAMES}
select p_partkey, name, list_has_any(tokens, {_TERMS}) as sensitive from tokens""",
    "parse_label": f"""with {_LABELS}
select c_custkey, coalesce(string_agg(name, ';' order by i) filter (where usable), '') as columns,
  coalesce(string_agg(value, ';' order by i) filter (where usable), '') as values,
  cast(count(*) filter (where not usable) as int) as warnings
from parsed group by c_custkey""",
    "sensitive_value": """with words as (
  select doc_id, unnest(regexp_split_to_array(text, '[ \\t\\r\\n]+')) as word from documents)
select doc_id, count(*) as words, count(*) filter (where
    """ + _looks_sensitive("word") + """) as sensitive_words
from words group by doc_id""",
    "mask_filters": f"""with {_SPECS}
select event_id, case when masked then '[masked column]' else col end as "column", operator,
  case when masked then '[masked value]' else val end as "value", masked from judged""",
    "mask_sensitive_cohorts": f"""with {SHARED_SQL}
select cohort_rank, case when sensitive then '[masked cohort label]' else "Dimensions" end
    as "Dimensions",
  case when sensitive then '[masked dimension]' else dims end as dimension_columns,
  sensitive as low_credibility,
  case when sensitive then 'sensitive_or_disallowed_dimension' end as masking_reason
from ranked""",
    "mask_low_volume": f"""with {INFORCE}
select case when "Sum_MAC" < {MIN_SHARED_CLAIMS} then '[masked cohort label]' else "Dimensions" end
    as "Dimensions", cast("Sum_MAC" as bigint) as "Sum_MAC",
  "Sum_MAC" < {MIN_SHARED_CLAIMS} as low_credibility,
  case when "Sum_MAC" < {MIN_SHARED_CLAIMS} then 'low_volume' end as masking_reason
from ({sql_totals(["Risk_Class", "Product_Group"])})""",
    "packet_rows": f"""with {SHARED_SQL}, {sql_intervals("ranked")}
select {_REF} as evidence_ref,
  case when {_REASON} is null then "Dimensions" else '[masked cohort label]' end as "Dimensions",
  case when sensitive then '[masked dimension]' else dims end as dimension_columns,
  {SQL_SUMS}, {SQL_RATIOS}, {SQL_INTERVALS},
  {_REASON} is not null as low_credibility, {_REASON} as masking_reason,
  coalesce({_REASON}, '') as caution_flags
from bounded where cohort_rank <= 20""",
    "packet_warnings": f"""with {SHARED_SQL}, {_SPECS}
select 'sensitive_or_disallowed_dimension' as code,
  'A sensitive or disallowed dimension was masked.' as message, {_REF} as evidence_refs
from ranked where sensitive and cohort_rank <= 20
union all
select 'sensitive_filter_masked', 'A sensitive or disallowed filter was masked.', null
where exists (select 1 from judged where masked)""",
}
