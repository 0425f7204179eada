"""Audit tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortwise.operators.audit import (
    SLICES,
    artifact_latest,
    lineage_edges,
    stale_downstream,
    stale_summaries,
    state_fingerprint,
    state_inputs,
    table_fingerprint,
)
from cohortwise.operators.cohorts import ae_summary
from cohortwise.registry.common import INFORCE
from cohortwise.scratch import new_table_path
from cohortwise.sources.digests import manifest_fingerprint, refresh_manifest
from cohortwise.sources.logs import append_batch, compact_log, read_log
from cohortwise.sources.tables import artifact_log, inforce, lineage_log


def query_audit_event_append(spark, sf_dir):
    """Each day's entries appended to one log, read back as steps per tool."""
    entries = artifact_log(spark, sf_dir)
    path = new_table_path(spark, "audit-log")
    # An entry without a time belongs to the second part.
    early = F.coalesce(F.col("entry_ts") < F.lit("2024-01-16").cast("timestamp_ntz"), F.lit(False))
    steps = entries.select(
        F.col("generating_tool").alias("tool_name"),
        F.col("path").alias("output_path"),
        "parameters",
        "entry_ts",
    )
    # Three batches, of which one is sent twice, put together in the end.
    odd = F.col("output_path").endswith("1")
    parts = {"early": steps.where(early), "late-odd": steps.where(~early & odd), "late": steps.where(~early & ~odd)}
    for name in ("early", "late-odd", "late", "late-odd"):
        append_batch(parts[name], path, name)
    compact_log(spark, path, steps.schema)
    append_batch(parts["early"], path, "early")
    return read_log(spark, path, steps.schema).groupBy("tool_name").agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_distinct("output_path").alias("outputs"),
        F.count_distinct("parameters").alias("parameter_sets"),
    )


def _seconds(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def query_artifact_latest(spark, sf_dir):
    latest = artifact_latest(artifact_log(spark, sf_dir).drop("source_artifacts"))
    return latest.withColumns({c: _seconds(c) for c in ("created_ts", "updated_ts")})


def query_lineage_edges(spark, sf_dir):
    return lineage_edges(artifact_log(spark, sf_dir))


# Numbers are fixed-point here, since the text of a double differs between engines.
_FIXED = ("MAC", "MOC", "MEC", "MAF", "MEF", "COLA", "Face_Amount")


def _fixed_point(spark, sf_dir):
    return inforce(spark, sf_dir).withColumns({c: F.col(c).cast("decimal(20,4)") for c in _FIXED})


def query_table_fingerprint(spark, sf_dir):
    return table_fingerprint(_fixed_point(spark, sf_dir))


def query_fingerprint_manifest(spark, sf_dir):
    """The same fingerprint out of file digests, of a table that grows by a second write."""
    df = _fixed_point(spark, sf_dir)
    path, manifest = new_table_path(spark, "grown"), new_table_path(spark, "manifest")
    late = F.coalesce(F.col("Study_Year") >= 1996, F.lit(False))
    for part in (df.where(~late), df.where(late)):
        part.write.mode("append").partitionBy("Gender").parquet(path)
        refresh_manifest(spark, path, manifest, df.schema)
    return manifest_fingerprint(spark, path, manifest, df.schema)


def query_state_fingerprint(spark, sf_dir):
    """Fingerprint of a run whose source is known by its row and claim counts."""
    summary = ae_summary(inforce(spark, sf_dir), ["Gender"])
    total = summary.agg(F.sum("Sum_MAC").cast("string").alias("claims"))
    inputs = state_inputs(group_by=["Gender"], measure="count", sort_by="AE_Ratio_Count")
    sources = {
        "prepared_data_path": F.sha2("claims", 256),
        "latest_ae_path": F.lit(None).cast("string"),
    }
    return total.select(state_fingerprint(sources, inputs).alias("state_fingerprint"))


def query_stale_summaries(spark, sf_dir):
    return stale_summaries(artifact_log(spark, sf_dir))


def query_stale_downstream(spark, sf_dir):
    return stale_downstream(lineage_log(spark, sf_dir))


QUERIES = {
    name.removeprefix("query_"): value
    for name, value in list(globals().items())
    if name.startswith("query_")
}

_LOG = """entries as (
  select event_id as entry_id, ts as entry_ts, event_type = 'view' as prepared,
    case event_type when 'view' then 'prepared_dataset' when 'click' then 'ae_summary'
      when 'purchase' then 'ai_ae_packet' else 'ae_visual_' || event_type end as artifact_type,
    'study_' || cast(user_id as varchar) as study,
    sha256('study_' || cast(user_id as varchar) || '|' || strftime(ts, '%Y-%m-%d')) as made_from,
    case event_type when 'view' then 'band' when 'click' then 'ae' when 'purchase' then 'packet'
      else 'visualize' end as generating_tool,
    props as parameters
  from events),
log as (
  select *, case when prepared then study || '/prepared' else study || '/' || artifact_type end
      as path,
    case when prepared then made_from
      else sha256(study || '#' || cast(entry_id as varchar)) end as content_hash
  from entries),
latest as (
  select artifact_type, path, min(entry_ts) as created, max(entry_ts) as updated,
    arg_max(content_hash, (entry_ts, entry_id)) as content_hash,
    arg_max(generating_tool, (entry_ts, entry_id)) as generating_tool,
    arg_max(parameters, (entry_ts, entry_id)) as parameters,
    arg_max(study, (entry_ts, entry_id)) as study,
    arg_max(made_from, (entry_ts, entry_id)) as made_from
  from log group by artifact_type, path)"""

_INPUTS = (
    '{"filters":[],"group_by":["Gender"],"measure":"count","min_claims":0,'
    '"package_version":"0.1.0","packet_schema_version":"ai_ae_packet.v1",'
    '"sort_by":"AE_Ratio_Count","source_hashes":{"latest_ae_path":null,"prepared_data_path":"'
)

def _fingerprint() -> str:
    kinds = dict.fromkeys(_FIXED, "decimal(20,4)") | {
        "Policy_Number": "string", "Duration": "int", "Issue_Age": "int", "Gender": "string",
        "Smoker": "string", "Risk_Class": "string", "Product_Group": "string", "Study_Year": "int",
    }
    cells = []
    for column in sorted(kinds):
        number = kinds[column] == "decimal(20,4)"
        text = f'cast(cast("{column}" as decimal(20,4)) as varchar)' if number else f'cast("{column}" as varchar)'
        cells.append(f"coalesce(cast(length({text}) as varchar) || ':' || {text}, '-')")
    sums = " || '|' || ".join(
        f"cast(sum(cast('0x' || substr(digest, {start}, {size}) as hugeint)) as varchar)" for start, size in SLICES
    )
    header = ",".join(f"{c}:{kinds[c]}" for c in sorted(kinds))
    return f"""with {INFORCE},
rows as (select sha256({" || '|' || ".join(cells)}) as digest from inforce)
select count(*) as row_count, sha256('{header}|' || cast(count(*) as varchar) || '|' || {sums})
  as content_hash from rows"""


# Reachability over the lineage of ``lineage_log``: nodes are study and kind.
_REACHED = """with recursive entries as (
  select event_id, ts, user_id as study, case event_type when 'view' then 'prepared_dataset'
      when 'click' then 'ae_summary' when 'purchase' then 'ai_ae_packet'
      else 'ae_visual_' || event_type end as kind, strftime(ts, '%Y-%m-%d') as day
  from events),
latest as (
  select study, kind, arg_max(day, (ts, event_id)) as day from entries group by all),
sources as (
  select study, kind, day, study // 2 as from_study, 'prepared_dataset' as from_kind
    from latest where kind = 'prepared_dataset' and study > 1
  union all select study, kind, day, study, 'prepared_dataset' from latest where kind = 'ae_summary'
  union all select study, kind, day, study, 'ae_summary' from latest where kind = 'ai_ae_packet'
  union all select study, kind, day, study // 2, 'ae_summary' from latest
    where kind = 'ai_ae_packet' and study > 1
  union all select study, kind, day, study, 'ai_ae_packet' from latest where kind like 'ae_visual_%'),
edges as (
  select s.study, s.kind, s.from_study, s.from_kind, s.day is distinct from l.day as changed
  from sources s join latest l on l.study = s.from_study and l.kind = s.from_kind),
reached as (
  select study, kind, 1 as steps from edges where changed
  union
  select e.study, e.kind, r.steps + 1 from edges e join reached r
    on e.from_study = r.study and e.from_kind = r.kind)
select kind as artifact_type, 'study_' || cast(study as varchar) || '/' ||
    case kind when 'prepared_dataset' then 'prepared' else kind end as path, min(steps) as steps
from reached group by 1, 2"""


SQL = {
    "table_fingerprint": _fingerprint(),
    "fingerprint_manifest": _fingerprint(),
    "stale_downstream": _REACHED,
    "audit_event_append": f"""with {_LOG}
select generating_tool as tool_name, count(*) as steps, count(distinct path) as outputs,
  count(distinct parameters) as parameter_sets from log group by 1""",
    "artifact_latest": f"""with {_LOG}
select artifact_type, path, strftime(created, '%Y-%m-%d %H:%M:%S') as created_ts,
  strftime(updated, '%Y-%m-%d %H:%M:%S') as updated_ts, content_hash, generating_tool, parameters
from latest""",
    "lineage_edges": f"""with {_LOG}
select entry_id, 'prepared_dataset' as source_type, study || '/prepared' as source_path,
  made_from as source_hash, artifact_type as target_type, path as target_path,
  content_hash as target_hash
from log where not prepared""",
    "state_fingerprint": f"""with {INFORCE}
select sha256('{_INPUTS}' || sha256(cast(cast(sum("MAC") as bigint) as varchar)) || '"}}}}')
  as state_fingerprint from inforce""",
    "stale_summaries": f"""with {_LOG}
select p.path as source_path, s.artifact_type, s.path, s.made_from as source_hash,
  p.content_hash as current_hash
from latest s join latest p
  on p.artifact_type = 'prepared_dataset' and p.path = s.study || '/prepared'
where s.artifact_type = 'ae_summary' and s.made_from <> p.content_hash""",
}
