"""Audit log, artifact versions, lineage, fingerprints and staleness as tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise import __version__
from cohortwise.contracts import PACKET_SCHEMA_VERSION
from cohortwise.functions.values import data_type, named
from cohortwise.scratch import cut_lineage

EVENTS = (
    "step_name string, tool_name string, input_path string, output_path string, "
    "parameters string, event_ts timestamp"
)
SOURCES = "array<struct<artifact_type:string,path:string,content_hash:string>>"


def canonical_json(value: Any) -> str:
    """JSON with sorted keys and no spaces, the same for equal content."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def audit_event(
    spark: SparkSession,
    step_name: str,
    tool_name: str,
    *,
    input_path: str | None = None,
    output_path: str | None = None,
    parameters: Mapping[str, Any] | None = None,
) -> DataFrame:
    """One log row for a finished step, stamped with the session's clock."""
    row = (step_name, tool_name, input_path, output_path, canonical_json(dict(parameters or {})))
    fields = EVENTS.rsplit(",", 1)[0]
    return spark.createDataFrame([row], fields).withColumn("event_ts", F.current_timestamp())


def artifact_latest(entries: DataFrame) -> DataFrame:
    """Newest entry per artifact type and path, with the time it was first created."""
    details = [
        c
        for c in entries.columns
        if c not in ("artifact_type", "path", "entry_ts", "entry_id")
    ]
    newest = F.max_by(F.struct(*details), F.struct("entry_ts", "entry_id"))
    return (
        entries.groupBy("artifact_type", "path")
        .agg(
            F.min("entry_ts").alias("created_ts"),
            F.max("entry_ts").alias("updated_ts"),
            newest.alias("_newest"),
        )
        .select("artifact_type", "path", "created_ts", "updated_ts", "_newest.*")
    )


def lineage_edges(entries: DataFrame) -> DataFrame:
    """One row per source an artifact was made from."""
    return entries.select(
        "entry_id",
        F.explode("source_artifacts").alias("source"),
        F.col("artifact_type").alias("target_type"),
        F.col("path").alias("target_path"),
        F.col("content_hash").alias("target_hash"),
    ).select(
        "entry_id",
        F.col("source.artifact_type").alias("source_type"),
        F.col("source.path").alias("source_path"),
        F.col("source.content_hash").alias("source_hash"),
        "target_type",
        "target_path",
        "target_hash",
    )


LATEST_INPUTS = ("artifact_type", "path", "entry_ts", "entry_id", "content_hash", "source_artifacts")


def stale_summaries(entries: DataFrame, kinds: Sequence[str] = ("ae_summary",)) -> DataFrame:
    """Current results made from a prepared table that has changed since.

    The join meets one row per prepared path; a path with very many results is split by
    adaptive execution.
    """
    wanted = entries.where(F.col("artifact_type").isin("prepared_dataset", *kinds))
    latest = artifact_latest(wanted.select(*LATEST_INPUTS))
    current = latest.where(F.col("artifact_type") == "prepared_dataset").select(
        F.col("path").alias("source_path"), F.col("content_hash").alias("current_hash")
    )
    made = (
        latest.where(F.col("artifact_type").isin(*kinds))
        .select("artifact_type", "path", F.explode("source_artifacts").alias("s"))
        .where(F.col("s.artifact_type") == "prepared_dataset")
        .select(
            "artifact_type",
            "path",
            F.col("s.path").alias("source_path"),
            F.col("s.content_hash").alias("source_hash"),
        )
    )
    return made.join(current, "source_path").where(F.col("source_hash") != F.col("current_hash"))


def _changed_sources(latest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current artifacts and their sources as (node, source) pairs, and the nodes with a source
    that has another content now than the one they were made from."""
    node = F.struct("artifact_type", "path")
    current = latest.select(node.alias("source"), F.col("content_hash").alias("current_hash"))
    made = latest.select(node.alias("node"), F.explode("source_artifacts").alias("s")).select(
        "node", F.struct("s.artifact_type", "s.path").alias("source"), F.col("s.content_hash").alias("made_from")
    )
    known = made.join(current, "source")  # sources without an entry of their own cannot change
    changed = known.where(~F.col("made_from").eqNullSafe(F.col("current_hash"))).select("node").distinct()
    return known.select("node", "source").distinct(), changed


def stale_downstream(entries: DataFrame) -> DataFrame:
    """Current artifacts that a changed source reaches over any number of steps, with the least
    number of steps (1: the changed source is its own).

    A source counts as changed where its newest entry has another content than the one recorded
    when the artifact was made. The frontier goes one step a turn and holds new artifacts only, so
    cycles end, and an artifact that several ways reach is listed once. Turns are as many as the
    longest way; each joins the frontier with the edges and leaves a table in the shared folder.
    """
    latest = cut_lineage(artifact_latest(entries.select(*LATEST_INPUTS)))
    edges, frontier = _changed_sources(latest)
    edges = cut_lineage(edges)
    steps, reached = 1, None
    frontier = cut_lineage(frontier)
    while not frontier.isEmpty():
        named_steps = frontier.withColumn("steps", F.lit(steps))
        reached = named_steps if reached is None else reached.unionAll(named_steps)
        ahead = edges.join(frontier.withColumnRenamed("node", "source"), "source").select("node").distinct()
        frontier = cut_lineage(ahead.join(reached, "node", "left_anti"))
        steps += 1
    if reached is None:
        reached = frontier.withColumn("steps", F.lit(1))
    return reached.select("node.artifact_type", "node.path", "steps")


def canonical_row(df: DataFrame) -> Column:
    """A row as one text that no other row shares: columns by name, each value with its length,
    a missing value as a dash."""
    cells = []
    for column in sorted(df.columns):
        kind = data_type(df, column)
        value = named(column)
        if isinstance(kind, T.BinaryType):
            value = F.hex(value)
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(value)
        text = value.cast("string")
        cells.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat_ws("|", *cells)


#: Where runs of hex digits of a row's hash begin, and how many: each fits a long.
SLICES = [(start, 15) for start in (1, 16, 31, 46)]
#: A run is summed in lanes of so many bits, so that sums stay whole numbers of 64 bits for up to
#: 2**43 rows and cost no decimal arithmetic a row.
LANE, LANES = 20, 3
STATE = ("row_count", *[f"d{start}_{lane}" for start, _ in SLICES for lane in range(LANES)])


def row_lanes(row: Column) -> list[Column]:
    """The lanes of a row's SHA-256, lowest first."""
    digest = F.sha2(row, 256)
    runs = {start: F.conv(F.substring(digest, start, size), 16, 10).cast("bigint") for start, size in SLICES}
    return [
        F.shiftright(run, LANE * lane).bitwiseAND(F.lit((1 << LANE) - 1)).alias(f"d{start}_{lane}")
        for start, run in runs.items()
        for lane in range(LANES)
    ]


def digest_sums() -> list[Column]:
    """Aggregates over ``row_lanes`` that make a state: the count and the sums of the lanes."""
    return [F.count(F.lit(1)).alias("row_count"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in STATE[1:]]]


def merged_states(states: DataFrame) -> DataFrame:
    """The state of several tables taken together: all parts add up."""
    return states.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in STATE])


def content_hash(schema: T.StructType) -> Column:
    """Hash of a state and of the names and types of the columns."""
    header = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(schema.fields, key=lambda f: f.name))
    sums = []
    for start, _ in SLICES:
        lanes = [F.col(f"d{start}_{lane}").cast("decimal(38,0)") * F.lit(1 << LANE * lane) for lane in range(LANES)]
        sums.append(sum(lanes[1:], lanes[0]).cast("decimal(38,0)").cast("string"))
    return F.sha2(F.concat_ws("|", F.lit(header), F.col("row_count").cast("string"), *sums), 256)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and order-free content hash, in one pass without a shuffle of rows.

    The hash covers names and types of the columns, the count, and the sums of four runs of 60 bits
    of each row's SHA-256, which move whenever a value changes, goes, or trades places.
    """
    state = df.select(*row_lanes(canonical_row(df))).agg(*digest_sums())
    return state.select("row_count", content_hash(df.schema).alias("content_hash"))


def state_inputs(
    *,
    group_by: Sequence[str],
    filters: Sequence[Mapping[str, Any]] = (),
    measure: str = "both",
    min_claims: float = 0,
    sort_by: str = "AE_Ratio_Amount",
) -> dict[str, Any]:
    """What, beside the sources, determines an analysis; the key names are fixed values."""
    return {
        "group_by": list(group_by),
        "filters": [dict(f) for f in filters],
        "measure": measure,
        "min_claims": min_claims,
        "sort_by": sort_by,
        "packet_schema_version": PACKET_SCHEMA_VERSION,
        "package_version": __version__,
    }


def state_fingerprint(sources: Mapping[str, Column], inputs: Mapping[str, Any]) -> Column:
    """SHA-256 over the canonical JSON of the source hashes and the inputs of an analysis.

    The hashes are columns, so the fingerprint needs no trip through the driver.
    """
    pairs = []
    for name in sorted(sources):
        value = F.when(sources[name].isNull(), "null").otherwise(
            F.concat(F.lit('"'), sources[name], F.lit('"'))
        )
        pairs.append(F.concat(F.lit(f"{json.dumps(name)}:"), value))
    hashes = F.concat(F.lit('"source_hashes":{'), F.concat_ws(",", *pairs), F.lit("}"))
    members = {key: F.lit(f"{json.dumps(key)}:{canonical_json(v)}") for key, v in inputs.items()}
    members["source_hashes"] = hashes
    body = F.concat_ws(",", *[members[key] for key in sorted(members)])
    return F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256)
