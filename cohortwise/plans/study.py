"""A whole study: profile, check, derive dimensions, sum cohorts, share results.

State lives in three append-only Parquet logs below the study's folder (steps, artifacts and
summaries), so a study resumes from its folder alone. Every write makes a new version, and a
version counts only once its artifact entry has been logged.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from typing import Any
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cohortwise.contracts import DEFAULT_TOP_N, OTHER_LABEL, PACKET_SCHEMA_VERSION, check_sort, default_sort
from cohortwise.functions.labels import summary_slug
from cohortwise.operators import audit
from cohortwise.operators.cohorts import check_grouping, ranked_summary
from cohortwise.operators.dimensions import Band, band, default_age_band, regroup
from cohortwise.operators.exhibits import exhibit_rows
from cohortwise.operators.filters import as_filter
from cohortwise.operators.masking import (
    mask_filters,
    masking_threshold,
    packet_rows,
    packet_warnings,
)
from cohortwise.operators.profile import profile_feature_types, profile_nulls, profile_summary
from cohortwise.operators.quality import REPORT, dq_gate, dq_report
from cohortwise.sources import digests, stores
from cohortwise.sources.logs import append_batch, compact_log, read_log
from cohortwise.sources.inforce import land_csv, read_inforce, read_landed_inforce, read_raw_strings, source_format

# ---- Fixed values: step and artifact names in the logs. ----
PROFILED = "Source dataset profiled"
VALIDATED = "Validation checks run"
BANDED = "Feature engineering band created"
REGROUPED = "Feature engineering regroup created"
SUMMED = "Grouped A/E analysis run"
PACKED = "Sanitized AI A/E packet built"
SOURCE, PREPARED, PRIOR = "source_dataset", "prepared_dataset", "prepared_dataset_prior"
SUMMARY, LATEST_SUMMARY, PACKET = "ae_summary", "latest_ae_summary", "ai_ae_packet"
EXHIBITED = "Visualization artifacts built"
EXHIBIT, GIVEN_SUMMARY = "ae_visual_rows", "given_ae_summary"
# ---- End of fixed values. ----

ENTRIES = (
    "entry_id string, entry_ts timestamp, artifact_type string, path string, location string, "
    f"content_hash string, source_artifacts {audit.SOURCES}, generating_tool string, "
    "parameters string"
)
SUMMARIES = (
    "Dimensions string, Sum_MAC bigint, Sum_MOC double, Sum_MEC double, Sum_MAF double, "
    "Sum_MEF double, AE_Ratio_Count double, AE_Ratio_Amount double, AE_Count_CI_Lower double, "
    "AE_Count_CI_Upper double, AE_Amount_CI_Lower double, AE_Amount_CI_Upper double, "
    "way int, grouping int, group_columns array<string>, group_values array<string>, "
    "cohort_rank bigint, scenario string, run_id string"
)
METADATA = (
    "schema_version string, group_by array<string>, filters string, measure string, sort_by string, "
    "min_claims double, masking_min_claims double, top_n int, source_hash string, "
    "state_fingerprint string, packet_fingerprint string, packet_version string"
)


class Study:
    """One study kept in a folder that all executors can reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    # -- logs ---------------------------------------------------------------------------

    def _read(self, name: str, schema: str) -> DataFrame:
        """A store of runs; logs are read by ``read_log``."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # nothing logged yet

    def steps(self) -> DataFrame:
        return read_log(self.spark, f"{self.root}/audit/steps", audit.EVENTS)

    def artifacts(self) -> DataFrame:
        return read_log(self.spark, f"{self.root}/audit/artifacts", ENTRIES)

    def summaries(self) -> DataFrame:
        return self._read("ae_summary", SUMMARIES)

    def compact(self) -> int:
        """Put the many small batches of the logs together; what they hold stays the same."""
        logs = {"audit/steps": audit.EVENTS, "audit/artifacts": ENTRIES, "packet_metadata": METADATA, "audit/digests": digests.MANIFEST}
        return sum(compact_log(self.spark, f"{self.root}/{name}", schema) for name, schema in logs.items())

    def _log(self, step: str, tool: str, source: str | None, output: str | None, **values) -> None:
        event = audit.audit_event(
            self.spark, step, tool, input_path=source, output_path=output, parameters=values
        )
        append_batch(event, f"{self.root}/audit/steps")

    def _record(
        self,
        kind: str,
        path: str,
        location: str,
        content_hash: str,
        tool: str,
        parameters: Mapping[str, Any],
        sources: Sequence[tuple[str, str, str]] = (),
    ) -> None:
        row = (
            stores.version_name(),
            kind,
            path,
            location,
            content_hash,
            [tuple(s) for s in sources],
            tool,
            audit.canonical_json(dict(parameters)),
        )
        fields = ENTRIES.replace("entry_ts timestamp, ", "")
        entry = self.spark.createDataFrame([row], fields).withColumn(
            "entry_ts", F.current_timestamp()
        )
        append_batch(entry, f"{self.root}/audit/artifacts")

    def _newest(self, kind: str) -> Row | None:
        rows = self.artifacts().where(F.col("artifact_type") == kind)
        return rows.orderBy(F.col("entry_id").desc()).limit(1).first()

    def _hash(self, df: DataFrame) -> str:
        return audit.table_fingerprint(df).first()["content_hash"]

    def _prepared_hash(self, location: str, saved: DataFrame) -> str:
        """Fingerprint of a saved table; each of its files is hashed once, however often it is asked."""
        manifest = f"{self.root}/audit/digests"
        digests.refresh_manifest(self.spark, location, manifest, saved.schema)
        return digests.manifest_fingerprint(self.spark, location, manifest, saved.schema).first()["content_hash"]

    def unchanged(self) -> bool:
        """Whether the prepared table still holds what was recorded when it was saved."""
        entry = self._prepared_entry()
        saved = stores.read_prepared(self.spark, entry["location"])
        return self._prepared_hash(entry["location"], saved) == entry["content_hash"]

    # -- steps --------------------------------------------------------------------------

    def _prepared_entry(self) -> Row:
        entry = self._newest(PREPARED)
        if entry is None:
            raise FileNotFoundError("The study has no prepared table; profile a source first.")
        return entry

    def prepared(self) -> DataFrame:
        return stores.read_prepared(self.spark, self._prepared_entry()["location"])

    def _save_prepared(
        self,
        df: DataFrame,
        tool: str,
        parameters: Mapping[str, Any],
        sources: Sequence[tuple[str, str, str]],
        partition_by: Sequence[str] = (),
        buckets: int = 0,
    ) -> DataFrame:
        location = stores.write_prepared(df, self.root, partition_by=partition_by, buckets=buckets)
        saved = stores.read_prepared(self.spark, location)
        self._record(
            PREPARED,
            f"{self.root}/prepared",
            location,
            self._prepared_hash(location, saved),
            tool,
            {**parameters, "partition_by": list(partition_by), "buckets": buckets},
            sources,
        )
        return saved

    def profile(
        self, path: str, *, partition_by: Sequence[str] = (), buckets: int = 0, **reader: Any
    ) -> dict[str, DataFrame]:
        """Read a source, add the default age band, save it, and describe it.

        A CSV is parsed once: landing it also gives its types, its hash, and the counts that
        ``validate`` reports.
        """
        parameters = {"data_path": path, "fmt": reader.get("fmt")}
        if (reader.get("fmt") or source_format(path)) == "csv" and reader.get("schema") is None:
            folder = f"{self.root}/landed/version={stores.version_name()}"
            landed = land_csv(self.spark, path, folder, multi_line=reader.get("multi_line", False))
            source, source_hash = read_landed_inforce(self.spark, landed), landed.content_hash(self.spark)
            parameters |= {"landed": folder, "raw_counts": landed.not_numbers}
        else:
            source = read_inforce(self.spark, path, **reader)
            source_hash = self._hash(source)
        self._record(SOURCE, path, path, source_hash, "profile", parameters)
        saved = self._save_prepared(
            default_age_band(source),
            "profile",
            parameters,
            [(SOURCE, path, source_hash)],
            partition_by,
            buckets,
        )
        self._log(PROFILED, "profile", path, f"{self.root}/prepared", **parameters)
        return {
            "summary": profile_summary(saved),
            "nulls": profile_nulls(saved),
            "feature_types": profile_feature_types(saved),
        }

    def validate(self) -> DataFrame:
        """All checks: numbers on the raw source, the rules on the prepared table."""
        source = self._newest(SOURCE)
        entry = self._prepared_entry()
        prepared = stores.read_prepared(self.spark, entry["location"])
        bucketed = json.loads(entry["parameters"]).get("buckets", 0) > 0
        raw = counts = None
        if source is not None:
            made = json.loads(source["parameters"])
            counts = made.get("raw_counts")
            if counts is None:
                raw = read_raw_strings(self.spark, source["location"], fmt=made["fmt"])
        # The report holds a few rows per column; keeping them avoids a second run for the gate.
        report = self.spark.createDataFrame(dq_report(prepared, raw, raw_counts=counts, co_located=bucketed).collect(), REPORT)
        gate = dq_gate(report).first()
        self._log(
            VALIDATED,
            "validate",
            source["location"] if source else None,
            None,
            status=gate["status"],
            issue_count=gate["issue_count"],
        )
        return report

    def _derive(self, tool: str, step: str, df: DataFrame, parameters: dict[str, Any]) -> DataFrame:
        before = self._prepared_entry()
        sources = [(PRIOR, before["path"], before["content_hash"])]
        origin = self._newest(SOURCE)
        if origin is not None:
            sources.append((SOURCE, origin["path"], origin["content_hash"]))
        parameters["previous_prepared_content_hash"] = before["content_hash"]
        layout = json.loads(before["parameters"])
        saved = self._save_prepared(df, tool, parameters, sources, layout["partition_by"], layout.get("buckets", 0))
        self._log(step, tool, before["location"], f"{self.root}/prepared", **parameters)
        return saved

    def band(
        self, source: str, new_column: str, spec: Band, *, overwrite: bool = False
    ) -> DataFrame:
        banded = band(self.prepared(), source, new_column, spec, overwrite=overwrite)
        parameters = {
            "source_column": source,
            "new_column": new_column,
            "strategy": spec.strategy,
            "bins": spec.bins,
            "custom_bins": spec.edges,
            "labels": spec.labels,
            "overwrite": overwrite,
        }
        return self._derive("band", BANDED, banded, parameters)

    def regroup(
        self,
        source: str,
        new_column: str,
        mapping: Mapping[str, Sequence[Any]],
        *,
        other: str = OTHER_LABEL,
        keep_unmapped: bool = False,
        overwrite: bool = False,
    ) -> DataFrame:
        grouped = regroup(
            self.prepared(),
            source,
            new_column,
            mapping,
            other=other,
            keep_unmapped=keep_unmapped,
            overwrite=overwrite,
        )
        parameters = {
            "source_column": source,
            "new_column": new_column,
            "mapping": dict(mapping),
            "unmapped_value": other,
            "keep_unmapped": keep_unmapped,
            "overwrite": overwrite,
        }
        return self._derive("regroup", REGROUPED, grouped, parameters)

    def ae(
        self,
        *groupings: Sequence[str],
        measure: str = "both",
        filters: Sequence[Any] = (),
        min_claims: float = 0,
        sort_by: str | None = None,
        level: float = 0.95,
    ) -> DataFrame:
        """Ranked summaries of one or more groupings, saved whole, out of one scan."""
        order = check_sort(sort_by or default_sort(measure))
        chosen = [as_filter(f) for f in filters]
        entry = self._prepared_entry()
        data = stores.read_prepared(self.spark, entry["location"])
        keys = [list(k) for k in dict.fromkeys(tuple(check_grouping(data, g)) for g in groupings)]
        run_id = stores.version_name()
        ranked = ranked_summary(
            data, keys, order, filters=chosen, min_claims=min_claims, level=level
        )
        path = stores.write_ae_summary(ranked, self.root, run_id)
        saved = self.summaries().where(F.col("run_id") == run_id)
        for place, group in enumerate(keys, 1):
            scenario = summary_slug(group)
            rows = saved.where(F.col("grouping") == place)
            inputs = audit.state_inputs(
                group_by=group,
                filters=[f.as_dict() for f in chosen],
                measure=measure,
                min_claims=min_claims,
                sort_by=order,
            )
            fingerprinted = audit.table_fingerprint(rows.drop("run_id")).withColumn(
                "state",
                audit.state_fingerprint(
                    {
                        "prepared_data_path": F.lit(entry["content_hash"]),
                        "latest_ae_path": F.col("content_hash"),
                    },
                    inputs,
                ),
            )
            hashes = fingerprinted.first()
            parameters = {
                **inputs,
                "way": len(group),
                "run_id": run_id,
                "scenario": scenario,
                "grouping": place,
                "state_fingerprint": hashes["state"],
            }
            self._record(
                SUMMARY,
                f"{path}/{'+'.join(quote(c, safe='') for c in group)}",
                path,
                hashes["content_hash"],
                "ae",
                parameters,
                [(PREPARED, entry["path"], entry["content_hash"])],
            )
            self._log(SUMMED, "ae", entry["location"], path, **parameters)
        # The last grouping is what a packet without further words is made from.
        self._record(
            LATEST_SUMMARY,
            f"{path}/latest",
            path,
            hashes["content_hash"],
            "ae",
            parameters,
            [(PREPARED, entry["path"], entry["content_hash"])],
        )
        return saved

    def latest_by_way(self) -> DataFrame:
        """The newest summary of each way, one or two columns, in the order of writing."""
        return stores.latest_by_way(self.summaries())

    def stale(self) -> DataFrame:
        """Latest summaries made from an older prepared table."""
        return audit.stale_summaries(self.artifacts())

    def stale_downstream(self) -> DataFrame:
        """Everything that a changed table reaches: summaries, and packets and exhibits of these."""
        return audit.stale_downstream(self.artifacts())

    def latest_ae(self) -> tuple[DataFrame, dict[str, Any]]:
        """The last summary and how it was made; refused once the prepared table has changed."""
        entry = self._newest(SUMMARY)
        if entry is None:
            raise FileNotFoundError("The study has no cohort summary; run one first.")
        made_from = entry["source_artifacts"][0]["content_hash"]
        if made_from != self._prepared_entry()["content_hash"]:
            raise FileNotFoundError("The last cohort summary is stale; run it again.")
        parameters = json.loads(entry["parameters"])
        rows = self.summaries().where(
            (F.col("run_id") == parameters["run_id"])
            & (F.col("grouping") == parameters["grouping"])
        )
        return stores.check_ae_summary(rows), parameters

    def _masked_filters(self, filters: Sequence[Mapping[str, Any]]) -> DataFrame:
        """Filters fit to share; only text can be personal data by itself."""
        rows = [
            (n, f["column"], f["operator"], f["value"] if isinstance(f["value"], str) else None, audit.canonical_json(f["value"]))
            for n, f in enumerate(filters)
        ]
        fields = "place int, column string, operator string, value string, given string"
        masked = mask_filters(self.spark.createDataFrame(rows, fields))
        shown = F.when(F.col("masked") | F.col("value").isNotNull(), F.col("value")).otherwise(F.col("given"))
        return masked.withColumn("value", shown).drop("given")

    def packet_metadata(self) -> DataFrame:
        """How each saved packet was made, one row a version."""
        return read_log(self.spark, f"{self.root}/packet_metadata", METADATA)

    def packet(
        self,
        *,
        top_n: int = DEFAULT_TOP_N,
        masking_min_claims: float | None = None,
        summary: DataFrame | None = None,
    ) -> tuple[DataFrame, DataFrame]:
        """Masked rows of the last summary, or of one given, and their warnings, both saved with
        a row of metadata."""
        if summary is None:
            summary, made = self.latest_ae()
            source = self._newest(LATEST_SUMMARY)
            origin = (LATEST_SUMMARY, source["path"], source["content_hash"])
        else:
            summary = stores.check_ae_summary(summary)
            made = {"min_claims": 0, "filters": [], "group_by": [], "measure": None, "sort_by": None, "state_fingerprint": None}
            origin = (GIVEN_SUMMARY, "given", self._hash(summary))
        rows = packet_rows(
            summary,
            top_n=top_n,
            masking_min_claims=masking_min_claims,
            min_claims=made["min_claims"],
        )
        shared = self._masked_filters(made["filters"])
        texts = [f for f in made["filters"] if isinstance(f["value"], str)]
        asked = [(f["column"], f["operator"], f["value"] if f in texts else None) for f in made["filters"]]
        filters = None
        if asked:
            filters = self.spark.createDataFrame(asked, "column string, operator string, value string")
        version = stores.version_name()
        path, warned = f"{self.root}/packet/version={version}", f"{self.root}/packet_warnings/version={version}"
        rows.write.mode("errorifexists").parquet(path)
        saved = self.spark.read.parquet(path)
        packet_warnings(summary, top_n=top_n, filters=filters).write.mode("errorifexists").parquet(warned)
        warnings = self.spark.read.parquet(warned)
        parameters = {
            "top_n": top_n,
            "masking_min_claims": masking_threshold(masking_min_claims, made["min_claims"]),
        }
        listed = [r.asDict() for r in shared.orderBy("place").drop("place", "masked").collect()]
        about = {
            "schema_version": PACKET_SCHEMA_VERSION,
            "group_by": list(made["group_by"]),
            "filters": audit.canonical_json(listed),
            "measure": made["measure"],
            "sort_by": made["sort_by"],
            "min_claims": float(made["min_claims"]),
            "masking_min_claims": float(parameters["masking_min_claims"]),
            "top_n": int(top_n),
            "source_hash": origin[2],
            "state_fingerprint": made["state_fingerprint"],
        }
        hashes = [self._hash(saved), self._hash(warnings), audit.canonical_json(about)]
        about["packet_fingerprint"] = hashlib.sha256("|".join(hashes).encode()).hexdigest()
        row = tuple({**about, "packet_version": version}.values())
        append_batch(self.spark.createDataFrame([row], METADATA), f"{self.root}/packet_metadata")
        self._record(
            PACKET, f"{self.root}/packet", path, about["packet_fingerprint"], "packet", parameters, [origin]
        )
        self._log(PACKED, "packet", origin[1], path, **parameters)
        return saved, warnings

    def exhibits(self, metric: str, *, summary: DataFrame | None = None) -> DataFrame:
        """Rows behind the exhibits of the last summary, or of one given; saved and recorded."""
        if summary is None:
            summary, _ = self.latest_ae()
            source = self._newest(LATEST_SUMMARY)
            origin = (LATEST_SUMMARY, source["path"], source["content_hash"])
        else:
            origin = (GIVEN_SUMMARY, "given", self._hash(summary))
        rows = exhibit_rows(stores.check_ae_summary(summary, allow_empty=False), metric)
        path = f"{self.root}/exhibits/metric={metric}/version={stores.version_name()}"
        rows.write.mode("errorifexists").parquet(path)
        saved = self.spark.read.parquet(path)
        parameters = {"metric": metric}
        self._record(EXHIBIT, f"{self.root}/exhibits/{metric}", path, self._hash(saved), "exhibits", parameters, [origin])
        self._log(EXHIBITED, "exhibits", origin[1], path, **parameters)
        return saved

    def run(
        self,
        path: str,
        groupings: Sequence[Sequence[str]],
        *,
        top_n: int = DEFAULT_TOP_N,
        reader: Mapping[str, Any] | None = None,
        **options: Any,
    ) -> tuple[DataFrame, DataFrame]:
        """Profile, validate, sum cohorts and build the packet; failed checks stop the run."""
        if not groupings:
            raise ValueError("Give at least one grouping.")
        self.profile(path, **dict(reader or {}))
        if dq_gate(self.validate()).first()["status"] == "FAIL":
            raise ValueError("Validation failed; no cohorts were summed.")
        self.ae(*groupings, **options)
        return self.packet(top_n=top_n)
