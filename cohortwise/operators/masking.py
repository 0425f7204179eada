"""Masking of personal data and small cohorts before results are shared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.contracts import (
    INTERVALS,
    DEFAULT_TOP_N,
    NULL_KEY_TEXT,
    PACKET_ROWS,
    RATIOS,
    SUMS,
    row_limit,
)
from cohortwise.functions.labels import (
    FILTER_WARNING,
    LOW_VOLUME_REASON,
    MASKED_COLUMN,
    MASKED_DIMENSION,
    MASKED_LABEL,
    MASKED_VALUE,
    PARSE_WARNING,
    SENSITIVE_REASON,
    parse_label,
    parse_warnings,
    sensitive_dimension,
    sensitive_value,
)
from cohortwise.functions.ratios import only_finite
from cohortwise.operators.ranking import evidence_ref

# ---- Fixed values: warning texts of a packet. ----
WARNING_TEXT = {
    PARSE_WARNING: "Unable to fully parse dimension label.",
    SENSITIVE_REASON: "A sensitive or disallowed dimension was masked.",
    FILTER_WARNING: "A sensitive or disallowed filter was masked.",
}
# ---- End of fixed values. ----

WARNINGS = "code string, message string, evidence_refs array<string>"


def mask_filters(filters: DataFrame) -> DataFrame:
    """Mask filters (column, operator, value) on personal data; flags the ones masked.

    Works on the filters of any number of runs at once; other columns pass through.
    """
    hidden = F.coalesce(sensitive_dimension(F.col("column")), F.lit(False)) | sensitive_value(
        F.col("value")
    )
    return filters.withColumn("masked", hidden).withColumns(
        {
            "column": F.when(F.col("masked"), MASKED_COLUMN).otherwise(F.col("column")),
            "value": F.when(F.col("masked"), MASKED_VALUE).otherwise(F.col("value")),
        }
    )


def label_dimensions(label: Column) -> Column:
    """Column names in a cohort label, in order."""
    return F.transform(parse_label(label), lambda p: p["column"])


def cohort_dimensions(summary: DataFrame) -> tuple[Column, Column]:
    """Names of the columns that form each cohort, and whether its label cannot be read.

    A summary with group_columns says so itself; only labels made elsewhere are taken apart.
    """
    label = F.col("Dimensions")
    names, unread = label_dimensions(label), parse_warnings(label) > 0
    if "group_columns" not in summary.columns:
        return names, unread
    known = F.col("group_columns").isNotNull()
    return F.when(known, F.col("group_columns")).otherwise(names), ~known & unread


def has_sensitive_dimension(dimensions: Column) -> Column:
    return F.exists(dimensions, sensitive_dimension)


def _label() -> Column:
    return F.coalesce(F.col("Dimensions"), F.lit(NULL_KEY_TEXT))


def mask_cohorts(summary: DataFrame, masking_min_claims: float = 1) -> DataFrame:
    """Hide labels of sensitive cohorts and of cohorts with too few claims.

    Adds Dimension_Columns, low_credibility, masking_reason and caution_flags. Sensitive
    cohorts also lose their column names; the measures stay.
    """
    dims, unread = cohort_dimensions(summary)
    enough = F.col("Sum_MAC") >= F.lit(float(masking_min_claims))
    flagged = summary.withColumns({"_dims": dims, "_unparsed": unread}).withColumn("_sensitive", has_sensitive_dimension(F.col("_dims")))
    reason = F.when(F.col("_sensitive"), SENSITIVE_REASON).when(~enough, LOW_VOLUME_REASON)
    masked = flagged.withColumn("masking_reason", reason)
    hidden = F.col("masking_reason").isNotNull()
    flags = F.array_compact(
        F.array(F.when(F.col("_unparsed"), PARSE_WARNING), F.col("masking_reason"))
    )
    return masked.withColumns(
        {
            "Dimension_Columns": F.when(
                F.col("_sensitive"), F.array(F.lit(MASKED_DIMENSION))
            ).otherwise(F.col("_dims")),
            "caution_flags": flags,
            "low_credibility": hidden,
            "Dimensions": F.when(hidden, MASKED_LABEL).otherwise(_label()),
        }
    ).drop("_dims", "_unparsed", "_sensitive")


def masking_threshold(masking_min_claims: float | None, min_claims: float = 0) -> float:
    """Claims below which a cohort is hidden: as asked, else the summary's own minimum or 1."""
    return max(1, min_claims) if masking_min_claims is None else masking_min_claims


def packet_rows(
    summary: DataFrame,
    *,
    top_n: int = DEFAULT_TOP_N,
    masking_min_claims: float | None = None,
    min_claims: float = 0,
    max_rows: int | None = PACKET_ROWS,
) -> DataFrame:
    """The first cohorts of a ranked summary, masked and ready to share.

    Asking for more than ``max_rows`` is an error; None lifts that bound.
    """
    top = summary.where(F.col("cohort_rank") <= row_limit(top_n, max_rows))
    known = F.when(
        only_finite(F.col("Sum_MAC").cast("double")).isNull(),
        F.raise_error(F.lit("A packet needs the claim count Sum_MAC of every cohort.")),
    ).otherwise(F.col("Sum_MAC").cast("double"))
    sums = {s: F.coalesce(only_finite(F.col(s).cast("double")), F.lit(0.0)) for s in SUMS}
    sums["Sum_MAC"] = known.cast("double")
    others = {c: only_finite(F.col(c).cast("double")) for c in (*RATIOS, *INTERVALS)}
    masked = mask_cohorts(
        top.withColumns({**sums, **others}), masking_threshold(masking_min_claims, min_claims)
    )
    return masked.select(
        evidence_ref().alias("evidence_ref"),
        "Dimensions",
        "Dimension_Columns",
        *SUMS,
        *RATIOS,
        *INTERVALS,
        "low_credibility",
        "masking_reason",
        "caution_flags",
    )


def _warning(code: str, refs: Column) -> Column:
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(WARNING_TEXT[code]).alias("message"),
        refs.alias("evidence_refs"),
    )


def cohort_warnings(summary: DataFrame) -> DataFrame:
    """Parse and masking warnings of a ranked summary."""
    refs = F.array(evidence_ref())
    dims, unread = cohort_dimensions(summary)
    found = F.array(
        F.when(unread, _warning(PARSE_WARNING, refs)),
        F.when(has_sensitive_dimension(dims), _warning(SENSITIVE_REASON, refs)),
    )
    return summary.select(F.inline(F.array_compact(found))).distinct()


def packet_warnings(
    summary: DataFrame,
    *,
    top_n: int = DEFAULT_TOP_N,
    filters: DataFrame | None = None,
    max_rows: int | None = PACKET_ROWS,
) -> DataFrame:
    """Distinct warnings of a packet: masked filters, unparsed labels, masked cohorts."""
    rows = cohort_warnings(summary.where(F.col("cohort_rank") <= row_limit(top_n, max_rows)))
    if filters is None:
        return rows
    hits = mask_filters(filters).where("masked").limit(1)
    none = F.lit(None).cast("array<string>")
    return hits.select(_warning(FILTER_WARNING, none).alias("w")).select("w.*").unionByName(rows)
