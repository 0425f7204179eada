"""Tables behind the exhibits: display values, masked labels, and the cohort hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.contracts import DEFAULT_TOP_N, NULL_KEY_TEXT, row_limit
from cohortwise.functions.labels import (
    MASKED_DIMENSION,
    MASKED_LABEL,
    PARSE_WARNING,
    SENSITIVE_REASON,
    parse_label,
    parse_warnings,
)
from cohortwise.functions.ratios import clip, only_finite
from cohortwise.operators.cohorts import MEASURE_COLUMNS
from cohortwise.operators.masking import has_sensitive_dimension
from cohortwise.operators.ranking import evidence_ref
from cohortwise.plans.ordered import running_total
from cohortwise.scratch import cut_lineage

# ---- Fixed values: display bounds. ----
AXIS = (0.0, 3.0)
COLOR_SCALE = (0.0, 2.0)
# ---- End of fixed values. ----

TRUE_COLUMNS = (
    "metric_actual_true",
    "metric_expected_true",
    "metric_ratio_true",
    "metric_ci_lower_true",
    "metric_ci_upper_true",
)


def metric_view(summary: DataFrame, metric: str) -> DataFrame:
    """The columns one metric shows, under common names; the expected claims size a cohort."""
    if metric not in MEASURE_COLUMNS:
        raise ValueError(f"Unknown metric {metric!r}; choose count or amount.")
    sources = MEASURE_COLUMNS[metric]
    shown = [
        only_finite(F.col(s).cast("double")).alias(t) for s, t in zip(sources, TRUE_COLUMNS)
    ]
    size = only_finite(F.col(sources[1]).cast("double")).alias("treemap_size_true")
    keys = [c for c in ("group_columns", "group_values") if c in summary.columns]
    return summary.select("cohort_rank", "Dimensions", *keys, *shown, size)


def exhibit_mask(cohorts: DataFrame) -> DataFrame:
    """Labels fit to print: sensitive cohorts masked, unreadable labels replaced.

    Needs cohort_rank and Dimensions; other columns pass through. group_columns and
    group_values, where a summary has them, are the cohort's key; else its label is taken apart.
    """
    label = F.col("Dimensions")
    pairs, unread = parse_label(label), parse_warnings(label) > 0
    if "group_values" in cohorts.columns:
        given = F.col("group_columns").isNotNull()
        key = F.zip_with(
            "group_columns",
            "group_values",
            lambda c, v: F.struct(c.alias("column"), F.coalesce(v, F.lit(NULL_KEY_TEXT)).alias("value")),
        )
        pairs, unread = F.when(given, key).otherwise(pairs), ~given & unread
    known = cohorts.withColumns(
        {"evidence_ref": evidence_ref(), "_pairs": pairs, "_unparsed": unread}
    )
    names = F.transform("_pairs", lambda p: p["column"])
    known = known.withColumn("_sensitive", has_sensitive_dimension(names))
    sensitive = F.col("_sensitive")
    unreadable = F.col("_unparsed") | (F.size("_pairs") == 0)
    text = F.coalesce(label, F.lit(NULL_KEY_TEXT))
    path = F.transform("_pairs", lambda p: F.concat(p["column"], F.lit("="), p["value"]))
    no_names = F.array().cast("array<string>")
    return known.withColumns(
        {
            "sanitized_dimensions": F.when(sensitive, MASKED_LABEL)
            .when(unreadable, F.col("evidence_ref"))
            .otherwise(text),
            "display_label": F.when(sensitive | unreadable, F.col("evidence_ref")).otherwise(text),
            "dimension_columns": F.when(sensitive, F.array(F.lit(MASKED_DIMENSION)))
            .when(unreadable, no_names)
            .otherwise(names),
            "hierarchy_parts": F.when(
                sensitive | unreadable, F.array("evidence_ref")
            ).otherwise(path),
            "masking_reason": F.when(sensitive, SENSITIVE_REASON).when(unreadable, PARSE_WARNING),
            "caution_flags": F.array_compact(
                F.array(
                    F.when(F.col("_unparsed"), PARSE_WARNING),
                    F.when(sensitive, SENSITIVE_REASON),
                )
            ),
        }
    ).drop("_pairs", "_unparsed", "_sensitive", "Dimensions", "group_columns", "group_values")


def _shown(source: str, bounds: tuple[float, float]) -> tuple[Column, Column]:
    shown = clip(F.col(source), *bounds)
    return shown, F.coalesce(shown != F.col(source), F.lit(False))


def exhibit_rows(summary: DataFrame, metric: str) -> DataFrame:
    """Every cohort with true values, values clipped to the axis, and clip flags."""
    masked = exhibit_mask(metric_view(summary, metric))
    added: dict[str, Column] = {}
    for name in ("ratio", "ci_lower", "ci_upper"):
        shown, clipped = _shown(f"metric_{name}_true", AXIS)
        added[f"metric_{name}_display"] = shown
        added[f"metric_{name}_clipped"] = clipped
    added["metric_ci_available"] = (
        F.col("metric_ci_lower_true").isNotNull() & F.col("metric_ci_upper_true").isNotNull()
    )
    color, saturated = _shown("metric_ratio_true", COLOR_SCALE)
    added["color_value_display"] = color
    added["color_value_saturated"] = saturated
    return masked.withColumnRenamed("cohort_rank", "source_row_number").withColumns(added)


def exhibit_top_n(rows: DataFrame, n: int = DEFAULT_TOP_N) -> DataFrame:
    """Review table of the first n cohorts in summary order, as many as asked for."""
    top = rows.where(F.col("source_row_number") <= row_limit(n))
    return top.select(
        "evidence_ref",
        "source_row_number",
        F.col("source_row_number").alias("visual_rank"),
        "sanitized_dimensions",
        F.array_join("dimension_columns", " | ").alias("dimension_columns"),
        *TRUE_COLUMNS,
        "metric_ratio_display",
        "metric_ci_lower_display",
        "metric_ci_upper_display",
        "metric_ratio_clipped",
        "metric_ci_lower_clipped",
        "metric_ci_upper_clipped",
        "metric_ci_available",
        "masking_reason",
        F.array_join("caution_flags", " | ").alias("caution_flags"),
    )


def hierarchy_rollup(rows: DataFrame) -> DataFrame:
    """One row per node of the label tree, with sums over the cohorts below it.

    A node's ratio is actual over expected; without expected claims it is the size-weighted
    mean of the cohort ratios, and without sizes their plain mean.
    """
    size = F.greatest(F.coalesce("treemap_size_true", F.lit(0.0)), F.lit(0.0))
    nodes = rows.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("hierarchy_parts")),
                lambda depth: F.slice("hierarchy_parts", F.lit(1), depth),
            )
        ).alias("path"),
        F.col("source_row_number").alias("place"),
        size.alias("size"),
        F.coalesce("metric_actual_true", F.lit(0.0)).alias("actual"),
        F.coalesce("metric_expected_true", F.lit(0.0)).alias("expected"),
        F.col("metric_ratio_true").alias("ratio"),
    )
    weighs = F.col("ratio").isNotNull() & (F.col("size") > 0)
    summed = nodes.groupBy("path").agg(
        F.min("place").alias("first_rank"),
        F.sum("size").alias("size"),
        F.sum("actual").alias("actual"),
        F.sum("expected").alias("expected"),
        F.sum(F.when(weighs, F.col("ratio") * F.col("size"))).alias("_weighted"),
        F.sum(F.when(weighs, F.col("size"))).alias("_weight"),
        F.avg("ratio").alias("_mean"),
    )
    ratio = (
        F.when(F.col("expected") > 0, F.col("actual") / F.col("expected"))
        .when(F.col("_weight") > 0, F.col("_weighted") / F.col("_weight"))
        .otherwise(F.col("_mean"))
    )
    return summed.select(
        "path",
        F.size("path").alias("depth"),
        F.element_at("path", -1).alias("label"),
        F.expr("slice(path, 1, size(path) - 1)").alias("parent"),
        "first_rank",
        "size",
        "actual",
        "expected",
        only_finite(ratio).alias("ratio"),
    )


def hierarchy_share(nodes: DataFrame, *, slices: int | None = None) -> DataFrame:
    """Each node's share of its parent's area, and where its part of the side begins.

    Children stand in order of first appearance. They split the width at even depths of the
    parent and the height at odd ones. Children of an empty parent get equal parts. A parent
    may have any number of children, so offsets are running totals over slices.
    """
    totals = nodes.groupBy("parent").agg(
        F.sum("size").alias("_total"), F.count(F.lit(1)).alias("_children")
    )
    weighed = nodes.join(totals, "parent").withColumns(
        {
            "_weight": F.when(F.col("_total") > 0, F.col("size")).otherwise(F.lit(1.0)),
            "_whole": F.when(F.col("_total") > 0, F.col("_total")).otherwise(
                F.col("_children").cast("double")
            ),
        }
    )
    placed = running_total(
        weighed,
        "_weight",
        order=[F.col("first_rank"), F.col("label")],
        segment=["parent"],
        name="_before",
        slices=slices,
    )
    return placed.withColumns(
        {
            "share": F.col("_weight") / F.col("_whole"),
            "offset": F.col("_before") / F.col("_whole"),
            "axis": F.when(F.col("depth") % 2 == 1, "width").otherwise("height"),
        }
    ).drop("_total", "_children", "_weight", "_whole", "_before")


#: The whole area as (x, y, width, height).
UNIT = (0.0, 0.0, 1.0, 1.0)


def hierarchy_layout(
    nodes: DataFrame, *, area: tuple[float, float, float, float] = UNIT, slices: int | None = None
) -> DataFrame:
    """The rectangle of each leaf: path, label, x, y, width, height, size, ratio.

    A node cuts its parent's rectangle along one side, from ``offset`` on and ``share`` long: an
    affine map of an interval, along x at odd depths and along y at even ones. A leaf's rectangle is
    the maps of all nodes on its path, put one into the other. Paths meet their own nodes by one
    join, on as many rows as the leaves' paths have nodes, however deep or wide the tree is.
    """
    placed = cut_lineage(hierarchy_share(nodes, slices=slices).select("path", "parent", "depth", "label", "share", "offset", "size", "ratio"))
    leaves = placed.join(placed.select(F.col("parent").alias("path")).distinct(), "path", "left_anti")
    on_path = leaves.select(
        F.col("path").alias("leaf"),
        F.explode(F.transform(F.sequence(F.lit(1), F.col("depth")), lambda d: F.slice("path", F.lit(1), d))).alias("path"),
    )
    cuts = on_path.join(placed.select("path", "depth", "share", "offset"), "path")
    # No deeper than the number of grouping columns.
    maps = cuts.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "offset", "share"))).alias("maps"))
    x, y, width, height = area

    def side(of: Column, start: float, length: float) -> Column:
        zero = F.struct(F.lit(float(start)).alias("at"), F.lit(float(length)).alias("long"))
        return F.aggregate(
            of,
            zero,
            lambda held, cut: F.struct(
                (held["at"] + held["long"] * cut["offset"]).alias("at"), (held["long"] * cut["share"]).alias("long")
            ),
        )

    across = side(F.filter("maps", lambda m: m["depth"] % 2 == 1), x, width)
    down = side(F.filter("maps", lambda m: m["depth"] % 2 == 0), y, height)
    composed = maps.select(F.col("leaf").alias("path"), across.alias("across"), down.alias("down"))
    return leaves.join(composed, "path").select(
        "path",
        "label",
        F.col("across.at").alias("x"),
        F.col("down.at").alias("y"),
        F.col("across.long").alias("width"),
        F.col("down.long").alias("height"),
        "size",
        "ratio",
    )
