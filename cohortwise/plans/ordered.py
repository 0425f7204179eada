"""Order-dependent results over data of any size.

A window without a partition key, or with one hot key, sends its rows to a single task. The
functions here cut the sorted data into even slices instead, work inside each slice, and carry
the slice totals over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.values import named
from cohortwise.scratch import cut_lineage


def running_total(
    df: DataFrame,
    value: str,
    *,
    order: Sequence[Column],
    segment: Sequence[str] = (),
    name: str,
    slices: int | None = None,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before each row, per segment.

    Rows are range-partitioned by segment and order, so a segment of any size spreads over
    several slices. Writing them freezes the slices: range bounds come from sampling and
    would differ if the rows were partitioned twice. ``order`` must leave no ties inside a
    segment. Without ``slices``, adaptive execution sizes them by the data, up to
    spark.sql.shuffle.partitions.
    """
    segments = [named(c) for c in segment]
    number = [slices] if slices else []
    ranged = df.repartitionByRange(*number, *segments, *order)
    cut = cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()))
    before = (
        Window.partitionBy(*segments, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast(cut.schema[value].dataType)
    inside = cut.withColumn("_inside", F.coalesce(F.sum(value).over(before), zero))
    carried = _carried(cut, value, segment)
    same = F.col("_slice") == F.col("_carry_slice")
    for i, column in enumerate(segments):
        same &= column.eqNullSafe(F.col(f"_seg{i}"))
    # At most one row per slice, see _carried.
    joined = inside.join(F.broadcast(carried), same, "left")
    total = F.col("_inside") + F.coalesce("_carry", F.lit(0))
    return joined.withColumn(name, total).select(*[named(c) for c in df.columns], name)


def _carried(cut: DataFrame, value: str, segment: Sequence[str]) -> DataFrame:
    """What a slice inherits for a segment that began in an earlier one.

    Slices are contiguous, so only the first segment of a slice can inherit anything, and only
    the first and last segments of a slice can lie in two: the result has at most one row per
    slice, and the sums behind it at most two.
    """
    names = [f"_seg{i}" for i in range(len(segment))]
    keyed = cut.select(
        *[named(c).alias(n) for c, n in zip(segment, names)],
        F.col("_slice").alias("_carry_slice"),
        F.col(value).alias("_value"),
    )
    if names:
        whole = F.struct(*names)
        ends = keyed.groupBy("_carry_slice").agg(F.min(whole).alias("a"), F.max(whole).alias("b"))
        shared = ends.select(F.explode(F.array("a", "b")).alias("end")).distinct()
        keyed = keyed.join(F.broadcast(shared), whole.eqNullSafe(F.col("end")), "left_semi")
    earlier = (
        Window.partitionBy(*(names or [F.lit(0)]))
        .orderBy("_carry_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = keyed.groupBy(*names, "_carry_slice").agg(F.sum("_value").alias("_total"))
    return (
        totals.withColumn("_carry", F.sum("_total").over(earlier))
        .where(F.col("_carry").isNotNull())
        .drop("_total")
    )
