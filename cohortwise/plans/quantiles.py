"""Exact quantiles of a column of any size.

Few distinct values are ranked in one task. For many, a sketch brackets each quantile, one
counting pass proves the brackets right, and only the values inside them are ranked.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.plans.ordered import running_total

# Up to this many distinct values are sorted in one task.
ONE_TASK_VALUES = 100_000
SKETCH_ACCURACY = 10_000
# Distance from a quantile to the ends of its bracket, in sketch errors.
BRACKET_ERRORS = 3


def value_ranks(numbers: DataFrame, *, spread: bool, slices: int | None = None) -> DataFrame:
    """Distinct values with their copies and the number of rows ``before`` them in order."""
    values = numbers.groupBy("value").agg(F.count(F.lit(1)).alias("copies"))
    if spread:
        order = [F.col("value")]
        return running_total(values, "copies", order=order, name="before", slices=slices)
    earlier = (
        Window.partitionBy(F.lit(0)).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    )
    return values.withColumn("before", F.coalesce(F.sum("copies").over(earlier), F.lit(0)))


def values_at(ranked: DataFrame, ranks: Iterable[int]) -> dict[int, float]:
    """Values at the given zero-based ranks; at most one row per rank reaches the driver."""
    wanted = F.array(*[F.lit(r).cast("bigint") for r in sorted(set(ranks))])
    after = F.col("before") + F.col("copies")
    held = F.filter(wanted, lambda r: (r >= F.col("before")) & (r < after))
    hits = ranked.withColumn("ranks", held).where(F.size("ranks") > 0)
    return {rank: row["value"] for row in hits.collect() for rank in row["ranks"]}


def sketch(number: Column, parts: int) -> Column:
    """Aggregate of values a little below and above each of the parts+1 quantiles."""
    margin = BRACKET_ERRORS / SKETCH_ACCURACY
    shares = [i / parts + side for i in range(parts + 1) for side in (-margin, margin)]
    inside = [F.lit(min(1.0, max(0.0, s))) for s in shares]
    return F.approx_percentile(number, F.array(*inside), SKETCH_ACCURACY)


def _brackets(sketched: Sequence[float]) -> list[tuple[float, float]]:
    """Disjoint value ranges that should hold the quantiles."""
    merged: list[tuple[float, float]] = []
    for low, high in sorted(zip(sketched[::2], sketched[1::2])):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _narrowed(
    numbers: DataFrame, ranks: Sequence[int], brackets: Sequence[tuple[float, float]]
) -> tuple[DataFrame, dict[int, int], int] | None:
    """Rows inside the brackets, each rank's rank among them, and their number.

    None if a rank turns out to lie outside, which the sketch's error bound all but excludes.
    """
    inside = [F.col("value").between(low, high) for low, high in brackets]
    counts = numbers.agg(
        *[F.count_if(F.col("value") < low) for low, _ in brackets],
        *[F.count_if(i) for i in inside],
    ).first()
    below, held = counts[: len(brackets)], counts[len(brackets) :]
    moved: dict[int, int] = {}
    for rank in ranks:
        for j, (start, size) in enumerate(zip(below, held)):
            if start <= rank < start + size:
                moved[rank] = rank - start + sum(held[:j])
        if rank not in moved:
            return None
    return numbers.where(reduce(or_, inside)), moved, sum(held)


def exact_quantiles(
    df: DataFrame,
    number: Column,
    parts: int,
    *,
    count: int,
    distinct: int,
    sketched: Sequence[float] | None = None,
    one_task_values: int = ONE_TASK_VALUES,
    slices: int | None = None,
) -> list[float]:
    """The parts+1 linear-interpolation quantiles of a column with ``count`` numbers.

    Ranks are whole-number arithmetic, so an edge that falls on a value is that value.
    ``distinct`` is an estimate that only decides how to rank; ``sketched`` is the result of
    ``sketch`` where another pass over the column has computed it already.
    """
    places = [divmod(i * (count - 1), parts) for i in range(parts + 1)]
    ranks = sorted({r for low, part in places for r in (low, low + (part > 0))})
    numbers = df.select(number.alias("value")).where(F.col("value").isNotNull())
    rows, moved, size = numbers, {r: r for r in ranks}, distinct
    if distinct > one_task_values:
        if sketched is None:
            sketched = numbers.agg(sketch(F.col("value"), parts)).first()[0]
        narrowed = _narrowed(numbers, ranks, _brackets(sketched))
        if narrowed:
            rows, moved, size = narrowed
    ranked = value_ranks(rows, spread=size > one_task_values, slices=slices)
    found = values_at(ranked, moved.values())
    at_rank = {rank: found[place] for rank, place in moved.items()}
    return [
        at_rank[low] + (at_rank[low + (part > 0)] - at_rank[low]) * (part / parts)
        for low, part in places
    ]
