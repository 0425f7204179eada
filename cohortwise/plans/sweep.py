"""Meeting each row with the earlier claims of its policy in one sweep over sorted ranges.

Rows are cut into ranges by policy and duration, so a policy of any size lies in neighbouring ranges.
Each task passes its range once, batch by batch, and keeps one running sum: the claims of the open
policy. What crosses a border is settled afterwards out of two rows a range: how many rows its first
policy has there, which meet the claims of that policy in the ranges before, and how many claims its
last policy has there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A range: what its rows meet inside it, and its first and last policy; pairs as text, since they may
#: exceed 64 bits. A range of one policy has it as both.
SWEPT = "slice int, pairs string, first string, first_copies long, last string, last_claims long"


class Sweep:
    """The state of a range while its rows come by in order."""

    def __init__(self) -> None:
        self.pairs = 0
        self.first: str | None = None
        self.first_copies = 0
        self.open: str | None = None
        self.claims = 0  # of the open policy so far

    def take(self, policies: pa.Array, copies: np.ndarray, claims: np.ndarray) -> None:
        """The next rows; durations within a policy rise from row to row."""
        n = len(policies)
        starts = np.ones(n, bool)
        starts[1:] = pc.not_equal(policies.slice(1), policies.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        if self.open is not None and policies[0].as_py() == self.open:
            starts[0] = False
        heads = np.flatnonzero(starts)
        before = np.cumsum(claims) - claims
        # Claims of the policy before each row: the running sum less what it was at the policy's head.
        base = np.full(n, -self.claims, np.int64)
        if len(heads):
            base[heads[0] :] = np.repeat(before[heads], np.diff(np.append(heads, n)))
        earlier = before - base
        self.pairs += _dot(copies, earlier)
        if self.first is None:
            self.first = policies[0].as_py()
        head = heads[heads > 0][0] if (heads > 0).any() else n
        if policies[0].as_py() == self.first:
            self.first_copies += int(copies[:head].sum())
        self.open = policies[n - 1].as_py()
        self.claims = int(earlier[-1] + claims[-1])


def _dot(a: np.ndarray, b: np.ndarray) -> int:
    """The exact sum of products; in 64 bits where they are enough."""
    if len(a) and int(a.max()) * int(b.max()) * len(a) < 1 << 62:
        return int(a @ b)
    return sum(x * y for x, y in zip(a.tolist(), b.tolist(), strict=True))


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = Sweep()
    for batch in batches:
        if batch.num_rows:
            state.take(batch.column("policy"), batch.column("copies").to_numpy(), batch.column("claims").to_numpy())
    if state.first is not None:
        row = {
            "slice": [TaskContext.get().partitionId()], "pairs": [str(state.pairs)], "first": [state.first],
            "first_copies": [state.first_copies], "last": [state.open], "last_claims": [state.claims],
        }
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), kinds, strict=True)], names=[*row])


def later_rows(keyed: DataFrame, *, slices: int | None = None, co_located: bool = False) -> DataFrame:
    """One row, ``later``: pairs of a claim and a later row of its policy.

    ``keyed``: policy, at, copies, claims, one row per policy and duration. Rows without a policy or
    a duration stand outside. Without ``slices``, adaptive execution sizes the ranges by the data.
    ``co_located``: each policy is in one task already, so rows stay where they are.
    """
    whole = keyed.where(F.col("policy").isNotNull() & F.col("at").isNotNull())
    rows = whole.select(F.col("policy").cast("string").alias("policy"), "at", "copies", "claims")
    number = [slices] if slices else []
    ranged = rows if co_located else rows.repartitionByRange(*number, "policy", "at")
    ordered = ranged.sortWithinPartitions("policy", "at").select("policy", "copies", "claims")
    swept = ordered.mapInArrow(_swept, SWEPT)
    if co_located:
        total = F.sum(F.col("pairs").cast("decimal(38,0)"))
        return swept.agg(F.coalesce(total, F.lit(0)).cast("bigint").alias("later"))
    # A range's first policy stands before its last in the order, so it does not meet its own claims.
    zero = F.lit(0).cast("bigint")
    borders = F.array(
        F.struct(F.col("first").alias("policy"), F.lit(0).alias("side"), F.col("first_copies").alias("copies"), zero.alias("claims"), F.col("pairs")),
        F.struct(F.col("last").alias("policy"), F.lit(1).alias("side"), zero.alias("copies"), F.col("last_claims").alias("claims"), F.lit("0").alias("pairs")),
    )
    ends = swept.select("slice", F.inline(borders))
    # Two rows a range at most.
    before = Window.partitionBy("policy").orderBy("slice", "side").rowsBetween(Window.unboundedPreceding, -1)
    wide = "decimal(38,0)"
    met = F.col("copies").cast("decimal(19,0)") * F.coalesce(F.sum("claims").over(before), zero).cast("decimal(19,0)")
    carried = ends.select((met.cast(wide) + F.col("pairs").cast(wide)).alias("pairs"))
    return carried.agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("bigint").alias("later"))
