"""Actuarial data-quality checks.

Every check yields (check_id, column_name, status, issue_count, message). All row-level checks
share one aggregation without a shuffle of rows; only the two checks on policy keys shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.contracts import MEASURES
from cohortwise.functions.values import (
    as_number,
    data_type,
    is_numeric,
    missing_text,
    named,
    parse_number,
)
from cohortwise.plans.sweep import later_rows
from cohortwise.scratch import cut_lineage

NUMERIC_COLUMNS = (*MEASURES, "Duration", "Issue_Age", "Age", "Face_Amount", "Study_Year")
INTEGER_COLUMNS = ("Duration", "Issue_Age", "Age", "Study_Year")
FULL_EXPOSURE_TOLERANCE = 1e-9

RAW_PROBLEM = "value(s) in the source are not numbers"
KEY_NAME = "Policy_Number+Duration"
# (check_id, column_name, failed, issue_count, problem)
Entry = tuple[str, str, Column, Column, str]
REPORT = "check_id string, column_name string, status string, issue_count bigint, message string"


@dataclass(frozen=True)
class RowCheck:
    """A rule that single rows break; ``broken`` is true for such rows."""

    check_id: str
    column: str
    broken: Column
    problem: str


def raw_checks(raw: DataFrame) -> list[RowCheck]:
    """Cells of the measures that are neither missing nor numbers, over a text view."""
    return [
        RowCheck(
            "dq_raw_non_numeric",
            m,
            parse_number(named(m)).isNull() & ~missing_text(named(m)),
            RAW_PROBLEM,
        )
        for m in MEASURES
        if m in raw.columns
    ]


def counted_raw_report(spark: SparkSession, counts: Mapping[str, int]) -> DataFrame:
    """Report of the raw check out of counts taken while a source was landed."""
    rows = []
    for column, count in counts.items():
        message = f"{column}: {count} {RAW_PROBLEM}" if count else None
        rows.append(("dq_raw_non_numeric", column, "FAIL" if count else "PASS", count, message))
    return spark.createDataFrame(rows, REPORT)


def row_checks(df: DataFrame) -> list[RowCheck]:
    """The rules that apply to the columns a table has.

    Comparisons use the numeric reading of a column, so a text column cannot break them; its
    type is reported by dq_numeric_type.
    """
    have = set(df.columns)
    mac, moc, mec = (as_number(df, c) if c in have else None for c in ("MAC", "MOC", "MEC"))
    checks = []

    def rule(check_id: str, column: str, broken: Column, problem: str) -> None:
        checks.append(RowCheck(check_id, column, broken, problem))

    for column in INTEGER_COLUMNS:
        if column in have and is_numeric(data_type(df, column)):
            fraction = as_number(df, column) % F.lit(1.0)  # NaN for an infinite value
            rule("dq_integer_valued", column, fraction != 0, "value(s) are not whole numbers")
    if "MAC" in have:
        rule("dq_mac_binary", "MAC", ~mac.isin(0.0, 1.0), "row(s) hold neither 0 nor 1")
    if "MEC" in have:
        inside = (mec > 0) & (mec < 1)
        rule("dq_mec_range", "MEC", ~inside, "row(s) are not between 0 and 1 exclusive")
    if "MOC" in have:
        inside = (moc > 0) & (moc <= 1)
        rule("dq_moc_range", "MOC", ~inside, "row(s) are not above 0 and up to 1")
    if "Face_Amount" in have:
        amount = as_number(df, "Face_Amount")
        rule("dq_face_positive", "Face_Amount", amount <= 0, "row(s) are not above 0")
    age = next((c for c in ("Issue_Age", "Age") if c in have), None)
    if age:
        rule("dq_age_positive", age, as_number(df, age) <= 0, "row(s) are not above 0")
    if {"MAC", "COLA"} <= have:
        cola = named("COLA")
        empty = cola.isNull() | (cola.cast("string") == "") | (cola.cast("string") == "NaN")
        rule(
            "dq_cola_null_when_alive",
            "COLA",
            (mac == 0) & ~empty,
            "row(s) without a claim carry a claim amount",
        )
        rule(
            "dq_cola_set_when_claim",
            "COLA",
            (mac == 1) & empty,
            "row(s) with a claim lack its amount",
        )
    if {"MAC", "MOC"} <= have:
        partial = F.abs(moc - 1.0) > FULL_EXPOSURE_TOLERANCE
        rule(
            "dq_moc_full_when_claim",
            "MOC",
            (mac == 1) & partial,
            "row(s) with a claim lack full exposure",
        )
    return checks


def _message(column: Column, count: Column, problem: Column) -> Column:
    return F.concat(column, F.lit(": "), count.cast("string"), F.lit(" "), problem)


def _report(counted: DataFrame, entries: Sequence[Entry]) -> DataFrame:
    """Report rows out of one row of counts."""
    rows = [
        F.struct(
            F.lit(check).alias("check_id"),
            F.lit(column).alias("column_name"),
            F.when(failed, "FAIL").otherwise("PASS").alias("status"),
            count.cast("bigint").alias("issue_count"),
            F.when(failed, _message(F.lit(column), count, F.lit(problem))).alias("message"),
        )
        for check, column, failed, count, problem in entries
    ]
    return counted.select(F.inline(F.array(*rows)))


def check_rows(df: DataFrame, checks: Sequence[RowCheck]) -> DataFrame:
    """Report of row-level checks out of one aggregation."""
    if not checks:
        return df.sparkSession.createDataFrame([], REPORT)
    counted = df.agg(*[F.count_if(c.broken).alias(f"c{i}") for i, c in enumerate(checks)])
    entries = [
        (c.check_id, c.column, F.col(f"c{i}") > 0, F.col(f"c{i}"), c.problem)
        for i, c in enumerate(checks)
    ]
    return _report(counted, entries)


def check_schema(df: DataFrame) -> DataFrame:
    """Required columns that are absent and number columns of another type."""
    rows = []
    for column in MEASURES:
        gone = column not in df.columns
        message = f"{column}: the required column is absent" if gone else None
        rows.append(
            ("dq_missing_columns", column, "FAIL" if gone else "PASS", int(gone), message)
        )
    for column in NUMERIC_COLUMNS:
        if column in df.columns:
            text = not is_numeric(data_type(df, column))
            message = f"{column}: the column must be numeric" if text else None
            rows.append(
                ("dq_numeric_type", column, "FAIL" if text else "PASS", int(text), message)
            )
    return df.sparkSession.createDataFrame(rows, REPORT)


def _keyed(df: DataFrame) -> DataFrame:
    """Rows and claims per policy and duration as stored, combined before the shuffle.

    Keys with a missing part keep their rows but lend no claims to the death check; ``at`` is the
    duration as a number, which text need not hold.
    """
    stored, at = named("Duration"), as_number(df, "Duration")
    if not is_numeric(data_type(df, "Duration")):
        stored = F.when(~missing_text(stored.cast("string")), stored.cast("string"))
    whole = F.col("Policy_Number").isNotNull() & at.isNotNull()
    claim = whole & (as_number(df, "MAC") == 1) if "MAC" in df.columns else F.lit(False)
    return df.groupBy(F.col("Policy_Number").alias("policy"), stored.alias("stored"), at.alias("at")).agg(
        F.count(F.lit(1)).alias("copies"), F.count_if(claim).alias("claims")
    )


#: Types whose values are different numbers as doubles too; longs are so up to EXACT.
TOLD_APART = (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)
EXACT = float(1 << 53)


def _by_number(keyed: DataFrame, *, co_located: bool = False) -> DataFrame:
    """One row per policy and duration as a number; text may write a number in several ways, and
    decimals and very large longs may share a double. Other rows are one per number already."""
    columns, kind = ("policy", "at", "copies", "claims"), data_type(keyed, "stored")
    if isinstance(kind, TOLD_APART):
        return keyed.select(*columns)
    if isinstance(kind, T.LongType) and not co_located:
        apart = F.coalesce(F.abs("at") < EXACT, F.lit(True))
        return keyed.where(apart).select(*columns).unionAll(_summed(keyed.where(~apart)))
    return _summed(keyed)


def _summed(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("policy", "at").agg(F.sum("copies").alias("copies"), F.sum("claims").alias("claims"))


def _repeats() -> list[Column]:
    repeated = F.col("copies") > 1
    whole = F.col("policy").isNotNull() & F.col("stored").isNotNull()
    return [F.count_if(repeated).alias("repeats"), F.count_if(repeated & whole).alias("pairs")]


def _repeat_entry() -> Entry:
    # Repeated keys with a missing part fail the check but are no pairs to count.
    failed, pairs = F.col("repeats") > 0, F.col("pairs")
    return "dq_duplicate_key", KEY_NAME, failed, pairs, "key(s) occur more than once"


def _later_entry() -> Entry:
    later = F.col("later")
    problem = "row(s) of exposure follow a claim of the same policy"
    return "dq_death_exposure", KEY_NAME, later > 0, later, problem


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Distinct policy and duration pairs that occur more than once, as one report row."""
    return _report(_keyed(df).agg(*_repeats()), [_repeat_entry()])


def death_exposure(df: DataFrame, *, slices: int | None = None, co_located: bool = False) -> DataFrame:
    """Pairs of a claim row and a later row of the same policy, as one report row.

    The pairs are counted, not built: one sweep over the rows in order of policy and duration meets
    each row with as many claims as lie below its duration, whatever number of rows a policy has.
    ``co_located``: the table is bucketed by policy, so its rows are swept where they lie.
    """
    keyed = _by_number(_keyed(df), co_located=co_located)
    later = later_rows(keyed if co_located else cut_lineage(keyed), slices=slices, co_located=co_located)
    return _report(later, [_later_entry()])


def key_checks(df: DataFrame, *, co_located: bool = False) -> DataFrame:
    """Both checks on policy keys out of one grouping; without any on a table bucketed by policy."""
    if "MAC" not in df.columns:
        return duplicate_keys(df)
    if co_located:
        return duplicate_keys(df).unionByName(death_exposure(df, co_located=True))
    keyed = cut_lineage(_keyed(df))
    later = later_rows(_by_number(keyed))
    return _report(keyed.agg(*_repeats()), [_repeat_entry()]).unionByName(_report(later, [_later_entry()]))


def dq_report(
    df: DataFrame,
    raw: DataFrame | None = None,
    *,
    raw_counts: Mapping[str, int] | None = None,
    co_located: bool = False,
) -> DataFrame:
    """All checks. ``raw`` is the text view of the source, before numbers were read from it;
    ``raw_counts`` are its failing cells per measure where landing has counted them;
    ``co_located`` says that the table is bucketed by policy."""
    parts = [check_schema(df), check_rows(df, row_checks(df))]
    if raw_counts is not None:
        parts.insert(0, counted_raw_report(df.sparkSession, raw_counts))
    elif raw is not None:
        parts.insert(0, check_rows(raw, raw_checks(raw)))
    if {"Policy_Number", "Duration"} <= set(df.columns):
        parts.append(key_checks(df, co_located=co_located))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def dq_gate(report: DataFrame) -> DataFrame:
    """PASS only if no check failed."""
    failed = F.count_if(F.col("status") == "FAIL")
    return report.agg(
        F.when(failed == 0, "PASS").otherwise("FAIL").alias("status"),
        failed.alias("issue_count"),
    )
