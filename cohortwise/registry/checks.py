"""Data-quality checks and the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortwise.operators.quality import (
    check_rows,
    death_exposure,
    dq_gate,
    dq_report,
    duplicate_keys,
    key_checks,
    raw_checks,
    row_checks,
)
from cohortwise.registry.common import FLAWED, INFORCE, TYPED, sql_missing, sql_number, typed_flaws
from cohortwise.scratch import new_table_path
from cohortwise.sources.stores import bucket_number, read_prepared, write_prepared
from cohortwise.sources.tables import flawed_inforce, inforce

ROW_CHECKS = (
    "dq_integer_valued",
    "dq_mac_binary",
    "dq_mec_range",
    "dq_moc_range",
    "dq_face_positive",
    "dq_age_positive",
    "dq_cola_null_when_alive",
    "dq_cola_set_when_claim",
    "dq_moc_full_when_claim",
)
RESULT = ("check_id", "column_name", "status", "issue_count")


def _row_check(check_id):
    def query(spark, sf_dir):
        df = typed_flaws(spark, sf_dir)
        chosen = [c for c in row_checks(df) if c.check_id == check_id]
        return check_rows(df, chosen).select(*RESULT)

    return query


def query_dq_raw_non_numeric(spark, sf_dir):
    raw = flawed_inforce(spark, sf_dir)
    return check_rows(raw, raw_checks(raw)).select(*RESULT)


def query_dq_duplicate_key(spark, sf_dir):
    return duplicate_keys(inforce(spark, sf_dir)).select(*RESULT)


def query_dq_death_exposure(spark, sf_dir):
    return death_exposure(inforce(spark, sf_dir)).select(*RESULT)


def query_dq_death_exposure_fractional(spark, sf_dir):
    """The same check with missing keys and durations between whole years."""
    return death_exposure(typed_flaws(spark, sf_dir)).select(*RESULT)


def query_bucketed_key_checks(spark, sf_dir):
    """Both key checks on a prepared version in buckets by policy, without moving its rows."""
    df = inforce(spark, sf_dir)
    path = write_prepared(df, new_table_path(spark, "bucketed"), buckets=bucket_number(df))
    return key_checks(read_prepared(spark, path), co_located=True).select(*RESULT)


def query_dq_gate(spark, sf_dir):
    """Gate of the clean-looking view and of the flawed one."""
    clean = dq_gate(dq_report(inforce(spark, sf_dir)))
    flawed = dq_gate(dq_report(typed_flaws(spark, sf_dir), flawed_inforce(spark, sf_dir)))
    return clean.withColumn("source", F.lit("inforce")).unionByName(
        flawed.withColumn("source", F.lit("flawed"))
    )


QUERIES = {
    **{name: _row_check(name) for name in ROW_CHECKS},
    **{
        name.removeprefix("query_"): value
        for name, value in list(globals().items())
        if name.startswith("query_")
    },
}


def _one(check: str, column: str, broken: str, source: str = "typed") -> str:
    return f"""select '{check}' as check_id, '{column}' as column_name,
  case when count(*) filter (where {broken}) > 0 then 'FAIL' else 'PASS' end as status,
  cast(count(*) filter (where {broken}) as bigint) as issue_count from {source}"""


def _raw(column: str) -> str:
    text = f'"{column}"'
    broken = f"not {sql_missing(text)} and ({sql_number(text)}) is null"
    return _one("dq_raw_non_numeric", column, broken, "flawed")


_EMPTY = """("COLA" is null or "COLA" = '')"""
_BROKEN = {
    "dq_mac_binary": ("MAC", '"MAC" not in (0, 1)'),
    "dq_mec_range": ("MEC", 'not ("MEC" > 0 and "MEC" < 1)'),
    "dq_moc_range": ("MOC", 'not ("MOC" > 0 and "MOC" <= 1)'),
    "dq_face_positive": ("Face_Amount", '"Face_Amount" <= 0'),
    "dq_age_positive": ("Issue_Age", '"Issue_Age" <= 0'),
    "dq_cola_null_when_alive": ("COLA", f'"MAC" = 0 and not {_EMPTY}'),
    "dq_cola_set_when_claim": ("COLA", f'"MAC" = 1 and {_EMPTY}'),
    "dq_moc_full_when_claim": ("MOC", '"MAC" = 1 and abs("MOC" - 1) > 1e-9'),
}


def _whole(column: str) -> str:
    broken = f'"{column}" is not null and (isinf("{column}") or "{column}" <> floor("{column}"))'
    return _one("dq_integer_valued", column, broken)


def _duplicates(source: str) -> str:
    return f"""select 'dq_duplicate_key' as check_id, 'Policy_Number+Duration' as column_name,
  case when count(*) > 0 then 'FAIL' else 'PASS' end as status,
  cast(count(*) filter (where "Policy_Number" is not null and "Duration" is not null) as bigint)
    as issue_count
from (select "Policy_Number", "Duration" from {source} group by all having count(*) > 1)"""


def _deaths(source: str) -> str:
    return f"""select 'dq_death_exposure' as check_id, 'Policy_Number+Duration' as column_name,
  case when count(*) > 0 then 'FAIL' else 'PASS' end as status,
  cast(count(*) as bigint) as issue_count
from {source} d join {source} l using ("Policy_Number")
where d."MAC" = 1 and l."Duration" > d."Duration" """


_ALL_TYPED = [
    *map(_whole, ("Duration", "Issue_Age")),
    *[_one(k, c, b) for k, (c, b) in _BROKEN.items()],
    _duplicates("typed"),
    _deaths("typed"),
]
_ALL_INFORCE = [
    _one(k, c, b.replace(_EMPTY, '("COLA" is null)'), "inforce") for k, (c, b) in _BROKEN.items()
] + [_duplicates("inforce"), _deaths("inforce")]
_RAWS = [_raw(c) for c in ("MAC", "MOC", "MEC", "MAF", "MEF")]


def _gate(checks: list[str], source: str) -> str:
    return f"""select case when count(*) filter (where status = 'FAIL') = 0 then 'PASS'
    else 'FAIL' end as status,
  cast(count(*) filter (where status = 'FAIL') as bigint) as issue_count,
  '{source}' as source from ({" union all ".join(checks)})"""


SQL = {
    "dq_raw_non_numeric": f"with {FLAWED} " + " union all ".join(_RAWS),
    "dq_integer_valued": f"with {TYPED} "
    + " union all ".join(map(_whole, ("Duration", "Issue_Age"))),
    **{k: f"with {TYPED} {_one(k, c, b)}" for k, (c, b) in _BROKEN.items()},
    "dq_duplicate_key": f"with {INFORCE} {_duplicates('inforce')}",
    "dq_death_exposure": f"with {INFORCE} {_deaths('inforce')}",
    "bucketed_key_checks": f"with {INFORCE} {_duplicates('inforce')} union all {_deaths('inforce')}",
    "dq_death_exposure_fractional": f"with {TYPED} {_deaths('typed')}",
    "dq_gate": f"with {INFORCE}, {TYPED} {_gate(_ALL_INFORCE, 'inforce')} union all "
    + _gate(_RAWS + _ALL_TYPED, "flawed"),
}
