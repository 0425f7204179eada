"""Landing a CSV: one parse gives typed Parquet and every fact about the source.

The types of a CSV's columns are those that all cells fit, known only once all are read. So a cell
is stored by what it holds, as a whole number, another number, or text, in columns of its own, and
the counts that decide the types are observed while the rows are written, together with the counts
of the raw-number check and the digest of the rows. Reading a column picks the stored columns of
its type; nothing is parsed a second time.

Text that a number does not print as (" 7", "007", "1.50") is stored beside the number, since the
column may turn out to be text. Observed counts are complete: landing is one stage without a shuffle,
and Spark takes each of its tasks into account once, whether or not it was retried.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.contracts import MEASURES
from cohortwise.functions.values import CSV_MISSING_CELLS, missing_text, named, parse_integer, parse_number
from cohortwise.operators.audit import STATE, canonical_row, content_hash, digest_sums, row_lanes
from cohortwise.scratch import compiled_methods

WHOLE, NUMBER, TEXT = "whole", "number", "text"


@dataclass(frozen=True)
class Landed:
    """A landed CSV: where its cells are, and what was observed while they were written."""

    path: str
    columns: list[str]
    kinds: dict[str, str]
    state: dict[str, int]
    not_numbers: dict[str, int] = field(default_factory=dict)

    @property
    def row_count(self) -> int:
        return self.state["row_count"]

    def content_hash(self, spark: SparkSession) -> str:
        """Hash of the cells as written in the CSV, whatever the order of the records."""
        if len(self.state) < len(STATE):
            raise ValueError("This CSV was landed without a digest.")
        cells = T.StructType([T.StructField(c, T.StringType()) for c in self.columns])
        state = spark.createDataFrame([tuple(self.state[c] for c in STATE)], ", ".join(f"{c} bigint" for c in STATE))
        return state.select(content_hash(cells)).first()[0]


def _stored(column: str, place: int) -> dict[str, Column]:
    """The columns that keep a column's cells: w whole numbers, n other numbers, t texts."""
    raw = named(column)
    cell = F.when(~raw.isin(*CSV_MISSING_CELLS), raw)
    if column == "Policy_Number":
        return {f"t{place}": cell}
    if column in MEASURES:
        return {f"n{place}": F.col(f"_n{place}")}
    whole, number = F.col(f"_w{place}"), F.col(f"_n{place}")
    printed = F.coalesce(whole.cast("string"), number.cast("string"))
    return {
        f"w{place}": whole,
        f"n{place}": F.when(whole.isNull(), number),
        f"t{place}": F.when(~printed.eqNullSafe(cell), cell),
    }


def _is_open(column: str) -> bool:
    """Whether the cells decide the type."""
    return column not in MEASURES and column != "Policy_Number"


def land(text: DataFrame, path: str, *, digest: bool = True) -> Landed:
    """Write a table of text cells to ``path``, in one job, and keep what is observed there.

    ``digest=False`` spares the hash of the rows for who reads the table and never asks for it.
    """
    columns = text.columns
    parsed = {}
    for place, column in enumerate(columns):
        # No text that means a missing cell is a number.
        if column != "Policy_Number":
            parsed[f"_n{place}"] = parse_number(named(column))
        if _is_open(column):
            parsed[f"_w{place}"] = parse_integer(named(column))
    # Parsed in a step of its own, as each number is looked at more than once.
    cells = text.select("*", *[c.alias(name) for name, c in parsed.items()])
    lanes = row_lanes(canonical_row(text)) if digest else []
    state = STATE if digest else STATE[:1]
    stored, checks, metrics = {}, {}, digest_sums()[: len(state)]
    for place, column in enumerate(columns):
        stored |= _stored(column, place)
        if column in MEASURES:
            checks[f"bad{place}"] = F.col(f"_n{place}").isNull() & ~missing_text(named(column))
            metrics.append(F.count_if(f"bad{place}").alias(f"bad{place}"))
        elif _is_open(column):
            w, n, t = (F.col(f"{kind}{place}") for kind in "wnt")
            metrics += [
                F.count_if(w.isNull() & n.isNull() & t.isNotNull()).alias(f"text{place}"),
                F.count_if(n.isNotNull()).alias(f"number{place}"),
                F.count_if(w.isNotNull()).alias(f"whole{place}"),
            ]
    seen = Observation()
    rows = cells.select(
        *[c.alias(name) for name, c in (stored | checks).items()], *lanes
    ).observe(seen, *metrics)
    with compiled_methods(text.sparkSession):
        rows.select(*stored).write.mode("errorifexists").parquet(f"{path}/cells")
    facts = seen.get
    kinds = {}
    for place, column in enumerate(columns):
        if not _is_open(column):
            kinds[column] = NUMBER if column in MEASURES else TEXT
        elif facts[f"text{place}"]:
            kinds[column] = TEXT
        else:
            kinds[column] = WHOLE if facts[f"whole{place}"] and not facts[f"number{place}"] else NUMBER
    landed = Landed(
        path,
        columns,
        kinds,
        {c: int(facts[c]) for c in state},
        {c: int(facts[f"bad{place}"]) for place, c in enumerate(columns) if c in MEASURES},
    )
    written = text.sparkSession.createDataFrame([(json.dumps(asdict(landed)),)], "value string")
    written.coalesce(1).write.mode("errorifexists").text(f"{path}/facts")
    return landed


def landed_at(spark: SparkSession, path: str) -> Landed:
    """A CSV that was landed before, by its folder."""
    facts: Mapping = json.loads(spark.read.text(f"{path}/facts", wholetext=True).first()["value"])
    return Landed(**{**facts, "path": path})


def read_landed(spark: SparkSession, landed: Landed) -> DataFrame:
    """The table with the types that its cells have shown."""
    out, fields = [], []
    for place, column in enumerate(landed.columns):
        w, n, t = (F.col(f"{kind}{place}") for kind in "wnt")
        kind = landed.kinds[column]
        fields += [T.StructField(name, _TYPES[name[0]]) for name in _stored_names(column, place)]
        if not _is_open(column):
            value = n if column in MEASURES else t
        elif kind == WHOLE:
            value = w
        elif kind == NUMBER:
            value = F.coalesce(n, w.cast("double"))
        else:
            value = F.coalesce(t, w.cast("string"), n.cast("string"))
        out.append(value.alias(column))
    return spark.read.schema(T.StructType(fields)).parquet(f"{landed.path}/cells").select(*out)


_TYPES = {"w": T.LongType(), "n": T.DoubleType(), "t": T.StringType()}


def _stored_names(column: str, place: int) -> list[str]:
    kinds = "wnt" if _is_open(column) else "n" if column in MEASURES else "t"
    return [f"{kind}{place}" for kind in kinds]
