"""Scalar filters on in-force rows."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.functions.values import data_type, is_numeric, named

OPERATORS = ("=", "!=", ">", ">=", "<", "<=")


@dataclass(frozen=True)
class RowFilter:
    """One comparison of a column with a constant."""

    column: str
    operator: str
    value: Any

    def __post_init__(self) -> None:
        if self.operator == "==":
            object.__setattr__(self, "operator", "=")
        if self.operator not in OPERATORS:
            raise ValueError(f"Filter operator {self.operator!r} is not one of {OPERATORS}.")
        if not isinstance(self.value, (str, int, float, bool, type(None))):
            raise ValueError(f"A filter compares with one text or number, not {self.value!r}.")

    def condition(self, kind: T.DataType) -> Column:
        """Predicate for a column of type ``kind``.

        A text never equals a number; asking which is larger is an error.
        """
        column, value = named(self.column), self.value
        if value is None:
            if self.operator in ("=", "!="):
                return F.lit(self.operator == "!=")
            raise ValueError(f"Column `{self.column}` cannot be ordered against a missing value.")
        number = is_numeric(kind)
        if isinstance(kind, T.BooleanType):
            column, number = column.cast("int"), True
        if isinstance(value, bool):
            value = int(value)
        if (number and isinstance(value, str)) or (
            isinstance(kind, T.StringType) and not isinstance(value, str)
        ):
            if self.operator in ("=", "!="):
                return F.lit(self.operator == "!=")
            raise ValueError(
                f"Column `{self.column}` of type {kind.simpleString()} cannot be ordered "
                f"against {self.value!r}."
            )
        constant = F.lit(value)
        if self.operator == "!=":  # rows without a value differ from every value
            return ~column.eqNullSafe(constant)
        compared = {
            "=": column == constant,
            ">": column > constant,
            ">=": column >= constant,
            "<": column < constant,
            "<=": column <= constant,
        }
        return compared[self.operator]

    def as_dict(self) -> dict[str, Any]:
        return {"column": self.column, "operator": self.operator, "value": self.value}


#: Field of a filter, and the keys under which a specification may give it.
SPECIFICATION = {"column": ("column",), "operator": ("op", "operator"), "value": ("value",)}


def read_specification(spec: Any) -> tuple[RowFilter | None, list[str]]:
    """The filter that a specification describes, or everything that is wrong with it."""
    if isinstance(spec, RowFilter):
        return spec, []
    if not isinstance(spec, Mapping):
        return None, ["it is no JSON object"]
    given = {field: [key for key in keys if key in spec] for field, keys in SPECIFICATION.items()}
    faults = [f"it lacks {' or '.join(SPECIFICATION[field])}" for field, keys in given.items() if not keys]
    faults += [
        f"its {keys[0]} is null" for field, keys in given.items() if keys and field != "value" and spec[keys[0]] is None
    ]
    if faults:
        return None, faults
    column, operator, value = (spec[keys[0]] for keys in given.values())
    try:
        return RowFilter(str(column), str(operator), value), []
    except ValueError as error:
        return None, [str(error)]


def read_specifications(specs: Iterable[Any]) -> list[RowFilter]:
    """All filters of a list; the faults of all its entries are reported at once."""
    read = [read_specification(spec) for spec in specs]
    faults = [f"Filter {n}: {'; '.join(found)}." for n, (_, found) in enumerate(read, 1) if found]
    if faults:
        raise ValueError(" ".join(faults))
    return [made for made, _ in read if made is not None]


def parse_filters(text: str | None) -> list[RowFilter]:
    """Filters from a JSON list; no text, no filters."""
    specs = json.loads(text) if text else []
    if isinstance(specs, list):
        return read_specifications(specs)
    raise ValueError("Filters are a JSON list of objects.")


def as_filter(spec: RowFilter | Mapping[str, Any]) -> RowFilter:
    return read_specifications([spec])[0]


def apply_filters(df: DataFrame, filters: Iterable[RowFilter | dict[str, Any]] = ()) -> DataFrame:
    """Rows that meet every filter.

    The compared column is never cast, so Parquet can skip row groups.
    """
    chosen = read_specifications(filters)
    for item in chosen:
        if item.column not in df.columns:
            raise KeyError(f"Column `{item.column}` is not in the table.")
    if not chosen:
        return df
    return df.where(reduce(and_, (f.condition(data_type(df, f.column)) for f in chosen)))
