"""Size, gaps and column kinds of an in-force table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.contracts import ALWAYS_NUMERICAL, CATEGORICAL_LIMIT
from cohortwise.functions.values import data_type, is_numeric, named, nan_to_null


def profile_summary(df: DataFrame, *, approximate: bool = False) -> DataFrame:
    """Rows and distinct policies (0 without a policy column)."""
    if "Policy_Number" not in df.columns:
        policies = F.lit(0).cast("bigint")
    elif approximate:
        policies = F.approx_count_distinct("Policy_Number")
    else:
        policies = F.count_distinct("Policy_Number")
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), policies.alias("unique_policy_count")
    )


def _value(df: DataFrame, column: str) -> Column:
    floating = isinstance(data_type(df, column), (T.FloatType, T.DoubleType))
    return nan_to_null(named(column)) if floating else named(column)


def _as_rows(one_row: DataFrame, values: dict[str, Column], name: str) -> DataFrame:
    """One row per column out of a single row of results."""
    entries = [
        F.struct(F.lit(column).alias("column_name"), value.alias(name))
        for column, value in values.items()
    ]
    return one_row.select(F.inline(F.array(*entries)))


def profile_nulls(df: DataFrame) -> DataFrame:
    """Missing values per column, counted in one pass."""
    counts = [
        F.count_if(_value(df, c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)
    ]
    places = {c: F.col(f"c{i}") for i, c in enumerate(df.columns)}
    return _as_rows(df.agg(*counts), places, "null_count")


def profile_feature_types(df: DataFrame) -> DataFrame:
    """``numerical`` or ``categorical`` per column.

    A numeric column outside the known roles is numerical above 20 distinct values. A sketch
    settles most columns: for up to 20 values its linear count cannot pass 21, so a larger
    estimate proves the point. Exact counting is left to the columns with few values, where
    map-side aggregation keeps the shuffle tiny.
    """
    measured = [
        c for c in df.columns if c not in ALWAYS_NUMERICAL and is_numeric(data_type(df, c))
    ]
    estimates = [F.approx_count_distinct(_value(df, c)) for c in measured]
    sketch = df.agg(*estimates).first() if measured else ()
    few = [c for c, n in zip(measured, sketch) if n <= CATEGORICAL_LIMIT + 1]
    exact = [F.count_distinct(_value(df, c)).alias(f"c{i}") for i, c in enumerate(few)]
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *exact)

    def kind(column: str) -> Column:
        if column in few:
            many = F.col(f"c{few.index(column)}") > CATEGORICAL_LIMIT
            return F.when(many, "numerical").otherwise("categorical")
        always = column in ALWAYS_NUMERICAL or column in measured
        return F.lit("numerical" if always else "categorical")

    return _as_rows(counted, {c: kind(c) for c in df.columns}, "feature_type")


def schema_columns(df: DataFrame) -> DataFrame:
    """Ordered columns with their Spark types."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, data_type string"
    )
