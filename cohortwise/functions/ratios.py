"""Ratio arithmetic with missing, zero and infinite inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortwise.functions.values import finite


def only_finite(number: Column) -> Column:
    return F.when(finite(number), number)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, or null unless both are finite and the denominator is positive."""
    ratio = F.try_divide(numerator, denominator)
    usable = (denominator > 0) & finite(denominator) & finite(numerator) & finite(ratio)
    return F.when(usable, ratio)


def clip(number: Column, low: float, high: float) -> Column:
    """Value moved into [low, high]; null stays null."""
    return F.when(number.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), number)))
