"""Confidence intervals of claim rates and A/E ratios.

The interval of a claim rate is the Jeffreys interval: quantiles of
Beta(claims + 1/2, exposure - claims + 1/2). Spark has no such quantile, so an Arrow UDF
computes it, on aggregated cohorts only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions import beta
from cohortwise.functions.ratios import only_finite
from cohortwise.functions.values import finite

# The quantile helper travels inside the UDF, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(beta)


def _rate_bounds(level: float):
    beta_quantile = beta.beta_quantile

    @F.pandas_udf("lower double, upper double")
    def bounds(claims: pd.Series, exposure: pd.Series) -> pd.DataFrame:
        mac = claims.to_numpy(dtype="float64", na_value=np.nan)
        moc = exposure.to_numpy(dtype="float64", na_value=np.nan)
        with np.errstate(invalid="ignore"):
            usable = np.isfinite(moc) & (moc > 0) & (mac >= 0) & (mac <= moc)
        result = np.full((len(mac), 2), np.nan)
        tail = (1.0 - level) / 2.0
        a, b = mac[usable] + 0.5, (moc - mac)[usable] + 0.5
        result[usable, 0] = beta_quantile(tail, a, b)
        result[usable, 1] = beta_quantile(1.0 - tail, a, b)
        return pd.DataFrame(result, columns=["lower", "upper"])

    return bounds


def rate_ci(claims: Column, exposure: Column, level: float = 0.95) -> Column:
    """Struct of lower and upper bound; null bounds when the counts make no rate."""
    if not 0.0 < level < 1.0:
        raise ValueError("The confidence level lies between 0 and 1.")
    return _rate_bounds(level)(claims.cast("double"), exposure.cast("double"))


def with_rate_ci(totals: DataFrame, level: float = 0.95) -> DataFrame:
    """Add Rate_CI_Lower and Rate_CI_Upper."""
    bounds = totals.withColumn("_rate", rate_ci(F.col("Sum_MAC"), F.col("Sum_MOC"), level))
    return bounds.withColumns(
        {
            "Rate_CI_Lower": only_finite(F.col("_rate.lower")),
            "Rate_CI_Upper": only_finite(F.col("_rate.upper")),
        }
    ).drop("_rate")


def count_ci(rate: Column) -> Column:
    """A rate bound as a bound of the count A/E ratio."""
    expected = F.col("Sum_MEC")
    usable = finite(expected) & (expected > 0)
    return only_finite(F.when(usable, rate * F.col("Sum_MOC") / expected))


def amount_ci(rate: Column) -> Column:
    """A rate bound as a bound of the amount A/E ratio, through the average claim.

    A cohort without claims borrows its expected average claim.
    """
    expected, expected_amount = F.col("Sum_MEC"), F.col("Sum_MEF")
    usable = (
        finite(expected_amount)
        & (expected_amount > 0)
        & (expected > 0)
        & F.col("Sum_MAF").isNotNull()
    )
    average = F.when(F.col("Sum_MAC") > 0, F.col("Sum_MAF") / F.col("Sum_MAC")).otherwise(
        F.when(expected > 0, expected_amount / expected)
    )
    return only_finite(F.when(usable, rate * F.col("Sum_MOC") * average / expected_amount))


def with_intervals(totals: DataFrame, level: float = 0.95) -> DataFrame:
    """Add the four interval columns; each cohort goes through the UDF once."""
    bounded = with_rate_ci(totals, level)
    return bounded.withColumns(
        {
            "AE_Count_CI_Lower": count_ci(F.col("Rate_CI_Lower")),
            "AE_Count_CI_Upper": count_ci(F.col("Rate_CI_Upper")),
            "AE_Amount_CI_Lower": amount_ci(F.col("Rate_CI_Lower")),
            "AE_Amount_CI_Upper": amount_ci(F.col("Rate_CI_Upper")),
        }
    ).drop("Rate_CI_Lower", "Rate_CI_Upper")
