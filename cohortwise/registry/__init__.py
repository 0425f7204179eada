"""Runnable queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortwise.registry import audits, bands, checks, cohorts, exhibits, masks, tables

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (tables, bands, checks, cohorts, masks, exhibits, audits)


def all_queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
