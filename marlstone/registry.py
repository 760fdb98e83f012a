"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.jobs import budgets, diagnoses, extractions, grids, knowledge, prices, reviews, stories, workbooks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (prices, stories, extractions, knowledge, diagnoses, grids, reviews, budgets, workbooks):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
