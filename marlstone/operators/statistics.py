"""Statistics of price assessments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.numbers import rounded

ROUTE = ("product", "location", "incoterm")


def month(date="date"):
    return F.date_format(date, "yyyy-MM")


def monthly_statistics(prices: DataFrame) -> DataFrame:
    """n, average mid, lowest low and highest high of each route and month."""
    return prices.groupBy(*ROUTE, month().alias("month")).agg(
        F.count("*").alias("n"), rounded(F.avg("mid"), 1).alias("avg_mid"),
        rounded(F.min("low"), 2).alias("min_low"), rounded(F.max("high"), 2).alias("max_high"))
