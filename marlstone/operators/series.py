"""Series of drivers: daily and monthly means, changes, rankings and price moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.numbers import rounded
from marlstone.operators.statistics import ROUTE, month


def daily_series(prices: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Mean of a day for each driver, over its configured route (concept, product, location, incoterm) or, without any, all of a product's routes."""
    if routes is not None:
        return prices.join(routes, list(ROUTE)).groupBy("concept", "date").agg(rounded(F.avg("mid"), 1).alias("value"))
    return prices.groupBy(F.col("product").alias("concept"), "date").agg(rounded(F.avg("mid"), 1).alias("value"))


def monthly_means(prices: DataFrame) -> DataFrame:
    return prices.groupBy(F.col("product").alias("concept"), month().alias("month")).agg(F.avg("mid").alias("mean"))


def next_changes(means: DataFrame) -> DataFrame:
    """Change to the next month that has data; the last month has none."""
    later = F.lead("mean").over(Window.partitionBy("concept").orderBy("month"))
    return means.withColumn("next_change", rounded(later - F.col("mean"), 2)).filter("next_change is not null").select(
        "concept", "month", "next_change")


def proxy_margin(means: DataFrame, ratios: DataFrame) -> DataFrame:
    """Sum of ratio x mean in the months where every concept of ratios (concept, ratio) has data."""
    terms = means.join(ratios, "concept").groupBy("month").agg(
        F.sum(F.col("ratio") * F.col("mean")).alias("margin"), F.countDistinct("concept").alias("k"))
    every = ratios.agg(F.countDistinct("concept").alias("every"))
    return terms.join(F.broadcast(every), F.col("k") == F.col("every")).select("month", rounded(F.col("margin"), 2).alias("margin"))


def naive_rank(means: DataFrame) -> DataFrame:
    """Drivers of each month by the size of their change to the month before, which must be the calendar's."""
    at = (F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")).alias("mi")
    w = Window.partitionBy("concept").orderBy("mi")
    change = rounded(F.abs(F.col("mean") / F.lag("mean").over(w) - 1) * 100, 4)
    moved = means.select("concept", "month", "mean", at).withColumns({"pct": change, "gap": F.col("mi") - F.lag("mi").over(w)})
    by_move = Window.partitionBy("month").orderBy(F.col("pct").desc(), "concept")
    return moved.filter("gap = 1").withColumn("rank", F.row_number().over(by_move).cast("bigint")).select("month", "concept", "pct", "rank")


def price_move(means: DataFrame) -> DataFrame:
    """First and last month, change and first peak of each driver; two months at least."""
    first, last = F.min_by("mean", "month"), F.max_by("mean", "month")
    peak = F.max(F.struct("mean", F.struct(-(F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int"))).alias("m"), "month"))
    return means.groupBy("concept").agg(
        F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count("*").alias("n_months"),
        F.when(first != 0, rounded((last / first - 1) * 100, 1)).alias("pct"), peak["month"].alias("peak_month")).filter("n_months >= 2")


def route_coverage(prices: DataFrame) -> DataFrame:
    return prices.groupBy(*ROUTE).agg(
        F.count("*").alias("n"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_date"))


def best_routes(prices: DataFrame) -> DataFrame:
    """The best covered route of each product, by months and then by rows; ties by name."""
    found = prices.groupBy(*ROUTE).agg(F.countDistinct(month()).alias("months"), F.count("*").alias("n"))
    order = Window.partitionBy("product").orderBy(F.col("months").desc(), F.col("n").desc(), "location", "incoterm")
    return found.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def _value_range(value):
    """A number of a value's range, 64 to an octave, that never falls as the value grows."""
    size = F.floor(F.log2(F.abs(value)) * 64)
    return F.when(value > 0, size + 100_000).when(value < 0, -100_000 - size).otherwise(0).cast("bigint")


def upper_medians(prices: DataFrame) -> DataFrame:
    """n and median (the upper one) of each route's mid.

    Rows are counted by route and range of values before any shuffle; the range that holds the middle is then looked into. So no
    task sees more than the counts of a route's ranges, or the values of one range.
    """
    ranged = prices.withColumn("range_", _value_range(F.col("mid")))
    counts = ranged.groupBy(*ROUTE, "range_").agg(F.count("*").alias("k"))
    w = Window.partitionBy(*ROUTE)
    before = F.coalesce(F.sum("k").over(w.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumns({"before": before, "n": F.sum("k").over(w)}).withColumn("middle", F.floor(F.col("n") / 2) + 1)
    held = placed.filter((F.col("before") < F.col("middle")) & (F.col("before") + F.col("k") >= F.col("middle"))).select(*ROUTE, "range_", "n", (F.col("middle") - F.col("before")).alias("nth"))
    inside = ranged.join(held, [*ROUTE, "range_"]).groupBy(*ROUTE, "n", "nth", "mid").agg(F.count("*").alias("k"))
    up = F.sum("k").over(w.orderBy("mid").rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("up", up).filter("up >= nth").groupBy(*ROUTE, "n").agg(F.min("mid").alias("median"))


def outliers(prices: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """n, upper median and rows outside [low, high] times it, of each route."""
    out = (F.col("mid") < low * F.col("median")) | (F.col("mid") > high * F.col("median"))
    return prices.join(upper_medians(prices), list(ROUTE)).groupBy(*ROUTE, "n", "median").agg(F.count_if(out).alias("n_outliers")).select(*ROUTE, "n", "median", "n_outliers")


def top_routes(prices: DataFrame, most: int = 5) -> DataFrame:
    """The most quoted routes with their places; ties by name."""
    counted = prices.groupBy(*ROUTE).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), *ROUTE).limit(most)
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), *ROUTE)).cast("bigint"))  # `most` rows


def weak_routes(prices: DataFrame, configured: DataFrame) -> DataFrame:
    """product, months (of the configured route), best_months, weak: whether it covers less than a third of the best route's months."""
    months = prices.groupBy(*ROUTE).agg(F.count_distinct(month()).alias("months"))
    best = months.groupBy("product").agg(F.max("months").alias("best_months"))
    own = configured.select(*ROUTE).join(months, list(ROUTE), "left").select("product", F.coalesce("months", F.lit(0)).alias("months"))
    return own.join(best, "product").withColumn("weak", 3 * F.col("months") < F.col("best_months"))


def route_pivot(prices: DataFrame, locations: list[str]) -> DataFrame:
    """Months by locations: number of assessments."""
    return prices.groupBy(month().alias("month")).pivot("location", locations).agg(F.count(F.lit(1))).na.fill(0, locations)
