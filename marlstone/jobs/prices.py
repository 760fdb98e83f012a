"""Queries on price assessments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.numbers import rounded
from marlstone.operators import series, statistics
from marlstone.sources.tables import ASSESSMENTS_SQL, assessments, table

LOCATIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def n13_monthly_price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.monthly_statistics(assessments(spark, sf_dir))


def n12_route_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.route_coverage(assessments(spark, sf_dir))


def n15_best_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.best_routes(assessments(spark, sf_dir))


def n16_route_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.route_pivot(assessments(spark, sf_dir), LOCATIONS)


def n5_outlier_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.outliers(assessments(spark, sf_dir))


def n15_weak_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early prices only, so that routes differ in months; one configured route has none."""
    products = table(spark, sf_dir, "part").select(F.col("p_type").alias("product")).distinct()
    configured = products.select("product", F.when(F.col("product") == "PROMO", "MOON").otherwise("ASIA").alias("location"), F.lit("A").alias("incoterm"))
    early = F.when(F.col("location") == "ASIA", F.to_date(F.lit("1995-09-01"))).otherwise(F.to_date(F.lit("1998-01-01")))
    return series.weak_routes(assessments(spark, sf_dir).filter(F.col("date") < early), configured)


def n16_top_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.top_routes(assessments(spark, sf_dir))


def t1_daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.daily_series(assessments(spark, sf_dir))


def t2_monthly_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = series.monthly_means(assessments(spark, sf_dir))
    return means.select("concept", "month", rounded(means["mean"], 2).alias("mean"))


def t4_next_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.next_changes(series.monthly_means(assessments(spark, sf_dir)))


def t21_naive_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.naive_rank(series.monthly_means(assessments(spark, sf_dir)))


def e9_price_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.price_move(series.monthly_means(assessments(spark, sf_dir)))


def t1_route_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's series is that of one route: Asia's, by the flag that its name's length gives."""
    products = table(spark, sf_dir, "part").select("p_type").distinct()
    flag = F.element_at(F.array(*map(F.lit, "ANR")), F.length("p_type") % 3 + 1)
    routes = products.select(F.lower("p_type").alias("concept"), F.col("p_type").alias("product"), F.lit("ASIA").alias("location"), flag.alias("incoterm"))
    return series.daily_series(assessments(spark, sf_dir), routes)


QUERIES = {
    f.__name__: f
    for f in (
        n5_outlier_guard, n12_route_coverage, n13_monthly_price_stats, n15_best_routes, n15_weak_routes, n16_route_pivot, n16_top_routes,
        t1_daily_series, t1_route_series, t2_monthly_means, t4_next_changes, t21_naive_rank, e9_price_move)
}

MEANS_SQL = f"SELECT product AS concept, strftime(date, '%Y-%m') AS month, avg(mid) AS mean FROM ({ASSESSMENTS_SQL}) GROUP BY ALL"
INDEX_SQL = "CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT)"

ORACLE_SQL = {
    "n13_monthly_price_stats": f"""
SELECT product, location, incoterm, strftime(date, '%Y-%m') AS month, count(*) AS n, floor(avg(mid) * 10 + 0.5) / 10 AS avg_mid,
  floor(min(low) * 100 + 0.5) / 100 AS min_low, floor(max(high) * 100 + 0.5) / 100 AS max_high
FROM ({ASSESSMENTS_SQL}) GROUP BY ALL
""",
    "n12_route_coverage": f"""
SELECT product, location, incoterm, count(*) AS n, strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date
FROM ({ASSESSMENTS_SQL}) GROUP BY ALL
""",
    "n15_best_routes": f"""
SELECT product, location, incoterm, months, n FROM (
  SELECT product, location, incoterm, count(DISTINCT strftime(date, '%Y-%m')) AS months, count(*) AS n
  FROM ({ASSESSMENTS_SQL}) GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY product ORDER BY months DESC, n DESC, location, incoterm) = 1
""",
    "n16_route_pivot": "SELECT strftime(date, '%Y-%m') AS month, "
    + ", ".join(f"count(*) FILTER (location = '{x}') AS \"{x}\"" for x in LOCATIONS)
    + f" FROM ({ASSESSMENTS_SQL}) GROUP BY 1",
    "n15_weak_routes": f"""
WITH p AS (SELECT * FROM ({ASSESSMENTS_SQL}) WHERE date < CASE WHEN location = 'ASIA' THEN DATE '1995-09-01' ELSE DATE '1998-01-01' END),
m AS (SELECT product, location, incoterm, count(DISTINCT strftime(date, '%Y-%m')) AS months FROM p GROUP BY ALL)
SELECT b.product, coalesce(o.months, 0) AS months, best_months, 3 * coalesce(o.months, 0) < best_months AS weak FROM (SELECT product, max(months) AS best_months FROM m GROUP BY 1) b
LEFT JOIN (SELECT * FROM m WHERE location = 'ASIA' AND incoterm = 'A' AND product <> 'PROMO') o ON o.product = b.product""",
    "n16_top_routes": f"""
SELECT *, row_number() OVER (ORDER BY n DESC, product, location, incoterm) AS place FROM (SELECT product, location, incoterm, count(*) AS n FROM ({ASSESSMENTS_SQL}) GROUP BY ALL) QUALIFY place <= 5""",
    "n5_outlier_guard": f"""
WITH p AS ({ASSESSMENTS_SQL}),
m AS (SELECT product, location, incoterm, count(*) AS n, list_sort(list(mid))[count(*) // 2 + 1] AS median FROM p GROUP BY ALL)
SELECT product, location, incoterm, n, median,
  CAST(count(*) FILTER (mid < 0.5 * median OR mid > 2.0 * median) AS BIGINT) AS n_outliers
FROM p JOIN m USING (product, location, incoterm) GROUP BY ALL
""",
    "t1_daily_series": f"SELECT product AS concept, date, floor(avg(mid) * 10 + 0.5) / 10 AS value FROM ({ASSESSMENTS_SQL}) GROUP BY ALL",
    "t1_route_series": f"SELECT lower(product) AS concept, date, floor(avg(mid) * 10 + 0.5) / 10 AS value FROM ({ASSESSMENTS_SQL}) WHERE location = 'ASIA' AND incoterm = (['A', 'N', 'R'])[length(product) % 3 + 1] GROUP BY ALL",
    "t2_monthly_means": f"SELECT concept, month, floor(mean * 100 + 0.5) / 100 AS mean FROM ({MEANS_SQL})",
    "t4_next_changes": f"""
SELECT concept, month, next_change FROM (
  SELECT concept, month, floor((lead(mean) OVER (PARTITION BY concept ORDER BY month) - mean) * 100 + 0.5) / 100 AS next_change FROM ({MEANS_SQL}))
WHERE next_change IS NOT NULL
""",
    "t21_naive_rank": f"""
WITH m AS (SELECT *, {INDEX_SQL} AS mi FROM ({MEANS_SQL})),
c AS (SELECT concept, month, mi - lag(mi) OVER w AS gap, floor(abs(mean / lag(mean) OVER w - 1) * 100 * 10000 + 0.5) / 10000 AS pct
  FROM m WINDOW w AS (PARTITION BY concept ORDER BY mi))
SELECT month, concept, pct, row_number() OVER (PARTITION BY month ORDER BY pct DESC, concept) AS rank FROM c WHERE gap = 1
""",
    "e9_price_move": f"""
SELECT concept, min(month) AS first_month, max(month) AS last_month, count(*) AS n_months,
  floor((max_by(mean, month) / min_by(mean, month) - 1) * 100 * 10 + 0.5) / 10 AS pct,
  first(month ORDER BY mean DESC, month) AS peak_month
FROM ({MEANS_SQL}) GROUP BY concept HAVING count(*) >= 2
""",
}
