"""Readers of the library's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.numbers import rounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price assessments (product, location, incoterm, date, low, high, mid) of the shipped lines."""
    line, part, supplier, nation, region = (
        table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation", "region"))
    places = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey).select("s_suppkey", F.col("r_name").alias("location"))
    high = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        line.join(part.select("p_partkey", F.col("p_type").alias("product")), F.col("l_partkey") == F.col("p_partkey"))
        .join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_id"),
            "product", "location", F.col("l_returnflag").alias("incoterm"),
            F.to_date("l_shipdate").alias("date"),
            rounded(high * (1 - F.col("l_discount")), 4).alias("low"), rounded(high, 4).alias("high"))
        .withColumn("mid", rounded((F.col("low") + F.col("high")) / 2, 4)))


_LOW_SQL = "floor(l_extendedprice / l_quantity * (1 - l_discount) * 10000 + 0.5) / 10000"
_HIGH_SQL = "floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000"
#: The same rows in SQL.
ASSESSMENTS_SQL = f"""
SELECT l_orderkey AS order_id, l_linenumber AS line_id, p_type AS product, r_name AS location, l_returnflag AS incoterm,
  CAST(l_shipdate AS DATE) AS date, {_LOW_SQL} AS low, {_HIGH_SQL} AS high,
  floor(({_LOW_SQL} + {_HIGH_SQL}) / 2 * 10000 + 0.5) / 10000 AS mid
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
