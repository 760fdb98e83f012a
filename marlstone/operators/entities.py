"""Source records and the assets they are merged into. Assets are (canonical_id, name, kind, site, controlled, members, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def members_of(assets: DataFrame) -> DataFrame:
    return assets.select("canonical_id", F.explode("members").alias("entity_id"))


def completed(records: DataFrame, assets: DataFrame) -> DataFrame:
    """canonical_id, name, kind, confidence, n: assets, and each record (entity_id, name) that none has as one of low confidence."""
    left = records.join(members_of(assets), "entity_id", "left_anti").select(
        F.concat(F.lit("unassigned_"), F.col("entity_id").cast("string")).alias("canonical_id"), "name", F.lit("other").alias("kind"), F.lit("low").alias("confidence"), F.lit(1).alias("n"))
    return assets.select("canonical_id", "name", "kind", "confidence", F.size("members").alias("n")).unionByName(left)


def partition_problems(records: DataFrame, assets: DataFrame) -> DataFrame:
    """entity_id, problem: records in no asset or in several, members that are no record."""
    held = members_of(assets).groupBy("entity_id").agg(F.count("*").alias("held"))
    known = records.groupBy("entity_id").agg(F.count("*").alias("known"))
    problem = F.when(F.col("known").isNull(), "unknown").when(F.col("held").isNull(), "missing").when(F.col("held") > 1, "duplicated")
    return known.join(held, "entity_id", "full").select("entity_id", problem.alias("problem")).filter("problem is not null")


def asset_edges(assets: DataFrame, sites: DataFrame, group: str = "group") -> DataFrame:
    """src, rel, dst, status: SAME_AS of the members (proposed), LOCATED_AT of assets at a known site, PART_OF of controlled ones."""
    asset = F.concat(F.lit("asset_"), F.col("canonical_id").cast("string"))
    none = F.lit(None).cast("string")
    same = members_of(assets).select(F.col("entity_id").cast("string").alias("src"), F.lit("SAME_AS").alias("rel"), asset.alias("dst"), F.lit("proposed").alias("status"))
    at = assets.join(sites.select(F.col("id").alias("site")).distinct(), "site", "left_semi").select(asset.alias("src"), F.lit("LOCATED_AT").alias("rel"), F.col("site").alias("dst"), none.alias("status"))
    part = assets.filter("controlled").select(asset.alias("src"), F.lit("PART_OF").alias("rel"), F.lit(group).alias("dst"), none.alias("status"))
    return same.unionByName(at).unionByName(part)


def found_by_name(records: DataFrame, assets: DataFrame, query: str) -> DataFrame:
    """canonical_id, name, source_names of assets whose name, or a member's snake_case name, holds the query."""
    q, snake = query.lower(), query.strip().replace(" ", "_").lower()
    named = members_of(assets).join(records.select("entity_id", F.col("name").alias("source_name")), "entity_id")
    per = named.groupBy("canonical_id").agg(
        F.array_join(F.array_sort(F.collect_set("source_name")), ", ").alias("source_names"), F.bool_or(F.contains(F.lower("source_name"), F.lit(snake))).alias("hit_"))
    return assets.join(per, "canonical_id").filter(F.col("hit_") | F.contains(F.lower("name"), F.lit(q))).select("canonical_id", "name", "source_names")


def approved(edges: DataFrame, approved_assets: DataFrame) -> DataFrame:
    """edges with the SAME_AS of some assets (asset) approved."""
    hit = approved_assets.select(F.col("asset").alias("dst"), F.lit(True).alias("hit_")).distinct()
    return edges.join(hit, "dst", "left").withColumn("status", F.when((F.col("rel") == "SAME_AS") & F.col("hit_"), "approved").otherwise(F.col("status"))).drop("hit_")


def asset_counts(edges: DataFrame) -> DataFrame:
    """asset, records, status: how many records an asset has, approved if all are."""
    same = edges.filter("rel = 'SAME_AS'").groupBy(F.col("dst").alias("asset")).agg(F.count("*").alias("records"), F.bool_and(F.col("status") == "approved").alias("all_"))
    return same.select("asset", "records", F.when(F.col("all_"), "approved").otherwise("proposed").alias("status"))
