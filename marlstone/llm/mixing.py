"""Mixing sources to target weights, by distributed prefix sums over hash-random keys.

Each document gets a random key (the start of a SHA-256 of seed and doc_id). The key's leading digits are
its range within its source, so one source's documents are dealt over many tasks; token sums of the
ranges give each range's offset, a running sum inside a range gives each document's, and the source is
cut exactly at its budget. A budget above the source's size repeats whole epochs first.

Defined cases: null text has size 0; null source is a source of its own, last in order; a source of
size 0 gets target 0; an empty table gives no rows; rows that repeat a doc_id are mixed one by one, in
order of size and text digest; other columns are ignored. The same input and seed give the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import common

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hex digits of the key that name a range: 16 ** 3 ranges a source.
RANGE_DIGITS = 3


def random_key(seed: str = SEED) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 16)


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> with target: the share of all sizes by weight, at most so many epochs.

    Sharing the excess again and again ends where each target is min(cap, weight * level); the level is
    found by going through the sources in order of cap / weight. Windows here hold one row a source.
    """
    cap = F.col("source_size") * most
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("nth", F.row_number().over(by_name)).withColumn(
        "w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    by_ratio = Window.orderBy(cap.cast("double") / F.col("w"), "nth")
    everything = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - before).cast("double") / rest
    levels = ranked.withColumns({"level": level, "at": F.row_number().over(by_ratio)})
    fits = F.col("w") * F.col("level") <= cap
    final = F.min(F.when(fits, F.struct("at", "level"))).over(everything)["level"]
    return levels.withColumn("final", final).select(
        "source", "source_size", F.least(cap.cast("double"), F.col("w") * F.col("final")).alias("target"))


@common.tidy("mixture")
def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words taken, repeats counted) of each row."""
    sized = docs.select(
        F.col("doc_id"), F.col("source"), F.size(common.words(F.col("text"))).cast("bigint").alias("size"),
        random_key(seed).alias("key"), F.xxhash64("text").alias("tie"))
    sized = sized.withColumns({"range": F.substring("key", 1, RANGE_DIGITS), "source_key": F.struct(F.col("source").alias("s"))})
    sized = common.written(sized, "sized")
    cells = sized.groupBy("source_key", "range").agg(F.sum("size").alias("cell_size"))
    cells = common.written(cells, "cells")  # 16 ** RANGE_DIGITS rows a source at most
    totals = cells.groupBy("source_key").agg(F.sum("cell_size").alias("source_size"))
    targets = source_targets(totals.withColumn("source", F.col("source_key.s")), weights, most)
    targets = targets.select(F.struct(F.col("source").alias("s")).alias("source_key"), "source_size", "target")
    in_source = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before_cell", F.coalesce(F.sum("cell_size").over(in_source), F.lit(0))).drop("cell_size")
    cells = cells.join(targets, "source_key")
    in_cell = (Window.partitionBy("source_key", "range").orderBy("key", "doc_id", "size", "tie")
               .rowsBetween(Window.unboundedPreceding, -1))
    placed = sized.join(cells, ["source_key", "range"]).withColumn(
        "before", F.col("before_cell") + F.coalesce(F.sum("size").over(in_cell), F.lit(0)))
    budget = F.round("target").cast("bigint")
    has = F.col("source_size") > 0
    epochs = F.when(has, F.expr("cast(round(target) as bigint) div nullif(source_size, 0)")).otherwise(0)
    rest = F.when(has, budget - epochs * F.col("source_size")).otherwise(0)
    taken = epochs * F.col("size") + F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"), "key", "tie")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs that the mix takes, whole, as often as it takes from them; rows of no words go. Columns may have any names."""
    key, tie, nth, times, copy = common.free_names(docs, "mix_key", "mix_tie", "mix_nth", "mix_times", "mix_copy")
    taken = mix(docs, **settings).filter("taken > 0").select(
        F.struct("doc_id", "source").alias(key), F.col("tie").alias(tie), F.ceil(F.col("taken") / F.col("size")).cast("int").alias(times))
    # repeated rows share an id, a text and a source: their takes are added up and one row stands for all
    taken = taken.groupBy(key, tie).agg(F.sum(times).cast("int").alias(times))
    named = docs.withColumns({key: F.struct("doc_id", "source"), tie: F.xxhash64("text")})
    one = named.join(taken, [key, tie]).withColumn(nth, F.row_number().over(Window.partitionBy(key, tie).orderBy(tie))).filter(F.col(nth) == 1)
    return one.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
