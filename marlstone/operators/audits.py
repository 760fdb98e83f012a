"""Audits: numbers of answers that no evidence has, quotes that a text does not hold; differences of snapshots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative distance at which a number still counts as supported.
TOLERANCE = 0.01
_STEP = math.log(1 + 3 * TOLERANCE)


def numbers(text: Column) -> Column:
    """The numbers written in a text; spaces and commas before three digits are separators, other commas decimal."""
    joined = F.regexp_replace(text, r"(?<=[0-9])[   ,](?=[0-9]{3}\b)", "")
    return F.transform(F.regexp_extract_all(joined, F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))


def _bucket(value: Column) -> Column:
    return F.floor(F.log(F.greatest(value, F.lit(1.0))) / _STEP)


def unsupported_numbers(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answer_id, n_checked, n_unsupported of each answer: distinct numbers of 10 or more, years left out.

    Numbers within the tolerance lie in the same or the next bucket of a logarithmic scale, so the search
    is an equality join on answer and bucket; every answer gets a row.
    """
    asked = answers.select("answer_id", F.explode(F.array_distinct(numbers(F.col("text")))).alias("n"))
    asked = asked.filter("n >= 10 and not n between 1990 and 2100").select("answer_id", "n", _bucket(F.col("n")).alias("bucket")).distinct()
    known = evidence.select("answer_id", F.explode(F.array_distinct(numbers(F.col("text")))).alias("k")).distinct()
    known = known.withColumn("bucket", F.explode(F.array(*[_bucket(F.col("k")) + d for d in (-1, 0, 1)])))
    near = F.abs(F.col("a.n") - F.col("e.k")) <= TOLERANCE * F.greatest(F.col("e.k"), F.lit(1.0))
    unknown = asked.alias("a").join(
        known.alias("e"), (F.col("a.answer_id") == F.col("e.answer_id")) & (F.col("a.bucket") == F.col("e.bucket")) & near, "left_anti")
    counted = asked.select("answer_id", F.lit(0).alias("bad")).unionByName(unknown.select("answer_id", F.lit(1).alias("bad")))
    counted = counted.groupBy("answer_id").agg(F.count_if(F.col("bad") == 0).alias("n_checked"), F.count_if(F.col("bad") == 1).alias("n_unsupported"))
    return answers.select("answer_id").distinct().join(counted, "answer_id", "left").na.fill(0, ["n_checked", "n_unsupported"])


def squashed(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0b\x0c\r]+", " ")))


def quotes_found(items: DataFrame, texts: DataFrame) -> DataFrame:
    """article_id, item, found: whether the quote is not empty and stands in the article, white space and case aside."""
    both = items.join(texts.select("article_id", "text"), "article_id", "left")
    quote = squashed(F.col("quote"))
    return both.select("article_id", "item", ((quote != "") & F.contains(squashed(F.col("text")), quote)).alias("found"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change: added, removed or changed rows between two snapshots with the same columns."""
    columns = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*columns).alias("a"))
    b = new.select(key, F.struct(*columns).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).filter("change is not null")


def running_balance(moves: DataFrame, group: str, order: list[str], amount: str) -> DataFrame:
    """moves with what remains after each of a group's moves; loads are positive, discharges negative."""
    from pyspark.sql import Window

    so_far = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return moves.withColumn("remaining", F.sum(amount).over(so_far))
