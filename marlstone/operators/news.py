"""News: mentions of terms, relational division, incidents, number grounding."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.lineage import bucketed, cut
from marlstone.operators.terms import longest_first

#: Edges of a bucket of reachable().
EDGES = 100_000


def mentions(articles: DataFrame, terms: DataFrame, term_list: list[str], chars: int | None = None) -> DataFrame:
    """article_id, concept_id and n: whole terms, longest first, any case, found in whole texts or their first chars."""
    ordered = sorted({t.lower() for t in term_list if len(t) >= 3}, key=lambda t: (-len(t), t))
    pattern = rf"(?iu)(?<![A-Za-z0-9])({'|'.join(map(re.escape, ordered))})(?![A-Za-z0-9])"
    text = F.substring("text", 1, chars) if chars else F.col("text")
    found = articles.select("article_id", F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("term"))
    counted = found.groupBy("article_id", F.lower("term").alias("term")).count()
    return counted.join(terms, "term").groupBy("article_id", "concept_id").agg(F.sum("count").alias("n"))


def indexed_mentions(articles: DataFrame, terms: DataFrame, chars: int | None = None) -> DataFrame:
    """mentions() for a vocabulary of any size: article_id, concept_id and n; a term may name several concepts."""
    text = F.substring("text", 1, chars) if chars else F.col("text")
    counted = longest_first(articles.select("article_id", text.alias("text")), ["article_id"], terms)
    named = terms.select(F.lower("term").alias("term"), "concept_id").distinct()
    return counted.join(named, "term").groupBy("article_id", "concept_id").agg(F.sum("n").alias("n"))


def mentioning_all(found: DataFrame, concepts: list[str]) -> DataFrame:
    """Articles that mention every one of some concepts, with all their mentions."""
    return found.filter(F.col("concept_id").isin(concepts)).groupBy("article_id").agg(
        F.countDistinct("concept_id").alias("k"), F.sum("n").alias("n")).filter(F.col("k") == len(set(concepts))).drop("k")


def newest_mentioning(found: DataFrame, articles: DataFrame, concepts: list[str], first: str, last: str, most: int = 50) -> DataFrame:
    """article_id, date, place: the newest of articles (article_id, date) from first to last that mention every one of some concepts."""
    inside = articles.filter(F.col("date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).select("article_id", "date")
    order = [F.col("date").desc(), "article_id"]
    hits = inside.join(mentioning_all(found, concepts), "article_id", "left_semi").orderBy(*order).limit(most)
    return hits.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))  # most rows


def incidents(events: DataFrame) -> DataFrame:
    """Events of one type, day and set of concepts are one incident; its reports and first event."""
    sets = events.groupBy("event_key", "type", "date").agg(F.array_join(F.array_sort(F.collect_set("concept")), ",").alias("concepts"))
    return sets.groupBy("type", "date", "concepts").agg(F.count("*").alias("reports"), F.min("event_key").alias("first_event"))


def dominant(events: DataFrame) -> DataFrame:
    """The most frequent direction of each type and concept; ties go to the one seen first."""
    counts = events.groupBy("type", "concept", "direction").agg(F.count("*").alias("n"), F.min("event_key").alias("seen"))
    return counts.groupBy("type", "concept").agg(
        F.max_by("direction", F.struct("n", -F.col("seen"))).alias("direction"), F.max("n").alias("n"))


def multiset_diff(ours: DataFrame, stored: DataFrame) -> DataFrame:
    """n_ours, n_stored and n_common of each sheet's values: rounded to cents, zeros left out."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        v = F.floor(F.col("value") * 100 + 0.5).cast("bigint")
        return df.select("sheet", v.alias("v")).filter("v <> 0").groupBy("sheet", "v").agg(F.count("*").alias(name))

    both = counted(ours, "a").join(counted(stored, "b"), ["sheet", "v"], "full").na.fill(0, ["a", "b"])
    return both.groupBy("sheet").agg(
        F.sum("a").alias("n_ours"), F.sum("b").alias("n_stored"), F.sum(F.least("a", "b")).alias("n_common")).withColumn(
        "agree", F.col("n_common") >= 0.9 * F.least("n_ours", "n_stored"))


def compared(ours: DataFrame, stored: DataFrame) -> DataFrame:
    """Each sheet's values against stored texts: n_ours, n_stored, n_common, unparseable, the shares found both ways and a verdict.

    Values are rounded to cents, zeros left out; of the stored texts "nan" is a value that matches none, other texts that are no numbers
    are unparseable.
    """
    parsed = stored.select("sheet", "value", F.col("value").try_cast("double").alias("v"))
    number = F.when(~F.isnan("v"), F.floor(F.col("v") * 100 + 0.5).cast("bigint"))
    b = parsed.filter("isnan(v) or v is not null").select("sheet", number.alias("v")).filter("v is null or v <> 0").groupBy("sheet", "v").agg(F.count("*").alias("b"))
    a = ours.select("sheet", F.floor(F.col("value") * 100 + 0.5).cast("bigint").alias("v")).filter("v <> 0").groupBy("sheet", "v").agg(F.count("*").alias("a"))
    both = a.join(b, ["sheet", "v"], "full").na.fill(0, ["a", "b"]).groupBy("sheet").agg(
        F.sum("a").alias("n_ours"), F.sum("b").alias("n_stored"), F.sum(F.least("a", "b")).alias("n_common"))
    odd = parsed.filter("value is not null").groupBy("sheet").agg(F.count_if(F.col("v").isNull()).alias("unparseable"))
    share = lambda n: F.round(F.when(F.col(n) > 0, 100 * F.col("n_common") / F.col(n)), 1)
    verdict = F.when(F.col("n_stored") == 0, "nothing stored").when(F.col("n_common") >= 0.9 * F.least("n_ours", "n_stored"), "agree").otherwise("inspect")
    return both.join(odd, "sheet", "left").na.fill(0, ["unparseable"]).select(
        "sheet", "n_ours", "n_stored", "n_common", "unparseable", share("n_ours").alias("ours_pct"), share("n_stored").alias("stored_pct"), verdict.alias("verdict"))


def reachable(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """src, dst and the fewest steps between them, up to a depth if one is given: each round puts an edge before the newly found pairs.

    Pairs are in buckets by src and edges by dst, so the pairs of a round are shuffled once, and those found before not at all.
    """
    steps = cut(edges.select("src", "dst").distinct())
    many = steps.count()
    # one bucket would count as dealt by no key
    n = max(2, -(-many // EDGES), min(steps.sparkSession.sparkContext.defaultParallelism, many // 1000))
    before, _ = bucketed(steps, n, "dst")
    new, plain = bucketed(steps.withColumn("steps", F.lit(1)), n, "src")
    found, result, k = new, plain, 1
    while (depth is None or k < depth) and not plain.isEmpty():
        k += 1
        grown = before.alias("e").join(new.hint("merge").alias("n"), F.col("e.dst") == F.col("n.src")).select(F.col("e.src"), F.col("n.dst"))
        # all parts of this union are dealt by src alike, so only grown is shuffled
        both = found.unionByName(grown.repartition(n, "src").withColumn("steps", F.lit(k)))
        fewest = both.groupBy("src", "dst").agg(F.min("steps").alias("steps"))
        new, plain = bucketed(fewest.filter(F.col("steps") == k), n, "src")
        found, result = found.unionByName(new), result.unionByName(plain)  # a scan a round: plans grow by one line, not by a copy
    return result


def searched(edges: DataFrame, seeds: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """seed, node, steps, before: what each seed reaches over edges (src, dst), the fewest steps to it, and the least node one step before it (null for the seed itself).

    Only what the last round found is joined with the edges, so work grows with what the seeds reach. With targets (seed, node) a seed is
    searched until all its targets are found, or nothing new is; a seed without targets is not searched.
    """
    steps = cut(edges.select("src", "dst").distinct())
    first = seeds.select("seed").distinct()
    new = cut(first.select("seed", F.col("seed").alias("node"), F.lit(0).alias("steps"), F.col("seed").alias("before")).withColumn("before", F.when(F.col("steps") > 0, F.col("before"))))
    found, k = new, 0
    wanted = None if targets is None else cut(targets.select("seed", "node").distinct().join(first, "seed", "left_semi"))
    while not new.isEmpty():
        k += 1
        if wanted is not None:
            wanted = cut(wanted.join(new.select("seed", "node"), ["seed", "node"], "left_anti"))
            new = new.join(wanted.select("seed").distinct(), "seed", "left_semi")
        grown = new.select("seed", F.col("node").alias("src")).join(steps, "src").groupBy("seed", F.col("dst").alias("node")).agg(F.min("src").alias("before"))
        new = cut(grown.join(found.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(k).alias("steps"), "before"))
        found = found.unionByName(new)  # a scan a round
    return found


def walked(found: DataFrame, ends: DataFrame) -> DataFrame:
    """seed, node, path of those ends (seed, node) that a search found: the nodes from the seed on, by their nodes before."""
    now = cut(found.join(ends.select("seed", "node").distinct(), ["seed", "node"], "left_semi").select("seed", "node", F.array("node").alias("path"), F.col("before").alias("at")))
    back = found.select("seed", F.col("node").alias("at"), F.col("before").alias("next_"))
    while not now.filter("at is not null").isEmpty():
        now = cut(now.join(back, ["seed", "at"], "left").select(
            "seed", "node", F.when(F.col("at").isNull(), F.col("path")).otherwise(F.concat(F.array("at"), "path")).alias("path"), F.col("next_").alias("at")))
    return now.select("seed", "node", "path")
