"""Queries on articles, events and stored facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import news
from marlstone.sources.tables import table

#: Demonstration vocabulary: term, concept.
TERMS = [("the", "grammar"), ("that", "grammar"), ("und", "german"), ("der", "german"), ("les", "french"), ("que", "latin"), ("con", "latin"), ("for", "english"), ("with", "english")]
_TERMS_SQL = ", ".join(f"('{t}', '{c}')" for t, c in TERMS)


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")
    return news.mentions(articles, spark.createDataFrame(TERMS, "term string, concept_id string"), [t for t, _ in TERMS])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 3).cast("bigint").alias("event_key"), F.col("event_type").alias("type"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat(F.lit("c"), F.col("user_id") % 5).alias("concept"),
        F.when(F.col("value") > 10, "up").otherwise("down").alias("direction"))


_EVENTS_SQL = """SELECT event_id // 3 AS event_key, event_type AS type, strftime(ts, '%Y-%m-%d') AS date,
  'c' || (user_id % 5) AS concept, CASE WHEN value > 10 THEN 'up' ELSE 'down' END AS direction FROM events"""


def n1_term_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir)


def n1_indexed_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mentions by the index that large vocabularies need."""
    articles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")
    return news.indexed_mentions(articles, spark.createDataFrame(TERMS, "term string, concept_id string"))


def n10_articles_mentioning_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.mentioning_all(_mentions(spark, sf_dir), ["english", "grammar"])


def n10_newest_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are published on 365 days; those of the second quarter."""
    articles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.date_add(F.make_date(F.lit(2024), F.lit(1), F.lit(1)), (F.col("doc_id") % 365).cast("int")).alias("date"))
    return news.newest_mentioning(_mentions(spark, sf_dir), articles, ["english", "grammar"], "2024-04-01", "2024-06-30").withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def n8_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.incidents(_events(spark, sf_dir))


def e1_dominant_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.dominant(_events(spark, sf_dir))


def s3_new_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have no shipped line yet."""
    done = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(done, "o_orderkey", "left_anti")


def x22_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sheet"), F.col("l_extendedprice").alias("value"), "l_orderkey")
    stored = facts.withColumn("value", F.when(F.col("l_orderkey") % 17 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return news.multiset_diff(facts, stored)


def x22_compared_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored texts: some prices moved, some no numbers, some nan; nothing is stored for a sheet."""
    k = F.col("l_orderkey")
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("sheet"), F.col("l_extendedprice").cast("double").alias("value"), k)
    text = F.when(k % 19 == 0, "n.a.").when(k % 23 == 0, "nan").when((k % 17 == 0) | ((F.col("sheet") == 1) & (k % 2 == 0)), (F.col("value") + 1).cast("string")).otherwise(F.col("value").cast("string"))
    return news.compared(facts, facts.filter("sheet <> 5").select("sheet", text.alias("value")))


def v13_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts lead to the parts of their half and third number."""
    part = table(spark, sf_dir, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("src"))
    dst = F.explode(F.array(*[F.floor(F.col("src") / k).cast("bigint") for k in (2, 3)]))
    return news.reachable(part.select("src", dst.alias("dst")).filter("src % 5 > 0"))


def v13_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways from large parts to the parts of a tenth and of a fortieth of their number."""
    part = table(spark, sf_dir, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("src"), "p_size")
    edges = part.select("src", F.explode(F.array(*[F.floor(F.col("src") / k).cast("bigint") for k in (2, 3)])).alias("dst")).filter("src % 5 > 0")
    seeds = part.filter("p_size > 40").select(F.col("src").alias("seed"))
    ends = seeds.select("seed", F.explode(F.array(*[F.floor(F.col("seed") / k).cast("bigint") for k in (9, 36)])).alias("node"))
    found = news.walked(news.searched(edges, seeds, ends), ends)
    return found.select("seed", "node", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


QUERIES = {
    f.__name__: f
    for f in (n1_term_mentions, n1_indexed_mentions, n8_incidents, n10_articles_mentioning_all, n10_newest_articles, e1_dominant_direction, s3_new_records, x22_multiset_diff, x22_compared_values, v13_reachability,
              v13_shortest_paths)
}

_MENTIONS_SQL = f"""
SELECT article_id, concept_id, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT article_id, term, count(*) AS n FROM (
    SELECT doc_id AS article_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]')) AS term FROM documents)
  GROUP BY ALL) JOIN (VALUES {_TERMS_SQL}) t(term, concept_id) USING (term) GROUP BY ALL"""

ORACLE_SQL = {
    "n1_term_mentions": _MENTIONS_SQL,
    "n1_indexed_mentions": _MENTIONS_SQL,
    "n10_articles_mentioning_all": f"""
SELECT article_id, CAST(sum(n) AS BIGINT) AS n FROM ({_MENTIONS_SQL}) WHERE concept_id IN ('english', 'grammar')
GROUP BY article_id HAVING count(DISTINCT concept_id) = 2
""",
    "n10_newest_articles": f"""
WITH m AS (SELECT article_id FROM ({_MENTIONS_SQL}) WHERE concept_id IN ('english', 'grammar') GROUP BY 1 HAVING count(DISTINCT concept_id) = 2),
d AS (SELECT article_id, strftime(DATE '2024-01-01' + CAST(article_id % 365 AS INT), '%Y-%m-%d') AS date FROM m)
SELECT *, row_number() OVER (ORDER BY date DESC, article_id) AS place FROM d WHERE date BETWEEN '2024-04-01' AND '2024-06-30' QUALIFY place <= 50
""",
    "n8_incidents": f"""
SELECT type, date, concepts, count(*) AS reports, min(event_key) AS first_event FROM (
  SELECT event_key, type, date, string_agg(DISTINCT concept, ',' ORDER BY concept) AS concepts FROM ({_EVENTS_SQL}) GROUP BY ALL)
GROUP BY ALL
""",
    "e1_dominant_direction": f"""
SELECT type, concept, direction, n FROM (
  SELECT type, concept, direction, count(*) AS n, min(event_key) AS seen FROM ({_EVENTS_SQL}) GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY type, concept ORDER BY n DESC, seen) = 1
""",
    "s3_new_records": """
SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (
  SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')
""",
    "x22_multiset_diff": """
WITH f AS (SELECT l_returnflag AS sheet, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS a,
  CAST(floor((CASE WHEN l_orderkey % 17 = 0 THEN l_extendedprice + 1 ELSE l_extendedprice END) * 100 + 0.5) AS BIGINT) AS b FROM lineitem),
x AS (SELECT sheet, a AS v, count(*) AS a FROM f WHERE a <> 0 GROUP BY 1, 2),
y AS (SELECT sheet, b AS v, count(*) AS b FROM f WHERE b <> 0 GROUP BY 1, 2)
SELECT sheet, CAST(sum(coalesce(a, 0)) AS BIGINT) AS n_ours, CAST(sum(coalesce(b, 0)) AS BIGINT) AS n_stored,
  CAST(sum(least(coalesce(a, 0), coalesce(b, 0))) AS BIGINT) AS n_common,
  sum(least(coalesce(a, 0), coalesce(b, 0))) >= 0.9 * least(sum(coalesce(a, 0)), sum(coalesce(b, 0))) AS agree
FROM x FULL JOIN y USING (sheet, v) GROUP BY sheet
""",
    "x22_compared_values": """
WITH f AS (SELECT l_linenumber AS sheet, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS a, l_orderkey % 19 = 0 AS odd, l_orderkey % 23 = 0 AS n,
  CAST(floor((CASE WHEN l_orderkey % 17 = 0 OR (l_linenumber = 1 AND l_orderkey % 2 = 0) THEN l_extendedprice + 1 ELSE l_extendedprice END) * 100 + 0.5) AS BIGINT) AS b FROM lineitem),
x AS (SELECT sheet, a AS v, count(*) AS a FROM f WHERE a <> 0 GROUP BY 1, 2),
y AS (SELECT sheet, CASE WHEN NOT n THEN b END AS v, count(*) AS b FROM f WHERE NOT odd AND sheet <> 5 AND (n OR b <> 0) GROUP BY 1, 2),
t AS (SELECT sheet, CAST(sum(coalesce(a, 0)) AS BIGINT) AS n_ours, CAST(sum(coalesce(b, 0)) AS BIGINT) AS n_stored,
  CAST(sum(least(coalesce(a, 0), coalesce(b, 0))) AS BIGINT) AS n_common FROM x FULL JOIN y USING (sheet, v) GROUP BY sheet),
u AS (SELECT sheet, count(*) FILTER (odd AND sheet <> 5) AS unparseable FROM f GROUP BY 1)
SELECT sheet, n_ours, n_stored, n_common, unparseable, round(100.0 * n_common / n_ours, 1) AS ours_pct, CASE WHEN n_stored > 0 THEN round(100.0 * n_common / n_stored, 1) END AS stored_pct,
  CASE WHEN n_stored = 0 THEN 'nothing stored' WHEN n_common >= 0.9 * least(n_ours, n_stored) THEN 'agree' ELSE 'inspect' END AS verdict FROM t JOIN u USING (sheet)
""",
    "v13_reachability": """
WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, p_partkey // k AS dst FROM part, (VALUES (2), (3)) t(k) WHERE p_partkey > 0 AND p_partkey % 5 > 0),
r AS (SELECT src, dst, 1 AS steps FROM e UNION SELECT r.src, e.dst, r.steps + 1 FROM r JOIN e ON r.dst = e.src)
SELECT src, dst, CAST(min(steps) AS INT) AS steps FROM r GROUP BY ALL
""",
    "v13_shortest_paths": """
WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, p_partkey // k AS dst FROM part, (VALUES (2), (3)) t(k) WHERE p_partkey > 0 AND p_partkey % 5 > 0),
sd AS (SELECT p_partkey AS seed FROM part WHERE p_partkey > 0 AND p_size > 40),
r AS (SELECT seed, seed AS node, 0 AS steps FROM sd UNION SELECT r.seed, e.dst, r.steps + 1 FROM r JOIN e ON r.node = e.src WHERE r.steps < 40),
d AS (SELECT seed, node, min(steps) AS steps FROM r GROUP BY ALL),
b AS (SELECT d.seed, d.node, min(p.node) AS before FROM d JOIN e ON e.dst = d.node JOIN d p ON p.seed = d.seed AND p.node = e.src AND p.steps = d.steps - 1 GROUP BY ALL),
w AS (SELECT DISTINCT seed, seed // k AS node, seed // k AS cur, CAST(seed // k AS VARCHAR) AS path FROM sd, (VALUES (9), (36)) t(k) WHERE (seed, seed // k) IN (SELECT (seed, node) FROM d)
  UNION ALL SELECT w.seed, w.node, b.before, CAST(b.before AS VARCHAR) || '>' || w.path FROM w JOIN b ON b.seed = w.seed AND b.node = w.cur WHERE w.cur <> w.seed)
SELECT seed, node, path FROM w WHERE cur = seed
""",
}
