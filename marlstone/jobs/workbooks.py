"""Queries on workbooks: the formula sheets' layout, suppliers as a contents sheet, documents as texts of sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.lineage import cut
from marlstone.jobs.budgets import _CELLS_SQL, _cells
from marlstone.jobs.stories import TERMS
from marlstone.operators import workbooks
from marlstone.sources.tables import table

PATTERNS = [("north", "S1", "file_[0-4]"), ("any", "s[2-3]", ""), ("tens", "S.0", "file")]


def w1_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the formula sheets, the first ones moved down by the sheet's number."""
    cells = _cells(spark, sf_dir).withColumn("row", F.col("row") + F.when(F.substring("sheet", 2, 2).cast("int") % 3 == 0, 4).otherwise(0))
    return workbooks.profiles(cells)


def w1_sheet_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formula sheets moved down, with a title and a note above."""
    down = F.when(F.substring("sheet", 2, 2).cast("int") % 3 == 0, 4).otherwise(0)
    moved = cut(_cells(spark, sf_dir).withColumn("row", F.col("row") + down))
    lists = workbooks.sheet_lists(moved, workbooks.profiles(moved))
    return lists.select("sheet", *[F.array_join(c, "|").alias(c) for c in ("preamble", "header_cells", "row_labels")])


def w2_formula_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumn("v_str", F.when((F.col("col") == 0) & (F.col("row") % 5 == 0), F.concat("v_str", F.lit(" Total"))).otherwise(F.col("v_str")))
    return workbooks.formula_counts(cells)


def w3_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    sheets = table(spark, sf_dir, "customer").select(n.alias("id"), F.concat(F.when(n % 9 == 0, "The INDEX ").when(n % 9 == 1, "Chart of ").otherwise(""), "c_name").alias("sheet"),
                                                     F.when(n % 2 == 0, n).alias("header_row"), (n % 3).alias("formulas"))
    return sheets.select("id", workbooks.role(F.col("sheet"), F.col("header_row"), F.col("formulas")).alias("role"))


def w4_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    row = F.floor(F.col("p_partkey") / 3).cast("int").alias("row")
    cells = part.select(row, F.lit(1).alias("col"), F.concat(F.lit(" s"), F.col("p_size")).alias("v_str")).unionByName(part.select(row, F.lit(2).alias("col"), F.col("p_name").alias("v_str"))).unionByName(
        part.select(row, F.lit(3).alias("col"), F.col("p_brand").alias("v_str"))).groupBy("row", "col").agg(F.max("v_str").alias("v_str"))
    sheets = part.filter("p_size % 2 = 0").select(F.concat(F.lit("S"), F.col("p_size")).alias("sheet")).distinct()
    return workbooks.descriptions(cells, sheets)


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sheet"), F.lit("rows").alias("zone"), F.lower("text").alias("text"))
    return workbooks.mentions(texts, spark.createDataFrame(TERMS, "term string, concept_id string"))


def w5_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir)


def w5_large_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different words of the benchmark's texts as terms, in the documents."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sheet"), F.lit("rows").alias("zone"), F.lower("text").alias("text"))
    w = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))
    pairs = table(spark, sf_dir, "benchmark").select(w.alias("w")).filter("size(w) > 1").select(F.explode(F.arrays_zip(
        F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w") - 1).alias("b"))).alias("p")).select("p.a", "p.b").distinct().filter("a <> b")
    terms = pairs.select(F.concat_ws(" ", "a", "b").alias("term"), F.concat(F.lit("c"), F.length("a") * 100 + F.length("b")).alias("concept_id"))
    return workbooks.mentions(texts, terms)


def w6_mentioning_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sheet"), F.when(F.col("doc_id") % 3 == 0, "other").otherwise("data").alias("role"))
    return workbooks.mentioning(cut(_mentions(spark, sf_dir)), sheets, ["english", "grammar"])


def w7_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = table(spark, sf_dir, "supplier").select(F.concat(F.lit("file_"), F.col("s_nationkey")).alias("file"), F.concat(F.lit("S"), F.col("s_suppkey")).alias("sheet"))
    exact = table(spark, sf_dir, "part").filter("p_size = 7").select(F.concat(F.lit(" s"), F.col("p_partkey") % 90).alias("name"), F.col("p_type").alias("code"))
    return workbooks.routed(sheets, exact, PATTERNS)


QUERIES = {f.__name__: f for f in (w1_profiles, w1_sheet_lists, w2_formula_counts, w3_roles, w4_descriptions, w5_mentions, w5_large_vocabulary, w6_mentioning_all, w7_routes)}

_TERMS_SQL = ", ".join(f"('{t}', '{c}')" for t, c in TERMS)
_MENTIONS_SQL = f"""SELECT sheet, 'rows' AS zone, concept_id, max(n) AS n FROM (SELECT doc_id AS sheet, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]')) AS w FROM documents) GROUP BY ALL)
  JOIN (VALUES {_TERMS_SQL}) t(w, concept_id) USING (w) GROUP BY ALL"""
ORACLE_SQL = {
    "w1_profiles": f"""WITH {_CELLS_SQL}, allc AS (SELECT sheet, "row" + o AS "row", t, n, col, s FROM (
    SELECT sheet, "row", col, CASE WHEN f THEN 1 ELSE 0 END AS t, 1 AS n, NULL AS s FROM num UNION ALL SELECT sheet, "row", col, 1, 1, t FROM txt WHERE t IS NOT NULL) JOIN (SELECT sheet, CASE WHEN CAST(sheet[2:] AS INT) % 3 = 0 THEN 4 ELSE 0 END AS o FROM (SELECT DISTINCT sheet FROM val)) USING (sheet)),
r AS (SELECT sheet, "row", sum(n) AS n, sum(t) AS t, arg_min(s, col) AS first, 2 * sum(t) >= sum(n) AS texty FROM allc WHERE "row" < 300 GROUP BY ALL),
h AS (SELECT sheet, min("row") FILTER (n >= 3 AND texty) AS head, min("row") AS lo FROM r GROUP BY 1),
e AS (SELECT h.sheet, head, lo, (SELECT min(x) FROM range(0, 302) t(x) WHERE x >= head AND NOT EXISTS (SELECT 1 FROM r WHERE r.sheet = h.sheet AND r."row" = x AND texty)) AS stop FROM h),
b AS (SELECT sheet, count(*) FILTER (gap > 1) AS gaps FROM (SELECT sheet, "row" - lag("row") OVER (PARTITION BY sheet ORDER BY "row") AS gap FROM r) GROUP BY 1)
SELECT e.sheet, head AS header_row, coalesce(stop - head, 0) AS header_depth, gaps + CASE WHEN lo > 0 THEN 1 ELSE 1 END AS blocks, false AS time_in_columns,
  coalesce((SELECT arg_min(first, "row") FROM r WHERE r.sheet = e.sheet AND "row" < 5), '') AS title FROM e JOIN b USING (sheet)""",
    "w1_sheet_lists": f"""WITH {_CELLS_SQL}, tx AS (SELECT sheet, "row" + o AS "row", col, t FROM txt JOIN (SELECT sheet, CASE WHEN CAST(sheet[2:] AS INT) % 3 = 0 THEN 4 ELSE 0 END AS o FROM (SELECT DISTINCT sheet FROM val)) USING (sheet) WHERE t IS NOT NULL),
al AS (SELECT sheet, "row", col, 1 AS s FROM tx UNION ALL SELECT sheet, "row" + CASE WHEN CAST(sheet[2:] AS INT) % 3 = 0 THEN 4 ELSE 0 END, col, CASE WHEN f THEN 1 ELSE 0 END FROM num),
rw AS (SELECT sheet, "row", count(*) AS n, 2 * sum(s) >= count(*) AS texty FROM al WHERE "row" < 300 GROUP BY ALL),
hd AS (SELECT sheet, min("row") FILTER (n >= 3 AND texty) AS head FROM rw GROUP BY 1),
dp AS (SELECT hd.sheet, coalesce(head, 0) AS head, least(greatest((SELECT min(x) FROM range(0, 302) t(x) WHERE x >= head AND NOT EXISTS (SELECT 1 FROM rw WHERE rw.sheet = hd.sheet AND rw."row" = x AND texty)) - head, 1), 3) AS depth FROM hd),
zn AS (SELECT DISTINCT sheet, CASE WHEN "row" < head THEN 1 WHEN "row" < head + coalesce(depth, 1) THEN 2 ELSE 3 END AS z, t FROM tx JOIN dp USING (sheet) WHERE "row" < 300)
SELECT sheet, coalesce((SELECT array_to_string(list_sort(list(t))[:30], '|') FROM zn WHERE zn.sheet = dp.sheet AND z = 1), '') AS preamble, coalesce((SELECT array_to_string(list_sort(list(t))[:200], '|') FROM zn WHERE zn.sheet = dp.sheet AND z = 2), '') AS header_cells,
  coalesce((SELECT array_to_string(list_sort(list(t))[:300], '|') FROM zn WHERE zn.sheet = dp.sheet AND z = 3), '') AS row_labels FROM dp""",
    "w2_formula_counts": f"""WITH {_CELLS_SQL}, q AS (SELECT sheet, "row", count(*) FILTER (f) AS f FROM num GROUP BY ALL) SELECT sheet, CAST(sum(f) AS BIGINT) AS formulas, count(*) FILTER (f > 0 AND "row" % 5 = 0) AS total_rows FROM q GROUP BY 1""",
    "w3_roles": """SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'contents' WHEN c_custkey % 9 = 1 THEN 'dashboard' WHEN c_custkey % 2 = 0 THEN 'data' WHEN c_custkey % 3 > 0 THEN 'dashboard' ELSE 'other' END AS role FROM customer""",
    "w4_descriptions": """WITH c AS (SELECT p_partkey // 3 AS r, max(' s' || p_size) AS s, max(p_name) AS a, max(p_brand) AS b FROM part WHERE p_partkey // 3 < 400 GROUP BY 1)
SELECT 'S' || s[3:] AS sheet, arg_max(a || ' | ' || b, r) AS description FROM c WHERE CAST(s[3:] AS INT) IN (SELECT p_size FROM part WHERE p_size % 2 = 0) GROUP BY 1""",
    "w5_mentions": _MENTIONS_SQL,
    "w5_large_vocabulary": """WITH pr AS (SELECT DISTINCT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark)) WHERE w[i] <> w[i + 1]),
tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+|[^a-z0-9]+') AS x FROM documents),
oc AS (SELECT doc_id, x[i] AS a, x[i + 2] AS b, count(*) AS n FROM (SELECT doc_id, x, unnest(range(1, len(x) - 1)) AS i FROM tk) WHERE x[i + 1] = ' ' GROUP BY ALL)
SELECT doc_id AS sheet, 'rows' AS zone, 'c' || (length(a) * 100 + length(b)) AS concept_id, max(n) AS n FROM oc JOIN pr USING (a, b) GROUP BY ALL""",
    "w6_mentioning_all": f"""WITH m AS ({_MENTIONS_SQL}), s AS (SELECT sheet, CASE WHEN sheet % 3 = 0 THEN 'other' ELSE 'data' END AS role, CAST(sum(n) AS BIGINT) AS strength FROM m WHERE concept_id IN ('english', 'grammar') GROUP BY 1 HAVING count(*) = 2)
SELECT *, row_number() OVER (ORDER BY role = 'data' DESC, strength DESC, sheet) AS place FROM s QUALIFY place <= 50""",
    "w7_routes": """WITH s AS (SELECT 'file_' || s_nationkey AS file, 'S' || s_suppkey AS sheet FROM supplier)
SELECT file, sheet, code FROM s JOIN (SELECT DISTINCT 'S' || (p_partkey % 90) AS sheet, p_type AS code FROM part WHERE p_size = 7) USING (sheet)
UNION SELECT file, sheet, 'north' FROM s WHERE sheet LIKE 'S1%' AND regexp_matches(file, '^file_[0-4]') UNION SELECT file, sheet, 'any' FROM s WHERE regexp_matches(sheet, '^S[23]') UNION SELECT file, sheet, 'tens' FROM s WHERE regexp_matches(sheet, '^S.0')""",
}
