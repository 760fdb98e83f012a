"""Queries on vocabularies and source entities. Parts are concepts, suppliers source records, nations the assets they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import entities, vocabulary
from marlstone.sources.tables import table

KINDS = ["product", "input", "metric"]


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some parts twice, some of an unknown kind, some without a name."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 50
    one = part.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.when(k == 3, "thing").otherwise(F.element_at(F.array(*map(F.lit, KINDS)), F.col("p_size") % 3 + 1)).alias("kind"),
                      F.when(k != 7, F.col("p_name")).alias("name"))
    return one.unionByName(one.filter(F.substring("id", -2, 2) == "11"))


_CONCEPTS_SQL = """c0 AS (SELECT 'p' || p_partkey AS id, CASE WHEN p_partkey % 50 = 3 THEN 'thing' ELSE (['product', 'input', 'metric'])[p_size % 3 + 1] END AS kind,
    CASE WHEN p_partkey % 50 <> 7 THEN p_name END AS name FROM part),
concepts AS (SELECT * FROM c0 UNION ALL SELECT * FROM c0 WHERE right(id, 2) = '11')"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one order line after another are made from each other; orders' last lines lead nowhere."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.when(F.col("l_linenumber") % 2 == 0, "MADE_FROM").otherwise("DEPENDS_ON").alias("rel"),
                       F.when(F.col("l_orderkey") % 900 == 0, F.concat(F.lit("x"), F.col("l_suppkey"))).otherwise(F.concat(F.lit("p"), F.col("l_suppkey") * 7)).alias("dst")).distinct()


_EDGES_SQL = """edges AS (SELECT DISTINCT 'p' || l_partkey AS src, CASE WHEN l_linenumber % 2 = 0 THEN 'MADE_FROM' ELSE 'DEPENDS_ON' END AS rel,
  CASE WHEN l_orderkey % 900 = 0 THEN 'x' || l_suppkey ELSE 'p' || (l_suppkey * 7) END AS dst FROM lineitem)"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's brand and name, and its type, name it."""
    part = table(spark, sf_dir, "part")
    cid = F.concat(F.lit("p"), F.col("p_partkey")).alias("concept_id")
    return part.select(F.concat_ws(" ", "p_brand", "p_name").alias("term"), cid).unionByName(part.select(F.col("p_type").alias("term"), cid)).distinct()


_TERMS_SQL = """terms AS (SELECT DISTINCT term, concept_id FROM (SELECT p_brand || ' ' || p_name AS term, 'p' || p_partkey AS concept_id FROM part
  UNION ALL SELECT p_type, 'p' || p_partkey FROM part))"""


def v1_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.integrity(_concepts(spark, sf_dir), _edges(spark, sf_dir), KINDS)


def v2_vocabulary_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as concepts, before and after: some come, some go, some change their name or definition; so do their terms and relations."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").filter("p_partkey > 0")
    cid = F.concat(F.lit("p"), k)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("p_size") % 3 + 1)

    def version(df: DataFrame, name, definition, step: int) -> dict[str, DataFrame]:
        return {"concepts": df.select(cid.alias("id"), kind.alias("kind"), name.alias("name"), definition.alias("definition")), "terms": df.select(name.alias("term"), cid.alias("concept_id")).distinct(),
                "relations": df.select(cid.alias("src"), F.lit("MADE_FROM").alias("rel"), F.concat(F.lit("p"), F.floor(k / step).cast("string")).alias("dst")).filter(k % 5 == 0)}

    before = version(part.filter(k % 11 != 1), F.col("p_name"), F.col("p_brand"), 2)
    after = version(part.filter(k % 13 != 1), F.when(k % 17 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.when(k % 19 != 0, F.col("p_brand")), 3)
    additions = part.filter(k % 7 == 0).select(F.concat(F.lit("extra "), F.col("p_type")).alias("term"), cid.alias("concept_id"))
    return vocabulary.changes(before, after, _edges(spark, sf_dir), additions)


def v3_orphan_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = _concepts(spark, sf_dir).filter("id like '%7'")
    return vocabulary.orphan_impact(removed, _edges(spark, sf_dir))


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return (table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("country"), F.when(F.col("n_nationkey") % 6 > 0, F.col("n_regionkey")).alias("region_id")).distinct(),
        table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region")))


def v4_region_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.region_dimension(*_places(spark, sf_dir))[0]


def v4_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.region_dimension(*_places(spark, sf_dir))[1]


def v5_expanded_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types have aliases from the orders' priorities; one is a placeholder."""
    aliases = table(spark, sf_dir, "part").select(F.when(F.col("p_size") == 1, "NaN").otherwise(F.concat_ws("_", "p_type", F.col("p_size").cast("string"))).alias("alias"), F.lower("p_type").alias("canonical"))
    return vocabulary.expanded(aliases.distinct(), _terms(spark, sf_dir))


def v6_term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.looked_up(_terms(spark, sf_dir), "small")


def v7_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.neighbourhood(_concepts(spark, sf_dir).select("id").distinct(), _edges(spark, sf_dir), _terms(spark, sf_dir))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of documents as labels, and parts' names with a unit."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("label_id"), F.substring_index("text", "\n", 1).alias("label"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("l"), F.col("p_partkey")).alias("label_id"), F.concat_ws(" ", F.initcap("p_name"), F.lit("of the"), "p_brand", F.lit("(kt)")).alias("label"))
    return docs.unionByName(parts)


_LABELS_SQL = """labels AS (SELECT 'd' || doc_id AS label_id, split_part(text, chr(10), 1) AS label FROM documents
  UNION ALL SELECT 'l' || p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' of the ' || p_brand || ' (kt)' FROM part)"""
_NORM_SQL = "list_filter(regexp_extract_all(lower(regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', '', 'g')), '[a-z0-9]+'), lambda w: w NOT IN ('" + "', '".join(vocabulary.STOP_WORDS) + "'))"


def v8_concept_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are the concepts; frequent words of the documents name some of them too."""
    part = table(spark, sf_dir, "part")
    words = {"le": "p0", "that": "p40", "und die": "p80", "de la": "p120", "was": "p160"}
    more = spark.createDataFrame(list(words.items()), "term string, concept_id string")
    terms = part.select(F.col("p_name").alias("term"), F.concat(F.lit("p"), F.col("p_partkey")).alias("concept_id")).unionByName(more)
    terms = terms.unionByName(part.select(F.concat_ws(" ", "p_name", F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("term"), F.concat(F.lit("p"), F.col("p_partkey")).alias("concept_id")))
    kinds = part.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("concept_id"), F.element_at(F.array(*map(F.lit, KINDS)), F.col("p_size") % 3 + 1).alias("kind"))
    return vocabulary.matched(_labels(spark, sf_dir), terms, kinds, ["input", "product"])


def v9_driver_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ["Marge", "Coût", "Volume (kt)", "prix (USD/t)", "Fret", "Chiffre d'affaires", "Ratio t/t", "FX", "Frais fixes ( M$ )", "other (x)"]
    label = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % 10 + 1).cast("int")), F.element_at(F.split("p_name", " "), 1))
    labels = table(spark, sf_dir, "part").select("p_partkey", label.alias("label"))
    return labels.select("p_partkey", vocabulary.driver_type(F.col("label")).alias("driver"), vocabulary.unit_of(F.col("label")).alias("unit"))


def v10_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").filter("p_size < 20").select(F.concat(F.lit(" "), F.lower("p_type")).alias("name"), F.lit("company").alias("kind"))
    return vocabulary.clashes(_terms(spark, sf_dir), names)


def v11_lane_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lanes, many of them wrong somewhere."""
    n = F.col("c_custkey")
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (n % k + 1).cast("int"))
    lanes = table(spark, sf_dir, "customer").select(
        n.alias("row_id"), pick(["supply", "export", "competitor", "other"], 4).alias("role"), pick(["public", "confirmed", "guess"], 3).alias("status"),
        F.concat(F.lit("p"), n % 60).alias("item"), F.when(n % 7 > 0, F.concat(F.lit("country_"), F.col("c_nationkey"))).otherwise(F.lit("sea")).alias("origin"),
        F.when(n % 5 > 0, F.concat(F.lit("p"), n % 30)).alias("to"), F.when(n % 2 > 0, F.lit("country_1")).alias("destination"),
        F.when(n % 3 > 0, F.array(F.concat(F.lit("p"), n % 9))).otherwise(F.array().cast("array<string>")).alias("via"), F.when(n % 6 < 3, (n % 5) / 3).alias("share"))
    kinds = table(spark, sf_dir, "part").filter("p_partkey < 50").select(
        F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.element_at(F.array(*map(F.lit, ("product", "route", "site", "input"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("kind"))
    return vocabulary.lane_problems(lanes, kinds)


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is made from the one of a third of its number, and from one of its size."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("product"), F.floor(F.col("p_partkey") / 3).cast("bigint").alias("input")).unionByName(
        part.filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("product"), F.col("p_size").cast("bigint").alias("input")))


_MADE_SQL = "made AS (SELECT p_partkey AS product, p_partkey // 3 AS input FROM part UNION SELECT p_partkey, p_size FROM part WHERE p_partkey % 4 = 0)"


def v12_missing_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product"), (F.col("l_suppkey") % 20).alias("input"))
    return vocabulary.missing_inputs(vocabulary.expected_inputs(_made(spark, sf_dir)), seen)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.lower(F.concat_ws("_", "c_mktsegment", F.col("c_custkey").cast("string"))).alias("name"), "c_nationkey", "c_mktsegment")


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one nation and segment as one asset: some left out, some in two, some unknown ones."""
    r = _records(spark, sf_dir).filter("entity_id % 13 <> 0")
    more = r.filter("entity_id % 17 = 0").withColumn("c_mktsegment", F.lit("EXTRA"))
    odd = r.filter("entity_id % 19 = 0").withColumn("entity_id", -F.col("entity_id") - 1)
    return r.unionByName(more).unionByName(odd).groupBy("c_nationkey", "c_mktsegment").agg(F.array_sort(F.collect_list("entity_id")).alias("members")).select(
        F.concat_ws("_", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("canonical_id"), F.concat_ws(" ", F.lit("Works"), "c_mktsegment").alias("name"),
        F.when(F.col("c_nationkey") % 2 == 0, "plant").otherwise("mine").alias("kind"), F.concat(F.lit("site_"), F.col("c_nationkey") % 8).alias("site"),
        (F.col("c_nationkey") % 3 == 0).alias("controlled"), F.when(F.size("members") > 5, "high").otherwise("medium").alias("confidence"), "members")


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.concat(F.lit("site_"), F.col("r_regionkey")).alias("id"))


_ASSETS_SQL = """r AS (SELECT c_custkey AS entity_id, lower(c_mktsegment || '_' || c_custkey) AS name, c_nationkey, c_mktsegment FROM customer),
r1 AS (SELECT * FROM r WHERE entity_id % 13 <> 0),
m AS (SELECT entity_id, c_nationkey, c_mktsegment FROM r1 UNION ALL SELECT entity_id, c_nationkey, 'EXTRA' FROM r1 WHERE entity_id % 17 = 0 UNION ALL SELECT -entity_id - 1, c_nationkey, c_mktsegment FROM r1 WHERE entity_id % 19 = 0),
mm AS (SELECT c_nationkey || '_' || c_mktsegment AS canonical_id, * FROM m),
a AS (SELECT canonical_id, 'Works ' || c_mktsegment AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'plant' ELSE 'mine' END AS kind, 'site_' || (c_nationkey % 8) AS site, c_nationkey % 3 = 0 AS controlled,
  CASE WHEN count(*) > 5 THEN 'high' ELSE 'medium' END AS confidence, count(*) AS n FROM mm GROUP BY canonical_id, c_nationkey, c_mktsegment)"""


def r2_completed_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.completed(_records(spark, sf_dir), _assets(spark, sf_dir)).withColumn("n", F.col("n").cast("bigint"))


def r3_partition_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.partition_problems(_records(spark, sf_dir), _assets(spark, sf_dir))


def r4_asset_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.asset_edges(_assets(spark, sf_dir), _sites(spark, sf_dir))


def r5_found_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.found_by_name(_records(spark, sf_dir), _assets(spark, sf_dir), "building 1")


def r7_asset_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of the first nations are approved."""
    edges = entities.asset_edges(_assets(spark, sf_dir), _sites(spark, sf_dir))
    ok = _assets(spark, sf_dir).filter("canonical_id like '1%'").select(F.concat(F.lit("asset_"), "canonical_id").alias("asset"))
    return entities.asset_counts(entities.approved(edges, ok))


QUERIES = {
    f.__name__: f
    for f in (v1_integrity, v2_vocabulary_changes, v3_orphan_impact, v4_region_concepts, v4_in_region, v5_expanded_aliases, v6_term_lookup, v7_neighbourhood, v8_concept_match, v9_driver_types,
              v10_clashes, v11_lane_problems, v12_missing_inputs, r2_completed_assets, r3_partition_problems, r4_asset_edges, r5_found_by_name, r7_asset_list)
}

ORACLE_SQL = {
    "v1_integrity": f"""WITH {_CONCEPTS_SQL}, {_EDGES_SQL} SELECT 'duplicate' AS problem, id FROM concepts GROUP BY id HAVING count(*) > 1
  UNION SELECT 'unknown kind', id FROM concepts WHERE kind = 'thing' UNION SELECT 'incomplete', id FROM concepts WHERE name IS NULL
  UNION SELECT 'dangling', id FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) WHERE id NOT IN (SELECT id FROM concepts)""",
    "v2_vocabulary_changes": f"""WITH {_EDGES_SQL}, q AS (SELECT *, p_partkey AS k, 'p' || p_partkey AS id, (['product', 'input', 'metric'])[p_size % 3 + 1] AS kd, CASE WHEN p_partkey % 17 = 0 THEN upper(p_name) ELSE p_name END AS n2,
  CASE WHEN p_partkey % 19 <> 0 THEN p_brand END AS d2 FROM part WHERE p_partkey > 0), a AS (SELECT * FROM q WHERE k % 11 <> 1), b AS (SELECT * FROM q WHERE k % 13 <> 1),
ta AS (SELECT DISTINCT p_name || ' -> ' || id AS t FROM a), tb AS (SELECT DISTINCT n2 || ' -> ' || id AS t FROM b), ra AS (SELECT id || ' MADE_FROM p' || (k // 2) AS t FROM a WHERE k % 5 = 0), rb AS (SELECT id || ' MADE_FROM p' || (k // 3) AS t FROM b WHERE k % 5 = 0)
SELECT '+' AS sign, 'concept' AS what, id || ' (' || kd || ')' AS said FROM b WHERE k % 11 = 1 UNION ALL SELECT '-', 'concept', id || ' (' || kd || ')' FROM a WHERE k % 13 = 1
UNION ALL SELECT '~', 'concept', id || '.name: ' || p_name || ' -> ' || n2 FROM a JOIN b USING (id, p_name, n2) WHERE p_name <> n2
UNION ALL SELECT '~', 'concept', a.id || '.definition: ' || a.p_brand || ' -> nothing' FROM a JOIN b USING (id) WHERE a.k % 19 = 0
UNION ALL SELECT '+', 'term', t FROM (SELECT t FROM tb EXCEPT SELECT t FROM ta) UNION ALL SELECT '-', 'term', t FROM (SELECT t FROM ta EXCEPT SELECT t FROM tb)
UNION ALL SELECT '+', 'relation', t FROM (SELECT t FROM rb EXCEPT SELECT t FROM ra) UNION ALL SELECT '-', 'relation', t FROM (SELECT t FROM ra EXCEPT SELECT t FROM rb)
UNION ALL SELECT '!', 'edges', id || ' ' || side || ' ' || rel || ': ' || count(*) FROM (SELECT src AS id, rel, 'out' AS side FROM edges UNION ALL SELECT dst, rel, 'in' FROM edges) WHERE id IN (SELECT id FROM a WHERE k % 13 = 1) GROUP BY id, side, rel
UNION ALL SELECT '!', 'added term', 'extra ' || p_type || ' -> ' || id FROM a WHERE k % 13 = 1 AND k % 7 = 0""",
    "v3_orphan_impact": f"""WITH {_CONCEPTS_SQL}, {_EDGES_SQL} SELECT id, rel, side, count(*) AS n FROM (SELECT src AS id, rel, 'out' AS side FROM edges UNION ALL SELECT dst, rel, 'in' FROM edges)
  WHERE id IN (SELECT id FROM concepts WHERE id LIKE '%7') GROUP BY ALL""",
    "v4_region_concepts": """SELECT DISTINCT 'country_' || lower(n_name) AS id, 'country' AS kind, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT 'region_' || lower(replace(r_name, ' ', '_')), 'region', r_name FROM region""",
    "v4_in_region": """SELECT DISTINCT 'country_' || lower(n_name) AS src, 'IN_REGION' AS rel, 'region_' || lower(replace(r_name, ' ', '_')) AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 6 > 0""",
    "v5_expanded_aliases": f"""WITH {_TERMS_SQL} SELECT * FROM terms UNION SELECT alias, concept_id FROM (SELECT DISTINCT p_type || ' ' || p_size AS alias, lower(p_type) AS canonical FROM part WHERE p_size <> 1) JOIN terms ON lower(term) = canonical""",
    "v6_term_lookup": f"WITH {_TERMS_SQL} SELECT concept_id, bool_or(lower(term) = 'small') AS exact FROM terms WHERE contains(lower(term), 'small') GROUP BY 1",
    "v7_neighbourhood": f"""WITH {_CONCEPTS_SQL}, {_EDGES_SQL}, {_TERMS_SQL} SELECT id, coalesce(o, '') AS outgoing, coalesce(i, '') AS incoming, coalesce(t, '') AS terms FROM (SELECT DISTINCT id FROM concepts)
  LEFT JOIN (SELECT src AS id, string_agg(rel || ' ' || dst, ', ' ORDER BY rel || ' ' || dst) AS o FROM edges GROUP BY 1) USING (id)
  LEFT JOIN (SELECT dst AS id, string_agg(rel || ' ' || src, ', ' ORDER BY rel || ' ' || src) AS i FROM edges GROUP BY 1) USING (id)
  LEFT JOIN (SELECT concept_id AS id, string_agg(term, ', ' ORDER BY term) AS t FROM terms GROUP BY 1) USING (id)""",
    "v8_concept_match": f"""WITH {_LABELS_SQL}, pt AS (SELECT *, 'p' || p_partkey AS cid FROM part),
t AS (SELECT DISTINCT cid, w FROM (SELECT cid, {_NORM_SQL.format("term")} AS w FROM (SELECT cid, p_name AS term FROM pt UNION ALL SELECT cid, p_name || ' ' || replace(p_brand, '#', ' ') FROM pt
  UNION ALL SELECT * FROM (VALUES ('p0', 'le'), ('p40', 'that'), ('p80', 'und die'), ('p120', 'de la'), ('p160', 'was')))) WHERE len(w) > 0),
l AS (SELECT label_id, list_distinct({_NORM_SQL.format("coalesce(label, '')")}) AS lw FROM labels),
s AS (SELECT label_id, cid, max(0.5 + 0.5 * len(w) / len(lw)) AS score FROM l, t WHERE list_has_all(lw, w) GROUP BY ALL),
k AS (SELECT s.*, (['product', 'input', 'metric'])[p_size % 3 + 1] AS kind FROM s JOIN pt USING (cid)),
n AS (SELECT *, row_number() OVER w AS nth, lead(score) OVER w AS s2, lead(kind) OVER w AS k2 FROM k WHERE kind <> 'metric' WINDOW w AS (PARTITION BY label_id ORDER BY score DESC, kind, cid)),
b AS (SELECT label_id, cid, round(score, 3) AS score, CASE WHEN score >= 0.75 OR (score >= 0.6 AND (s2 IS NULL OR s2 < score OR k2 <> kind)) THEN 'accept' WHEN score >= 0.4 THEN 'review' ELSE 'unknown' END AS decision FROM n WHERE nth = 1)
SELECT label_id, cid AS concept_id, coalesce(score, 0.0) AS score, coalesce(decision, 'unknown') AS decision FROM labels LEFT JOIN b USING (label_id)""",
    "v9_driver_types": """SELECT p_partkey, (['margin', 'cost', 'volume', 'price', 'freight', 'revenue', 'consumption_ratio', 'fx', 'fixed_cost', 'unknown'])[p_partkey % 10 + 1] AS driver,
  (['', '', 'kt', 'USD/t', '', '', '', '', 'M$', ''])[p_partkey % 10 + 1] AS u, nullif(u, '') AS unit FROM part""".replace("SELECT p_partkey,", "SELECT p_partkey, driver, unit FROM (SELECT p_partkey,") + ")",
    "v10_clashes": f"WITH {_TERMS_SQL} SELECT term, concept_id, 'company' AS name_kind FROM terms WHERE lower(term) IN (SELECT lower(p_type) FROM part WHERE p_size < 20)",
    "v11_lane_problems": """WITH kinds AS (SELECT 'p' || p_partkey AS id, (['product', 'route', 'site', 'input'])[p_partkey % 4 + 1] AS kind FROM part WHERE p_partkey < 50),
l AS (SELECT c_custkey AS n, (['supply', 'export', 'competitor', 'other'])[c_custkey % 4 + 1] AS role, (['public', 'confirmed', 'guess'])[c_custkey % 3 + 1] AS status, 'p' || (c_custkey % 60) AS item,
  CASE WHEN c_custkey % 7 > 0 THEN 'country_' || c_nationkey ELSE 'sea' END AS origin, CASE WHEN c_custkey % 5 > 0 THEN 'p' || (c_custkey % 30) END AS dest, CASE WHEN c_custkey % 2 > 0 THEN 'country_1' END AS destination,
  CASE WHEN c_custkey % 3 > 0 THEN 'p' || (c_custkey % 9) END AS via, CASE WHEN c_custkey % 6 < 3 THEN (c_custkey % 5) / 3 END AS share FROM customer),
j AS (SELECT l.*, i.kind AS ik, t.kind AS tk, v.kind AS vk, 'lane:' || role || ':' || item || ':' || origin || ':' || coalesce(dest, destination, 'world') AS lane_id
  FROM l LEFT JOIN kinds i ON i.id = item LEFT JOIN kinds t ON t.id = dest LEFT JOIN kinds v ON v.id = via)
SELECT n AS row_id, lane_id, concat_ws(',', CASE WHEN role = 'other' THEN 'role' END, CASE WHEN status = 'guess' THEN 'status' END, CASE WHEN ik IS NULL OR ik NOT IN ('product', 'input') THEN 'item' END,
  CASE WHEN via IS NOT NULL AND (vk IS NULL OR vk <> 'route') THEN 'via' END, CASE WHEN origin = 'sea' THEN 'origin' END, CASE WHEN role = 'supply' AND (tk IS NULL OR tk <> 'site') THEN 'to' END,
  CASE WHEN role = 'export' AND destination IS NULL THEN 'destination' END, CASE WHEN share IS NOT NULL AND NOT (status = 'confirmed' AND share BETWEEN 0 AND 1) THEN 'share' END,
  CASE WHEN count(*) OVER (PARTITION BY lane_id) > 1 THEN 'duplicate' END) AS problems FROM j""",
    "v12_missing_inputs": f"""WITH {_MADE_SQL}, two AS (SELECT a.product, b.input FROM made a JOIN made b ON a.input = b.product), three AS (SELECT a.product, b.input FROM two a JOIN made b ON a.input = b.product)
SELECT product, input FROM (SELECT * FROM made UNION SELECT * FROM two UNION SELECT * FROM three) WHERE product <> input AND (product, input) NOT IN (SELECT (l_partkey, l_suppkey % 20) FROM lineitem)""",
    "r2_completed_assets": f"""WITH {_ASSETS_SQL} SELECT canonical_id, name, kind, confidence, n FROM a UNION ALL SELECT 'unassigned_' || entity_id, name, 'other', 'low', 1 FROM r WHERE entity_id % 13 = 0""",
    "r3_partition_problems": f"""WITH {_ASSETS_SQL} SELECT entity_id, CASE WHEN k IS NULL THEN 'unknown' WHEN h IS NULL THEN 'missing' ELSE 'duplicated' END AS problem
  FROM (SELECT entity_id, 1 AS k FROM r) FULL JOIN (SELECT entity_id, count(*) AS h FROM m GROUP BY 1) USING (entity_id) WHERE k IS NULL OR h IS NULL OR h > 1""",
    "r4_asset_edges": f"""WITH {_ASSETS_SQL} SELECT CAST(entity_id AS VARCHAR) AS src, 'SAME_AS' AS rel, 'asset_' || canonical_id AS dst, 'proposed' AS status FROM mm
  UNION ALL SELECT 'asset_' || canonical_id, 'LOCATED_AT', site, NULL FROM a WHERE site IN (SELECT 'site_' || r_regionkey FROM region) UNION ALL SELECT 'asset_' || canonical_id, 'PART_OF', 'group', NULL FROM a WHERE controlled""",
    "r5_found_by_name": f"""WITH {_ASSETS_SQL} SELECT canonical_id, a.name, string_agg(DISTINCT r.name, ', ' ORDER BY r.name) AS source_names FROM mm JOIN r USING (entity_id) JOIN a USING (canonical_id)
  GROUP BY canonical_id, a.name HAVING bool_or(contains(r.name, 'building_1')) OR contains(lower(a.name), 'building 1')""",
    "r7_asset_list": f"WITH {_ASSETS_SQL} SELECT 'asset_' || canonical_id AS asset, n AS records, CASE WHEN canonical_id LIKE '1%' THEN 'approved' ELSE 'proposed' END AS status FROM a",
}
