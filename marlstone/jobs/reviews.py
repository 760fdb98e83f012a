"""Queries on exposure of lanes, audits of texts, snapshots and source entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.numbers import rounded
from marlstone.operators import audits, exposure
from marlstone.sources.tables import ASSESSMENTS_SQL, assessments, table

#: What an event says of a market.
DIRECTIONS = ["up", "down", "disrupted", "restored", "moved"]
#: Demonstration aliases of places: alias, route.
ALIASES = [("c8", "c1"), ("c9", "c2")]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incident is what one user did on one day."""
    raw = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat(F.lit("c"), F.col("user_id") % 10).alias("concept"),
        F.when(F.col("event_type") == "view", "unclear").when(F.col("value") > 10, "impaired").otherwise("eased").alias("state"), "user_id")
    raw = raw.withColumn("incident", F.concat_ws(":", "user_id", "date")).drop("user_id")
    return exposure.remapped(raw, spark.createDataFrame(ALIASES, "alias string, route string"))


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    place = lambda k: F.concat(F.lit("c"), k % 10)
    return table(spark, sf_dir, "nation").select(
        n.alias("lane_id"), F.element_at(F.array(*map(F.lit, ("supply", "export", "competitor"))), n % 3 + 1).alias("role"),
        F.concat(F.lit("item "), F.col("n_regionkey")).alias("item"), place(n).alias("origin"), F.array(place(n + 3)).alias("via"),
        F.when(n % 4 > 0, place(2 * n + 1)).alias("destination"))


_EVENTS_SQL = """SELECT strftime(ts, '%Y-%m-%d') AS date,
  CASE user_id % 10 WHEN 8 THEN 'c1' WHEN 9 THEN 'c2' ELSE 'c' || (user_id % 10) END AS concept,
  CASE WHEN event_type = 'view' THEN 'unclear' WHEN value > 10 THEN 'impaired' ELSE 'eased' END AS state,
  user_id || ':' || strftime(ts, '%Y-%m-%d') AS incident FROM events"""


def e3_alias_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("concept", "state").agg(F.count("*").alias("n"))


def e4_lane_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that touch each lane, by the effect on it."""
    counted = _events(spark, sf_dir).groupBy("concept", "state").agg(F.count("*").alias("n"))
    both = counted.join(exposure.touches(_lanes(spark, sf_dir)), "concept")
    return both.groupBy("lane_id", exposure.effect(F.col("role"), F.col("state")).alias("effect")).agg(F.sum("n").alias("n"))


def e8_link_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.lane_links(_events(spark, sf_dir), _lanes(spark, sf_dir))


def e5_market_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as events on their return flag's market; the line's number gives the direction."""
    events = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("incident"), F.col("l_returnflag").alias("concept"),
        F.element_at(F.array(*map(F.lit, DIRECTIONS)), (F.col("l_linenumber") % 5 + 1)).alias("direction"))
    roles = spark.createDataFrame([("A", "bought"), ("N", "sold"), ("R", "sold")], "item string, role string")
    return exposure.market_effects(events, roles)


def e8_link_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.link_events(_events(spark, sf_dir), _lanes(spark, sf_dir))


def e8_explained_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links with their reasons: nations as lanes, two concepts as markets, one as a site."""
    k = F.col("event_id") % 2 == 0
    direction = F.when(F.col("event_type") == "view", "moved").when(F.col("value") > 10, F.when(k, "disrupted").otherwise("down")).otherwise(F.when(k, "restored").otherwise("up"))
    day = F.date_format("ts", "yyyy-MM-dd")
    events = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", day).alias("incident"), day.alias("date"), F.concat(F.lit("c"), F.col("user_id") % 10).alias("concept"), direction.alias("direction"))
    n = F.col("lane_id")
    lanes = _lanes(spark, sf_dir).withColumns({"to": F.when(n % 8 == 0, F.lit("home")), "status": F.when(n % 5 == 0, "confirmed"), "via": F.when(n % 6 > 0, F.col("via"))})
    items = spark.createDataFrame([("c3", "bought"), ("c4", "sold")], "item string, side string")
    return exposure.explained_links(events, lanes, items, spark.createDataFrame([("c5",)], "site string"), "us")


def e2_merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty events are an incident, but for each ninth one, which is its own."""
    raw = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    reports = raw.select("event_id", day.alias("date"), F.concat(F.lit("c"), F.col("user_id") % 7).alias("concept"), F.col("event_type").alias("direction"),
                         F.when(F.col("value") > 10, "price").otherwise("supply").alias("channel"), F.floor(F.col("event_id") / 3).cast("bigint").alias("article_id"))
    group = F.floor(F.col("event_id") / 20).cast("bigint")
    held = raw.filter("event_id % 9 > 0").groupBy(group.alias("g")).agg(F.min(day).alias("incident_date"), F.collect_list("event_id").alias("ids"))
    return exposure.merged_events(reports, held.select(F.explode("ids").alias("event_id"), F.concat(F.lit("i"), F.col("g")).alias("incident"), "incident_date"))


def e6_site_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sites that make their customers' segments."""
    direction = F.when(F.col("event_type") == "click", "disrupted").when(F.col("event_type") == "view", "up").otherwise(F.col("event_type"))
    site = lambda k: F.concat(F.lit("s"), k)
    events = table(spark, sf_dir, "events").select(site(F.col("user_id") % 25).alias("concept"), direction.alias("direction"), F.floor(F.col("event_id") / 5).alias("incident"))
    made = table(spark, sf_dir, "customer").select(site(F.col("c_nationkey")).alias("site"), F.col("c_mktsegment").alias("product"))
    return exposure.site_effects(events, made)


def e7_reached_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is an input of those of twice its number; each tenth part is an own product."""
    part = table(spark, sf_dir, "part")
    made = part.filter("p_partkey > 0").select(F.col("p_partkey").alias("product"), F.floor(F.col("p_partkey") / 2).cast("bigint").alias("input"))
    return exposure.reached(part.filter("p_size > 25").select(F.col("p_partkey").alias("item")), made, part.filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("product")))


def e10_monthly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asia's route A is configured but for one product, whose own route has no prices."""
    products = table(spark, sf_dir, "part").select(F.col("p_type").alias("product")).distinct()
    configured = products.select("product", F.when(F.col("product") == "PROMO", "MOON").otherwise("ASIA").alias("location"), F.lit("A").alias("incoterm"))
    return exposure.monthly_prices(assessments(spark, sf_dir), configured, "1997-02-01", "1997-09-30").withColumn("mean", rounded(F.col("mean"), 2))


def e11_scoped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0")
    reach = nation.select(F.concat(F.lit("item "), "n_regionkey").alias("item"), F.concat(F.lit("prod "), F.col("n_nationkey") % 4).alias("product")).distinct()
    links = exposure.lane_links(_events(spark, sf_dir), _lanes(spark, sf_dir)).select("effect", "role", "item", "incidents")
    return exposure.scoped(links, reach, "prod 2")


def e11_untouched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of large lines are touched, and reach the next part."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("p"), F.col("p_partkey")).alias("item"))
    links = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("item"))
    reach = part.select("item", F.concat(F.lit("p"), F.col("p_partkey") + 1).alias("product"))
    return exposure.untouched(part, links, reach)


def e11_lane_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.status_label(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("item"), F.when(F.col("s_suppkey") % 4 > 0, "public").otherwise("confirmed").alias("status")))


def e12_lane_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lanes, their large lines as hops."""
    hops = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("lane_id"), F.col("l_linenumber").alias("nth"), F.concat(F.lit("r"), F.col("l_suppkey")).alias("route"))
    return exposure.lane_snapshot(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lane_id")), hops)


def a2_number_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents as answers, the even one before each as its evidence."""
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 2).alias("answer_id"), "doc_id", "text")
    return audits.unsupported_numbers(docs.filter("doc_id % 2 = 1"), docs.filter("doc_id % 2 = 0"))


def n3_quotes_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first sentence as a quote, altered in every third."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")
    first = F.substring_index("text", ".", 1)
    items = texts.select("article_id", F.lit(0).alias("item"), F.when(F.col("article_id") % 3 == 0, F.concat(first, F.lit("⁂"))).otherwise(first).alias("quote"))
    return audits.quotes_found(items, texts)


def v2_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts before and after: some added, some removed, some repriced."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")
    new = part.filter("p_partkey % 13 <> 1").withColumn(
        "p_retailprice", F.when(F.col("p_partkey") % 17 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")))
    return audits.snapshot_diff(part.filter("p_partkey % 11 <> 1"), new, "p_partkey")


def k7_remaining_cargo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a voyage: its first line loads, the others discharge."""
    quantity = F.col("l_quantity").cast("bigint")
    moves = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, 100 * quantity).otherwise(-quantity).alias("amount"))
    return audits.running_balance(moves, "l_orderkey", ["l_linenumber", "amount"], "amount")


def r1_entity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with nation, region, products and the number of their lines, which are counted before any join."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    products = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    products = products.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("products"), F.sum("n").alias("metrics"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .join(products, F.col("s_suppkey") == F.col("l_suppkey"), "left")
            .select("s_suppkey", F.col("n_name").alias("country"), F.col("r_name").alias("parent"),
                    F.coalesce("products", F.lit("")).alias("products"), F.coalesce("metrics", F.lit(0)).alias("metrics")))


def r6_site_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries as assets: member records, distinct products and metrics."""
    records = r1_entity_features(spark, sf_dir)
    sums = records.groupBy("country").agg(F.count("*").alias("records"), F.sum("metrics").alias("metrics"))
    products = records.select("country", F.explode(F.split("products", ",")).alias("p")).filter("p <> ''")
    products = products.groupBy("country").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("products"))
    return sums.join(products, "country", "left")


QUERIES = {
    f.__name__: f
    for f in (e3_alias_remap, e4_lane_touches, e5_market_effects, e8_link_rollup, e8_link_events, e8_explained_links, e2_merged_events, e6_site_effects, e7_reached_products,
              e10_monthly_prices, e11_scoped_links, e11_untouched_items, e11_lane_status, e12_lane_snapshot, a2_number_grounding, n3_quotes_found, v2_snapshot_diff,
              k7_remaining_cargo, r1_entity_features, r6_site_assets)
}

_TOUCH_SQL = f"""WITH lanes AS (SELECT n_nationkey AS lane_id, ['supply', 'export', 'competitor'][n_nationkey % 3 + 1] AS role, 'item ' || n_regionkey AS item,
  'c' || (n_nationkey % 10) AS o, 'c' || ((n_nationkey + 3) % 10) AS v, CASE WHEN n_nationkey % 4 > 0 THEN 'c' || ((2 * n_nationkey + 1) % 10) END AS d FROM nation),
t AS (SELECT lane_id, role, item, concept, min(pos) AS pos, CASE WHEN concept = any_value(o) THEN 'origin' WHEN concept = any_value(d) THEN 'destination' ELSE 'route' END AS kind FROM (
    SELECT *, o AS concept, 0 AS pos FROM lanes WHERE role <> 'export' UNION ALL SELECT *, v, 1 FROM lanes UNION ALL SELECT *, d, 2 FROM lanes WHERE d IS NOT NULL) GROUP BY lane_id, role, item, concept),
x AS (SELECT *, CASE WHEN state = 'unclear' THEN 'unclear' WHEN (role = 'competitor') = (state = 'eased') THEN 'headwind' ELSE 'tailwind' END AS effect
  FROM ({_EVENTS_SQL}) JOIN t USING (concept)),
f AS (SELECT effect, role, item, incident, arg_min(date, (lane_id, pos, date)) AS date, arg_min(kind, (lane_id, pos, date)) AS kind FROM x GROUP BY ALL)"""
_FEATURES_SQL = """SELECT s_suppkey, n_name AS country, r_name AS parent, coalesce(products, '') AS products, coalesce(metrics, 0) AS metrics FROM supplier
LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT l_suppkey, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS products, count(*) AS metrics
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON s_suppkey = l_suppkey"""
_SQUASHED = "lower(trim(regexp_replace(coalesce({}, ''), '[ \\t\\n\\x0b\\x0c\\r]+', ' ', 'g')))"
_NUMBERS = ("SELECT DISTINCT doc_id // 2 AS answer_id, CAST(replace(unnest(regexp_extract_all(regexp_replace(regexp_replace(text, {}, {}, 'g'), {}, {}, 'g'), "
            "'[0-9]+(?:[.,][0-9]+)?')), ',', '.') AS DOUBLE) AS n FROM documents WHERE doc_id % 2 = ").format(*["'([0-9])[   ,]([0-9]{3})\\b'", "'\\1\\2'"] * 2)

ORACLE_SQL = {
    "e3_alias_remap": f"SELECT concept, state, count(*) AS n FROM ({_EVENTS_SQL}) GROUP BY ALL",
    "e4_lane_touches": _TOUCH_SQL + " SELECT lane_id, effect, count(*) AS n FROM x GROUP BY ALL",
    "e8_link_rollup": _TOUCH_SQL + """ SELECT effect, role, item, count(*) AS incidents, min(date) AS first_date, max(date) AS last_date,
  (SELECT count(DISTINCT lane_id) FROM x WHERE x.effect = f.effect AND x.role = f.role AND x.item = f.item) AS lanes FROM f GROUP BY effect, role, item""",
    "e8_link_events": _TOUCH_SQL + """ SELECT effect, role, item, string_agg(DISTINCT kind, ',' ORDER BY kind) AS touched, string_agg(date || ' ' || incident || ' ' || kind, '; ' ORDER BY date || ' ' || incident || ' ' || kind) AS events
  FROM (SELECT *, row_number() OVER (PARTITION BY effect, role, item ORDER BY date, incident) AS nth FROM f) WHERE nth <= 8 GROUP BY ALL""",
    "e8_explained_links": """WITH e AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS incident, strftime(ts, '%Y-%m-%d') AS date, 'c' || (user_id % 10) AS concept,
  CASE WHEN event_type = 'view' THEN 'moved' WHEN value > 10 THEN CASE WHEN event_id % 2 = 0 THEN 'disrupted' ELSE 'down' END ELSE CASE WHEN event_id % 2 = 0 THEN 'restored' ELSE 'up' END END AS d FROM events),
ln AS (SELECT n_nationkey AS n, ['supply', 'export', 'competitor'][n_nationkey % 3 + 1] AS role, 'item ' || n_regionkey AS item, 'c' || (n_nationkey % 10) AS o, CASE WHEN n_nationkey % 6 > 0 THEN 'c' || ((n_nationkey + 3) % 10) END AS v,
  CASE WHEN n_nationkey % 4 > 0 THEN 'c' || ((2 * n_nationkey + 1) % 10) END AS dst, CASE WHEN n_nationkey % 5 = 0 THEN 'confirmed' ELSE 'public' END AS status FROM nation),
rt AS (SELECT *, o || ' -> ' || coalesce(v, 'direct') || ' -> ' || coalesce(dst, CASE WHEN n % 8 = 0 THEN 'home' END, 'world market') AS lane FROM ln),
tc AS (SELECT n, concept, min(pos) AS pos FROM (SELECT n, o AS concept, 0 AS pos FROM ln WHERE role <> 'export' UNION ALL SELECT n, v, CASE WHEN role = 'export' THEN 0 ELSE 1 END FROM ln WHERE v IS NOT NULL UNION ALL SELECT n, dst, 2 FROM ln WHERE dst IS NOT NULL) GROUP BY ALL),
x AS (SELECT e.incident, e.date, CASE WHEN d IN ('disrupted', 'down') THEN 'impaired' WHEN d IN ('restored', 'up') THEN 'eased' ELSE 'unclear' END AS state, rt.*, tc.pos FROM e JOIN tc USING (concept) JOIN rt USING (n)),
a AS (SELECT incident, date, CASE WHEN state = 'unclear' THEN 'unclear' WHEN (role = 'competitor') = (state = 'eased') THEN 'headwind' ELSE 'tailwind' END AS effect, role AS link, item, (CAST(n AS VARCHAR), pos, date) AS ord,
  CASE WHEN state = 'unclear' THEN 'direction of the effect unclear' WHEN role = 'supply' AND state = 'impaired' THEN 'less ' || item || ' reaching us from ' || o || ': availability risk and a higher ' || item || ' cost'
    WHEN role = 'supply' THEN item || ' supply from ' || o || ' back to normal: lower cost pressure' WHEN role = 'export' AND state = 'impaired' THEN 'us ' || item || ' shipments to ' || coalesce(dst, '') || ' delayed or costlier (freight, longer route, duties)'
    WHEN role = 'export' THEN 'us ' || item || ' shipments to ' || coalesce(dst, '') || ' easier' WHEN state = 'impaired' THEN 'less competing ' || item || ' from ' || o || ' on the market: support for the price us gets'
    ELSE 'more competing ' || item || ' from ' || o || ': pressure on the price us gets' END AS why, lane, status FROM x
  UNION ALL SELECT incident, date, CASE WHEN d IN ('up', 'disrupted') THEN 'headwind' WHEN d IN ('down', 'restored') THEN 'tailwind' ELSE 'unclear' END AS ef, 'input market', concept, ('', 0, date),
    concept || ' market ' || CASE ef WHEN 'headwind' THEN 'tighter or dearer' WHEN 'tailwind' THEN 'easier or cheaper' ELSE 'moved' END || ': us buys it', NULL, 'graph' FROM e WHERE concept = 'c3'
  UNION ALL SELECT incident, date, CASE d WHEN 'up' THEN 'tailwind' WHEN 'down' THEN 'headwind' ELSE 'unclear' END, 'product market', concept, ('', 0, date), concept || ' market ' || CASE d WHEN 'up' THEN 'price up' WHEN 'down' THEN 'price down' ELSE d END || ': us sells it', NULL, 'graph' FROM e WHERE concept = 'c4'
  UNION ALL SELECT incident, date, CASE WHEN d IN ('disrupted', 'down') THEN 'headwind' WHEN d IN ('restored', 'up') THEN 'tailwind' ELSE 'unclear' END, 'own site', concept, ('', 0, date), 'event at us site ' || concept || ': production of what it makes may be affected', NULL, 'graph' FROM e WHERE concept = 'c5'),
p AS (SELECT effect, link, item, incident, arg_min(date, ord) AS date FROM a GROUP BY ALL),
q AS (SELECT effect, link, item, count(*) AS incidents, min(date) AS first_date, max(date) AS last_date FROM p GROUP BY ALL)
SELECT q.*, (SELECT string_agg(DISTINCT why, '; ' ORDER BY why) FROM a WHERE (a.effect, a.link, a.item) = (q.effect, q.link, q.item)) AS why, coalesce((SELECT string_agg(DISTINCT lane, '; ' ORDER BY lane) FROM a WHERE (a.effect, a.link, a.item) = (q.effect, q.link, q.item)), '') AS lanes,
  (SELECT CASE WHEN bool_and(status = 'public') THEN 'public knowledge, not confirmed' ELSE string_agg(DISTINCT status, '; ' ORDER BY status) END FROM a WHERE (a.effect, a.link, a.item) = (q.effect, q.link, q.item)) AS lane_status FROM q""",
    "e2_merged_events": """
WITH r AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, 'c' || (user_id % 7) AS concept, event_type AS direction, CASE WHEN value > 10 THEN 'price' ELSE 'supply' END AS channel, event_id // 3 AS article_id FROM events),
i AS (SELECT event_id, 'i' || (event_id // 20) AS incident, strftime(min(ts) OVER (PARTITION BY event_id // 20), '%Y-%m-%d') AS incident_date FROM events WHERE event_id % 9 > 0),
b AS (SELECT r.* EXCLUDE (date), coalesce(incident, CAST(event_id AS VARCHAR)) AS incident, coalesce(incident_date, date) AS date FROM r LEFT JOIN i USING (event_id)),
d AS (SELECT incident, concept, direction, row_number() OVER (PARTITION BY incident, concept ORDER BY count(*) DESC, min(event_id)) AS nth FROM b GROUP BY incident, concept, direction),
c AS (SELECT incident, concept, channel, row_number() OVER (PARTITION BY incident, concept ORDER BY count(*) DESC, min(event_id)) AS nth FROM b GROUP BY incident, concept, channel)
SELECT incident, concept, arg_min(date, event_id) AS date, d.direction, c.channel, array_to_string(list_slice(list_sort(list(DISTINCT article_id)), 1, 3), ',') AS article_ids
FROM b JOIN d USING (incident, concept) JOIN c USING (incident, concept) WHERE d.nth = 1 AND c.nth = 1 GROUP BY incident, concept, d.direction, c.channel""",
    "e6_site_effects": """
SELECT effect, 's' || k AS site, product, incidents FROM (SELECT CASE direction WHEN 'click' THEN 'headwind' WHEN 'view' THEN 'tailwind' ELSE 'unclear' END AS effect, k, count(DISTINCT incident) AS incidents FROM (
  SELECT event_type AS direction, user_id % 25 AS k, event_id // 5 AS incident FROM events) GROUP BY ALL) JOIN (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS product FROM customer) USING (k)""",
    "e7_reached_products": """
WITH RECURSIVE made AS (SELECT DISTINCT p_partkey AS product, p_partkey // 2 AS input FROM part WHERE p_partkey > 0), up AS (SELECT input AS item, product FROM made UNION SELECT up.item, m.product FROM up JOIN made m ON m.input = up.product)
SELECT item, product FROM (SELECT p_partkey AS item, p_partkey AS product FROM part WHERE p_size > 25 UNION SELECT item, product FROM up WHERE item IN (SELECT p_partkey FROM part WHERE p_size > 25)) WHERE product % 10 = 0""",
    "e11_scoped_links": _TOUCH_SQL + """, q AS (SELECT 'item ' || n_regionkey AS item, 'prod ' || (n_nationkey % 4) AS product FROM nation WHERE n_nationkey % 2 = 0 GROUP BY ALL)
SELECT effect, role, item, incidents, reached FROM (SELECT effect, role, item, count(*) AS incidents FROM f GROUP BY ALL) JOIN (SELECT item, string_agg(product, ',' ORDER BY product) AS reached FROM q GROUP BY 1) USING (item) WHERE contains(reached, 'prod 2')""",
    "e11_untouched_items": """
SELECT DISTINCT 'p' || p_partkey AS item FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) AND p_partkey NOT IN (SELECT p_partkey + 1 FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 48)""",
    "e11_lane_status": """SELECT s_nationkey AS item, CASE WHEN bool_and(s_suppkey % 4 > 0) THEN 'public knowledge, not confirmed' WHEN bool_and(s_suppkey % 4 = 0) THEN 'confirmed' ELSE 'confirmed,public' END AS lane_status FROM supplier GROUP BY 1""",
    "e12_lane_snapshot": """SELECT o_orderkey AS lane_id, coalesce((SELECT string_agg('r' || l_suppkey, ' -> ' ORDER BY l_linenumber, 'r' || l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30), 'direct') AS via FROM orders""",
    "e10_monthly_prices": f"""
WITH p AS (SELECT *, strftime(date, '%Y-%m') AS month FROM ({ASSESSMENTS_SQL}) WHERE date BETWEEN '1997-02-01' AND '1997-09-30'),
r AS (SELECT product, location, incoterm, count(*) AS n, count(DISTINCT month) AS months FROM p GROUP BY ALL),
b AS (SELECT *, (location = 'ASIA' AND incoterm = 'A' AND product <> 'PROMO' OR location = 'MOON') AND months >= 2 AS good FROM r),
c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY product ORDER BY good DESC, n DESC, location, incoterm) = 1)
SELECT product AS concept, month, floor(avg(mid) * 100 + 0.5) / 100 AS mean, CASE WHEN good THEN 'configured' ELSE 'most quoted' END AS source FROM p JOIN c USING (product, location, incoterm) GROUP BY ALL""",
    "e5_market_effects": """
SELECT CASE WHEN role = 'bought' AND d IN (0, 2) THEN 'headwind' WHEN role = 'bought' AND d IN (1, 3) THEN 'tailwind' WHEN role = 'sold' AND d = 0 THEN 'tailwind' WHEN role = 'sold' AND d = 1 THEN 'headwind' ELSE 'unclear' END AS effect,
  role, item, count(DISTINCT incident) AS incidents FROM (SELECT CASE WHEN l_returnflag = 'A' THEN 'bought' ELSE 'sold' END AS role, l_returnflag AS item, l_orderkey AS incident, l_linenumber % 5 AS d
FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')) GROUP BY ALL""",
    "a2_number_grounding": f"""
WITH a AS (SELECT * FROM ({_NUMBERS}1) WHERE n >= 10 AND NOT n BETWEEN 1990 AND 2100), e AS ({_NUMBERS}0),
c AS (SELECT answer_id, count(*) AS n_checked, count(*) FILTER (NOT EXISTS (
  SELECT 1 FROM e WHERE e.answer_id = a.answer_id AND abs(a.n - e.n) <= 0.01 * greatest(e.n, 1))) AS n_unsupported FROM a GROUP BY 1)
SELECT answer_id, coalesce(n_checked, 0) AS n_checked, coalesce(n_unsupported, 0) AS n_unsupported
FROM (SELECT DISTINCT doc_id // 2 AS answer_id FROM documents WHERE doc_id % 2 = 1) LEFT JOIN c USING (answer_id)""",
    "n3_quotes_found": f"""
SELECT article_id, 0 AS item, q <> '' AND contains({_SQUASHED.format('text')}, q) AS found FROM (
  SELECT doc_id AS article_id, text, {_SQUASHED.format("split_part(text, '.', 1) || CASE WHEN doc_id % 3 = 0 THEN chr(8258) ELSE '' END")} AS q FROM documents)""",
    "v2_snapshot_diff": """
SELECT p_partkey, CASE WHEN p_partkey % 11 = 1 THEN 'added' WHEN p_partkey % 13 = 1 THEN 'removed' ELSE 'changed' END AS change FROM part
WHERE (p_partkey % 11 = 1) <> (p_partkey % 13 = 1) OR (p_partkey % 11 <> 1 AND p_partkey % 13 <> 1 AND p_partkey % 17 = 0)""",
    "k7_remaining_cargo": """
SELECT *, CAST(sum(amount) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, amount ROWS UNBOUNDED PRECEDING) AS BIGINT) AS remaining FROM (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 100 * CAST(l_quantity AS BIGINT) ELSE -CAST(l_quantity AS BIGINT) END AS amount FROM lineitem)""",
    "r1_entity_features": _FEATURES_SQL,
    "r6_site_assets": f"""
SELECT country, count(*) AS records, CAST(sum(metrics) AS BIGINT) AS metrics,
  (SELECT string_agg(DISTINCT p_type, ',' ORDER BY p_type) FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
   JOIN nation ON s_nationkey = n_nationkey WHERE n_name = f.country) AS products
FROM ({_FEATURES_SQL}) f GROUP BY country""",
}
