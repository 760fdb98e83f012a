"""Queries on extracted items. An order is an article of price assessments (a line each), three events are one of events; some items are made false."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.lineage import cut, shared_path
from marlstone.operators import cleaning, extraction, filters
from marlstone.sources import stores
from marlstone.sources.tables import table

#: Events count as such if they have one of these types.
EVENT_TYPES = ["click", "purchase", "signup", "error"]
FIRST_EVENT_ARTICLE = 10_000_000


def _day(column: str):
    return F.date_format(column, "yyyy-MM-dd")


def _price_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as an array in order, with what they say and which of them are made false."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    high = F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("bigint")
    low = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * (1 - F.col("l_discount"))).cast("bigint")
    said = F.concat_ws("", "p_type", F.lit(" at "), low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" USD/t"))
    return line.groupBy(F.col("l_orderkey").alias("article_id")).agg(F.min(_day("l_shipdate")).alias("date"), F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("p_type").alias("product"), F.col("l_returnflag").alias("incoterm"),
        F.concat(F.lit("R"), (F.col("l_suppkey") % 5).cast("string")).alias("location"), low.alias("lo"), high.alias("hi"), said.alias("said"),
        ((F.col("l_orderkey") + F.col("l_linenumber")) % 11).alias("k")))).alias("lines"))


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat_ws(" by ", "event_type", F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").groupBy((F.floor(F.col("event_id") / 3).cast("bigint") + FIRST_EVENT_ARTICLE).alias("article_id")).agg(
        F.min(_day("ts")).alias("date"), F.array_sort(F.collect_list(F.struct(
            "event_id", F.col("event_type").alias("type"), _day("ts").alias("day"), "user_id", said.alias("said")))).alias("lines"))


Lines = tuple[DataFrame, DataFrame]


def _lines(spark: SparkSession, sf_dir: str) -> Lines:
    return _price_lines(spark, sf_dir), _event_lines(spark, sf_dir)


def _articles(lines: Lines) -> DataFrame:
    told = lambda df, sep: df.select("article_id", "date", F.array_join(F.transform("lines", lambda x: x["said"]), sep).alias("text"))
    return told(lines[0], ".\n").unionByName(told(lines[1], "; "))


def _records(spark: SparkSession, sf_dir: str, lines: Lines | None = None) -> DataFrame:
    price_lines, event_lines = lines or _lines(spark, sf_dir)

    def assessment(x):
        quote = F.when(x["k"] == 1, F.concat(x["said"], F.lit(" today"))).when(x["k"] == 2, "").when(
            x["k"] == 3, F.concat(F.lit("  "), F.upper(x["said"]))).otherwise(x["said"])
        low = F.when(x["k"] == 4, x["hi"] + 1).when(x["k"] != 5, x["lo"]).cast("double")
        high = F.when(x["k"] == 6, x["hi"] + 1_000_000).otherwise(x["hi"]).cast("double")
        return F.struct(x["product"].alias("product"), x["location"].alias("location"), x["incoterm"].alias("incoterm"), low.alias("low"), high.alias("high"), quote.alias("quote"))

    def event(x):
        date = F.when(x["event_id"] % 5 == 0, "2026-02-29").when(x["event_id"] % 5 == 1, "soon").when(x["event_id"] % 5 > 2, x["day"])
        affects = F.array(F.struct(F.concat(F.lit(" C"), (x["user_id"] % 4).cast("string")).alias("term"), F.lit("up").alias("direction"), F.lit("price").alias("channel")))
        return F.struct(x["type"].alias("type"), date.alias("date"), F.concat(F.lit("user "), x["user_id"].cast("string")).alias("summary"),
                        F.when(x["event_id"] % 7 == 0, "nothing").otherwise(x["said"]).alias("quote"), affects.alias("affects"))

    none_p, none_e = F.array().cast(f"array<{stores.ASSESSMENT}>"), F.array().cast(f"array<{stores.EVENT}>")
    prices = price_lines.select(F.lit("prices").alias("kind"), "article_id", "date", F.struct(
        F.transform("lines", assessment).alias("assessments"), none_e.alias("events")).alias("output"))
    events = event_lines.select(F.lit("events").alias("kind"), "article_id", "date", F.struct(
        none_p.alias("assessments"), F.transform("lines", event).alias("events")).alias("output"))
    return prices.unionByName(events)


def _prices(spark: SparkSession, sf_dir: str, lines: Lines | None = None) -> DataFrame:
    """The lines, which records and articles both tell, are put together once."""
    lines = lines or (cut(_price_lines(spark, sf_dir)), _event_lines(spark, sf_dir))
    return extraction.priced(extraction.quoted(extraction.unnested(_records(spark, sf_dir, lines), "prices"), _articles(lines)))


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    # medians and rows both come from them
    return extraction.guarded(cut(_prices(spark, sf_dir).filter("verified").select("id", *extraction.ROUTE, "low", "high")))


def n2_unnested_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.unnested(_records(spark, sf_dir), "prices")


def n4_price_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prices(spark, sf_dir).select("id", "quote_ok", "price_ok", "verified")


def n5_outlier_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guarded(spark, sf_dir).select("id", "mid", "outlier")


def n6_event_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.dated(extraction.unnested(_records(spark, sf_dir), "events")).select("id", "date", "type")


def n7_resolved_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by their types in lower case (two concepts for some), locations by R0 to R3."""
    part = table(spark, sf_dir, "part").select(F.lower("p_type").alias("term"), F.concat_ws("_", F.lit("product"), F.length("p_type").cast("string"), F.lower("p_type")).alias("concept_id"))
    more = table(spark, sf_dir, "part").filter("p_size > 40").select(F.col("p_type").alias("term"), F.lit("product_big").alias("concept_id"))
    places = table(spark, sf_dir, "region").filter("r_regionkey < 4").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("term"), F.lower("r_name").alias("concept_id"))
    terms = part.unionByName(more).unionByName(places).distinct()
    return extraction.resolved(extraction.unnested(_records(spark, sf_dir), "prices"), terms, "product", "location").select("id", "product_concept", "location_concept")


def n9_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tuple(map(cut, _lines(spark, sf_dir)))
    events = extraction.quoted(extraction.unnested(_records(spark, sf_dir, lines), "events"), _articles(lines))
    return extraction.accounted(_prices(spark, sf_dir, lines), events.withColumn("verified", F.col("quote_ok")))[2]


def n11_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.concat_ws(" ", "event_type", _day("ts")).alias("incident"), _day("ts").alias("date"), "event_id", F.floor(F.col("event_id") / 3).cast("bigint").alias("article_id"),
        F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string")).alias("concept"), F.col("props").alias("quote"))
    return extraction.timeline(events, ["c1", "c4"], "2024-01-20")


def n14_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _prices(spark, sf_dir).filter("verified").withColumnRenamed("published", "date")
    return extraction.listed(prices, "LARGE", "1997-01-01", "1999-06-30")


def s2_extraction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records written as JSON lines and read with their schema."""
    path = shared_path(spark, "records")
    _records(spark, sf_dir).write.json(path)
    events = extraction.unnested(stores.extraction_records(spark, path), "events")
    return events.select("id", "published", "type", "date", "quote", F.col("affects")[0]["term"].alias("term"))


def s4_diagnosis_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation as a reviewed diagnosis, a document a file; its suppliers by balance are the ranking."""
    suppliers = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(
        F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(F.col("s_acctbal").alias("score"), F.col("s_name").alias("id"))))), 1, 3).alias("ranking"))
    docs = suppliers.select(
        F.concat(F.lit("d"), F.col("s_nationkey")).alias("name"), F.lit("reviewed").alias("status"), F.lit("margin").alias("metric"), F.lit("p").alias("product"),
        F.concat(F.lit("2024-"), F.lpad((F.col("s_nationkey") % 12 + 1).cast("string"), 2, "0")).alias("period"),
        F.transform("ranking", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("ranking"), F.col("ranking")[0]["id"].alias("top1"))
    path = shared_path(spark, "diagnoses")
    # one file a document: as many partitions as documents, which people review one by one
    docs.select("name", F.to_json(F.struct("*")).alias("value")).write.partitionBy("name").text(path)
    found = stores.diagnosis_documents(spark, path + "/*/*.txt")
    return found.select("name", "period", "top1", F.size("ranking").cast("bigint").alias("n_ranked"))


def s5_config_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route aliases as configuration, joined with orders by priority."""
    config = stores.config_table(spark, [("1-URGENT", "fast"), ("2-HIGH", "fast"), ("5-LOW", "slow")], "o_orderpriority string, lane string")
    return table(spark, sf_dir, "orders").join(config, "o_orderpriority", "left").groupBy(F.coalesce("lane", F.lit("none")).alias("lane")).agg(F.count("*").alias("n"))


def s6_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines by flag, then flag R again with other values: R is replaced, the others stay."""
    path = shared_path(spark, "layer")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    stores.reloaded(lines, path, "l_returnflag")
    stores.reloaded(lines.filter("l_returnflag = 'R'").withColumn("n", -F.col("n")), path, "l_returnflag")
    return stores.reloaded(lines.filter("l_returnflag = 'R'").withColumn("n", -F.col("n")), path, "l_returnflag")


def s6_stored_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer of all lines by flag, replaced by none, and by those of flag R: how many rows each version has."""
    layer = stores.Layer(spark, shared_path(spark, "stored-layer"))
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey")
    for condition in ("true", "false", "l_returnflag = 'R'"):
        layer.replace(lines.filter(condition))
    found = [layer.read(v).groupBy("l_returnflag").agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), "l_returnflag", "n") for v in layer.versions()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def s7_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types by size in a stored layer; sizes that are there stay as they are."""
    part = table(spark, sf_dir, "part").select(F.col("p_size").cast("bigint").alias("size"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    layer = stores.Layer(spark, shared_path(spark, "types"))
    layer.replace(part.filter("size % 3 = 0").groupBy("size", "brand").agg(F.max("type").alias("type")))
    return layer.upsert(part.filter("size % 2 = 0"), ["size", "brand"])


def s8_partitioned_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("file"), F.col("l_linestatus").alias("sheet"), F.col("l_orderkey").alias("row"), "l_extendedprice",
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("cell"))
    return stores.partitioned(facts, shared_path(spark, "facts"), "file", "sheet").filter("file = 'A' and row % 3 = 0").select("file", "sheet", "cell")


def f1_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = filters.as_of(table(spark, sf_dir, "lineitem"), "1998-05-17", "l_shipdate")
    return seen.groupBy("l_returnflag").agg(F.count("*").alias("n"), _max_day("l_shipdate").alias("last"))


def _max_day(column: str):
    return F.date_format(F.max(column), "yyyy-MM-dd")


def f2_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("d", F.to_date("l_shipdate"))
    one = filters.between(lines, "1997-02-03", "1997-03-05", "d").withColumn("w", F.lit("days"))
    two = filters.in_months(lines, ["1996-12", "1999-02"], "d").withColumn("w", F.lit("months"))
    return one.unionByName(two).groupBy("w", "l_returnflag").agg(F.count("*").alias("n"), _max_day("d").alias("last"))


def f3_targeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "documents").select("doc_id", F.expr("date_add(date'2024-01-01', cast(doc_id % 365 as int))").alias("date"), F.concat(F.lit("News: "), F.substring("text", 1, 60)).alias("headline"), "text")
    return filters.targeted(articles, "2024-03-01", "News", "th[ea]").select("doc_id")


def f4_named_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    return names.filter(filters.named_like(F.col("name"), "r"))


def f5_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _odd_cells(spark, sf_dir)
    return cells.select("id", filters.is_missing(F.col("v_str"), F.col("v_num"), ["NM", "n/a", 9999.0, 0.0]).alias("missing"))


def _odd_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 7
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(k == 0, " nm ").when(k == 1, "N/A").when(k == 2, "  ").when(k == 3, F.col("p_name")).alias("v_str"),
        F.when(k == 4, 9999.0).when(k == 5, 0.0).when(k == 6, F.col("p_size").cast("double")).alias("v_num"),
        F.when(F.col("p_size") % 3 == 0, 'mmm-yy " F "').when(F.col("p_size") % 3 == 1, "mmm-yy").alias("fmt"))


_CELLS_SQL = """(SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN ' nm ' WHEN 1 THEN 'N/A' WHEN 2 THEN '  ' WHEN 3 THEN p_name END AS v_str,
  CASE p_partkey % 7 WHEN 4 THEN 9999.0 WHEN 5 THEN 0.0 WHEN 6 THEN p_size END AS v_num, CASE p_size % 3 WHEN 0 THEN 'mmm-yy " F "' WHEN 1 THEN 'mmm-yy' END AS fmt FROM part)"""


def f6_actual_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odd_cells(spark, sf_dir).filter(filters.actual_only(F.col("fmt"))).select("id", "fmt")


def f7_skipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("labels"), "p_size")
    return rows.filter(~filters.skipped(F.col("labels"), F.col("p_size"), ["RING", "red"], [7, 11])).select("p_partkey")


def f8_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.capped(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice").desc(), "o_orderkey")


def a3_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's first turn is the evidence, with an article in most; its other turns answer, some with that article."""
    turns = table(spark, sf_dir, "conversations")
    number = (F.col("conv_id") + 100_000).cast("string")
    evidence = turns.filter("turn = 0 and conv_id % 5 > 0").select(F.col("conv_id").alias("answer_id"), F.concat(F.col("text"), F.lit(" article "), number).alias("text"))
    answers = turns.filter("turn > 0").select(F.col("conv_id").alias("answer_id"), F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("see "), number)).otherwise(F.col("text")).alias("text"))
    return extraction.cited(answers, evidence)


def k1_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names as companies; nations and regions known, one nation as a vessel too."""
    nation, region, customer = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    aliases = nation.select(F.lower("n_name").alias("alias"), F.lit("country").alias("kind"), F.concat(F.lit("country_"), F.col("n_nationkey")).alias("canonical")).unionByName(
        region.select(F.col("r_name").alias("alias"), F.lit("region").alias("kind"), F.concat(F.lit("region_"), F.col("r_regionkey")).alias("canonical"))).unionByName(
        nation.filter("n_nationkey < 9").select(F.col("n_name").alias("alias"), F.lit("vessel").alias("kind"), F.lit("ship").alias("canonical"))).unionByName(
        customer.filter("c_custkey % 4 = 0").select(F.col("c_name").alias("alias"), F.lit("company").alias("kind"), F.col("c_mktsegment").alias("canonical")))
    names = customer.select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" NATION_"), F.col("c_nationkey"))).otherwise(F.col("c_name")).alias("name"), "c_custkey")
    return cleaning.places(names, aliases)


def k2_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "nation").filter("n_nationkey % 7 > 0").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("country"), F.col("r_name").alias("region"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("country"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("sheet_region"))
    return cleaning.regions(rows, known).select("c_custkey", "region")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    return table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, F.concat(F.lit("Total "), F.col("p_name"))).when(k == 1, F.concat(F.col("p_name"), F.lit(" Subtotal "))).when(
        k == 2, "OTHERS").when(k == 3, F.concat(F.col("p_name"), F.lit(" totally"))).when(k == 4, F.col("p_name")).alias("label"))


def k3_aggregate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("p_partkey", cleaning.is_aggregate(F.col("label")).alias("aggregate"))


def k4_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy(cleaning.scenario(F.year("l_shipdate"), F.year("o_orderdate")).alias("scenario"), cleaning.scenario(F.year("l_shipdate"), F.year("o_orderdate"), False).alias("strict")).agg(F.count("*").alias("n"))


def k5_freight_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    often = F.element_at(F.array(*map(F.lit, (" | Weekly", "|monthly ", "", " | Yearly", " / spot"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    header = F.when(F.col("s_suppkey") % 11 == 0, F.col("s_name")).otherwise(F.concat(F.lit("Port "), F.col("s_nationkey"), F.lit(" TO "), F.col("s_name"), often))
    return table(spark, sf_dir, "supplier").select("s_suppkey", cleaning.freight(header).alias("f")).select("s_suppkey", "f.*")


def k6_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = F.element_at(F.array(*map(F.lit, (" 15-15-15", " 10:26:26", "", " 5-x-5"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.initcap("p_name"), grade).alias("product"))
    aliases = table(spark, sf_dir, "part").filter("p_name like 'red%'").select(F.upper("p_name").alias("alias"), F.concat_ws("_", F.lit("red"), F.substring_index("p_name", " ", -1)).alias("canonical"))
    return cleaning.products(rows, aliases)


def k8_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.upper(F.date_format(d, "d MMM yyyy"))).when(
        k == 3, F.date_format(d, "yyyyMMdd")).when(k == 4, " TBC ").otherwise("31/02/2020")
    return table(spark, sf_dir, "orders").select("o_orderkey", cleaning.clean_date(text, ["tbc", "n/a"]).alias("date"))


QUERIES = {
    f.__name__: f
    for f in (
        n2_unnested_items, n4_price_validation, n5_outlier_items, n6_event_dates, n7_resolved_items, n9_accounting, n11_timeline, n14_assessments,
        s2_extraction_records, s4_diagnosis_documents, s5_config_tables, s6_reload, s6_stored_layer, s7_upsert, s8_partitioned_facts,
        f1_as_of, f2_windows, f3_targeted, f4_named_like, f5_missing, f6_actual_only, f7_skipped_rows, f8_capped,
        a3_citations, k1_places, k2_regions, k3_aggregate_rows, k4_scenarios, k5_freight_headers, k6_products, k8_dates)
}

_ITEMS = """
ex AS (SELECT l_orderkey AS article_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
    min(strftime(l_shipdate, '%Y-%m-%d')) OVER (PARTITION BY l_orderkey) AS published, p_type AS product, 'R' || (l_suppkey % 5) AS location, l_returnflag AS incoterm,
    CAST(floor(l_extendedprice / l_quantity * (1 - l_discount)) AS BIGINT) AS lo, CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS hi, (l_orderkey + l_linenumber) % 11 AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey),
said AS (SELECT *, product || ' at ' || lo || '-' || hi || ' USD/t' AS said FROM ex),
items AS (SELECT article_id || '-p' || pos AS id, article_id, published, product, location, incoterm, CAST(CASE k WHEN 4 THEN hi + 1 WHEN 5 THEN NULL ELSE lo END AS DOUBLE) AS low,
    CAST(CASE k WHEN 6 THEN hi + 1000000 ELSE hi END AS DOUBLE) AS high,
    CASE k WHEN 1 THEN said || ' today' WHEN 2 THEN '' WHEN 3 THEN '  ' || upper(said) ELSE said END AS quote, k,
    k NOT IN (1, 2) AS quote_ok, k NOT IN (2, 4, 5, 6) AS price_ok
  FROM said),
good AS (SELECT *, (low + high) / 2 AS mid FROM items WHERE quote_ok AND price_ok),
guard AS (SELECT *, mid / list_sort(list(mid) OVER (PARTITION BY product, location, incoterm))[count(*) OVER (PARTITION BY product, location, incoterm) // 2 + 1] AS ratio FROM good)"""
_EVENT_ITEMS = """
evs AS (SELECT event_id // 3 + 10000000 AS article_id, row_number() OVER (PARTITION BY event_id // 3 ORDER BY event_id) - 1 AS pos,
    min(strftime(ts, '%Y-%m-%d')) OVER (PARTITION BY event_id // 3) AS published, strftime(ts, '%Y-%m-%d') AS day, * FROM events),
ei AS (SELECT article_id || '-e' || pos AS id, published, event_type AS type, CASE event_id % 5 WHEN 0 THEN '2026-02-29' WHEN 1 THEN 'soon' WHEN 2 THEN NULL ELSE day END AS date, day, event_id,
    CASE WHEN event_id % 7 = 0 THEN 'nothing' ELSE event_type || ' by ' || user_id END AS quote, ' C' || (user_id % 4) AS term FROM evs)"""

ORACLE_SQL = {
    "n2_unnested_items": f"WITH {_ITEMS} SELECT id, article_id, published, product, location, incoterm, low, high, quote FROM items",
    "n4_price_validation": f"WITH {_ITEMS} SELECT id, quote_ok, price_ok, quote_ok AND price_ok AS verified FROM items",
    "n5_outlier_items": f"WITH {_ITEMS} SELECT id, mid, ratio < 0.5 OR ratio > 2.0 AS outlier FROM guard",
    "n6_event_dates": f"WITH {_EVENT_ITEMS} SELECT id, type, CASE WHEN event_id % 5 > 2 THEN day ELSE published END AS date FROM ei",
    "n7_resolved_items": f"""WITH {_ITEMS}, t AS (SELECT upper(p_type) AS term, min(c) AS concept FROM (SELECT p_type, 'product_' || length(p_type) || '_' || lower(p_type) AS c FROM part
    UNION SELECT p_type, 'product_big' FROM part WHERE p_size > 40) GROUP BY 1), r AS (SELECT 'R' || r_regionkey AS term, lower(r_name) AS concept FROM region WHERE r_regionkey < 4)
  SELECT id, t.concept AS product_concept, r.concept AS location_concept FROM items LEFT JOIN t ON upper(product) = t.term LEFT JOIN r ON location = r.term""",
    "n9_accounting": f"""WITH {_ITEMS}, {_EVENT_ITEMS} SELECT 'prices' AS kind, (SELECT count(*) FROM items) AS n_items, (SELECT count(*) FROM items WHERE NOT (quote_ok AND price_ok)) AS n_rejected,
    (SELECT count(*) FROM guard WHERE ratio < 0.5 OR ratio > 2.0) AS n_outliers UNION ALL SELECT 'events', count(*), count(*) FILTER (quote = 'nothing'), 0 FROM ei""",
    "n11_timeline": """WITH e AS (SELECT event_type || ' ' || strftime(ts, '%Y-%m-%d') AS incident, strftime(ts, '%Y-%m-%d') AS date, event_id, event_id // 3 AS article_id, props FROM events WHERE user_id % 10 IN (1, 4))
  SELECT incident, min(date) AS date, count(*) AS reports, arg_min(props, event_id) AS quote, array_to_string(list_slice(list_sort(list(DISTINCT article_id)), 1, 5), ',') AS articles
  FROM e WHERE date <= '2024-01-20' GROUP BY incident""",
    "n14_assessments": f"""WITH {_ITEMS} SELECT published AS date, location, incoterm, low, high, mid, quote FROM good WHERE product = 'LARGE' AND published BETWEEN '1997-01-01' AND '1999-06-30'""",
    "s2_extraction_records": f"WITH {_EVENT_ITEMS} SELECT id, published, type, date, quote, term FROM ei",
    "s4_diagnosis_documents": """SELECT 'd' || s_nationkey AS name, '2024-' || lpad(CAST(s_nationkey % 12 + 1 AS VARCHAR), 2, '0') AS period, arg_max(s_name, (s_acctbal, s_name)) AS top1, least(count(*), 3) AS n_ranked
  FROM supplier GROUP BY s_nationkey""",
    "s5_config_tables": """SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' WHEN o_orderpriority = '5-LOW' THEN 'slow' ELSE 'none' END AS lane, count(*) AS n FROM orders GROUP BY 1""",
    "s6_reload": "SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag = 'R' THEN -c ELSE c END AS n FROM (SELECT l_returnflag, l_linestatus, count(*) AS c FROM lineitem GROUP BY ALL)",
    "s6_stored_layer": """SELECT v.version, l_returnflag, count(*) AS n FROM lineitem, (VALUES (1), (3)) v(version) WHERE version = 1 OR l_returnflag = 'R' GROUP BY ALL""",
    "s7_upsert": """WITH o AS (SELECT p_size AS size, p_brand AS brand, max(p_type) AS type FROM part WHERE p_size % 3 = 0 GROUP BY ALL)
  SELECT * FROM o UNION ALL SELECT p_size, p_brand, min(p_type) FROM part WHERE p_size % 2 = 0 AND (p_size, p_brand) NOT IN (SELECT (size, brand) FROM o) GROUP BY 1, 2""".replace("p_size AS size", "CAST(p_size AS BIGINT) AS size"),
    "s8_partitioned_facts": "SELECT l_returnflag AS file, l_linestatus AS sheet, l_orderkey || '-' || l_linenumber AS cell FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey % 3 = 0",
    "f1_as_of": "SELECT l_returnflag, count(*) AS n, strftime(max(l_shipdate), '%Y-%m-%d') AS last FROM lineitem WHERE l_shipdate <= '1998-05-17' GROUP BY 1",
    "f2_windows": """SELECT w, l_returnflag, count(*) AS n, strftime(max(d), '%Y-%m-%d') AS last FROM (
  SELECT 'days' AS w, l_returnflag, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN '1997-02-03' AND '1997-03-05'
  UNION ALL SELECT 'months', l_returnflag, CAST(l_shipdate AS DATE) FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') IN ('1996-12', '1999-02')) GROUP BY ALL""",
    "f3_targeted": """SELECT doc_id FROM documents WHERE doc_id % 365 >= 60 AND regexp_matches(substr(text, 1, 60), '(?i)th[ea]') AND regexp_matches(text, '(?i)th[ea]')""",
    "f4_named_like": "SELECT p_partkey, replace(p_name, ' ', '_') AS name FROM part WHERE p_name LIKE 'r%' OR p_name LIKE '% r%'",
    "f5_missing": "SELECT id, id % 7 NOT IN (3, 6) AS missing FROM part, " + _CELLS_SQL + " WHERE p_partkey = id",
    "f6_actual_only": f"SELECT id, fmt FROM {_CELLS_SQL} WHERE fmt IS NULL OR fmt = 'mmm-yy'",
    "f7_skipped_rows": "SELECT p_partkey FROM part WHERE NOT contains(p_name, 'ring') AND NOT contains(p_name, 'red') AND p_size NOT IN (7, 11)",
    "f8_capped": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
    "a3_citations": """WITH e AS (SELECT DISTINCT conv_id AS answer_id, unnest(regexp_extract_all(text || ' article ' || (conv_id + 100000), '\\b([0-9]{6,})\\b', 1)) AS a FROM conversations WHERE turn = 0 AND conv_id % 5 > 0),
  n AS (SELECT DISTINCT conv_id AS answer_id, unnest(regexp_extract_all(CASE WHEN conv_id % 3 = 0 THEN 'see ' || (conv_id + 100000) ELSE text END, '\\b([0-9]{6,})\\b', 1)) AS a FROM conversations WHERE turn > 0),
  k AS (SELECT e.answer_id, count(*) AS n_known, count(n.a) AS n_cited FROM e LEFT JOIN n ON e.answer_id = n.answer_id AND e.a = n.a GROUP BY 1)
  SELECT answer_id, coalesce(n_known, 0) AS n_known, coalesce(n_cited, 0) AS n_cited, coalesce(n_known, 0) = 0 OR n_cited > 0 AS ok
  FROM (SELECT DISTINCT conv_id AS answer_id FROM conversations WHERE turn > 0) LEFT JOIN k USING (answer_id)""",
    "k1_places": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ' NATION_' || c_nationkey ELSE c_name END AS name,
  CASE WHEN c_custkey % 3 = 0 THEN 'country' WHEN c_custkey % 4 = 0 THEN 'company' ELSE 'other' END AS kind,
  CASE WHEN c_custkey % 3 = 0 THEN 'country_' || c_nationkey WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS canonical FROM customer""",
    "k2_regions": """SELECT c_custkey, coalesce(CASE WHEN c_nationkey % 7 > 0 THEN r_name END, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'unknown_region') AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "k3_aggregate_rows": "SELECT p_partkey, p_partkey % 6 < 3 AS aggregate FROM part",
    "k4_scenarios": """SELECT CASE WHEN s >= p THEN 'forecast' ELSE 'release' END AS scenario, CASE WHEN s > p THEN 'forecast' ELSE 'release' END AS strict, count(*) AS n
  FROM (SELECT year(l_shipdate) AS s, year(o_orderdate) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY ALL""",
    "k5_freight_headers": """SELECT s_suppkey, CASE WHEN s_suppkey % 11 > 0 THEN 'Port ' || s_nationkey END AS origin,
  CASE WHEN s_suppkey % 11 > 0 THEN s_name || CASE WHEN s_suppkey % 5 = 4 THEN ' / spot' ELSE '' END END AS destination,
  CASE WHEN s_suppkey % 11 > 0 THEN CASE s_suppkey % 5 WHEN 0 THEN 'weekly' WHEN 1 THEN 'monthly' END END AS frequency FROM supplier""",
    "k6_products": """SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ([' 15-15-15', ' 10:26:26', '', ' 5-x-5'])[p_partkey % 4 + 1] AS product,
  CASE WHEN p_partkey % 4 < 3 AND p_name LIKE 'red%' THEN 'red_' || split_part(p_name, ' ', 2) ELSE p_name || CASE WHEN p_partkey % 4 = 3 THEN ' 5-x-5' ELSE '' END END AS canonical,
  CAST(CASE p_partkey % 4 WHEN 0 THEN 15 WHEN 1 THEN 10 END AS INT) AS n, CAST(CASE p_partkey % 4 WHEN 0 THEN 15 WHEN 1 THEN 26 END AS INT) AS p, CAST(CASE p_partkey % 4 WHEN 0 THEN 15 WHEN 1 THEN 26 END AS INT) AS k FROM part""",
    "k8_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN CAST(o_orderdate AS DATE) END AS date FROM orders",
}
