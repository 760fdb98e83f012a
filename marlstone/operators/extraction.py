"""Items that were extracted from articles: unnested, held against their article, resolved, counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from marlstone.functions.lineage import cut
from marlstone.operators.audits import squashed
from marlstone.operators.series import upper_medians

ROUTE = ["product", "location", "incoterm"]


def unnested(records: DataFrame, kind: str) -> DataFrame:
    """One row an item of the records of a kind ("prices" or "events"): id (article, letter, place), article_id, date and the item's fields."""
    field, letter = {"prices": ("assessments", "p"), "events": ("events", "e")}[kind]
    rows = records.filter(F.col("kind") == kind).select("article_id", F.col("date").alias("published"), F.posexplode(f"output.{field}").alias("pos", "item"))
    return rows.select(F.concat(F.col("article_id").cast("string"), F.lit(f"-{letter}"), F.col("pos").cast("string")).alias("id"), "article_id", "published", "item.*")


def quoted(items: DataFrame, articles: DataFrame) -> DataFrame:
    """items with quote_ok: the quote is not empty and stands in the article, white space and case aside. An article's text is folded once."""
    texts = articles.select("article_id", squashed(F.col("text")).alias("text_"))
    quote = squashed(F.col("quote"))
    return items.join(texts, "article_id", "left").withColumn("quote_ok", (quote != "") & F.coalesce(F.contains("text_", quote), F.lit(False))).drop("text_")


def number_in(value: Column, quote: Column) -> Column:
    """Whether a number's whole part stands in the quote, commas aside."""
    return F.contains(F.replace(quote, F.lit(","), F.lit("")), F.floor(value).cast("bigint").cast("string"))


def priced(items: DataFrame) -> DataFrame:
    """quoted() assessments with price_ok (numbers there, in order, above zero and in the quote) and verified."""
    ok = (F.col("low") > 0) & (F.col("low") <= F.col("high")) & number_in(F.col("low"), F.col("quote")) & number_in(F.col("high"), F.col("quote"))
    return items.withColumn("price_ok", F.coalesce(ok, F.lit(False))).withColumn("verified", F.col("quote_ok") & F.col("price_ok"))


def guarded(prices: DataFrame) -> DataFrame:
    """Verified assessments with mid and outlier: farther than twice from the upper median of their route, names in any case."""
    named = prices.withColumns({"mid": (F.col("low") + F.col("high")) / 2, **{f"r_{c}": F.lower(c) if c != "incoterm" else F.col(c) for c in ROUTE}})
    medians = upper_medians(named.select(*[F.col(f"r_{c}").alias(c) for c in ROUTE], "mid")).select(*[F.col(c).alias(f"r_{c}") for c in ROUTE], "median")
    both = named.join(medians, [f"r_{c}" for c in ROUTE])
    ratio = F.col("mid") / F.col("median")
    return both.withColumn("outlier", (ratio < 0.5) | (ratio > 2.0)).drop(*[f"r_{c}" for c in ROUTE], "median")


def dated(events: DataFrame) -> DataFrame:
    """Events whose date, if it is none of the calendar, is their article's."""
    real = F.when(F.regexp_like("date", F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.col("date").try_cast("date"))
    return events.withColumn("date", F.coalesce(F.date_format(real, "yyyy-MM-dd"), F.col("published")))


def resolved(items: DataFrame, terms: DataFrame, *columns: str) -> DataFrame:
    """items with a concept for each text column, by the trimmed text in any case; of a term's concepts the least. Terms are unique afterwards."""
    one = terms.groupBy(F.lower("term").alias("term_")).agg(F.min("concept_id").alias("found_"))
    for c in columns:
        items = items.withColumn("term_", F.lower(F.btrim(c))).join(one, "term_", "left").withColumnRenamed("found_", f"{c}_concept").drop("term_")
    return items


def accounting(prices: DataFrame, events: DataFrame) -> DataFrame:
    """kind, n_items, n_rejected and n_outliers; prices: verified and outlier, events: verified."""
    both = prices.select(F.lit("prices").alias("kind"), "verified", "outlier").unionByName(events.select(F.lit("events").alias("kind"), "verified", F.lit(False).alias("outlier")))
    return both.groupBy("kind").agg(
        F.count("*").alias("n_items"), F.count_if(~F.col("verified")).alias("n_rejected"), F.count_if(F.coalesce("outlier", F.lit(False))).alias("n_outliers"))


def accounted(prices: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The verified prices, with their outliers marked, the verified events, and accounting() of both: all is counted while the verified items are written.

    prices and events have verified. Each is gone through once; outliers need a route's median, and so a pass over the verified prices.
    """
    told, tables = {"prices": Observation("prices"), "events": Observation("events")}, {}
    for kind, items in (("prices", prices), ("events", events)):
        counts = [F.count(F.lit(1)).alias("n_items"), F.count_if(~F.col("verified")).alias("n_rejected")]
        tables[kind] = cut(items.observe(told[kind], *counts).filter("verified"))
    outliers = Observation("outliers")
    marked = cut(guarded(tables["prices"]).observe(outliers, F.count_if("outlier").alias("n_outliers")))
    rows = [(kind, told[kind].get["n_items"], told[kind].get["n_rejected"], outliers.get["n_outliers"] if kind == "prices" else 0) for kind in told]
    counted = prices.sparkSession.createDataFrame(rows, "kind string, n_items long, n_rejected long, n_outliers long")
    return marked, tables["events"], counted


def timeline(events: DataFrame, concepts: list[str], until: str) -> DataFrame:
    """Incidents that touch any of some concepts until a date: reports, the five least articles and the first event's quote.

    events: incident, date, event_id, article_id, concept, quote.
    """
    hit = events.filter(F.col("concept").isin(concepts) & (F.col("date") <= until))
    return hit.groupBy("incident").agg(
        F.min("date").alias("date"), F.count_distinct("event_id").alias("reports"), F.min_by("quote", "event_id").alias("quote"),
        F.array_join(F.slice(F.array_sort(F.collect_set("article_id")), 1, 5).cast("array<string>"), ",").alias("articles"))


def listed(prices: DataFrame, product: str, first: str, last: str) -> DataFrame:
    """A product's assessments of a period with their quotes."""
    return prices.filter((F.col("product") == product) & F.col("date").between(first, last)).select(
        "date", "location", "incoterm", "low", "high", ((F.col("low") + F.col("high")) / 2).alias("mid"), "quote")


def cited(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answer_id, n_known, n_cited, ok: where the evidence names articles (numbers of six digits or more), the answer must name one of them."""
    ids = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(\d{6,})\b"), F.lit(1)))
    known = evidence.select("answer_id", F.explode(ids).alias("article")).distinct()
    named = answers.select("answer_id", F.explode(ids).alias("article")).distinct().withColumn("cited", F.lit(1))
    found = known.join(named, ["answer_id", "article"], "left").groupBy("answer_id").agg(F.count("*").alias("n_known"), F.count("cited").alias("n_cited"))
    out = answers.select("answer_id").distinct().join(found, "answer_id", "left").na.fill(0, ["n_known", "n_cited"])
    return out.withColumn("ok", (F.col("n_known") == 0) | (F.col("n_cited") > 0))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("nth_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("nth_ = 1").drop("nth_")
