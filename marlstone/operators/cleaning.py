"""Cleaning rules for places, periods, scenarios, products and dates of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of places, the first that knows a name wins.
PLACE_ORDER = ["company", "country", "region", "city", "vessel", "hub"]
#: Words of aggregate rows, and how often a freight line is quoted.
AGGREGATES = ["total", "subtotal", "world", "others"]
FREQUENCIES = {"w": "weekly", "m": "monthly", "q": "quarterly", "a": "annual"}
DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "d MMM yyyy", "yyyyMMdd"]


def places(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, kind and canonical of each name: by the alias (alias, kind, canonical) of the first kind in order; else other."""
    rank = F.array_position(F.array(*map(F.lit, PLACE_ORDER)), F.col("kind"))
    known = aliases.groupBy(F.lower(F.btrim("alias")).alias("key_")).agg(F.min_by(F.struct("kind", "canonical"), F.struct(rank, "canonical")).alias("hit_"))
    return names.withColumn("key_", F.lower(F.btrim("name"))).join(known, "key_", "left").select(
        *names.columns, F.coalesce("hit_.kind", F.lit("other")).alias("kind"), F.col("hit_.canonical").alias("canonical"))


def regions(rows: DataFrame, country_regions: DataFrame) -> DataFrame:
    """rows (country, sheet_region) with a region that is never null."""
    return rows.join(country_regions, "country", "left").withColumn("region", F.coalesce("region", "sheet_region", F.lit("unknown_region")))


def is_aggregate(label: Column) -> Column:
    """Whether a label has a word of aggregates, or its last word is a total."""
    words = F.split(F.lower(F.btrim(label)), r"\s+")
    return F.coalesce(F.arrays_overlap(words, F.array(*map(F.lit, AGGREGATES))) | F.endswith(F.element_at(words, -1), F.lit("total")), F.lit(False))


def scenario(year: Column, published: Column, same_year_is_forecast: bool = True) -> Column:
    ahead = year >= published if same_year_is_forecast else year > published
    return F.when(year.isNull() | published.isNull(), None).when(ahead, "forecast").otherwise("release")


def freight(header: Column) -> Column:
    """struct(origin, destination, frequency) of "Origin to Destination | Frequency"; null fields where the form is another."""
    form = r"(?i)^\s*(.+?)\s+to\s+(.+?)\s*(?:\|\s*(\w)\w*\s*)?$"
    part = lambda k: F.nullif(F.regexp_extract(header, form, k), F.lit(""))
    often = F.create_map(*[F.lit(x) for kv in FREQUENCIES.items() for x in kv])
    return F.struct(part(1).alias("origin"), part(2).alias("destination"), F.try_element_at(often, F.lower(part(3))).alias("frequency"))


def grade(product: Column) -> Column:
    """struct(n, p, k): the N-P-K grade in a product's name, in percent."""
    form = r"(\d{1,2})[-:](\d{1,2})[-:](\d{1,2})"
    part = lambda k: F.nullif(F.regexp_extract(product, form, k), F.lit("")).cast("int")
    return F.struct(part(1).alias("n"), part(2).alias("p"), part(3).alias("k"))


def products(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows (product) with canonical (by alias, else the trimmed lower-case name) and the grade's n, p and k."""
    one = aliases.groupBy(F.lower(F.btrim("alias")).alias("key_")).agg(F.min("canonical").alias("canonical"))
    bare = F.btrim(F.regexp_replace(F.lower("product"), r"\s*\d{1,2}[-:]\d{1,2}[-:]\d{1,2}\s*", " "))
    return rows.withColumn("key_", bare).join(one, "key_", "left").withColumn("canonical", F.coalesce("canonical", "key_")).select(
        *rows.columns, "canonical", *[grade(F.col("product"))[x].alias(x) for x in "npk"])


def clean_date(text: Column, markers: list[str]) -> Column:
    """A date in one of the known forms; text markers and other texts are null."""
    t = F.btrim(text)
    found = F.coalesce(*[F.try_to_date(F.initcap(t) if "MMM" in f else t, f) for f in DATE_FORMATS])
    return F.when(~F.lower(t).isin([m.lower() for m in markers]), found)
