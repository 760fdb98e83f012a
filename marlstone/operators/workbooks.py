"""Sheets of workbooks: what their layout is, what they are about, which ones mention given concepts, where rules send them.

Cells are (sheet, row, col, v_str, v_num, formula), counted from 0.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.terms import occurrences

#: Rows looked at for the layout, and the fixed words of sheets' names that give their role.
SCAN_ROWS = 300
CONTENTS_WORDS, DASHBOARD_WORDS = ["contents", "index", "toc"], ["dashboard", "chart", "summary"]


def _filled(cells: DataFrame) -> DataFrame:
    return cells.filter((F.btrim(F.coalesce("v_str", F.lit(""))) != "") | F.col("v_num").isNotNull() | F.col("formula").isNotNull())


def is_time(text: Column, number: Column) -> Column:
    year = F.when(F.length(F.btrim(text)) <= 8, F.substring(F.btrim(text), 1, 4).try_cast("int"))
    return F.coalesce((number.between(1990, 2060) & (number == F.floor(number))) | year.between(1990, 2060), F.lit(False))


def profiles(cells: DataFrame) -> DataFrame:
    """sheet, header_row, header_depth, blocks, time_in_columns and title of each sheet, by its first SCAN_ROWS rows.

    The header is the first row of three filled cells or more, half of them text; it goes on while rows are half text. Blocks are
    runs of filled rows.
    """
    seen = _filled(cells).filter(F.col("row") < SCAN_ROWS)
    text = F.col("v_str").isNotNull() | F.col("formula").isNotNull()
    rows = seen.groupBy("sheet", "row").agg(F.count("*").alias("n"), F.count_if(text).alias("t"), F.count_if(is_time(F.col("v_str"), F.col("v_num"))).alias("times"),
                                            F.min_by(F.coalesce("v_str", "formula", F.col("v_num").cast("string")), "col").alias("first"))
    rows = rows.withColumn("texty", 2 * F.col("t") >= F.col("n"))
    head = F.min(F.when((F.col("n") >= 3) & F.col("texty"), F.col("row"))).over(Window.partitionBy("sheet"))
    order = Window.partitionBy("sheet").orderBy("row")
    rows = rows.withColumns({"head": head, "gap": F.col("row") - F.lag("row", 1, -1).over(order) > 1})
    # rows of the header's run: text rows without a gap from the header on
    broken = F.max(F.when((F.col("row") >= F.col("head")) & (~F.col("texty") | (F.col("gap") & (F.col("row") > F.col("head")))), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("in_head", (F.col("row") >= F.col("head")) & (broken == 0))
    first = F.min(F.when(F.col("row") < 5, F.col("row")))
    return rows.groupBy("sheet").agg(
        F.max("head").cast("bigint").alias("header_row"), F.count_if("in_head").alias("header_depth"),
        (F.count_if(F.col("gap") & (F.col("row") > 0)) + F.when(F.min("row") > 0, 0).otherwise(1)).alias("blocks"),
        F.coalesce(F.bool_or((F.col("row") == F.col("head")) & (F.col("times") >= 5)), F.lit(False)).alias("time_in_columns"),
        F.coalesce(F.substring(F.min_by(F.when(F.col("row") < 5, F.col("first")), F.when(F.col("row") < 5, F.col("row"))), 1, 120), F.lit("")).alias("title"), first.alias("first_")).drop("first_")


def sheet_lists(cells: DataFrame, profile: DataFrame) -> DataFrame:
    """sheet, preamble, header_cells, row_labels: the different texts above the header (the first 30 in order), in the first three of its rows (200), and in the
    first three columns below (300); texts are trimmed and cut at 60 characters, formulas are none. profile: sheet, header_row, header_depth (profiles()).
    """
    where = profile.select("sheet", F.coalesce("header_row", F.lit(0)).alias("head"), F.least(F.greatest("header_depth", F.lit(1)), F.lit(3)).alias("depth"))
    seen = cells.filter((F.col("row") < SCAN_ROWS) & F.col("formula").isNull() & (F.btrim(F.coalesce("v_str", F.lit(""))) != "") & ~F.startswith("v_str", F.lit("="))).join(where, "sheet")
    below = F.col("row") >= F.col("head") + F.col("depth")
    zone = F.when(F.col("row") < F.col("head"), "preamble").when(~below, "header_cells").when(F.col("col") < 3, "row_labels")
    texts = seen.select("sheet", zone.alias("zone"), F.substring(F.btrim("v_str"), 1, 60).alias("t")).filter("zone is not null").distinct()
    most = F.when(F.col("zone") == "preamble", 30).when(F.col("zone") == "header_cells", 200).otherwise(300)
    first = texts.withColumn("nth", F.row_number().over(Window.partitionBy("sheet", "zone").orderBy("t"))).filter(F.col("nth") <= most)
    told = lambda z: F.array_sort(F.collect_list(F.when(F.col("zone") == z, F.col("t")))).alias(z)
    found = first.groupBy("sheet").agg(*map(told, ("preamble", "header_cells", "row_labels")))
    none = F.array().cast("array<string>")
    return profile.select("sheet").join(found, "sheet", "left").select("sheet", *[F.coalesce(z, none).alias(z) for z in ("preamble", "header_cells", "row_labels")])


def formula_counts(cells: DataFrame) -> DataFrame:
    """sheet, formulas, total_rows: formulas of a whole sheet, and rows of formulas with "total" in their first four columns."""
    named = F.coalesce(F.contains(F.lower("v_str"), F.lit("total")), F.lit(False)) & (F.col("col") < 4)
    rows = cells.groupBy("sheet", "row").agg(F.count("formula").alias("f"), F.bool_or(named).alias("named"))
    return rows.groupBy("sheet").agg(F.sum("f").alias("formulas"), F.count_if((F.col("f") > 0) & F.col("named")).alias("total_rows"))


def role(name: Column, header_row: Column, formulas: Column) -> Column:
    """contents or dashboard by the sheet's name; without a header dashboard, if it has formulas, or other; else data."""
    says = lambda words: F.regexp_like(F.lower(name), F.lit("|".join(map(re.escape, words))))
    return (F.when(says(CONTENTS_WORDS), "contents").when(says(DASHBOARD_WORDS), "dashboard")
            .when(header_row.isNull(), F.when(formulas > 0, "dashboard").otherwise("other")).otherwise("data"))


def descriptions(contents: DataFrame, sheets: DataFrame, rows: int = 400) -> DataFrame:
    """sheet, description: texts beside a sheet's name in contents (row, col, v_str), any case; the last row that names it."""
    names = sheets.select(F.lower(F.btrim("sheet")).alias("key_"), "sheet").distinct()
    texts = contents.filter((F.col("row") < rows) & (F.btrim(F.coalesce("v_str", F.lit(""))) != "")).withColumn("key_", F.lower(F.btrim("v_str")))
    hits = texts.join(names, "key_").groupBy("row").agg(F.min_by("sheet", "col").alias("sheet"))
    others = texts.join(hits, "row").filter(F.col("key_") != F.lower(F.btrim("sheet")))
    told = others.groupBy("sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", F.btrim("v_str").alias("t")))).alias("p"))
    told = told.select("sheet", "row", F.substring(F.array_join(F.transform("p", lambda x: x["t"]), " | "), 1, 500).alias("d"))
    return hits.join(told, ["sheet", "row"], "left").groupBy("sheet").agg(F.max_by(F.coalesce("d", F.lit("")), "row").alias("description"))


def mentions(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """sheet, zone, concept_id, n of texts (sheet, zone, text): how often the concept's most frequent term stands there as a token, any case.

    Terms of three characters or more are looked up by their pieces; the texts of a sheet's zone are one text, a line each.
    """
    joined = texts.groupBy("sheet", "zone").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    named = terms.select(F.lower("term").alias("term"), "concept_id").distinct()
    counted = occurrences(joined, ["sheet", "zone"], terms).join(named, "term")
    return counted.groupBy("sheet", "zone", "concept_id").agg(F.max("n").alias("n"))


def mentioning(found: DataFrame, sheets: DataFrame, concepts: list[str]) -> DataFrame:
    """sheet, role, strength, place of the sheets (sheet, role) that mention all of some concepts: data sheets first, then by mentions."""
    per = found.filter(F.col("concept_id").isin(concepts)).groupBy("sheet").agg(F.count_distinct("concept_id").alias("k"), F.sum("n").alias("strength")).filter(F.col("k") == len(set(concepts)))
    both = per.join(sheets.select("sheet", "role"), "sheet").select("sheet", "role", "strength")
    order = [(F.col("role") == "data").desc(), F.col("strength").desc(), "sheet"]
    return both.orderBy(*order).limit(50).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))  # 50 rows


def routed(sheets: DataFrame, exact: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """file, sheet, code: where rules send sheets: by a whole name (name, code) in any case, or by patterns (code, of the sheet, of the file) from the beginning."""
    named = sheets.withColumn("key_", F.lower(F.btrim("sheet"))).join(exact.select(F.lower(F.btrim("name")).alias("key_"), "code"), "key_").select("file", "sheet", "code")
    fits = [F.when(F.regexp_like("sheet", F.lit(f"(?i)^(?:{s})")) & F.regexp_like("file", F.lit(f"(?i)^(?:{f})")), F.lit(code)) for code, s, f in patterns]
    by_form = sheets.select("file", "sheet", F.explode(F.array_compact(F.array(*fits))).alias("code"))
    return named.unionByName(by_form).distinct()
