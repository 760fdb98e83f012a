"""Cell grids of messy sheets to long facts with provenance, and checks of them.

Cells are rows of (sheet, row, col, v_str, v_num, fmt), counted from 0; a blank cell is absent or has nulls.
Each window holds one sheet (or one of its rows), so sheets are dealt over tasks.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Month names of period labels.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
FORECAST = r'(?i)"\s*f\s*"'


def period(label: Column) -> Column:
    """First month (yyyy-MM) of a year, quarter or month label; null for other texts."""
    t = F.lower(F.btrim(label))

    def year(digits: Column) -> Column:
        n = digits.cast("int")
        return F.when(F.length(digits) == 4, n).when(n >= 69, 1900 + n).otherwise(2000 + n)

    def made(y: Column, m: Column) -> Column:
        return F.format_string("%04d-%02d", y, m)

    a, b = r"^([1-4])q(\d{2}|\d{4})$", r"^q([1-4])\s*(\d{4})$"
    quarter_year = F.regexp_extract(t, a, 2)
    quarter_year = F.when(F.length(quarter_year) == 2, F.concat(F.lit("20"), quarter_year)).otherwise(quarter_year)
    c = r"^([a-z]{3})[- ](\d{2}|\d{4})$"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(t, c, 1)).cast("int")
    return (
        F.when(t.rlike(r"^\d{4}$"), F.when(t.try_cast("int").between(1990, 2100), made(t.try_cast("int"), F.lit(1))))
        .when(t.rlike(a), made(quarter_year.try_cast("int"), 3 * F.regexp_extract(t, a, 1).try_cast("int") - 2))
        .when(t.rlike(b), made(F.regexp_extract(t, b, 2).try_cast("int"), 3 * F.regexp_extract(t, b, 1).try_cast("int") - 2))
        .when(t.rlike(c) & (month > 0), made(year(F.regexp_extract(t, c, 2)), month)))


def a1(row: Column, col: Column) -> Column:
    """A cell's name; columns of one, two or three letters."""
    def letter(n: Column) -> Column:
        return F.char(65 + n)

    two, three = F.floor(col / 26) - 1, F.floor((col - 26) / 676) - 1
    name = F.when(col < 26, letter(col)).when(col < 702, F.concat(letter(two), letter(col % 26))).otherwise(
        F.concat(letter(three), letter(F.floor((col - 26) / 26) % 26), letter(col % 26)))
    return F.concat(name, (row + 1).cast("string"))


def cell_text(text: Column, number: Column) -> Column:
    """What a cell says: its text, or its number, whole ones without a point; null for blanks."""
    number = number.cast("double")
    said = F.when(number == F.floor(number), F.format_string("%.0f", number)).otherwise(number.cast("string"))
    return F.coalesce(F.nullif(F.btrim(text), F.lit("")), F.when(~F.isnan(number), said))


def headers(cells: DataFrame, n_rows: int) -> DataFrame:
    """sheet, col, header: the first rows, numbers as they read, blanks filled from the left, joined from top to bottom."""
    so_far = Window.partitionBy("sheet", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    filled = cells.filter((F.col("row") < n_rows) & (F.col("col") > 0)).withColumn("v", F.last(cell_text(F.col("v_str"), F.col("v_num")), ignorenulls=True).over(so_far))
    parts = filled.filter("v is not null").groupBy("sheet", "col").agg(F.array_sort(F.collect_list(F.struct("row", "v"))).alias("p"))
    return parts.select("sheet", "col", F.array_join(F.transform("p", lambda x: x["v"]), " | ").alias("header"))


def labelled_rows(cells: DataFrame, n_rows: int, marker: str) -> DataFrame:
    """sheet, row, label, fmt, section: rows under the header; a section is the latest label that fits the marker."""
    so_far = Window.partitionBy("sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    labels = cells.filter((F.col("row") >= n_rows) & (F.col("col") == 0)).select("sheet", "row", cell_text(F.col("v_str"), F.col("v_num")).alias("label"), "fmt")
    is_marker = F.col("label").rlike(marker)
    return (labels.withColumn("section", F.last(F.when(is_marker, F.col("label")), ignorenulls=True).over(so_far))
            .filter(F.coalesce(~is_marker, F.lit(True))))


def facts(cells: DataFrame, n_rows: int, marker: str) -> DataFrame:
    """One row a numeric cell: sheet, row, col, section, label, header, value, status and the cell's name."""
    values = cells.filter((F.col("row") >= n_rows) & (F.col("col") > 0) & F.col("v_num").isNotNull()).select("sheet", "row", "col", "v_num")
    both = values.join(labelled_rows(cells, n_rows, marker), ["sheet", "row"]).join(headers(cells, n_rows), ["sheet", "col"], "left")
    return both.select(
        "sheet", "row", "col", "section", "label", "header", F.col("v_num").alias("value"),
        F.when(F.col("fmt").rlike(FORECAST), "forecast").otherwise("actual").alias("status"), a1(F.col("row"), F.col("col")).alias("cell"))


def value_check(cells: DataFrame, n_rows: int) -> DataFrame:
    """sheet, n_numeric, n_other, ok: some numbers, and one text in ten value cells at most."""
    body = cells.filter((F.col("row") >= n_rows) & (F.col("col") > 0) & (F.col("v_num").isNotNull() | F.col("v_str").isNotNull()))
    counted = body.groupBy("sheet").agg(F.count("v_num").alias("n_numeric"), F.count_if(F.col("v_num").isNull()).alias("n_other"))
    return counted.withColumn("ok", (F.col("n_numeric") > 0) & (10 * F.col("n_other") <= F.col("n_numeric") + F.col("n_other")))


def period_order(cells: DataFrame, n_rows: int, marker: str) -> DataFrame:
    """sheet, n_periods, n_violations, ok: rows whose period is before the one above (rows without one left out)."""
    rows = labelled_rows(cells, n_rows, marker).withColumn("p", period(F.col("label"))).filter("p is not null")
    rows = rows.withColumn("above", F.lag("p").over(Window.partitionBy("sheet").orderBy("row")))
    counted = rows.groupBy("sheet").agg(F.count("*").alias("n_periods"), F.count_if(F.col("p") < F.col("above")).alias("n_violations"))
    return counted.withColumn("ok", F.col("n_violations") == 0)


def header_order(cells: DataFrame, n_rows: int) -> DataFrame:
    """sheet, n_periods, n_violations, ok: columns whose period, in the last header row, is before the one to the left (columns without one left out)."""
    heads = cells.filter((F.col("row") == n_rows - 1) & (F.col("col") > 0)).select("sheet", "col", period(F.col("v_str")).alias("p")).filter("p is not null")
    heads = heads.withColumn("left_", F.lag("p").over(Window.partitionBy("sheet").orderBy("col")))
    counted = heads.groupBy("sheet").agg(F.count("*").alias("n_periods"), F.count_if(F.col("p") < F.col("left_")).alias("n_violations"))
    return counted.withColumn("ok", F.col("n_violations") == 0)


def total_rows(found: DataFrame) -> DataFrame:
    """sheet, section, row, label of rows that equal the sum of their section's other rows in every column, within 1 %."""
    sums = found.groupBy("sheet", "section", "col").agg(F.sum("value").alias("s"))
    rest = F.col("s") - F.col("value")
    near = F.abs(F.col("value") - rest) * 100 <= F.greatest(F.abs("value"), F.abs(rest), F.lit(1))
    size = found.groupBy("sheet", "section").agg(F.count_distinct("row").alias("n_rows"))
    fits = found.join(sums, ["sheet", "section", "col"]).groupBy("sheet", "section", "row", "label").agg(
        F.bool_and(near).alias("fits"), F.count_if(F.col("value") != 0).alias("n_values"))
    return fits.join(size, ["sheet", "section"]).filter("fits and n_values >= 2 and n_rows > 2").select("sheet", "section", "row", "label")


def located(cells: DataFrame, anchors: DataFrame, reach: int = 60) -> DataFrame:
    """anchors (sheet, col, row, text) -> sheet, offset: how far the nearest cell with the text lies, of those above or at most reach below; null without one."""
    spots = cells.filter("v_str is not null").select("sheet", "col", F.col("row").alias("at"), F.lower(F.btrim("v_str")).alias("text"))
    wanted = anchors.select("sheet", "col", F.col("row").alias("from"), F.lower(F.btrim("text")).alias("text"))
    offset = F.col("at") - F.col("from")
    both = wanted.join(spots, ["sheet", "col", "text"], "left").withColumn("offset", F.when(offset <= reach, offset))
    return both.groupBy("sheet").agg(F.min_by("offset", F.when(F.col("offset").isNotNull(), F.struct(F.abs("offset"), "at"))).alias("offset"))


def spec_problems(specs: DataFrame, units: list[str], operations: list[str]) -> DataFrame:
    """spec_id, problems of specifications (first_row, last_row, first_col, last_col, header_rows, label_columns, operators, value_unit, anchor_text)."""
    outside = lambda xs, lo, hi: F.exists(xs, lambda x: (x < F.col(lo)) | (x > F.col(hi)))
    rules = {
        "missing key": F.concat(*[F.when(F.col(c).isNull(), "x").otherwise("") for c in ("header_rows", "label_columns", "operators", "value_unit")]) != "",
        "unknown operator": F.size(F.array_except("operators", F.array(*map(F.lit, operations)))) > 0, "stack is not last": F.try_element_at("operators", F.lit(-1)) != "stack",
        "row outside": outside(F.col("header_rows"), "first_row", "last_row"), "column outside": outside(F.col("label_columns"), "first_col", "last_col"),
        "unknown unit": ~F.col("value_unit").isin(units), "anchor without text": F.btrim("anchor_text") == ""}
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))
    return specs.select("spec_id", F.array_join(found, ",").alias("problems"))


def filled_labels(cells: DataFrame, n_rows: int, n_labels: int, skipped: list[str]) -> DataFrame:
    """sheet, row, labels: the label columns of each row under the header, blanks filled from above, as one text. Rows one of whose labels, filled ones too, holds a
    skipped word do not come out, but are filled from. Cells are grouped to rows once, and all label columns filled in one order of a sheet's rows."""
    text = cell_text(F.col("v_str"), F.col("v_num"))
    own = [F.max(F.when(F.col("col") == k, text)).alias(f"own_{k}") for k in range(n_labels)]
    rows = cells.filter(F.col("row") >= n_rows).groupBy("sheet", "row").agg(*own)
    so_far = Window.partitionBy("sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    filled = [F.coalesce(F.last(f"own_{k}", ignorenulls=True).over(so_far), F.lit("")) for k in range(n_labels)]
    texts = rows.select("sheet", "row", F.array(*filled).alias("texts"))
    hit = F.lit(False)
    for w in skipped:
        hit = hit | F.contains(F.lower(F.array_join("texts", "\n")), F.lit(w.lower()))
    return texts.filter(~hit).select("sheet", "row", F.array_join("texts", " | ").alias("labels"))


def marked_facts(found: DataFrame, column_formats: DataFrame, published: str | None = None) -> DataFrame:
    """facts with status also from a column's format (sheet, col, fmt) and, with a date of publication (yyyy-MM), from later periods in the label or the header."""
    both = found.join(column_formats.select("sheet", "col", F.col("fmt").alias("fmt_")), ["sheet", "col"], "left")
    after = lambda text: F.coalesce(period(text) > published, F.lit(False))
    later = after(F.col("label")) | F.coalesce(F.exists(F.split("header", r" \| "), after), F.lit(False)) if published else F.lit(False)
    ahead = (F.col("status") == "forecast") | F.coalesce(F.col("fmt_").rlike(FORECAST), F.lit(False)) | later
    return both.withColumn("status", F.when(ahead, "forecast").otherwise("actual")).drop("fmt_")


def without_subtotals(found: DataFrame, terms: DataFrame, kinds: list[str]) -> DataFrame:
    """facts but those whose label names (term, kind) something of a skipped kind and no country."""
    held = terms.groupBy(F.lower("term").alias("key_")).agg(F.collect_set("kind").alias("k"))
    skip = held.filter(F.arrays_overlap("k", F.array(*map(F.lit, kinds))) & ~F.array_contains("k", "country")).select("key_")
    return found.withColumn("key_", F.lower("label")).join(skip, "key_", "left_anti").drop("key_")


def evidenced_units(texts: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """sheet, unit: units whose name or alias stands in the sheet's text as a token. aliases is a closed vocabulary."""
    text = F.lower("text")
    stands = lambda a: F.regexp_like(text, F.lit("(?<![a-z0-9])" + re.escape(a) + "(?![a-z0-9])"))
    hits = F.array_compact(F.array(*[F.when(stands(a), F.lit(u)) for a, u in sorted(aliases.items())]))
    return texts.select("sheet", F.explode(hits).alias("unit")).distinct()


def unit_check(specs: DataFrame, evidence: DataFrame, aliases: dict[str, str], better: dict[str, list[str]]) -> DataFrame:
    """sheet, unit, ok: a specification's unit (sheet, value_unit) is in the sheet's text, and none that is more specific."""
    of = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    unit = F.coalesce(F.try_element_at(of, F.lower(F.btrim("value_unit"))), F.lower(F.btrim("value_unit")))
    seen = evidence.groupBy("sheet").agg(F.collect_set("unit").alias("seen"))
    finer = F.create_map(*[x for u, more in better.items() for x in (F.lit(u), F.array(*map(F.lit, more)))])
    both = specs.withColumn("unit", unit).join(seen, "sheet", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    ok = F.array_contains("seen", F.col("unit")) & ~F.coalesce(F.arrays_overlap("seen", F.try_element_at(finer, F.col("unit"))), F.lit(False))
    return both.select("sheet", "unit", ok.alias("ok"))


def header_check(cells: DataFrame, n_rows: int) -> DataFrame:
    """sheet, n_cells, n_numbers, ok: one header cell in five at most is a number that is no year."""
    head = cells.filter((F.col("row") < n_rows) & (F.col("col") > 0) & (F.col("v_str").isNotNull() | F.col("v_num").isNotNull()))
    numbers = F.count_if(F.col("v_num").isNotNull() & ~F.col("v_num").between(1900, 2100))
    return head.groupBy("sheet").agg(F.count("*").alias("n_cells"), numbers.alias("n_numbers")).withColumn("ok", 5 * F.col("n_numbers") <= F.greatest("n_cells", F.lit(1)))


def label_check(cells: DataFrame, n_rows: int) -> DataFrame:
    """sheet, n_rows, n_empty, ok: one row with values in five at most has no label."""
    rows = cells.filter((F.col("row") >= n_rows) & (F.col("col") > 0) & F.col("v_num").isNotNull()).select("sheet", "row").distinct()
    named = cells.filter("col = 0").select("sheet", "row", F.col("v_str").alias("label"))
    both = rows.join(named, ["sheet", "row"], "left")
    empty = F.count_if(F.btrim(F.coalesce("label", F.lit(""))) == "")
    return both.groupBy("sheet").agg(F.count("*").alias("n_rows"), empty.alias("n_empty")).withColumn("ok", 5 * F.col("n_empty") <= F.col("n_rows"))


def section_check(found: DataFrame) -> DataFrame:
    """sheet, n_orphans, orphans (the first five cells by name), ok: all values stand under a section."""
    bare = F.when(F.col("section").isNull(), F.col("cell"))
    out = found.groupBy("sheet").agg(F.count(bare).alias("n_orphans"), F.array_join(F.slice(F.array_sort(F.collect_set(bare)), 1, 5), ",").alias("orphans"))
    return out.withColumn("ok", F.col("n_orphans") == 0)


def outside_check(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """sheet, below, right, ok: numbers in the three rows below a table (sheet, first_row, last_row, first_col, last_col), and in the two columns right of its first 21 rows."""
    near = cells.filter("v_num is not null").join(bounds, "sheet")
    below = (F.col("row") > F.col("last_row")) & (F.col("row") <= F.col("last_row") + 3) & F.col("col").between(F.col("first_col"), F.col("last_col"))
    right = (F.col("col") > F.col("last_col")) & (F.col("col") <= F.col("last_col") + 2) & F.col("row").between(F.col("first_row"), F.least(F.col("last_row"), F.col("first_row") + 20))
    out = near.groupBy("sheet").agg(F.count_if(below).alias("below"), F.count_if(right).alias("right"))
    return out.withColumn("ok", (F.col("below") == 0) & (F.col("right") == 0))


def corner_check(corners: DataFrame) -> DataFrame:
    """sheet, ok of corner cells "rows\\columns" (sheet, corner, row_dimension, column_dimension): five letters of each word are in the dimension's name."""
    word = lambda k: F.substring(F.lower(F.btrim(F.get(F.split("corner", r"\\", 2), F.lit(k)))), 1, 5)
    ok = F.contains(F.lower("row_dimension"), word(0)) & F.contains(F.lower("column_dimension"), word(1))
    return corners.filter(F.contains("corner", F.lit("\\"))).select("sheet", ok.alias("ok"))


def total_columns(found: DataFrame) -> DataFrame:
    """sheet, col of columns that equal the sum of the other columns in every row, within 1 %; three columns and two values at least."""
    row = found.groupBy("sheet", "row").agg(F.sum("value").alias("s"))
    size = found.groupBy("sheet").agg(F.count_distinct("col").alias("n_cols"), F.count_distinct("row").alias("n_rows"))
    rest = F.col("s") - F.col("value")
    near = F.abs(F.col("value") - rest) * 100 <= F.greatest(F.abs("value"), F.abs(rest), F.lit(1))
    gap = F.abs("s") * 100 <= F.greatest(F.abs("s"), F.lit(1))  # of rows where the column is blank: only a sum near zero fits
    blank = found.join(row, ["sheet", "row"])
    fits = blank.groupBy("sheet", "col").agg(F.bool_and(near).alias("fits"), F.count_if(F.col("value") != 0).alias("n_values"), F.count("*").alias("have"), F.count_if(gap).alias("near_zero"))
    zero = row.groupBy("sheet").agg(F.count_if(gap).alias("zero_rows"))
    both = fits.join(size, "sheet").join(zero, "sheet")
    return both.filter("fits and n_values >= 2 and n_cols > 2 and n_rows - have <= zero_rows - near_zero").select("sheet", "col")


def dropped_column_check(found: DataFrame, dropped: DataFrame) -> DataFrame:
    """sheet, col, ok of dropped columns (sheet, col): none of their values but zeros, or the sum of the other columns. found holds all columns of the kept rows."""
    real = found.filter("value <> 0").select("sheet", "col").distinct().withColumn("real", F.lit(True))
    totals = total_columns(found).withColumn("total", F.lit(True))
    both = dropped.join(real, ["sheet", "col"], "left").join(totals, ["sheet", "col"], "left")
    return both.select("sheet", "col", (F.col("real").isNull() | F.col("total").isNotNull()).alias("ok"))


def dropped_row_check(found: DataFrame, dropped: DataFrame) -> DataFrame:
    """sheet, row, ok of dropped rows' values (sheet, section, row, label, col, value): labelled total, or in every column the sum of its section's kept rows."""
    sums = found.groupBy("sheet", "section", "col").agg(F.sum("value").alias("s"))
    both = dropped.join(sums, ["sheet", "section", "col"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    near = F.abs(F.col("value") - F.col("s")) * 100 <= F.greatest(F.abs("value"), F.abs("s"), F.lit(1))
    named = F.bool_or(F.coalesce(F.contains(F.lower("label"), F.lit("total")), F.lit(False)))
    return both.groupBy("sheet", "row").agg((named | F.bool_and(near)).alias("ok"))


def subtotal_label_check(found: DataFrame, terms: DataFrame) -> DataFrame:
    """sheet, n_regions, n_countries, n_totals, ok: labels do not mix regions with countries (term, kind), and none says total."""
    held = terms.groupBy(F.lower("term").alias("key_")).agg(F.array_sort(F.collect_set("kind")).alias("k"))
    names = found.select("sheet", F.lower("label").alias("key_")).distinct().join(held, "key_", "left")
    out = names.groupBy("sheet").agg(
        F.count_if(F.col("k") == F.array(F.lit("region"))).alias("n_regions"), F.count_if(F.array_contains("k", "country")).alias("n_countries"), F.count_if(F.contains("key_", F.lit("total"))).alias("n_totals"))
    return out.withColumn("ok", ((F.col("n_regions") == 0) | (F.col("n_countries") == 0)) & (F.col("n_totals") == 0))


def latest_specs(specs: DataFrame) -> DataFrame:
    """The newest specification of each file and sheet, whatever its status; of equal times the last by name."""
    order = Window.partitionBy("file", "sheet").orderBy(F.col("at").desc(), F.col("name").desc())
    return specs.withColumn("nth_", F.row_number().over(order)).filter("nth_ = 1").drop("nth_")


def monthly_mid(cells: DataFrame, header: str, n_rows: int) -> DataFrame:
    """sheet, month, mid: the mean of the column under a header and the one right of it, of actual months; the last row of a month counts."""
    column = cells.filter((F.col("row") < n_rows) & (F.lower(F.btrim("v_str")) == header.lower())).groupBy("sheet").agg(F.min("col").alias("c"))
    dates = cells.filter((F.col("row") >= n_rows) & (F.col("col") == 0) & ~F.coalesce(F.col("fmt").rlike(FORECAST), F.lit(False))).select("sheet", "row", period(F.col("v_str")).alias("month")).filter("month is not null")
    both = cells.filter("v_num is not null").join(column, "sheet").filter((F.col("col") == F.col("c")) | (F.col("col") == F.col("c") + 1))
    per = both.groupBy("sheet", "row").agg(F.avg("v_num").alias("mid"), F.count("*").alias("n")).filter("n = 2").join(dates, ["sheet", "row"])
    return per.groupBy("sheet", "month").agg(F.max_by("mid", "row").alias("mid"))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """sheet, check, ok, status: all checks by name; a sheet is rejected when one of them fails."""
    rows = [df.select("sheet", F.lit(name).alias("check"), "ok") for name, df in checks.items()]
    every = F.bool_and("ok").over(Window.partitionBy("sheet"))
    return reduce(DataFrame.unionByName, rows).withColumn("status", F.when(every, "proposed").otherwise("rejected"))
