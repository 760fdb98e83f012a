"""Specifications of tables replayed on cell grids: many sheets, each by its own specification, in one job.

Cells are (sheet, row, col, v_str, v_num, fmt), counted from 0. A specification is a row of

    spec_id, sheet, first_row, last_row, first_col, last_col, header_rows and label_columns (in their order), fill_header, fill_labels,
    drop_rows, drop_columns, skip_words, skip_kinds, subtitles (row, level, name), missing (markers), published (a date, or null), unit,
    anchor_row, anchor_col, anchor_text (null: none), row_dimensions, column_dimension, section_dimension, fixed (a map)

Joins are on the sheet and the specification; windows hold one specification's rows or one of its header rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.lineage import cut
from marlstone.operators.grids import (
    FORECAST, a1, cell_text, dropped_column_check, dropped_row_check, outside_check, period, subtotal_label_check, total_columns, total_rows)


def placed(specs: DataFrame, cells: DataFrame, reach: int = 60) -> DataFrame:
    """specs with offset, how far their anchor's text has moved in its column (the nearest cell at most reach rows below, the upper of two), and all rows moved by it.

    Without an anchor the offset is 0; where the text is gone it is null, as are the rows: such a specification yields nothing.
    """
    spots = cells.filter("v_str is not null").select("sheet", F.col("col").alias("anchor_col"), F.lower(F.btrim("v_str")).alias("said_"), F.col("row").alias("at_"))
    wanted = specs.filter("anchor_text is not null").select("spec_id", "sheet", "anchor_col", "anchor_row", F.lower(F.btrim("anchor_text")).alias("said_"))
    away = F.col("at_") - F.col("anchor_row")
    found = wanted.join(spots, ["sheet", "anchor_col", "said_"]).filter(away <= reach).groupBy("spec_id").agg(F.min_by(away, F.struct(F.abs(away), "at_")).alias("offset"))
    both = specs.join(found, "spec_id", "left").withColumn("offset", F.when(F.col("anchor_text").isNull(), 0).otherwise(F.col("offset")))
    moved = lambda c: F.transform(c, lambda r: r + F.col("offset"))
    return both.withColumns({
        **{c: F.col(c) + F.col("offset") for c in ("first_row", "last_row")}, **{c: moved(c) for c in ("header_rows", "drop_rows")},
        "subtitles": F.transform("subtitles", lambda s: F.struct((s["row"] + F.col("offset")).alias("row"), s["level"].alias("level"), s["name"].alias("name")))})


def _ahead(fmt: Column, text: Column, published: Column) -> Column:
    """Whether a cell speaks of a forecast: by its number format, or as a period that starts after the date of publication."""
    later = F.to_date(F.concat(period(text), F.lit("-01"))) > published
    return F.coalesce(fmt.rlike(FORECAST), F.lit(False)) | F.coalesce(later, F.lit(False))


def column_headers(inside: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_id, col, header, header_period, ahead: the header rows' cells from top to bottom, joined by " | "; with fill_header a blank takes the cell left of it.

    ahead: one of the column's own header cells speaks of a forecast. header_period: the first period that they name.
    """
    grid = specs.select("spec_id", "published", "fill_header", F.explode(F.sequence("first_col", "last_col")).alias("col"), "header_rows").select(
        "spec_id", "published", "fill_header", "col", F.posexplode("header_rows").alias("pos", "row"))
    grid = grid.join(inside.select("spec_id", "row", "col", "text", "fmt"), ["spec_id", "row", "col"], "left")
    left = Window.partitionBy("spec_id", "pos").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumns({"said": F.when(F.col("fill_header"), F.last("text", ignorenulls=True).over(left)).otherwise(F.col("text")), "ahead": _ahead(F.col("fmt"), F.col("text"), F.col("published"))})
    parts = F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("pos", "said"))))
    return grid.groupBy("spec_id", "col").agg(
        F.array_join(F.transform(parts, lambda p: p["said"]), " | ").alias("header"), F.min_by(period(F.col("text")), F.when(period(F.col("text")).isNotNull(), F.col("pos"))).alias("header_period"),
        F.bool_or("ahead").alias("ahead")).filter("header <> ''")


def row_labels(inside: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_id, row, labels (one a label column), sections, ahead of all rows but header and dropped ones.

    With fill_labels a blank label takes the last one above it in its column, whether or not that row is skipped later. sections: the names of the latest subtitles;
    one of a level ends those of lower levels.
    """
    rows = inside.select("spec_id", "row").distinct().join(
        specs.select("spec_id", "header_rows", "drop_rows", "label_columns", "fill_labels", "published", "subtitles"), "spec_id")
    rows = rows.filter(~F.array_contains("header_rows", F.col("row")) & ~F.array_contains("drop_rows", F.col("row")))
    each = rows.select("spec_id", "row", "fill_labels", "published", F.posexplode("label_columns").alias("pos", "col")).join(inside.select("spec_id", "row", "col", "text", "fmt"), ["spec_id", "row", "col"], "left")
    above = Window.partitionBy("spec_id", "pos").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    said = F.when(F.col("fill_labels"), F.last("text", ignorenulls=True).over(above)).otherwise(F.col("text"))
    each = each.withColumns({"said": F.coalesce(said, F.lit("")), "ahead": _ahead(F.col("fmt"), F.col("text"), F.col("published"))})
    named = each.groupBy("spec_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda p: p["said"]).alias("labels"), F.bool_or("ahead").alias("ahead"))
    seen = F.filter(F.array_sort("subtitles"), lambda s: s["row"] <= F.col("row"))
    none = F.array().cast("array<string>")
    under = F.aggregate(seen, none, lambda now, s: F.concat(F.slice(F.concat(now, F.array_repeat(F.lit(""), s["level"])), 1, s["level"]), F.array(s["name"])))
    return named.join(rows.select("spec_id", "row", under.alias("sections")), ["spec_id", "row"])


def inside_cells(cells: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_id, row, col, text, v_num, fmt, marked (a missing marker) of the cells in each specification's range."""
    bounds = specs.select("spec_id", "sheet", "first_row", "last_row", "first_col", "last_col", "missing")
    kept = cells.join(bounds, "sheet").filter(F.col("row").between(F.col("first_row"), F.col("last_row")) & F.col("col").between(F.col("first_col"), F.col("last_col")))
    text, number = F.lower(F.btrim("v_str")), F.col("v_num").cast("double")
    marked = F.exists("missing", lambda m: F.coalesce((F.lower(F.btrim(m)) == text) | (m.try_cast("double") == number), F.lit(False)))
    return kept.select("spec_id", "sheet", "row", "col", cell_text(F.col("v_str"), F.col("v_num")).alias("text"), number.alias("v_num"), "fmt", marked.alias("marked"))


def kept_rows(rows: DataFrame, specs: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """row_labels() with subtotal, without the rows whose label holds a skipped word, in any case. subtotal: the last label names (kinds: term, kind) something
    of a skipped kind and no country."""
    both = rows.join(specs.select("spec_id", "skip_words", "skip_kinds"), "spec_id")
    both = both.filter(~F.exists("labels", lambda x: F.exists("skip_words", lambda w: F.contains(F.lower(x), F.lower(w)))))
    if kinds is None:
        return both.withColumn("subtotal", F.lit(False)).drop("skip_words", "skip_kinds")
    held = kinds.groupBy(F.lower("term").alias("leaf_")).agg(F.collect_set("kind").alias("kinds_"))
    both = both.withColumn("leaf_", F.lower(F.element_at("labels", -1))).join(held, "leaf_", "left")
    skip = F.arrays_overlap("kinds_", "skip_kinds") & ~F.array_contains("kinds_", "country")
    return both.withColumn("subtotal", F.coalesce(skip, F.lit(False))).drop("leaf_", "kinds_", "skip_words", "skip_kinds")


def _of_columns(cells: DataFrame, heads: DataFrame, specs: DataFrame) -> DataFrame:
    """Cells (spec_id, col) in columns with a header that are no label columns, with header, head_ahead and dropped (the column is)."""
    both = cells.join(heads.select("spec_id", "col", "header", F.col("ahead").alias("head_ahead")), ["spec_id", "col"]).join(specs.select("spec_id", "label_columns", "drop_columns"), "spec_id")
    return both.filter(~F.array_contains("label_columns", F.col("col"))).withColumn("dropped", F.array_contains("drop_columns", F.col("col"))).drop("label_columns", "drop_columns")


def _section() -> Column:
    return F.array_join(F.filter("sections", lambda x: x != ""), " | ")


def replayed(cells: DataFrame, specs: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """spec_id, sheet, row, col, sections, labels, header, dims, value, unit, status, cell: a row for each number of each specification (placed).

    Skipped rows and subtotals go (kept_rows), columns without header, label columns and dropped ones, and missing markers. dims has the dimensions' names; status
    is forecast where the row's labels or the column's header cells speak of one.
    """
    specs = specs.filter("offset is not null")
    inside = inside_cells(cells, specs)
    rows = kept_rows(row_labels(inside, specs), specs, kinds).filter("not subtotal")
    values = inside.filter("v_num is not null and not marked").select("spec_id", "sheet", "row", "col", F.col("v_num").alias("value"))
    both = _of_columns(values, column_headers(inside, specs), specs).filter("not dropped").join(rows, ["spec_id", "row"])
    both = both.join(specs.select("spec_id", "unit", "row_dimensions", "column_dimension", "section_dimension", "fixed"), "spec_id")
    section = _section()
    dims = F.map_concat(
        "fixed", F.when(F.col("section_dimension").isNotNull(), F.create_map("section_dimension", section)).otherwise(F.create_map().cast("map<string,string>")),
        F.map_from_arrays("row_dimensions", "labels"), F.create_map("column_dimension", "header"))
    return both.select(
        "spec_id", "sheet", "row", "col", section.alias("sections"), "labels", "header", dims.alias("dims"), "value", "unit",
        F.when(F.col("ahead") | F.col("head_ahead"), "forecast").otherwise("actual").alias("status"), a1(F.col("row"), F.col("col")).alias("cell"))


def checked(cells: DataFrame, specs: DataFrame, kinds: DataFrame) -> DataFrame:
    """spec_id, check, ok, detail, status: every check of what each specification (placed) takes from its sheet; one failed check rejects it.

    A specification whose anchor is gone has the check "anchor" only.
    """
    lost = specs.filter("offset is null").select("spec_id", F.lit("anchor").alias("check"), F.lit(False).alias("ok"), F.col("anchor_text").alias("detail"))
    specs = specs.filter("offset is not null")
    inside = cut(inside_cells(cells, specs))
    heads, labels = cut(column_headers(inside, specs)), row_labels(inside, specs)
    rows = cut(kept_rows(labels, specs, kinds).withColumn("leaf", F.element_at("labels", -1)))
    filled = inside.filter("text is not null and not marked")
    body = cut(_of_columns(filled.select("spec_id", "row", "col", "v_num"), heads, specs).join(rows.select("spec_id", "row", "leaf", "subtotal", _section().alias("section")), ["spec_id", "row"]))
    taken = body.filter("not subtotal and not dropped")
    numbers = body.filter("v_num is not null").select(F.col("spec_id").alias("sheet"), "row", "col", "section", F.col("leaf").alias("label"), F.col("v_num").alias("value"), "subtotal", "dropped")
    # kept rows have a number in a kept column
    kept = numbers.filter("not subtotal and not dropped").select("sheet", "row").distinct()
    candidates = cut(numbers.filter("not subtotal").join(kept, ["sheet", "row"], "left_semi"))
    facts = candidates.filter("not dropped")

    counted = taken.groupBy("spec_id").agg(F.count("v_num").alias("n"), F.count_if(F.col("v_num").isNull()).alias("other"))
    values = specs.select("spec_id").join(counted, "spec_id", "left").na.fill(0, ["n", "other"]).select(
        "spec_id", F.lit("values_parse").alias("check"), ((F.col("n") > 0) & (10 * F.col("other") <= F.col("n") + F.col("other"))).alias("ok"), F.format_string("%d numbers, %d other", "n", "other").alias("detail"))
    top = _of_columns(inside.filter("text is not null"), heads, specs).filter("not dropped").join(specs.select("spec_id", "header_rows"), "spec_id").filter(F.array_contains("header_rows", F.col("row")))
    odd = F.col("v_num").isNotNull() & ~F.col("v_num").between(1900, 2100)
    header = top.groupBy("spec_id").agg(F.count("*").alias("n"), F.count_if(odd).alias("odd")).select(
        "spec_id", F.lit("header_is_text").alias("check"), (5 * F.col("odd") <= F.col("n")).alias("ok"), F.format_string("%d of %d are numbers", "odd", "n").alias("detail"))
    leaves = facts.select(F.col("sheet").alias("spec_id"), "row", "label").distinct()
    named = leaves.groupBy("spec_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "").alias("empty")).select(
        "spec_id", F.lit("labels_present").alias("check"), (5 * F.col("empty") <= F.col("n")).alias("ok"), F.format_string("%d of %d are empty", "empty", "n").alias("detail"))
    orphan = F.when(F.col("section") == "", a1(F.col("row"), F.col("col")))
    sections = facts.join(specs.filter("size(subtitles) > 0").select(F.col("spec_id").alias("sheet")), "sheet", "left_semi").groupBy(F.col("sheet").alias("spec_id")).agg(
        F.array_join(F.slice(F.array_sort(F.collect_set(orphan)), 1, 5), ",").alias("detail")).select("spec_id", F.lit("subtitle_covers_rows").alias("check"), (F.col("detail") == "").alias("ok"), "detail")
    bounds = specs.select("sheet", "first_row", "last_row", "first_col", "last_col", "spec_id")
    # a sheet may have several tables
    outside = outside_check(cells.join(bounds.select("sheet", "spec_id"), "sheet").drop("sheet").withColumnRenamed("spec_id", "sheet"), bounds.drop("sheet").withColumnRenamed("spec_id", "sheet"))
    whole = outside.select(F.col("sheet").alias("spec_id"), F.lit("covers_whole_table").alias("check"), "ok", F.format_string("%d below, %d right", "below", "right").alias("detail"))

    def ordered(df: DataFrame, name: str, at: str) -> DataFrame:
        lagged = df.filter("p is not null").withColumn("before", F.lag("p").over(Window.partitionBy("spec_id").orderBy(at)))
        bad = F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("p") < F.col("before"), F.struct(F.col(at).alias("at"), "p")))), lambda x: x["p"]), 1, 5), ",")
        return lagged.groupBy("spec_id").agg(bad.alias("detail")).select("spec_id", F.lit(name).alias("check"), (F.col("detail") == "").alias("ok"), "detail")

    columns = _of_columns(heads.select("spec_id", "col", F.col("header_period").alias("p")), heads, specs).filter("not dropped")
    in_order = [ordered(columns, "column_periods_in_order", "col"), ordered(leaves.withColumn("p", period(F.col("label"))), "row_periods_in_order", "row")]

    def none_of(df: DataFrame, name: str, said: Column) -> DataFrame:
        hit = df.groupBy(F.col("sheet").alias("spec_id")).agg(F.array_join(F.slice(F.array_sort(F.collect_set(said)), 1, 5), ",").alias("detail"))
        return specs.select("spec_id").join(hit, "spec_id", "left").na.fill("", ["detail"]).select("spec_id", F.lit(name).alias("check"), (F.col("detail") == "").alias("ok"), "detail")

    line = F.lpad((F.col("row") + 1).cast("string"), 7, " ")
    letter = F.regexp_extract(a1(F.lit(0), F.col("col")), "^[A-Z]+", 0)
    gone = specs.select(F.col("spec_id").alias("sheet"), "drop_columns", "drop_rows", "header_rows", "label_columns")
    lost_columns = heads.select(F.col("spec_id").alias("sheet"), "col").join(gone.select("sheet", F.explode("drop_columns").alias("col")).distinct(), ["sheet", "col"])
    texts = inside.join(gone.withColumnRenamed("sheet", "spec_id").drop("drop_columns"), "spec_id").filter(F.array_contains("drop_rows", F.col("row")) & ~F.array_contains("header_rows", F.col("row")))
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.array_contains("label_columns", F.col("col")), F.struct("col", "text")))), lambda x: x["text"]), " ")
    said = texts.groupBy("spec_id", "row").agg(label.alias("label"))
    under = F.filter(F.array_sort("subtitles"), lambda t: t["row"] <= F.col("row"))
    dropped = _of_columns(texts.filter("v_num is not null and not marked").select("spec_id", "row", "col", "v_num"), heads, specs).filter("not dropped")
    dropped = dropped.join(said, ["spec_id", "row"]).join(specs.select("spec_id", "subtitles"), "spec_id").withColumn("section", F.array_join(F.aggregate(
        under, F.array().cast("array<string>"), lambda now, t: F.concat(F.slice(F.concat(now, F.array_repeat(F.lit(""), t["level"])), 1, t["level"]), F.array(t["name"]))), " | "))
    dropped = dropped.select(F.col("spec_id").alias("sheet"), "section", "row", "label", "col", F.col("v_num").alias("value"))
    # a dropped row may be the sum of its section's rows, or of its subtotals
    subtotals = numbers.filter("subtotal and not dropped")
    by_rows = dropped_row_check(facts, dropped).unionByName(dropped_row_check(subtotals, dropped)).groupBy("sheet", "row").agg(F.bool_or("ok").alias("ok"))
    totals = [none_of(total_rows(facts), "no_total_rows", line), none_of(total_columns(facts), "no_total_columns", letter),
              none_of(dropped_column_check(candidates, lost_columns).filter("not ok"), "dropped_columns_are_totals", letter), none_of(by_rows.filter("not ok"), "dropped_rows_are_totals", line)]
    mixed = subtotal_label_check(facts, kinds).select(F.col("sheet").alias("spec_id"), F.lit("no_subtotal_labels").alias("check"), "ok", F.format_string("%d regions, %d countries, %d totals", "n_regions", "n_countries", "n_totals").alias("detail"))
    every = lost
    for df in (values, header, named, sections, whole, *in_order, *totals, mixed):
        every = every.unionByName(df)
    passed = F.bool_and("ok").over(Window.partitionBy("spec_id"))  # a dozen checks
    return every.withColumn("detail", F.trim("detail")).withColumn("status", F.when(passed, "proposed").otherwise("rejected"))


#: Keys that a specification must have a value for.
REQUIRED = ("sheet", "first_row", "last_row", "first_col", "last_col", "header_rows", "label_columns", "unit", "row_dimensions", "column_dimension")


def spec_problems(specs: DataFrame, units: list[str]) -> DataFrame:
    """spec_id, problems of specifications before they are replayed, by name and joined by commas."""
    inside = lambda c, lo, hi: F.forall(c, lambda x: (x >= F.col(lo)) & (x <= F.col(hi)))
    no = lambda c: F.coalesce(~c, F.lit(False))
    every = F.concat("header_rows", "drop_rows", F.transform("subtitles", lambda s: s["row"]))
    named = F.concat("row_dimensions", F.array("column_dimension"), F.when(F.col("section_dimension").isNotNull(), F.array("section_dimension")).otherwise(F.array().cast("array<string>")), F.map_keys("fixed"))
    rules = {
        **{f"no {c}": F.col(c).isNull() for c in REQUIRED},
        "range": no((F.col("first_row") <= F.col("last_row")) & (F.col("first_col") <= F.col("last_col"))),
        "no header row": F.coalesce(F.size("header_rows") == 0, F.lit(False)), "no label column": F.coalesce(F.size("label_columns") == 0, F.lit(False)),
        "row outside": no(inside(every, "first_row", "last_row")), "column outside": no(inside(F.concat("label_columns", "drop_columns"), "first_col", "last_col")),
        "label columns and dimensions": no(F.size("label_columns") == F.size("row_dimensions")), "label column dropped": F.coalesce(F.arrays_overlap("label_columns", "drop_columns"), F.lit(False)),
        "dimension twice": no(F.size(F.array_distinct(named)) == F.size(named)), "subtitles without dimension": F.coalesce((F.size("subtitles") > 0) & F.col("section_dimension").isNull(), F.lit(False)),
        "subtitle without name": F.coalesce(F.exists("subtitles", lambda s: F.coalesce(F.btrim(s["name"]), F.lit("")) == ""), F.lit(False)), "unknown unit": no(F.col("unit").isin(units)),
        "anchor": F.coalesce((F.btrim("anchor_text") == "") | F.col("anchor_text").isNotNull() & (F.col("anchor_row").isNull() | F.col("anchor_col").isNull()), F.lit(False))}
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return specs.select("spec_id", F.array_join(found, ",").alias("problems"))
