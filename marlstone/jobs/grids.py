"""Queries on cell grids. A sheet is a nation's orders: a row a month under a marker a year, a column a priority, and a total row a year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.lineage import cut, dealt
from marlstone.operators import grids, replay
from marlstone.sources.tables import table

HEADER_ROWS, MARKER, FIRST_YEAR = 2, "^Year ", 1995


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets, derived once and read by every branch of a query."""
    return cut(_cells(spark, sf_dir))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    values = orders.groupBy(
        F.col("c_nationkey").alias("sheet"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("col"),
    ).agg(F.sum(F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint")).alias("cents")).withColumn("v", F.expr("cents div 100"))
    top = 2 + 14 * (F.col("y") - FIRST_YEAR)
    none, no_value = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    missing = F.col("v") % 20 == 0

    def shaped(df: DataFrame, row, col, v_str, v_num, fmt) -> DataFrame:
        return df.select("sheet", row.cast("int").alias("row"), col.alias("col"), v_str.alias("v_str"), v_num.alias("v_num"), fmt.alias("fmt"))

    body = shaped(values, top + F.col("m"), F.col("col"), F.when(missing, "NM"), F.when(~missing, F.col("v")), none)
    sums = values.filter(~missing).groupBy("sheet", "y", "col").agg(F.sum("v").alias("s"))
    totals = shaped(sums, top + 13, F.col("col"), none, F.col("s"), none)
    months = values.select("sheet", "y", "m").distinct()
    fmt = F.when(F.col("y") >= 2001, 'mmm-yy "f"').otherwise("mmm-yy")
    labels = shaped(months, top + F.col("m"), F.lit(0), F.date_format(F.make_date("y", "m", F.lit(1)), "MMM-yy"), no_value, fmt)
    years = months.select("sheet", "y").distinct()
    markers = shaped(years, top, F.lit(0), F.concat(F.lit("Year "), F.col("y")), no_value, none)
    ends = shaped(years, top + 13, F.lit(0), F.lit("Total"), no_value, none)
    columns = values.select("sheet", "col").distinct()
    groups = shaped(columns, F.lit(0), F.col("col"), F.when(F.col("col") % 2 == 1, F.concat(F.lit("Group "), F.col("col"))), no_value, none)
    names = shaped(columns, F.lit(1), F.col("col"), F.concat(F.lit("P"), F.col("col")), no_value, none)
    return (body.unionByName(totals).unionByName(labels).unionByName(markers).unionByName(ends)
            .unionByName(groups).unionByName(names))


CELLS_SQL = """
WITH val AS (SELECT c_nationkey AS sheet, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(substr(o_orderpriority, 1, 1) AS INT) AS col,
    CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) // 100 AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
cells AS (
  SELECT sheet, 2 + 14 * (y - 1995) + m AS "row", col, CASE WHEN v % 20 = 0 THEN 'NM' END AS v_str, CASE WHEN v % 20 <> 0 THEN v END AS v_num, NULL AS fmt FROM val
  UNION ALL SELECT sheet, 15 + 14 * (y - 1995), col, NULL, CAST(sum(v) AS BIGINT), NULL FROM val WHERE v % 20 <> 0 GROUP BY sheet, y, col
  UNION ALL SELECT DISTINCT sheet, 2 + 14 * (y - 1995) + m, 0, strftime(make_date(y, m, 1), '%b-%y'), NULL,
    CASE WHEN y >= 2001 THEN 'mmm-yy "f"' ELSE 'mmm-yy' END FROM val
  UNION ALL SELECT DISTINCT sheet, 2 + 14 * (y - 1995), 0, 'Year ' || y, NULL, NULL FROM val
  UNION ALL SELECT DISTINCT sheet, 15 + 14 * (y - 1995), 0, 'Total', NULL, NULL FROM val
  UNION ALL SELECT DISTINCT sheet, 0, col, CASE WHEN col % 2 = 1 THEN 'Group ' || col END, NULL, NULL FROM val
  UNION ALL SELECT DISTINCT sheet, 1, col, 'P' || col, NULL, NULL FROM val),
filled AS (SELECT sheet, "row", col, last_value(v_str IGNORE NULLS) OVER (PARTITION BY sheet, "row" ORDER BY col) AS v FROM cells WHERE "row" < 2 AND col > 0),
heads AS (SELECT sheet, col, string_agg(v, ' | ' ORDER BY "row") AS header FROM filled WHERE v IS NOT NULL GROUP BY ALL),
marked AS (SELECT sheet, "row", v_str AS label, fmt,
  last_value(CASE WHEN v_str LIKE 'Year %' THEN v_str END IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY "row") AS section
  FROM cells WHERE "row" >= 2 AND col = 0),
rows_ AS (SELECT * FROM marked WHERE label NOT LIKE 'Year %'),
facts AS (SELECT c.sheet, c."row", c.col, section, label, header, v_num AS value,
  CASE WHEN r.fmt LIKE '%"f"%' THEN 'forecast' ELSE 'actual' END AS status, chr(65 + c.col) || (c."row" + 1) AS cell
  FROM cells c JOIN rows_ r ON c.sheet = r.sheet AND c."row" = r."row" LEFT JOIN heads h ON c.sheet = h.sheet AND c.col = h.col
  WHERE c."row" >= 2 AND c.col > 0 AND v_num IS NOT NULL),
periods AS (SELECT sheet, "row", label, strftime(strptime(label, '%b-%y'), '%Y-%m') AS period FROM rows_ WHERE label <> 'Total'),
checked AS (SELECT sheet, count(v_num) AS n_numeric, count(*) - count(v_num) AS n_other FROM cells
  WHERE "row" >= 2 AND col > 0 AND (v_num IS NOT NULL OR v_str IS NOT NULL) GROUP BY sheet),
moves AS (SELECT sheet, period, lag(period) OVER (PARTITION BY sheet ORDER BY "row") AS above FROM periods),
ordered AS (SELECT sheet, count(*) AS n_periods, count(*) FILTER (period < above) AS n_violations FROM moves GROUP BY sheet),
near AS (SELECT *, sum(value) OVER (PARTITION BY sheet, section, col) - value AS rest FROM facts),
sized AS (SELECT sheet, section, count(DISTINCT "row") AS n_rows FROM facts GROUP BY ALL),
totals AS (SELECT sheet, section, "row", label FROM near JOIN sized USING (sheet, section) GROUP BY ALL
  HAVING bool_and(abs(value - rest) * 100 <= greatest(abs(value), abs(rest), 1)) AND count(*) FILTER (value <> 0) >= 2 AND any_value(n_rows) > 2)
"""


def x3_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.headers(cells(spark, sf_dir), HEADER_ROWS)


def x5_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.labelled_rows(cells(spark, sf_dir), HEADER_ROWS, MARKER)


def x6_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.facts(cells(spark, sf_dir), HEADER_ROWS, MARKER)


def x9_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grids.labelled_rows(cells(spark, sf_dir), HEADER_ROWS, MARKER)
    return rows.select("sheet", "row", "label", grids.period(F.col("label")).alias("period")).filter("period is not null")


def x2_anchor_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each sheet's nearest total lies from where a specification would have it."""
    anchors = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("sheet"), F.lit(0).alias("col"), (20 + F.col("n_nationkey")).alias("row"), F.lit(" TOTAL").alias("text"))
    return grids.located(cells(spark, sf_dir), anchors)


def x11_value_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.value_check(cells(spark, sf_dir), HEADER_ROWS)


def x15_period_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.period_order(cells(spark, sf_dir), HEADER_ROWS, MARKER)


def x15_header_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns are years, in some sheets quarters that begin anew in the fourth column."""
    quarter = F.concat((F.col("col") % 4 + 1).cast("string"), F.lit("Q1995"))
    label = F.when(F.col("sheet") % 3 == 0, quarter).otherwise((FIRST_YEAR + F.col("col")).cast("string"))
    odd = cells(spark, sf_dir).withColumn("v_str", F.when((F.col("row") == 1) & (F.col("col") > 0), label).otherwise(F.col("v_str")))
    return grids.header_order(odd, HEADER_ROWS)


def x17_total_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.total_rows(cut(x6_facts(spark, sf_dir)))


def x21_check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = cells(spark, sf_dir)
    found = cut(grids.facts(grid, HEADER_ROWS, MARKER))
    bad = grids.total_rows(found).select("sheet").distinct().withColumn("bad", F.lit(True))
    no_totals = found.select("sheet").distinct().join(bad, "sheet", "left").select("sheet", F.col("bad").isNull().alias("ok"))
    return grids.report({
        "values_parse": grids.value_check(grid, HEADER_ROWS), "row_periods_in_order": grids.period_order(grid, HEADER_ROWS, MARKER),
        "no_total_rows": no_totals})


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(grids.facts(cells(spark, sf_dir), HEADER_ROWS, MARKER))


def x1_spec_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as specifications, many of them wrong somewhere."""
    n = F.col("c_custkey")
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (n % k + 1).cast("int"))
    ops = F.when(n % 5 == 0, F.array(F.lit("stack"), F.lit("ffill"))).when(n % 5 == 1, F.array(F.lit("pivot"), F.lit("stack"))).when(n % 5 == 2, F.lit(None).cast("array<string>")).otherwise(F.array(F.lit("ffill"), F.lit("stack")))
    specs = table(spark, sf_dir, "customer").select(
        n.alias("spec_id"), F.lit(3).alias("first_row"), F.lit(20).alias("last_row"), F.lit(1).alias("first_col"), F.lit(6).alias("last_col"), F.array((n % 7 + 2).cast("int")).alias("header_rows"),
        F.array((n % 8).cast("int")).alias("label_columns"), ops.alias("operators"), pick(["kiloton", "usd_per_ton", "bushel"], 3).alias("value_unit"), pick(["Prices", " ", None], 3).alias("anchor_text"))
    return grids.spec_problems(specs, ["kiloton", "usd_per_ton"], ["ffill", "subtitle", "stack"])


def x4_filled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's lines as rows: its first label stands in the first of three rows, the second in most; some rows are dropped."""
    given = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sheet"), (F.col("l_partkey") + 2).cast("int").alias("row"), F.col("l_linenumber").alias("k"))
    line = dealt(given, "sheet").groupBy("sheet", "row").agg(F.max("k").alias("k"))  # all that follows stays in a sheet
    cell = lambda col, v_str: F.struct(F.lit(col).alias("col"), v_str.alias("v_str"))
    first = F.when(F.col("row") % 3 == 0, cell(0, F.concat(F.lit("A"), "row")))
    second = F.when(F.col("k") < 6, cell(1, F.when(F.col("row") % 10 == 3, "Sub Total").otherwise(F.concat(F.lit("B"), "k"))))
    rest = F.when(F.col("k") >= 6, cell(4, F.lit(None).cast("string")))
    rows = line.select("sheet", "row", F.explode(F.array(first, second, rest)).alias("c")).filter("c is not null").select("sheet", "row", "c.*", F.lit(None).cast("double").alias("v_num"))
    return grids.filled_labels(rows, 2, 2, ["TOTAL"])


def x7_marked_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column 3 is formatted as forecast; published in June 2000."""
    found = _facts(spark, sf_dir)
    formats = found.select("sheet", "col").distinct().select("sheet", "col", F.when(F.col("col") == 3, '0 "F"').alias("fmt"))
    return grids.marked_facts(found, formats, "2000-06").select("cell", "sheet", "status")


def _specs(grid: DataFrame) -> DataFrame:
    """A specification a sheet, written when its table stood three rows lower; in a fifth of the sheets the anchor's text is gone."""
    at = lambda k, level, name: F.struct((F.col("row") + k).alias("row"), F.lit(level).alias("level"), name.alias("name"))
    marks = grid.filter(F.col("v_str").rlike(MARKER)).select("sheet", F.explode(F.array(at(3, 0, F.col("v_str")), at(3, 1, F.lit("H1")), at(10, 1, F.lit("H2")))).alias("s"))
    marks = marks.groupBy("sheet").agg(F.collect_list("s").alias("subtitles"))
    size = grid.groupBy("sheet").agg((F.max("row") + 3).alias("last_row"), F.max("col").alias("last_col"))
    ints, texts, even = (lambda *xs: F.array(*map(F.lit, xs)).cast("array<int>")), (lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")), F.col("sheet") % 2 == 0
    return size.join(marks, "sheet").select(
        F.concat(F.lit("spec"), "sheet").alias("spec_id"), "sheet", F.lit(3).alias("first_row"), "last_row", F.lit(0).alias("first_col"), "last_col", ints(3, 4).alias("header_rows"), ints(0).alias("label_columns"),
        F.lit(True).alias("fill_header"), even.alias("fill_labels"), ints().alias("drop_rows"), F.when(even, ints(5)).otherwise(ints()).alias("drop_columns"), texts("TOTAL").alias("skip_words"),
        texts("region").alias("skip_kinds"), "subtitles", texts("nm").alias("missing"), F.to_date(F.lit("1997-06-15")).alias("published"), F.lit("usd").alias("unit"), F.lit(4).alias("anchor_row"),
        F.lit(1).alias("anchor_col"), F.when(F.col("sheet") % 5 == 0, "Gone").otherwise("p1 ").alias("anchor_text"), texts("month").alias("row_dimensions"), F.lit("priority").alias("column_dimension"),
        F.lit("year").alias("section_dimension"), F.create_map(F.lit("source"), F.lit("orders")).alias("fixed"))


def x6_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications moved to their anchors and replayed on all sheets."""
    grid = cells(spark, sf_dir)
    found = replay.replayed(grid, cut(replay.placed(_specs(grid), grid)), _terms(spark, sf_dir))
    return found.select("spec_id", "cell", *[F.col("dims")[d].alias(d) for d in ("source", "year", "month", "priority")], F.col("value").cast("bigint").alias("value"), "unit", "status")


def x21_all_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of the specifications of x6_replayed; in a third of the sheets nothing is skipped, in a fourth of them the table ends two rows early."""
    grid = cells(spark, sf_dir)
    n = F.col("sheet")
    none = F.array().cast("array<string>")
    specs = _specs(grid).withColumns({
        "skip_words": F.when(n % 3 == 1, none).otherwise(F.col("skip_words")), "skip_kinds": F.when(n % 3 == 1, none).otherwise(F.col("skip_kinds")),
        "last_row": F.when(n % 4 == 1, F.col("last_row") - 2).otherwise(F.col("last_row"))})
    return replay.checked(grid, cut(replay.placed(specs, grid)), _terms(spark, sf_dir))


def x1_specs_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The specifications of x6_replayed, broken in one way each by their sheet's number."""
    n = F.col("sheet")
    s = _specs(cells(spark, sf_dir))
    s = s.withColumns({
        "unit": F.when(n % 12 == 1, "bushel").when(n % 12 != 2, F.col("unit")), "row_dimensions": F.when(n % 12 == 3, F.array(F.lit("a"), F.lit("b"))).otherwise(F.col("row_dimensions")),
        "drop_rows": F.when(n % 12 == 4, F.array(F.lit(1))).otherwise(F.col("drop_rows")), "section_dimension": F.when(n % 12 != 5, F.col("section_dimension")),
        "fixed": F.when(n % 12 == 6, F.create_map(F.lit("month"), F.lit("x"))).otherwise(F.col("fixed")), "anchor_row": F.when(n % 12 != 7, F.col("anchor_row")),
        "drop_columns": F.when(n % 12 == 8, F.array(F.lit(0))).when(n % 12 == 9, F.array(F.lit(77))).otherwise(F.col("drop_columns")), "header_rows": F.when(n % 12 == 10, F.array().cast("array<int>")).otherwise(F.col("header_rows"))})
    return replay.spec_problems(s, ["usd", "kiloton"])


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of labels as names: January is a region, February a region and a country, March a country."""
    return spark.createDataFrame([(f"{m}-{y:02d}", k) for y in range(95, 100) for m, k in (("jan", "region"), ("feb", "region"), ("feb", "country"), ("mar", "country"))], "term string, kind string")


def x8_without_subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.without_subtotals(_facts(spark, sf_dir), _terms(spark, sf_dir), ["region"]).groupBy("sheet").agg(F.count("*").alias("n"))


#: A closed vocabulary of units, and which of them say more than others.
UNITS = {"metric ton": "metric_ton", "tonnes": "metric_ton", "000 tonnes": "kiloton", "kt": "kiloton", "kt p2o5": "kiloton_p2o5"}
BETTER = {"metric_ton": ["kiloton_p2o5", "kiloton"], "kiloton": ["kiloton_p2o5"]}


def _unit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    said = F.element_at(F.array(*map(F.lit, ["Sales in 000 tonnes, ", "(kt P2O5) ", "ktonnes or tonnes ", "no unit", "kt; "])), (n % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(n.alias("sheet"), F.concat(said, "c_name").alias("text"))


def x10_evidenced_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.evidenced_units(_unit_texts(spark, sf_dir), UNITS)


def x10_unit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sheet"), F.when(F.col("c_custkey") % 2 == 0, " KT ").otherwise("Tonnes").alias("value_unit"))
    return grids.unit_check(specs, grids.evidenced_units(_unit_texts(spark, sf_dir), UNITS), UNITS, BETTER)


def x12_header_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header cells of some sheets are numbers."""
    number = (F.col("row") < 2) & (F.col("sheet") % 4 == 0) & (F.col("col") % 3 > 0)
    odd = cells(spark, sf_dir).withColumn("v_num", F.when(number, F.when(F.col("col") == 1, 1999).otherwise(F.col("col") * 10)).otherwise(F.col("v_num")))
    return grids.header_check(odd, HEADER_ROWS)


def x12_label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = (F.col("col") == 0) & (F.col("sheet") % 3 == 0) & (F.col("row") % 4 == 0)
    odd = cells(spark, sf_dir).withColumn("v_str", F.when(blank, " ").otherwise(F.col("v_str")))
    return grids.label_check(odd, HEADER_ROWS)


def x13_section_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first year's marker is missing in some sheets."""
    odd = cells(spark, sf_dir).filter(f"not (sheet % 5 = 1 and col = 0 and v_str = 'Year {FIRST_YEAR}')")
    return grids.section_check(grids.facts(odd, HEADER_ROWS, MARKER))


def x14_outside_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sheet"), F.lit(2).alias("first_row"), (F.col("n_nationkey") * 2 + 20).alias("last_row"), F.lit(0).alias("first_col"), (F.col("n_nationkey") % 3 + 3).alias("last_col"))
    return grids.outside_check(cells(spark, sf_dir), bounds)


def x16_corner_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sheet"), F.concat(F.when(F.col("c_custkey") % 7 > 0, F.concat("c_mktsegment", F.lit(" \\ Months"))).otherwise(F.col("c_name"))).alias("corner"),
                                                      F.lit("building_furniture").alias("row_dimension"), F.when(F.col("c_custkey") % 2 == 0, "month").otherwise("by months").alias("column_dimension"))
    return grids.corner_check(corners)


def _with_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In some sheets a sixth column holds the sum of the others; in others it misses one row's."""
    found = _facts(spark, sf_dir).select("sheet", "row", "col", F.col("value").cast("bigint").alias("value"))
    sums = found.groupBy("sheet", "row").agg(F.sum("value").alias("value")).filter("sheet % 3 > 0").withColumn("value", F.when((F.col("sheet") % 3 == 2) & (F.col("row") == 16), 7).otherwise(F.col("value")))
    return found.unionByName(sums.select("sheet", "row", F.lit(6).alias("col"), "value"))


def x18_total_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.total_columns(_with_sums(spark, sf_dir))


def x19_dropped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifth column is dropped, the sixth, and a seventh that is empty."""
    found = cut(_with_sums(spark, sf_dir))
    dropped = found.select("sheet").distinct().withColumn("col", F.explode(F.array(F.lit(5), F.lit(6), F.lit(7))))
    return grids.dropped_column_check(found, dropped)


def x19_dropped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years' totals are dropped without their label, and in some sheets December too."""
    found = _facts(spark, sf_dir)
    gone = (F.col("label") == "Total") | ((F.col("sheet") % 2 == 0) & F.col("label").rlike("^Dec"))
    kept = found.filter((F.col("label") != "Total"))
    dropped = found.filter(gone).withColumn("label", F.when(F.col("sheet") % 5 == 0, F.concat(F.lit("my "), F.col("label"))))
    return grids.dropped_row_check(kept, dropped)


def x20_subtotal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _facts(spark, sf_dir).filter("sheet % 2 = 0 or label <> 'Total'").filter("sheet % 3 > 0 or not label rlike '^(Feb|Mar)'")
    return grids.subtotal_label_check(found, _terms(spark, sf_dir))


def x23_latest_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("f"), F.col("o_custkey") % 50).alias("file"), F.concat(F.lit("s"), F.col("o_orderkey") % 7).alias("sheet"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"),
        F.concat(F.lit("n"), F.col("o_orderkey")).alias("name"), F.col("o_orderstatus").alias("status"))
    return grids.latest_specs(specs)


def x24_monthly_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group 3 and the column right of it."""
    return grids.monthly_mid(cells(spark, sf_dir), " group 3".strip(), HEADER_ROWS).withColumn("mid", F.col("mid").cast("double"))


QUERIES = {
    f.__name__: f
    for f in (x2_anchor_offset, x3_headers, x5_sections, x6_facts, x6_replayed, x1_specs_checked, x21_all_checks, x9_periods, x11_value_check, x15_period_order, x15_header_order, x17_total_rows, x21_check_report,
              x1_spec_problems, x4_filled_labels, x7_marked_facts, x8_without_subtotals, x10_evidenced_units, x10_unit_check, x12_header_check, x12_label_check, x13_section_check, x14_outside_check,
              x16_corner_check, x18_total_columns, x19_dropped_rows, x19_dropped_columns, x20_subtotal_labels, x23_latest_specs, x24_monthly_mid)
}

ORACLE_SQL = {
    "x2_anchor_offset": CELLS_SQL + """
SELECT n_nationkey AS sheet, arg_min(d, (abs(d), "row")) AS "offset" FROM nation LEFT JOIN (
  SELECT sheet, "row", v_str FROM cells WHERE col = 0 AND lower(trim(v_str)) = 'total') ON sheet = n_nationkey
CROSS JOIN LATERAL (SELECT CASE WHEN "row" - 20 - n_nationkey <= 60 THEN "row" - 20 - n_nationkey END AS d) GROUP BY 1""",
    "x3_headers": CELLS_SQL + "SELECT sheet, col, header FROM heads",
    "x5_sections": CELLS_SQL + 'SELECT sheet, "row", label, fmt, section FROM rows_',
    "x6_facts": CELLS_SQL + "SELECT * FROM facts",
    "x9_periods": CELLS_SQL + "SELECT * FROM periods",
    "x11_value_check": CELLS_SQL + "SELECT *, n_numeric > 0 AND 10 * n_other <= n_numeric + n_other AS ok FROM checked",
    "x15_period_order": CELLS_SQL + "SELECT *, n_violations = 0 AS ok FROM ordered",
    "x15_header_order": CELLS_SQL + """, p AS (SELECT sheet, col, CASE WHEN sheet % 3 = 0 THEN '1995-' || lpad(CAST(3 * (col % 4) + 1 AS VARCHAR), 2, '0') ELSE (1995 + col) || '-01' END AS p FROM (SELECT DISTINCT sheet, col FROM val)),
l AS (SELECT sheet, p, lag(p) OVER (PARTITION BY sheet ORDER BY col) AS l FROM p)
SELECT sheet, count(*) AS n_periods, count(*) FILTER (p < l) AS n_violations, count(*) FILTER (p < l) = 0 AS ok FROM l GROUP BY 1""",
    "x17_total_rows": CELLS_SQL + "SELECT * FROM totals",
    "x21_check_report": CELLS_SQL + """, every AS (
  SELECT sheet, 'values_parse' AS "check", n_numeric > 0 AND 10 * n_other <= n_numeric + n_other AS ok FROM checked
  UNION ALL SELECT sheet, 'row_periods_in_order', n_violations = 0 FROM ordered
  UNION ALL SELECT DISTINCT sheet, 'no_total_rows', sheet NOT IN (SELECT sheet FROM totals) FROM facts)
SELECT *, CASE WHEN bool_and(ok) OVER (PARTITION BY sheet) THEN 'proposed' ELSE 'rejected' END AS status FROM every""",
    "x1_spec_problems": """SELECT c_custkey AS spec_id, concat_ws(',', CASE WHEN c_custkey % 5 = 2 THEN 'missing key' END, CASE WHEN c_custkey % 5 = 1 THEN 'unknown operator' END, CASE WHEN c_custkey % 5 = 0 THEN 'stack is not last' END,
  CASE WHEN c_custkey % 7 + 2 < 3 THEN 'row outside' END, CASE WHEN c_custkey % 8 NOT BETWEEN 1 AND 6 THEN 'column outside' END, CASE WHEN c_custkey % 3 = 2 THEN 'unknown unit' END, CASE WHEN c_custkey % 3 = 1 THEN 'anchor without text' END) AS problems FROM customer""",
    "x4_filled_labels": """WITH l AS (SELECT l_suppkey AS sheet, CAST(l_partkey + 2 AS INT) AS "row", max(l_linenumber) AS k FROM lineitem GROUP BY ALL), o AS (SELECT *, CASE WHEN k < 6 THEN CASE WHEN "row" % 10 = 3 THEN 'Sub Total' ELSE 'B' || k END END AS b FROM l)
SELECT sheet, "row", coalesce(last_value(CASE WHEN "row" % 3 = 0 THEN 'A' || "row" END IGNORE NULLS) OVER w, '') || ' | ' || coalesce(last_value(b IGNORE NULLS) OVER w, '') AS labels FROM o WINDOW w AS (PARTITION BY sheet ORDER BY "row") QUALIFY NOT contains(labels, 'Total')""",
    "x6_replayed": CELLS_SQL + """SELECT 'spec' || sheet AS spec_id, cell, 'orders' AS source, section || CASE WHEN CAST(strftime(strptime(label, '%b-%y'), '%m') AS INT) < 7 THEN ' | H1' ELSE ' | H2' END AS year, label AS month,
  header AS priority, CAST(value AS BIGINT) AS value, 'usd' AS unit, CASE WHEN strptime(label, '%b-%y') > DATE '1997-06-15' THEN 'forecast' ELSE 'actual' END AS status
FROM facts WHERE label <> 'Total' AND NOT regexp_matches(label, '^Jan-9[5-9]') AND sheet % 5 > 0 AND (sheet % 2 = 1 OR col <> 5)""",
    "x21_all_checks": CELLS_SQL + """, sz AS (SELECT sheet, max("row") - CASE WHEN sheet % 4 = 1 THEN 2 ELSE 0 END AS last_row FROM cells GROUP BY sheet),
vf AS (SELECT f.*, section || CASE WHEN (f."row" - 2) % 14 < 7 THEN ' | H1' ELSE ' | H2' END AS sec FROM facts f JOIN sz USING (sheet)
  WHERE sheet % 5 > 0 AND f."row" <= last_row AND (sheet % 3 = 1 OR (label <> 'Total' AND NOT regexp_matches(label, '^Jan-9[5-9]')))),
kf AS (SELECT * FROM vf WHERE sheet % 2 = 1 OR col <> 5),
sp AS (SELECT DISTINCT sheet FROM cells WHERE sheet % 5 > 0),
tr AS (SELECT sheet, "row", bool_and(abs(value - rest) * 100 <= greatest(abs(value), abs(rest), 1)) AND count(*) FILTER (value <> 0) >= 2 AND any_value(n) > 2 AS hit FROM (
  SELECT *, sum(value) OVER (PARTITION BY sheet, sec, col) - value AS rest, (SELECT count(DISTINCT "row") FROM kf k WHERE k.sheet = kf.sheet AND k.sec = kf.sec) AS n FROM kf) GROUP BY ALL),
tc AS (SELECT sheet, col, bool_and(abs(value - rest) * 100 <= greatest(abs(value), abs(rest), 1)) AND count(*) FILTER (value <> 0) >= 2 AS hit FROM (SELECT *, sum(value) OVER (PARTITION BY sheet, "row") - value AS rest FROM kf) GROUP BY ALL),
lb AS (SELECT DISTINCT sheet, lower(label) AS l FROM kf),
lc AS (SELECT sheet, count(*) FILTER (regexp_matches(l, '^jan-9[5-9]')) AS r, count(*) FILTER (regexp_matches(l, '^(feb|mar)-9[5-9]')) AS c, count(*) FILTER (contains(l, 'total')) AS t FROM lb GROUP BY 1),
ch AS (
  SELECT sheet, 'anchor' AS "check", FALSE AS ok, 'Gone' AS detail FROM (SELECT DISTINCT sheet FROM cells WHERE sheet % 5 = 0)
  UNION ALL SELECT sheet, 'values_parse', TRUE, count(*) || ' numbers, 0 other' FROM kf GROUP BY sheet
  UNION ALL SELECT sheet, 'header_is_text', TRUE, '0 of ' || count(*) || ' are numbers' FROM cells WHERE sheet % 5 > 0 AND "row" < 2 AND v_str IS NOT NULL AND (sheet % 2 = 1 OR col <> 5) GROUP BY sheet
  UNION ALL SELECT sheet, 'labels_present', TRUE, '0 of ' || count(DISTINCT "row") || ' are empty' FROM kf GROUP BY sheet
  UNION ALL SELECT sheet, 'subtitle_covers_rows', bool_and(sec IS NOT NULL), '' FROM kf GROUP BY sheet
  UNION ALL SELECT sheet, 'covers_whole_table', count(v_num) FILTER (c."row" > last_row) = 0, count(v_num) FILTER (c."row" > last_row) || ' below, 0 right' FROM cells c JOIN sz USING (sheet) WHERE sheet % 5 > 0 GROUP BY sheet
  UNION ALL SELECT sheet, 'row_periods_in_order', TRUE, '' FROM sp
  UNION ALL SELECT sheet, 'no_total_rows', NOT bool_or(hit), coalesce(array_to_string(list_sort(list("row" + 1) FILTER (hit))[:5], ','), '') FROM tr GROUP BY sheet
  UNION ALL SELECT sheet, 'no_total_columns', NOT bool_or(hit), coalesce(array_to_string(list_sort(list(chr(65 + col)) FILTER (hit))[:5], ','), '') FROM tc GROUP BY sheet
  UNION ALL SELECT sheet, 'dropped_columns_are_totals', sheet % 2 = 1 OR NOT EXISTS (SELECT 1 FROM vf WHERE vf.sheet = sp.sheet AND col = 5 AND value <> 0), CASE WHEN sheet % 2 = 0 AND EXISTS (SELECT 1 FROM vf WHERE vf.sheet = sp.sheet AND col = 5 AND value <> 0) THEN 'F' ELSE '' END FROM sp
  UNION ALL SELECT sheet, 'dropped_rows_are_totals', TRUE, '' FROM sp
  UNION ALL SELECT sheet, 'no_subtotal_labels', (r = 0 OR c = 0) AND t = 0, r || ' regions, ' || c || ' countries, ' || t || ' totals' FROM lc)
SELECT 'spec' || sheet AS spec_id, "check", ok, detail, CASE WHEN bool_and(ok) OVER (PARTITION BY sheet) THEN 'proposed' ELSE 'rejected' END AS status FROM ch""",
    "x1_specs_checked": """SELECT 'spec' || n AS spec_id, (['', 'unknown unit', 'no unit', 'label columns and dimensions', 'row outside', 'subtitles without dimension', 'dimension twice', 'anchor', 'label column dropped', 'column outside',
  'no header row', ''])[n % 12 + 1] AS problems FROM (SELECT DISTINCT c_nationkey AS n FROM customer JOIN orders ON o_custkey = c_custkey)""",
    "x7_marked_facts": CELLS_SQL + """SELECT cell, sheet, CASE WHEN status = 'forecast' OR col = 3 OR (label <> 'Total' AND strftime(try_strptime(label, '%b-%y'), '%Y-%m') > '2000-06') THEN 'forecast' ELSE 'actual' END AS status FROM facts""",
    "x8_without_subtotals": CELLS_SQL + "SELECT sheet, count(*) AS n FROM facts WHERE NOT regexp_matches(label, '^Jan-9[5-9]') GROUP BY 1",
    "x10_evidenced_units": "SELECT c_custkey AS sheet, unnest(([['kiloton', 'metric_ton'], ['kiloton', 'kiloton_p2o5'], ['metric_ton'], [], ['kiloton']])[c_custkey % 5 + 1]) AS unit FROM customer",
    "x10_unit_check": """SELECT c_custkey AS sheet, CASE WHEN c_custkey % 2 = 0 THEN 'kiloton' ELSE 'metric_ton' END AS unit, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 5 IN (0, 4) ELSE c_custkey % 5 = 2 END AS ok FROM customer""",
    "x12_header_check": CELLS_SQL + """, h AS (SELECT sheet, v_str, CASE WHEN sheet % 4 = 0 AND col % 3 > 0 THEN CASE WHEN col = 1 THEN 1999 ELSE col * 10 END END AS n FROM cells WHERE "row" < 2 AND col > 0)
SELECT sheet, count(*) AS n_cells, count(*) FILTER (n <> 1999) AS n_numbers, 5 * count(*) FILTER (n <> 1999) <= count(*) AS ok FROM h WHERE v_str IS NOT NULL OR n IS NOT NULL GROUP BY 1""",
    "x12_label_check": CELLS_SQL + """, v AS (SELECT DISTINCT sheet, "row" FROM cells WHERE "row" >= 2 AND col > 0 AND v_num IS NOT NULL)
SELECT sheet, count(*) AS n_rows, count(*) FILTER (sheet % 3 = 0 AND "row" % 4 = 0) AS n_empty, 5 * count(*) FILTER (sheet % 3 = 0 AND "row" % 4 = 0) <= count(*) AS ok FROM v GROUP BY 1""",
    "x13_section_check": CELLS_SQL + """, o AS (SELECT *, sheet % 5 = 1 AND section = 'Year 1995' AS bad FROM facts)
SELECT sheet, count(*) FILTER (bad) AS n_orphans, coalesce(array_to_string(list_slice(list_sort(list(cell) FILTER (bad)), 1, 5), ','), '') AS orphans, count(*) FILTER (bad) = 0 AS ok FROM o GROUP BY 1""",
    "x14_outside_check": CELLS_SQL + """SELECT sheet, count(*) FILTER ("row" > lr AND "row" <= lr + 3 AND col <= lc) AS below, count(*) FILTER (col > lc AND col <= lc + 2 AND "row" BETWEEN 2 AND least(lr, 22)) AS "right",
  count(*) FILTER ("row" > lr AND "row" <= lr + 3 AND col <= lc) = 0 AND count(*) FILTER (col > lc AND col <= lc + 2 AND "row" BETWEEN 2 AND least(lr, 22)) = 0 AS ok
  FROM (SELECT *, sheet * 2 + 20 AS lr, sheet % 3 + 3 AS lc FROM cells WHERE v_num IS NOT NULL) GROUP BY 1""",
    "x16_corner_check": "SELECT c_custkey AS sheet, contains('building_furniture', lower(c_mktsegment[1:5])) AS ok FROM customer WHERE c_custkey % 7 > 0",
    "x18_total_columns": CELLS_SQL + ", s AS (SELECT DISTINCT sheet FROM facts) SELECT sheet, CAST(6 AS INT) AS col FROM s WHERE sheet % 3 = 1 OR (sheet % 3 = 2 AND sheet NOT IN (SELECT sheet FROM facts WHERE \"row\" = 16))",
    "x19_dropped_rows": CELLS_SQL + """, k AS (SELECT sheet, section, col, sum(value) AS s FROM facts WHERE label <> 'Total' GROUP BY ALL),
d AS (SELECT f.*, coalesce(s, 0) AS s FROM facts f LEFT JOIN k USING (sheet, section, col) WHERE label = 'Total' OR (sheet % 2 = 0 AND label LIKE 'Dec%'))
SELECT sheet, "row", bool_or(sheet % 5 = 0 AND label = 'Total') OR bool_and(abs(value - s) * 100 <= greatest(abs(value), abs(s), 1)) AS ok FROM d GROUP BY ALL""",
    "x19_dropped_columns": CELLS_SQL + """, s AS (SELECT DISTINCT sheet FROM facts), c AS (SELECT sheet, CAST(unnest([5, 6, 7]) AS INT) AS col FROM s)
SELECT sheet, col, CASE col WHEN 5 THEN sheet NOT IN (SELECT sheet FROM facts WHERE col = 5 AND value <> 0) WHEN 6 THEN sheet % 3 <> 2 OR sheet NOT IN (SELECT sheet FROM facts WHERE "row" = 16) ELSE true END AS ok FROM c""",
    "x20_subtotal_labels": CELLS_SQL + """, n AS (SELECT DISTINCT sheet, lower(label) AS l FROM facts WHERE (sheet % 2 = 0 OR label <> 'Total') AND (sheet % 3 > 0 OR NOT regexp_matches(label, '^(Feb|Mar)'))),
c AS (SELECT sheet, count(*) FILTER (regexp_matches(l, '^jan-9[5-9]')) AS n_regions, count(*) FILTER (regexp_matches(l, '^(feb|mar)-9[5-9]')) AS n_countries, count(*) FILTER (l = 'total') AS n_totals FROM n GROUP BY 1)
SELECT *, (n_regions = 0 OR n_countries = 0) AND n_totals = 0 AS ok FROM c""",
    "x23_latest_specs": """SELECT 'f' || (o_custkey % 50) AS file, 's' || (o_orderkey % 7) AS sheet, strftime(o_orderdate, '%Y-%m-%d') AS at, 'n' || o_orderkey AS name, o_orderstatus AS status FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey % 50, o_orderkey % 7 ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, 'n' || o_orderkey DESC) = 1""",
    "x24_monthly_mid": CELLS_SQL + """SELECT sheet, strftime(strptime(label, '%b-%y'), '%Y-%m') AS month, avg(value) AS mid FROM facts WHERE label <> 'Total' AND col IN (3, 4) AND status = 'actual' GROUP BY ALL HAVING count(*) = 2""",
}
