"""Queries on profit models and formulas. A supplier's year is a submission's period; sheets hold an order line's part and number as row and column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.lineage import cut
from marlstone.functions.numbers import rounded
from marlstone.operators import formulas, pnl
from marlstone.sources.tables import table

#: Lines that one task sums to cells.
LINES_OF_A_TASK = 250_000
#: Cells that one task names or reads.
CELLS_OF_A_TASK = 500_000
INPUTS = ["volume", "price", "input_price", "freight_rate", "fixed"]
MODEL: pnl.Model = {
    "margin": (["revenue", "costs"], lambda r, c: r - c),  # needs rows that come later
    "revenue": (["volume", "price"], lambda v, p: v * p),
    "costs": (["material", "freight", "fixed"], pnl.sum_of),
    "material": (["volume", "input_price"], lambda v, p: v * p * 0.5),
    "freight": (["volume", "freight_rate"], lambda v, f: v * f),
    "margin_rate": (["margin", "revenue"], pnl.divided),
    "worst": (["material", "freight"], pnl.greatest_of),
}


def _submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers, so that sums are the same in any order; a supplier's volume is zero in some years."""
    line = table(spark, sf_dir, "lineitem")
    cents = F.sum(F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("bigint"))
    per = line.groupBy(F.col("l_suppkey").alias("submission"), F.year("l_shipdate").alias("period")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"), cents.alias("cents"), F.count("*").alias("n"))
    zero = (F.col("submission") + F.col("period")) % 11 == 0
    return per.select("submission", "period", F.when(zero, 0).otherwise(F.col("q")).cast("double").alias("volume"), F.expr("cents div q").cast("double").alias("price"),
                      F.expr("cents div q div 3 + n").cast("double").alias("input_price"), (F.col("n") % 7).cast("double").alias("freight_rate"), F.lit(250_000.0).alias("fixed"))


_SUBMITTED_SQL = """s AS (SELECT submission, period, CAST(CASE WHEN (submission + period) % 11 = 0 THEN 0 ELSE q END AS DOUBLE) AS volume, CAST(cents // q AS DOUBLE) AS price, CAST(cents // q // 3 + n AS DOUBLE) AS input_price,
    CAST(n % 7 AS DOUBLE) AS freight_rate, CAST(250000 AS DOUBLE) AS fixed FROM (
  SELECT l_suppkey AS submission, year(l_shipdate) AS period, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM lineitem GROUP BY ALL))"""
_MARGIN = "{v} * {p} - ({v} * {i} * 0.5 + {v} * {f} + {x})"
_OWN = {"v": "volume", "p": "price", "i": "input_price", "f": "freight_rate", "x": "fixed"}


def m1_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pnl.evaluated(_submitted(spark, sf_dir), MODEL, INPUTS)
    return got.select("submission", "period", "revenue", "material", "costs", "margin", rounded(F.col("margin_rate"), 6).alias("margin_rate"), "worst")


def m2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.totals(_submitted(spark, sf_dir), MODEL, INPUTS, "margin")


def m3_sensitivities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.sensitivities(_submitted(spark, sf_dir), MODEL, INPUTS, "margin", digits=4)


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market's price of each year, and of an input in every second one."""
    orders = table(spark, sf_dir, "orders")
    per = orders.groupBy(F.year("o_orderdate").alias("period")).agg(F.expr("cast(max(o_totalprice) as bigint) div 100").cast("double").alias("price"))
    return per.withColumn("input_price", F.when(F.col("period") % 2 == 0, F.floor(F.col("price") / 2).cast("double")))


_MARKET_SQL = """mk AS (SELECT period, price, CASE WHEN period % 2 = 0 THEN floor(price / 2) END AS input_price FROM (SELECT year(o_orderdate) AS period, CAST(CAST(trunc(max(o_totalprice)) AS BIGINT) // 100 AS DOUBLE) AS price FROM orders GROUP BY 1)),
a AS (SELECT s.submission, s.period, volume, coalesce(mk.price, s.price) AS price, coalesce(mk.input_price, s.input_price) AS input_price, freight_rate, fixed FROM s LEFT JOIN mk USING (period))"""


def m4_mark_to_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pnl.mark_to_market(_submitted(spark, sf_dir), _market(spark, sf_dir), ["price", "input_price"])
    return got.select("submission", "period", "price", "input_price")


def m5_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _submitted(spark, sf_dir)
    after = pnl.mark_to_market(plan, _market(spark, sf_dir), ["price", "input_price"]).withColumn("volume", F.col("volume") + 10)
    return pnl.shapley(plan, after, MODEL, INPUTS, "margin", digits=1)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text in three columns, numbers or formulas in the lines' columns; each fourth row has formulas, a sixth of them typed over."""
    line = table(spark, sf_dir, "lineitem")
    none, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    row, col = F.col("row"), F.col("col")
    # dealt twice, and each time summed without a further exchange: plain numbers make small rows
    lines = line.select((F.col("l_suppkey") % 20).alias("k"), F.col("l_partkey").cast("int").alias("row"), (F.col("l_linenumber") + 2).alias("col"), "l_quantity")
    parts = -(-line.count() // LINES_OF_A_TASK) or 1
    sheet = F.concat(F.lit("S"), "k").alias("sheet")
    values = lines.repartition(parts, "k", "row").groupBy("k", "row", "col").agg(F.sum("l_quantity").alias("v")).select(sheet, "row", "col", "v")
    rows = lines.select("k", "row").repartition(parts, "k", "row").distinct().select(sheet, "row")
    letter = F.char(65 + col)
    ref = lambda k: F.concat(letter, (row + k).cast("string"))
    span = lambda a, b: F.concat(ref(a), F.lit(":"), ref(b))
    text = (F.when(row % 32 == 3, F.concat(F.lit("="), ref(0), F.lit("*1.05+12+250")))
            .when(row % 32 == 19, F.concat(F.lit("=IF("), ref(1), F.lit("=\"A1\",SUM('S3'!B2:B4),MAX("), span(2, 4), F.lit("))")))
            .when(row % 16 == 7, F.concat(F.lit("='S3'!B5+"), ref(0)))
            .when(row % 32 == 11, F.concat(F.lit("=[1]Book!A1+SUM("), span(-1, 0), F.lit(")")))
            .when(row % 32 == 27, F.concat(F.lit("=SUM("), span(-3, -1), F.lit(")+S4!$B$"), (row + 1).cast("string"), F.lit("+LOG10(7)")))
            .otherwise(F.concat(F.lit("="), ref(1), F.lit("/2"))))
    formula = F.when((row % 4 == 3) & ((row + col) % 6 > 0), text)
    numbers = values.select("sheet", "row", "col", none.alias("v_str"), F.when(formula.isNull(), F.col("v")).alias("v_num"), formula.alias("formula"))
    said = [F.concat(F.lit("G"), row % 3), F.when(row % 7 > 0, F.concat(F.lit("Item "), row % 50)), F.when(row % 5 == 0, F.concat(F.lit("alt "), row))]
    texts = rows.select("sheet", "row", F.explode(F.array(*[F.struct(F.lit(k).alias("col"), t.alias("v_str")) for k, t in enumerate(said)])).alias("c")).filter("c.v_str is not null")
    return numbers.unionByName(texts.select("sheet", "row", "c.*", no_number.alias("v_num"), none.alias("formula")))


_CELLS_SQL = """val AS (SELECT 'S' || (l_suppkey % 20) AS sheet, CAST(l_partkey AS INT) AS "row", l_linenumber + 2 AS col, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
num AS (SELECT *, "row" % 4 = 3 AND ("row" + col) % 6 > 0 AS f FROM val),
txt AS (SELECT sheet, "row", unnest([0, 1, 2]) AS col, unnest(['G' || ("row" % 3), CASE WHEN "row" % 7 > 0 THEN 'Item ' || ("row" % 50) END, CASE WHEN "row" % 5 = 0 THEN 'alt ' || "row" END]) AS t FROM (SELECT DISTINCT sheet, "row" FROM val)),
bst AS (SELECT sheet, arg_max(col, (n, -col)) AS best FROM (SELECT sheet, col, count(DISTINCT t) AS n FROM txt WHERE t IS NOT NULL GROUP BY ALL) GROUP BY sheet),
lab AS (SELECT sheet, "row", arg_min(t, (col <> best, col)) AS label FROM txt JOIN bst USING (sheet) WHERE t IS NOT NULL GROUP BY ALL),
abst AS (SELECT n.sheet, n."row", n.col, CASE n."row" % 32
    WHEN 3 THEN coalesce('[' || a.label || ']', '[row-1]') || '*1.05+12+250'
    WHEN 19 THEN 'IF([row]="A1",SUM(' || CASE WHEN n.sheet = 'S3' THEN '' ELSE 'S3' END || '[' || coalesce(u.label, 'r2') || ' .. ' || coalesce(v.label, 'r4') || ']),MAX([block below]))'
    WHEN 11 THEN '[1]Book[row-' || n."row" || ']+SUM([block above])'
    WHEN 27 THEN 'SUM([' || coalesce(d.label, 'r' || (n."row" - 3)) || ' .. ' || coalesce(b.label, 'r' || (n."row" - 1)) || '])+' || CASE WHEN n.sheet = 'S4' THEN '' ELSE 'S4' END || '[row]+LOG10(7)'
    WHEN 7 THEN seven WHEN 23 THEN seven ELSE '[row]/2' END AS text, CASE n."row" % 32 WHEN 3 THEN '1.05,250' WHEN 27 THEN '7' WHEN 15 THEN '2' WHEN 31 THEN '2' ELSE '' END AS constants
  FROM (SELECT * FROM num WHERE f) n LEFT JOIN lab a ON a.sheet = n.sheet AND a."row" = n."row" - 1 LEFT JOIN lab b ON b.sheet = n.sheet AND b."row" = n."row" - 2
  LEFT JOIN lab d ON d.sheet = n.sheet AND d."row" = n."row" - 4 LEFT JOIN lab c ON c.sheet = 'S3' AND c."row" = 4 LEFT JOIN lab u ON u.sheet = 'S3' AND u."row" = 1 LEFT JOIN lab v ON v.sheet = 'S3' AND v."row" = 3,
  LATERAL (SELECT CASE WHEN n.sheet = 'S3' THEN '' ELSE 'S3' END || '[' || coalesce(c.label, 'row' || CASE WHEN n."row" < 4 THEN '+' ELSE '' END || (4 - n."row")) || ']+' || coalesce('[' || a.label || ']', '[row-1]') AS seven)),
rul AS (SELECT sheet, "row", text AS rule, constants, n, variants FROM (SELECT *, count(*) OVER (PARTITION BY sheet, "row") AS variants, row_number() OVER (PARTITION BY sheet, "row" ORDER BY n DESC, at_col) AS nth
  FROM (SELECT sheet, "row", text, constants, count(*) AS n, min(col) AS at_col FROM abst GROUP BY ALL)) WHERE nth = 1)"""


def _parts(cells: DataFrame) -> int:
    """In how many parts the cells of a table are dealt by row, so that what one task sorts does not grow with the input."""
    return -(-cells.count() // CELLS_OF_A_TASK) or 1


def g1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cut(_cells(spark, sf_dir))
    return formulas.labels(cells, _parts(cells))


def g2_abstracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cut(_cells(spark, sf_dir))
    return _joined(formulas.abstracted(cells, parts=_parts(cells)))


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("constants", F.array_join("constants", ","))


def g3_row_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cut(_cells(spark, sf_dir))
    return _joined(formulas.row_rules(formulas.abstracted(cells, parts=_parts(cells))))


def g3_sheet_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cut(_cells(spark, sf_dir))
    named = cut(formulas.labels(cells, _parts(cells)))
    return formulas.sheet_rules(formulas.row_rules(formulas.abstracted(cells, named, _parts(cells))), named)


def g4_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formulas.dependencies(_cells(spark, sf_dir))


def g5_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formulas.overrides(_cells(spark, sf_dir))


def g6_hidden_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _cells(spark, sf_dir).filter("formula is not null")
    return typed.select("sheet", "row", "col", F.array_join(formulas.hidden_constants(F.col("formula")), ",").alias("constants"))


def m7_override_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is typed over a formula that halves its row's sum."""
    cells = _cells(spark, sf_dir)
    key = [F.col("sheet").alias("submission"), F.col("col").alias("period"), "row"]
    typed = formulas.overrides(cells).select(*key, F.col("v_num").alias("typed"))
    half = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("S"), F.col("l_suppkey") % 20).alias("submission"), F.col("l_partkey").cast("int").alias("row")).agg((F.sum("l_quantity") / 2).alias("by_formula"))
    return pnl.override_gaps(typed, half.join(typed.select("submission", "period", "row"), ["submission", "row"]))


def _budget_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's years as a sheet of values: volume, price and what follows from them; some suppliers miss a value."""
    got = pnl.evaluated(_submitted(spark, sf_dir), MODEL, INPUTS)
    rows = [("volume", "volume", None), ("price", "price", "p"), ("revenue", "revenue", None), ("input_price", "price", "i"), ("material", "cost", "i"), ("freight", "freight", None), ("fixed", "fixed_cost", None), ("margin", "margin", None)]
    value = lambda c: F.when((F.col("submission") % 10 != 3) | (F.col("period") != 1997), F.col(c)).alias("v")
    long = got.select("submission", "period", F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(label).alias("label"), F.lit(d).alias("driver"), F.lit(c).cast("string").alias("concept"), value(label)) for k, (label, d, c) in enumerate(rows)])).alias("x"))
    return long.groupBy("submission", "x.ord", "x.label", "x.driver", "x.concept").agg(F.transform(F.array_sort(F.collect_list(F.struct("period", "x.v"))), lambda s: s["v"]).alias("vals"))


def d2_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formulas.identities(_budget_rows(spark, sf_dir)).withColumn("k", rounded(F.col("k"), 6))


def d3_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _budget_rows(spark, sf_dir)
    marked = rows.select("submission", "label", (F.col("label") == "margin").alias("has_formulas"))
    return formulas.roles(marked, formulas.identities(rows)).select("submission", "label", "role")


def m6_model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _budget_rows(spark, sf_dir)
    formula = F.when(F.col("label") == "margin", "[revenue] - [costs]").when(F.col("label") == "freight", "[1]Book[row-1] * 2")
    found = rows.select("submission", "label", F.when(formula.isNotNull(), "computed").otherwise("input").alias("role"), formula.alias("formula"), F.col("vals").alias("values"))
    return pnl.model_rows(found)


def d4_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets as submissions: their rows' rules, overrides, links, and inputs of the first product that they miss."""
    cells = cut(_cells(spark, sf_dir))
    parts = _parts(cells)
    named = cut(formulas.labels(cells, parts))
    rules = formulas.row_rules(formulas.abstracted(cells, named, parts))
    rows = named.join(rules, ["sheet", "row"], "left").select(
        F.col("sheet").alias("submission"), "label", F.when(F.col("rule").isNull(), "input").otherwise("computed").alias("role"), "constants",
        F.when(F.col("row") % 3 > 0, "t").alias("unit"), F.when(F.col("row") % 4 > 0, "c").alias("concept"))
    typed = formulas.overrides(cells).join(named, ["sheet", "row"]).select(F.col("sheet").alias("submission"), "label")
    links = formulas.references(cells.filter("contains(formula, '[')")).filter("book <> ''").join(named, ["sheet", "row"]).select(F.col("sheet").alias("submission"), "label")
    missing = cells.filter("col = 3 and row = 40").select(F.col("sheet").alias("submission"), F.lit("sulphur").alias("input"))
    return formulas.questions(rows, typed, links, missing)


def d1_period_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's sheet: a note of one year, then a row of month labels (forecasts from 1998), then a part type a row, the last one without label."""
    nation = F.col("c_nationkey")
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    months = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")
    kind = F.substring("o_orderpriority", 1, 1).cast("int")
    values = orders.groupBy(nation.alias("sheet"), (nation % 3 + 3 + kind).alias("row"), months.alias("col"), kind.alias("kind")).agg(F.count("*").cast("double").alias("v_num"))
    none = {"v_str": F.lit(None).cast("string"), "v_num": F.lit(None).cast("double"), "formula": F.lit(None).cast("string"), "number_format": F.lit(None).cast("string")}
    cell = lambda df, **given: df.select("sheet", "row", "col", *[given.get(k, v).alias(k) for k, v in none.items()])
    heads = values.select("sheet", (F.col("sheet") % 3 + 3).alias("row"), "col").distinct()
    label = F.date_format(F.add_months(F.to_date(F.lit("1991-12-01")), F.col("col")), "MMM-yy")
    ahead = F.when(F.col("col") > 72, 'mmm-yy "f"').otherwise("mmm-yy")
    notes = values.select("sheet", F.lit(1).alias("row"), F.lit(0).alias("col")).distinct()
    named = values.filter("kind < 5").select("sheet", "row", F.lit(0).alias("col"), "kind").distinct()
    types = cell(named.withColumn("v_str", F.concat(F.lit("Type "), "kind")), v_str=F.col("v_str"))
    cells = cell(values, v_num=F.col("v_num")).unionByName(cell(heads, v_str=label, number_format=ahead)).unionByName(cell(notes, v_num=F.lit(2024.0))).unionByName(types)
    return formulas.period_table(cells)


YEARS = range(1992, 1999)
_LINES = ["Production (kt)", "Price ($/t)", "Revenue (M$)", "Input price ($/t)", "Input cost (M$)", "Freight ($/t)", "Freight cost (M$)", "Fixed costs (M$)", "Headcount", "Total costs (M$)", "Margin (M$)",
          "Margin rate (%)", "External (M$)"]


def _branch_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's budget: years across (the last a forecast), lines down. Total costs are written in two ways; in a tenth of the sheets they
    refer to the margin, a tenth have a rule of their own, and a fifth have a number typed over a formula."""
    given = _submitted(spark, sf_dir)
    years = given.select("submission").distinct().withColumn("period", F.explode(F.array(*map(F.lit, YEARS))))
    s = years.join(given, ["submission", "period"], "left").fillna(0.0)
    number, col = F.col("submission"), F.col("period") - (YEARS[0] - 1)
    letter = F.char(65 + col)
    at = lambda row: F.concat(letter, F.lit(str(row)))
    said = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    total = (F.when(number % 10 == 7, said("=SUM(", at(8), ":", at(9), ")+", at(12), "*0")).when(number % 2 == 0, said("=SUM(", at(8), ":", at(9), ")+", at(6)))
             .otherwise(said("=", at(6), "+", at(8), "+", at(9))))
    material = said("=", at(2), "*", at(5), "*0.5/1000", F.when(number % 10 == 3, said("+0*", number.cast("string"))).otherwise(""))
    typed = (number % 5 == 0) & (F.col("period") == 1995)
    lines = [(F.col("volume"), None), (F.col("price"), None), (None, said("=", at(2), "*", at(3), "/1000")), (F.col("input_price"), None), (F.when(typed, 7.5), F.when(~typed, material)),
             (F.col("freight_rate"), None), (None, said("=", at(2), "*", at(7), "/1000")), (F.lit(250.0), None), (F.lit(12.0), None), (None, total), (None, said("=", at(4), "-", at(11))),
             (None, said("=IFERROR(", at(12), "/", at(4), ",0)")), (None, said("=[1]Hypotheses!", at(4), "*2"))]
    null, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    cell = lambda row, col, v_str, v_num, formula, fmt: F.struct(
        F.lit(row).alias("row"), col.cast("int").alias("col"), v_str.alias("v_str"), (null if v_num is None else v_num).alias("v_num"), (text if formula is None else formula).alias("formula"), fmt.alias("number_format"))
    across = [cell(0, col, text, F.col("period").cast("double"), None, F.when(F.col("period") == YEARS[-1], '0 "f"').otherwise("0"))]
    across += [cell(k + 1, col, text, v, f, text) for k, (v, f) in enumerate(lines)]
    down = [cell(k, F.lit(0), F.lit(t), None, None, text) for k, t in enumerate(["Budget", *_LINES])]
    sheet = F.concat(F.lit("B"), number.cast("string")).alias("sheet")
    both = s.select(sheet, F.explode(F.array(*across)).alias("c")).unionByName(s.select("submission").distinct().select(sheet, F.explode(F.array(*down)).alias("c")))
    return both.select("sheet", "c.*")


def m1_harvested_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules read from the sheets' formulas, evaluated on the sheets' inputs."""
    cells = cut(_branch_cells(spark, sf_dir))
    rows = cut(pnl.discovered_rows(formulas.period_table(cells), formulas.row_rules(formulas.abstracted(cells))))
    found = pnl.evaluated_sheets(rows)
    return found.select("submission", "label", F.posexplode_outer("vals").alias("pos", "v"), "problem").select(
        "submission", "label", "pos", rounded(F.col("v"), 6).alias("value"), "problem")


QUERIES = {
    f.__name__: f
    for f in (m1_evaluated, m1_harvested_rules, m2_totals, m3_sensitivities, m4_mark_to_market, m5_shapley, m6_model_rows, m7_override_gaps, g1_labels, g2_abstracted, g3_row_rules, g3_sheet_rules, g4_dependencies,
              g5_overrides, g6_hidden_constants, d1_period_table, d2_identities, d3_roles, d4_questions)
}


def _subset(mask: int) -> str:
    """The margin where the inputs of a mask are the later ones."""
    names = {k: f"{'a' if mask >> j & 1 else 's'}.{c}" + (" + 10" if c == "volume" and mask >> j & 1 else "") for j, (k, c) in enumerate(_OWN.items())}
    return "sum(" + _MARGIN.format(**{k: f"({v})" for k, v in names.items()}) + f") AS v{mask}"


def _shapley_sql() -> str:
    """By its definition: the mean, over all orders of the inputs, of what the target gains when the input's turn comes."""
    import itertools

    parts = []
    for j, name in enumerate(_OWN.values()):
        gains = []
        for order in itertools.permutations(range(5)):
            before = sum(1 << x for x in order[: order.index(j)])
            gains.append((before | 1 << j, before))
        counted = {g: gains.count(g) for g in set(gains)}
        total = " + ".join(f"{n} * (v{a} - v{b})" for (a, b), n in sorted(counted.items()))
        parts.append(f"SELECT submission, '{name}' AS input, floor(({total}) / 120.0 * 10 + 0.5) / 10 AS contribution, floor((v31 - v0) * 10 + 0.5) / 10 AS total_change, CAST(0 AS DOUBLE) AS unexplained FROM w")
    return f"WITH {_SUBMITTED_SQL}, {_MARKET_SQL}, w AS (SELECT s.submission, {', '.join(map(_subset, range(32)))} FROM s JOIN a USING (submission, period) GROUP BY 1) " + " UNION ALL ".join(parts)


def _sensitivity_sql() -> str:
    def moved(k: str, by: str) -> str:
        return f"sum({_MARGIN.format(**(_OWN | {k: '(' + _OWN[k] + by + ')'}))})"

    base = f"sum({_MARGIN.format(**_OWN)})"
    parts = " UNION ALL ".join(f"SELECT submission, '{c}' AS input, {moved(k, ' * 1.01')} - {base} AS p, {moved(k, ' + 1')} - {base} AS u FROM s GROUP BY submission" for k, c in _OWN.items())
    return f"""WITH {_SUBMITTED_SQL}, e AS ({parts}), r AS (SELECT submission, input, floor(p * 10000 + 0.5) / 10000 AS per_pct, floor(u * 10000 + 0.5) / 10000 AS per_unit FROM e WHERE abs(p) > 1e-12 OR abs(u) > 1e-12)
SELECT *, row_number() OVER (PARTITION BY submission ORDER BY abs(per_pct) DESC, input) AS rank FROM r"""


#: Identities by trying every signed sum of two to four amounts, then taking them in the order of the targets.
_NEAR = "len(list_filter(range(1, len({a}) + 1), lambda i: abs({a}[i] - {b}) > 0.005 * greatest(abs({a}[i]), abs({b}), 1e-9))) = 0"
_IDENTITIES_SQL = f"""{_SUBMITTED_SQL}, ev AS (SELECT *, volume * price AS revenue, volume * input_price * 0.5 AS material, volume * freight_rate AS freight FROM s),
lg AS (SELECT submission, period, unnest(range(0, 8)) AS ord, unnest(['volume', 'price', 'revenue', 'input_price', 'material', 'freight', 'fixed', 'margin']) AS label, unnest(['volume', 'price', 'revenue', 'price', 'cost', 'freight', 'fixed_cost', 'margin']) AS driver,
  unnest([NULL, 'p', NULL, 'i', 'i', NULL, NULL, NULL]) AS concept, unnest([volume, price, revenue, input_price, material, freight, fixed, revenue - (material + freight + fixed)]) AS v FROM ev),
fu AS (SELECT submission, CAST(ord AS INT) AS ord, label, driver, concept, list(v ORDER BY period) AS x, {_NEAR.format(a="x", b="x[1]")} AS flat FROM lg
  WHERE submission NOT IN (SELECT submission FROM s WHERE period = 1997 AND submission % 10 = 3) GROUP BY ALL HAVING count(*) >= 3),
am AS (SELECT *, list_position(['margin', 'revenue', 'cost', 'fixed_cost', 'freight'], driver) AS prio FROM fu WHERE driver NOT IN ('volume', 'price')),
cb AS (SELECT submission, [ord] AS ords, [label] AS labs, [0] AS sg, x FROM am
  UNION ALL SELECT c.submission, list_append(ords, a.ord), list_append(labs, a.label), list_append(sg, z), list_transform(range(1, len(c.x) + 1), lambda i: c.x[i] + (1 - 2 * z) * a.x[i]) FROM cb c JOIN am a ON a.submission = c.submission AND a.ord > c.ords[-1], (VALUES (0), (1)) t(z) WHERE len(ords) < 4),
ht AS (SELECT t.submission, t.label, array_to_string(list_sort(list_append(labs, t.label)), ',') AS key, array_to_string(list_transform(range(1, len(labs) + 1), lambda i: CASE WHEN sg[i] = 0 THEN '+' ELSE '-' END || '[' || labs[i] || ']'), '') AS expr,
    row_number() OVER (PARTITION BY t.submission ORDER BY len(ords), prio, t.ord, ords, sg) AS nth
  FROM am t JOIN cb c ON c.submission = t.submission AND len(ords) > 1 AND NOT list_contains(labs, t.label) AND NOT flat AND {_NEAR.format(a="t.x", b="c.x[i]")}),
st AS (SELECT DISTINCT submission, CAST(0 AS BIGINT) AS i, ['' ] AS done, [''] AS told, FALSE AS fresh FROM fu
  UNION ALL SELECT st.submission, nth, CASE WHEN NOT list_contains(done, label) AND NOT list_contains(told, key) THEN list_append(done, label) ELSE done END, CASE WHEN NOT list_contains(done, label) AND NOT list_contains(told, key) THEN list_append(told, key) ELSE told END,
    NOT list_contains(done, label) AND NOT list_contains(told, key) FROM st JOIN ht ON ht.submission = st.submission AND nth = i + 1),
sm AS (SELECT ht.submission, ht.label, expr FROM st JOIN ht ON ht.submission = st.submission AND nth = i WHERE fresh),
lf AS (SELECT * FROM am WHERE NOT flat AND (submission, label) NOT IN (SELECT (submission, label) FROM sm)),
pr AS (SELECT t.submission, t.label, v.ord AS o1, p.ord AS o2, '[' || v.label || ']*[' || p.label || ']' AS expr, list_transform(range(1, len(t.x) + 1), lambda i: t.x[i] / v.x[i] / p.x[i]) AS q
  FROM lf t JOIN fu v ON v.submission = t.submission AND v.driver = 'volume' JOIN fu p ON p.submission = t.submission AND p.driver = 'price' AND (t.driver = 'revenue' OR t.concept IS NULL OR t.concept = p.concept)
  WHERE t.driver IN ('revenue', 'cost') AND NOT list_contains(v.x, 0) AND NOT list_contains(p.x, 0)),
pd AS (SELECT submission, label, arg_min(expr, (o1, o2)) AS expr, arg_min(q[1], (o1, o2)) AS k FROM pr WHERE {_NEAR.format(a="q", b="q[1]")} GROUP BY ALL),
ra AS (SELECT t.submission, t.label, '[' || v.label || ']' AS expr, list_transform(range(1, len(t.x) + 1), lambda i: t.x[i] / v.x[i]) AS q FROM lf t JOIN fu v ON v.submission = t.submission AND v.driver = 'volume' AND NOT v.flat
  WHERE t.driver IN ('cost', 'freight') AND NOT list_contains(v.x, 0) AND (t.submission, t.label) NOT IN (SELECT (submission, label) FROM pd)),
kn AS (SELECT submission, label, 'flat' AS kind, 'constant' AS expr, x[1] AS k FROM fu WHERE flat UNION ALL SELECT submission, label, 'sum', expr, NULL FROM sm UNION ALL SELECT submission, label, 'product', expr, k FROM pd
  UNION ALL SELECT submission, label, 'ratio', expr, q[1] FROM ra WHERE {_NEAR.format(a="q", b="q[1]")}),
gr AS (SELECT submission, label, list_transform(range(1, len(x)), lambda i: x[i + 1] / nullif(x[i], 0)) AS q FROM fu WHERE (submission, label) NOT IN (SELECT (submission, label) FROM kn) AND NOT list_contains(x[:-2], 0)),
ids AS (SELECT submission, label, kind, expr, floor(k * 1e6 + 0.5) / 1e6 AS k FROM (SELECT * FROM kn UNION ALL SELECT submission, label, 'growth', 'per period', q[1] - 1 FROM gr WHERE {_NEAR.format(a="q", b="q[1]")}))"""

_M = _MARGIN.format(**_OWN)
ORACLE_SQL = {
    "m1_evaluated": f"""WITH {_SUBMITTED_SQL} SELECT submission, period, volume * price AS revenue, volume * input_price * 0.5 AS material, volume * input_price * 0.5 + volume * freight_rate + fixed AS costs, {_M} AS margin,
  floor(CASE WHEN volume * price <> 0 THEN ({_M}) / (volume * price) END * 1e6 + 0.5) / 1e6 AS margin_rate, greatest(volume * input_price * 0.5, volume * freight_rate) AS worst FROM s""",
    "m2_totals": f"WITH {_SUBMITTED_SQL} SELECT submission, sum({_M}) AS total FROM s GROUP BY 1",
    "m3_sensitivities": _sensitivity_sql(),
    "m4_mark_to_market": f"WITH {_SUBMITTED_SQL}, {_MARKET_SQL} SELECT submission, period, price, input_price FROM a",
    "m5_shapley": _shapley_sql(),
    "m6_model_rows": """SELECT submission, label, CASE WHEN label = 'margin' THEN '[revenue] - [costs]' END AS formula, label <> 'margin' AS is_input
  FROM (SELECT l_suppkey AS submission, bool_or(year(l_shipdate) = 1997) AS y FROM lineitem GROUP BY 1), (SELECT unnest(['volume', 'price', 'revenue', 'input_price', 'material', 'freight', 'fixed', 'margin']) AS label)
  WHERE label = 'margin' OR submission % 10 <> 3 OR NOT y""",
    "m7_override_gaps": f"""WITH {_CELLS_SQL}, sp AS (SELECT sheet, "row", min(col) AS lo, max(col) AS hi FROM num WHERE f GROUP BY ALL)
SELECT sheet AS submission, col AS period, "row", v AS typed, h AS by_formula, v - h AS gap FROM num JOIN sp USING (sheet, "row") JOIN (SELECT sheet, "row", sum(v) / 2 AS h FROM val GROUP BY ALL) USING (sheet, "row") WHERE NOT f AND col > lo AND col < hi""",
    "g1_labels": f'WITH {_CELLS_SQL} SELECT sheet, "row", label FROM lab',
    "g2_abstracted": f'WITH {_CELLS_SQL} SELECT sheet, "row", col, text, constants FROM abst',
    "g3_row_rules": f'WITH {_CELLS_SQL} SELECT * FROM rul',
    "g3_sheet_rules": f"""WITH {_CELLS_SQL}, k AS (SELECT sheet, "row", n, coalesce(label, 'r' || ("row" + 1)) AS label, CASE WHEN "row" % 32 IN (3, 27, 7, 23) AND NOT contains(rule, '[row') THEN coalesce(label, 'r' || ("row" + 1)) || ' = ' || rule ELSE rule END AS rule
  FROM rul LEFT JOIN lab USING (sheet, "row"))
SELECT sheet, rule, count(*) AS rows, CAST(sum(n) AS BIGINT) AS cells, arg_min(label, "row") AS example FROM k GROUP BY ALL""",
    "g4_dependencies": f"""WITH {_CELLS_SQL}, r AS (SELECT sheet, CASE "row" % 32 WHEN 11 THEN '[1]Book' WHEN 27 THEN 'S4' ELSE 'S3' END AS to_sheet FROM num WHERE f AND "row" % 32 IN (7, 23, 11, 19, 27))
SELECT sheet, to_sheet, to_sheet = '[1]Book' AS external, count(*) AS n FROM r WHERE to_sheet <> sheet GROUP BY ALL""",
    "g5_overrides": f"""WITH {_CELLS_SQL}, sp AS (SELECT sheet, "row", min(col) AS lo, max(col) AS hi FROM num WHERE f GROUP BY ALL) SELECT sheet, "row", col, v AS v_num FROM num JOIN sp USING (sheet, "row") WHERE NOT f AND col > lo AND col < hi""",
    "g6_hidden_constants": f'WITH {_CELLS_SQL} SELECT sheet, "row", col, constants FROM abst',
    "d1_period_table": """WITH o AS (SELECT c_nationkey AS sheet, CAST(substr(o_orderpriority, 1, 1) AS INT) AS kind, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS col FROM orders JOIN customer ON o_custkey = c_custkey),
v AS (SELECT sheet, kind, col, CAST(count(*) AS DOUBLE) AS value FROM o GROUP BY ALL)
SELECT sheet, sheet % 3 + 3 + kind AS "row", 'Type ' || kind AS label, col, strftime(DATE '1991-12-01' + to_months(CAST(col AS INT)), '%Y-%m') AS period, value, FALSE AS has_formula, col > 72 AS forecast
FROM (SELECT DISTINCT sheet, kind FROM v WHERE kind < 5) JOIN (SELECT DISTINCT sheet, col FROM v) USING (sheet) LEFT JOIN v USING (sheet, kind, col)""",
    "m1_harvested_rules": f"""WITH {_SUBMITTED_SQL}, y AS (SELECT submission, CAST(unnest(range({YEARS[0]}, {YEARS[-1] + 1})) AS INT) AS period FROM (SELECT DISTINCT submission FROM s)),
g AS (SELECT submission, period, coalesce(volume, 0) AS v, coalesce(price, 0) AS p, coalesce(input_price, 0) AS i, coalesce(freight_rate, 0) AS f FROM y LEFT JOIN s USING (submission, period)),
e AS (SELECT *, v * p / 1000 AS revenue, v * i * 0.5 / 1000 AS material, v * f / 1000 AS freight, v * i * 0.5 / 1000 + v * f / 1000 + 250 AS total FROM g),
l AS (SELECT submission, period, unnest({_LINES[:12]}) AS label, unnest([v, p, revenue, i, material, f, freight, 250, 12, total, revenue - total, coalesce((revenue - total) / nullif(revenue, 0), 0)]) AS value FROM e)
SELECT 'B' || submission AS submission, label, CAST(CASE WHEN bad THEN NULL ELSE period - {YEARS[0]} END AS INT) AS pos, floor(CASE WHEN bad THEN NULL ELSE value END * 1e6 + 0.5) / 1e6 AS value,
  CASE WHEN submission % 10 = 7 THEN 'unknown rows or a cycle: [''Margin (M$)'', ''Margin rate (%)'', ''Total costs (M$)'']' END AS problem
FROM (SELECT *, submission % 10 = 7 AND label NOT IN ('Production (kt)', 'Price ($/t)', 'Input price ($/t)', 'Freight ($/t)', 'Fixed costs (M$)', 'Headcount') AS bad FROM l) WHERE NOT bad OR period = {YEARS[0]}""",
    "d2_identities": f"WITH RECURSIVE {_IDENTITIES_SQL} SELECT * FROM ids",
    "d3_roles": f"""WITH RECURSIVE {_IDENTITIES_SQL} SELECT DISTINCT submission, label, CASE WHEN label = 'margin' THEN 'computed' WHEN kind IN ('sum', 'product', 'ratio') THEN 'computed (identity)' ELSE 'input' END AS role FROM lg LEFT JOIN ids USING (submission, label)""",
    "d4_questions": f"""WITH {_CELLS_SQL}, sp AS (SELECT sheet, "row", min(col) AS lo, max(col) AS hi FROM num WHERE f GROUP BY ALL), lr AS (SELECT lab.*, rule, constants FROM lab LEFT JOIN rul USING (sheet, "row"))
SELECT sheet AS submission, label AS about, 'hidden constant' AS question FROM lr WHERE constants <> ''
UNION SELECT sheet, label, 'typed over a formula' FROM num JOIN sp USING (sheet, "row") JOIN lab USING (sheet, "row") WHERE NOT f AND col > lo AND col < hi
UNION SELECT sheet, label, 'unit' FROM lr WHERE rule IS NULL AND "row" % 3 = 0 UNION SELECT sheet, label, 'concept' FROM lr WHERE rule IS NULL AND "row" % 4 = 0
UNION SELECT sheet, label, 'external link' FROM num JOIN lab USING (sheet, "row") WHERE f AND "row" % 32 = 11 UNION SELECT sheet, 'sulphur', 'expected input' FROM num WHERE col = 3 AND "row" = 40""",
}
