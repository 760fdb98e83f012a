"""Formulas of sheets to rules, and what a budget's pasted values say: labels, dependencies, overrides, identities, questions.

Cells are (sheet, row, col, v_str, v_num, formula, number_format), counted from 0; only period tables need the last one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.lineage import cut
from marlstone.operators.grids import FORECAST, period

LABEL_COLUMNS = 6
_SIGN = r"[\p{L}\p{N}_.]"
_CELL = r"\$?[A-Za-z]{1,3}\$?\d+"
#: A cell or a range as one piece, with its sheet and book: a name followed by a bracket is a function, text in double quotes is none.
_REFERENCE = rf"(?<![\p{{L}}\p{{N}}_.\]#!])((?:(?:\[\d+\])?(?:{_SIGN}+|'(?:[^']|'')+')!)?{_CELL}(?::{_CELL})?)(?![\p{{L}}\p{{N}}_.(!])"
#: The pieces of a formula in their order: text, reference (group 1), name or number, any other sign. Joined, they are the formula.
PIECE = rf'"(?:[^"]|"")*"|{_REFERENCE}|{_SIGN}+|[\s\S]'
#: Numbers in formulas that scale or convert units and are no assumptions.
UNIT_FACTORS = ["1", "10", "100", "1000", "1000000", "1e3", "1e6", "0.001", "12", "0"]
#: How near values must be in every period, the most rows of a sum, and which row an equation is about.
REL_TOL, MAX_TERMS = 0.005, 4
PRIORITY = ["margin", "revenue", "cost", "fixed_cost", "freight", "unknown"]


def labels(cells: DataFrame, parts: int | None = None) -> DataFrame:
    """sheet, row, label: of the first columns the one with most different texts names the rows, the leftmost of equal ones; others fill its gaps.

    Texts are dealt by row before they are sorted, in so many parts if a number is given.
    """
    texts = cells.filter((F.col("col") < LABEL_COLUMNS) & F.col("v_str").isNotNull() & F.col("formula").isNull())
    best = texts.groupBy("sheet", "col").agg(F.count_distinct("v_str").alias("n")).groupBy("sheet").agg(F.max_by("col", F.struct("n", -F.col("col"))).alias("best"))
    return dealt_rows(texts.join(best, "sheet"), parts).groupBy("sheet", "row").agg(F.min_by("v_str", F.struct((F.col("col") != F.col("best")).alias("other"), "col")).alias("label"))


def dealt_rows(df: DataFrame, parts: int | None) -> DataFrame:
    return df.repartition("sheet", "row") if parts is None else df.repartition(parts, "sheet", "row")


def pieces(formula: Column, group: int = 0) -> Column:
    """The pieces of a formula, without the equals sign it starts with; group 1 gives the references, and "" for other pieces."""
    return F.regexp_extract_all(F.regexp_replace(formula, "^=", ""), F.lit(PIECE), F.lit(group))


def _read(cells: DataFrame) -> DataFrame:
    """references(), and one row without a reference (ref, pos and what follows are null) of each formula that has none."""
    refs = F.transform(pieces(F.col("formula"), 1), lambda x, k: F.struct(k.alias("pos"), x.alias("ref")))
    each = cells.filter("formula is not null").select("sheet", "row", "col", "formula", F.explode_outer(F.filter(refs, lambda x: x["ref"] != "")).alias("r"))
    each = each.select("sheet", "row", "col", "formula", "r.pos", "r.ref")
    prefix = F.regexp_replace(F.regexp_extract("ref", "^(.*)!", 1), "^'|'$", "")
    # the book stands before the quoted name or inside the quotes
    book = F.regexp_extract(prefix, r"^(\[\d+\])", 1)
    name = F.replace(F.regexp_replace(F.regexp_replace(prefix, r"^\[\d+\]", ""), "^'", ""), F.lit("''"), F.lit("'"))
    rows = F.transform(F.regexp_extract_all(F.substring_index("ref", "!", -1), F.lit(r"(\d+)"), F.lit(1)), lambda r: r.cast("int") - 1)
    each = each.withColumns({"book": book, "rows_": rows, "to_sheet": F.coalesce(F.nullif(name, F.lit("")), "sheet")})
    return each.withColumns({"first_row": F.array_min("rows_"), "last_row": F.array_max("rows_")}).drop("rows_")


def references(cells: DataFrame) -> DataFrame:
    """sheet, row, col, formula, and each reference in order: pos (of its piece), ref, book ("" or "[1]"), to_sheet, first_row, last_row."""
    return _read(cells).filter("ref is not null")


def abstracted(cells: DataFrame, named: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """sheet, row, col, text, constants: formulas with the rows' labels in place of references.

    A reference into the formula's own row is [row], into another row its label, or [row+k] without one or in another book; a range over rows is
    [a .. b] (r7 for a row without label, or in another book), and [block above] or [block below] where it ends just above or starts
    just below the formula, whatever its other end. Other sheets and books stand before the bracket. Text in quotes stays. constants: the numbers of
    the formula that convert no units. named: the labels, if they are there already.

    cells and labels are read once: the one or two ends of all references meet the labels in one join, and the result is dealt by sheet and row, in
    so many parts if a number is given.
    """
    named = (labels(cells, parts) if named is None else named).select(F.col("sheet").alias("known"), F.col("row").alias("at"), "label")
    own = (F.col("book") == "") & (F.col("to_sheet") == F.col("sheet"))
    one = F.col("first_row") == F.col("last_row")
    away = F.col("first_row") - F.col("row")
    fixed = (F.when(one & (away == 0), "row").when(~one & own & (F.col("last_row") == F.col("row") - 1), "block above")
             .when(~one & own & (F.col("first_row") == F.col("row") + 1), "block below"))
    ahead = F.concat(F.when(own, "").otherwise(F.concat("book", "to_sheet")), F.lit("["))
    numbered = lambda row: F.concat(F.lit("r"), (F.col(row) + 1).cast("string"))
    # what stands before the label, the row whose label it is, what stands for a missing one, and what comes after
    end = lambda nth, before, at, instead, after: F.struct(
        (2 * F.col("pos") + nth).alias("nth"), before.alias("before"), at.alias("at"), instead.alias("instead"), F.lit(after).alias("after"))
    no_row = F.lit(None).cast("int")
    ends = (F.when(fixed.isNotNull(), F.array(end(0, ahead, no_row, fixed, "]")))
            .when(one, F.array(end(0, ahead, F.col("first_row"), F.format_string("row%+d", away), "]")))
            .when(F.col("ref").isNotNull(), F.array(end(0, ahead, F.col("first_row"), numbered("first_row"), " .. "), end(1, F.lit(""), F.col("last_row"), numbered("last_row"), "]"))))
    found = _read(cells).select("sheet", "row", "col", "formula", F.when(F.col("book") == "", F.col("to_sheet")).alias("known"), F.explode_outer(ends).alias("end"))
    # labels of other books are not known; what needs no label has no row, and is spread by the formula's
    found = found.select("sheet", "row", "col", "formula", "end.nth", "end.before", "end.instead", "end.after",
                         F.when(F.col("end.at").isNotNull(), F.col("known")).alias("known"), F.coalesce("end.at", "row").alias("at"))
    found = dealt_rows(found.join(named, ["known", "at"], "left"), parts)
    said = F.struct("nth", F.concat("before", F.coalesce("label", "instead"), "after").alias("said"))
    per = found.groupBy("sheet", "row", "col", "formula").agg(F.map_from_entries(F.collect_list(F.when(F.col("nth").isNotNull(), said))).alias("refs"))
    per = per.withColumn("pieces", pieces(F.col("formula")))
    refs = F.col("refs")
    woven = F.array_join(F.transform("pieces", lambda p, k: F.coalesce(F.concat(refs[2 * k], F.coalesce(refs[2 * k + 1], F.lit(""))), p)), "")
    return per.select("sheet", "row", "col", woven.alias("text"), _hidden(F.col("pieces")).alias("constants"))


def row_rules(texts: DataFrame) -> DataFrame:
    """sheet, row, rule, constants, n, variants: the most frequent abstract formula of each row, of equal ones the one that comes first in it."""
    n = texts.groupBy("sheet", "row", "text").agg(F.count("*").alias("n"), F.min("col").alias("at"), F.min("constants").alias("constants"))
    first = Window.partitionBy("sheet", "row").orderBy(F.col("n").desc(), "at")
    ranked = n.withColumns({"nth": F.row_number().over(first), "variants": F.count("*").over(Window.partitionBy("sheet", "row"))})
    return ranked.filter("nth = 1").select("sheet", "row", F.col("text").alias("rule"), "constants", "n", "variants")


def sheet_rules(rules: DataFrame, named: DataFrame) -> DataFrame:
    """sheet, rule, rows and cells that have it, example (the first such row's label). Rules relative to their row count together; another is its row's alone
    and named by it. named: sheet, row, label."""
    label = F.coalesce("label", F.concat(F.lit("r"), (F.col("row") + 1).cast("string")))
    relative = F.regexp_like("rule", F.lit(r"\[(row[\]+-]|block (above|below)\])"))
    keyed = rules.join(named, ["sheet", "row"], "left").withColumn("label", label)
    keyed = keyed.withColumn("rule", F.when(relative, F.col("rule")).otherwise(F.concat("label", F.lit(" = "), "rule")))
    return keyed.groupBy("sheet", "rule").agg(F.count("*").alias("rows"), F.sum("n").alias("cells"), F.min_by("label", "row").alias("example"))


def dependencies(cells: DataFrame) -> DataFrame:
    """sheet, to_sheet, external, n: references from sheet to sheet, and to other books as [1]Sheet."""
    refs = references(cells).select("sheet", F.concat("book", "to_sheet").alias("to_sheet"), (F.col("book") != "").alias("external"))
    return refs.filter("external or to_sheet <> sheet").groupBy("sheet", "to_sheet", "external").agg(F.count("*").alias("n"))


def overrides(cells: DataFrame) -> DataFrame:
    """sheet, row, col, v_num: numbers typed strictly inside the columns that a row's formulas span."""
    span = cells.filter("formula is not null").groupBy("sheet", "row").agg(F.min("col").alias("lo"), F.max("col").alias("hi"))
    typed = cells.filter("formula is null and v_num is not null")
    return typed.join(span, ["sheet", "row"]).filter("col > lo and col < hi").select("sheet", "row", "col", "v_num")


def _hidden(read: Column) -> Column:
    number = lambda p: F.regexp_like(p, F.lit(r"^[0-9]+([.][0-9]+)?$"))
    return F.array_except(F.array_distinct(F.filter(read, number)), F.array(*map(F.lit, UNIT_FACTORS)))


def hidden_constants(formula: Column) -> Column:
    """The whole or decimal numbers written in a formula, outside references and text, that convert no units."""
    return _hidden(pieces(formula))


def period_table(cells: DataFrame, rows: int = 30) -> DataFrame:
    """sheet, row, label, col, period, value, has_formula, forecast: a row for each labelled row below the header and each of its columns.

    The header is the first row, of so many, with two period labels or more; a column is a forecast if the header's number format says so.
    Rows without number or formula under the header go.
    """
    whole = F.when(F.col("v_num") == F.floor("v_num"), F.col("v_num").cast("bigint").cast("string"))
    read = cells.filter(F.col("row") < rows).withColumn("period", period(F.coalesce("v_str", whole))).filter("period is not null and formula is null")
    head = read.groupBy("sheet", "row").count().filter("count >= 2").groupBy("sheet").agg(F.min("row").alias("head"))
    forecast = F.coalesce(F.regexp_like("number_format", F.lit(FORECAST)), F.lit(False))
    columns = read.join(head, "sheet").filter("row = head").select("sheet", "head", "col", "period", forecast.alias("forecast"))
    filled = cells.filter("v_num is not null or formula is not null").select(
        "sheet", "row", "col", F.when(F.col("formula").isNull(), F.col("v_num")).alias("value"), F.col("formula").isNotNull().alias("has_formula"))
    placed = filled.join(columns.select("sheet", "head", "col"), ["sheet", "col"]).filter("row > head")
    kept = placed.select("sheet", "row").distinct().join(labels(cells), ["sheet", "row"])
    grid = kept.join(columns.drop("head"), "sheet").join(placed.drop("head"), ["sheet", "row", "col"], "left")
    return grid.select("sheet", "row", "label", "col", "period", "value", F.coalesce("has_formula", F.lit(False)).alias("has_formula"), "forecast")


# ---- identities on pasted values


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= REL_TOL * F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))


def _all_close(a: Column, b: Column) -> Column:
    return F.forall(F.zip_with(a, b, _close), lambda x: x)


def _constant(vals: Column) -> Column:
    return F.forall(vals, lambda x: _close(x, F.get(vals, F.lit(0))))


def _times(sign: Column, vals: Column) -> Column:
    return F.transform(vals, lambda x: x * sign)


def _sums(terms: DataFrame, size: int) -> DataFrame:
    """submission, ords, labels, signs and vals of the signed sums of so many terms (one or two) in sheet order, under both signs of each."""
    one = terms.withColumn("sign", F.explode(F.array(F.lit(1.0), F.lit(-1.0)))).select(
        "submission", F.array("ord").alias("ords"), F.array("label").alias("labels"), F.array("sign").alias("signs"), _times(F.col("sign"), F.col("vals")).alias("vals"))
    if size == 1:
        return one
    other = one.select("submission", *[F.col(c).alias(f"{c}_") for c in ("ords", "labels", "signs", "vals")])
    both = one.join(other, "submission").filter(F.col("ords")[0] < F.col("ords_")[0])
    return both.select("submission", *[F.concat(c, f"{c}_").alias(c) for c in ("ords", "labels", "signs")], F.zip_with("vals", "vals_", lambda x, y: x + y).alias("vals"))


def _met(targets: DataFrame, terms: DataFrame, size: int) -> DataFrame:
    """submission, label, rank (of the target), ords, labels, signs: all sums of so many terms that are a target, the first with sign plus.

    Half of a sum is taken from the target, and what is left meets the other half, whose terms come later in the sheet, in cells as wide as the target's tolerance
    (rounded up to a power of two) in the period where the target is largest, and in the neighbouring cells; the values of all periods decide.
    """
    first, second = (1, 1) if size == 2 else (2, size - 2)
    sizes = F.transform("t_vals", F.abs)
    tolerance = 1.01 * REL_TOL * F.greatest(F.array_max(sizes), F.lit(1e-9))
    named = targets.select("submission", F.col("label").alias("t"), "rank", F.col("vals").alias("t_vals")).withColumns(
        {"width": F.ceil(F.log2(tolerance)).cast("int"), "at": F.array_position(sizes, F.array_max(sizes)).cast("int")})
    # far beyond any value that could still fit, so that cells are whole numbers
    cell = lambda vals: F.floor(F.least(F.greatest(F.element_at(vals, F.col("at")) / F.pow(F.lit(2.0), F.col("width")), F.lit(-1e15)), F.lit(1e15)))
    halves = named.join(_sums(terms, first).filter(F.col("signs")[0] > 0), "submission").filter(~F.array_contains("labels", F.col("t")))
    halves = halves.withColumn("left", F.zip_with("t_vals", "vals", lambda x, y: x - y)).withColumn("near", cell("left"))
    halves = halves.withColumn("cell", F.explode(F.array(F.col("near") - 1, F.col("near"), F.col("near") + 1)))
    widths = named.select("submission", "width", "at").distinct()
    rest = _sums(terms, second).join(widths, "submission").withColumn("cell", cell("vals")).select(
        "submission", "width", "at", "cell", *[F.col(c).alias(f"{c}_") for c in ("ords", "labels", "signs", "vals")])
    both = halves.join(rest, ["submission", "width", "at", "cell"]).filter(
        (F.array_max("ords") < F.array_min("ords_")) & ~F.array_contains("labels_", F.col("t"))
        & _all_close(F.col("t_vals"), F.zip_with("vals", "vals_", lambda x, y: x + y)))
    return both.select("submission", F.col("t").alias("label"), "rank", *[F.concat(c, f"{c}_").alias(c) for c in ("ords", "labels", "signs")])


def _chosen(found: DataFrame) -> DataFrame:
    """submission, label, expr: each target's first sum, in order of targets, whose rows no target before has told about."""
    order = F.struct("rank", "ords", F.transform("signs", lambda s: -s).alias("turned"), "label", "labels", "signs", F.array_sort(F.concat(F.array("label"), "labels")).alias("rows"))
    each = found.groupBy("submission").agg(F.array_sort(F.collect_list(order)).alias("found"))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<array<string>>").alias("told"), F.filter("found", lambda x: F.lit(False)).alias("hits"))

    def step(state: Column, x: Column) -> Column:
        new = ~F.array_contains(state["done"], x["label"]) & ~F.array_contains(state["told"], x["rows"])
        more = F.struct(F.array_append(state["done"], x["label"]).alias("done"), F.array_append(state["told"], x["rows"]).alias("told"), F.array_append(state["hits"], x).alias("hits"))
        return F.when(new, more).otherwise(state)

    hits = each.select("submission", F.explode(F.aggregate("found", empty, step, lambda state: state["hits"])).alias("h"))
    expr = F.array_join(F.zip_with("h.signs", "h.labels", lambda s, x: F.concat(F.when(s > 0, "+").otherwise("-"), F.lit("["), x, F.lit("]"))), "")
    return hits.select("submission", "h.label", expr.alias("expr"))


def _factors(targets: DataFrame, rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """submission, label, expr, k of targets that are a constant times a row of each kind, the first such rows in sheet order."""
    now = targets.select("submission", "label", F.col("driver").alias("t_driver"), F.col("concept").alias("t_concept"), F.col("vals").alias("rest"), F.array().cast("array<int>").alias("ords"), F.lit("").alias("expr"))
    for kind in kinds:
        factor = rows.filter(F.col("driver") == kind)
        if kinds == ("volume",):
            factor = factor.filter("not flat")
        now = now.join(factor.select("submission", "ord", F.col("label").alias("f"), "concept", "vals"), "submission")
        if kind == "price":  # a cost's price is its own concept's
            now = now.filter((F.col("t_driver") == "revenue") | F.coalesce(F.col("t_concept") == "", F.col("t_concept").isNull()) | F.col("concept").eqNullSafe(F.col("t_concept")))
        quotient = F.zip_with("rest", "vals", lambda x, y: F.try_divide(x, y))
        now = now.filter(F.forall("vals", lambda x: x != 0)).select(
            "submission", "label", "t_driver", "t_concept", quotient.alias("rest"), F.array_append("ords", F.col("ord").cast("int")).alias("ords"), F.concat("expr", F.lit("*["), "f", F.lit("]")).alias("expr"))
    fits = now.filter(_constant(F.col("rest")))
    return fits.groupBy("submission", "label").agg(F.min(F.struct("ords", "expr", F.col("rest")[0].alias("k"))).alias("m")).select(
        "submission", "label", F.substring("m.expr", 2, 1_000_000).alias("expr"), "m.k")


def identities(rows: DataFrame) -> DataFrame:
    """submission, label, kind, expr, k: relations that hold in every period between a submission's rows (label, driver, concept, vals in sheet order ord).

    A row is flat; or an amount is a signed sum of two to four others, k times a volume and a price, or k times a volume; or it grows by
    a constant rate k. Rows of less than three periods, or with gaps, take no part; of rows with equal labels the last counts. Amounts are
    looked at in the order of PRIORITY, and a sum is told about its first row only. Sums of each size are found by joins over what is still unexplained.
    """
    full = rows.filter((F.size("vals") >= 3) & F.forall("vals", lambda v: v.isNotNull() & ~F.isnan(v)))
    last = Window.partitionBy("submission", "label").orderBy(F.col("ord").desc())
    full = full.withColumn("nth_", F.row_number().over(last)).filter("nth_ = 1").withColumn("flat", _constant(F.col("vals")))
    full = cut(full.select("submission", F.col("ord").cast("int").alias("ord"), "label", "driver", "concept", "vals", "flat"))
    out = full.filter("flat").select("submission", "label", F.lit("flat").alias("kind"), F.lit("constant").alias("expr"), F.col("vals")[0].alias("k"))
    place = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("driver"))
    amounts = full.filter(F.col("driver").isin(PRIORITY))
    open_ = amounts.filter("not flat").withColumn("rank", F.struct(place.alias("p"), "ord"))
    for size in range(2, MAX_TERMS + 1):
        hit = cut(_chosen(_met(open_, amounts, size)))
        out = out.unionByName(hit.select("submission", "label", F.lit("sum").alias("kind"), "expr", F.lit(None).cast("double").alias("k")))
        open_ = cut(open_.join(hit, ["submission", "label"], "left_anti"))
    for kind, of, drivers in (("product", ("volume", "price"), ["revenue", "cost", "unknown"]), ("ratio", ("volume",), ["cost", "unknown", "freight"])):
        hit = cut(_factors(open_.filter(F.col("driver").isin(drivers)), full, of))
        out = out.unionByName(hit.select("submission", "label", F.lit(kind).alias("kind"), "expr", "k"))
        open_ = open_.join(hit, ["submission", "label"], "left_anti")
    rest = full.join(out.select("submission", "label"), ["submission", "label"], "left_anti")
    growth = F.zip_with(F.slice("vals", 2, F.size("vals") - 1), F.slice("vals", 1, F.size("vals") - 1), lambda x, y: F.try_divide(x, y))
    growing = rest.withColumn("g", growth).filter(F.forall("g", lambda x: x.isNotNull()) & _constant(F.col("g")))
    return out.unionByName(growing.select("submission", "label", F.lit("growth").alias("kind"), F.lit("per period").alias("expr"), (F.col("g")[0] - 1).alias("k")))


def roles(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (submission, label, has_formulas) with a role: computed, computed (identity), or input. Flat and growing rows are inputs."""
    explained = found.filter("kind in ('sum', 'product', 'ratio')").select("submission", "label", F.lit(True).alias("hit_")).distinct()
    role = F.when(F.col("has_formulas"), "computed").when(F.col("hit_"), "computed (identity)").otherwise("input")
    return rows.join(explained, ["submission", "label"], "left").withColumn("role", role).drop("hit_")


def questions(rows: DataFrame, typed: DataFrame, links: DataFrame, missing: DataFrame) -> DataFrame:
    """submission, about, question: what a submitter is asked, each thing once.

    rows: submission, label, role, constants, unit, concept; typed (overrides) and links (to other books): submission, label; missing: submission, input.
    """
    ask: Callable[..., DataFrame] = lambda df, about, what: df.select("submission", F.col(about).alias("about"), F.lit(what).alias("question"))
    asked = lambda when, what: F.when(when, F.lit(what))
    given = F.col("role") == "input"
    # rows are gone through once for all that is asked about them
    of_rows = F.array_compact(F.array(asked(F.size("constants") > 0, "hidden constant"), asked(given & F.col("unit").isNull(), "unit"), asked(given & F.col("concept").isNull(), "concept")))
    out = rows.select("submission", F.col("label").alias("about"), F.explode(of_rows).alias("question"))
    for df, about, what in ((typed, "label", "typed over a formula"), (links, "label", "external link"), (missing, "input", "expected input")):
        out = out.unionByName(ask(df, about, what))
    return out.distinct()
