"""Profit models over one row a submission and period: rules as Column functions, evaluated in the order they need.

A model is {row: (rows it needs, function of their Columns)}, written by hand or compiled from rule texts over row labels. Division by zero
and missing values give null, which totals skip.
"""

from __future__ import annotations

import ast
import math
import operator
import re
from collections.abc import Callable
from functools import reduce
from types import SimpleNamespace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.numbers import rounded

Rule = tuple[list[str], Callable[..., Column]]
Model = dict[str, Rule]
KEY = ["submission", "period"]
MOST_CHANGED = 12
EXTERNAL = r"\[\d+\]"


def sum_of(*rows: Column) -> Column:
    return reduce(lambda a, b: a + b, rows)


def divided(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def least_of(*rows: Column) -> Column:
    """The least, null if any is."""
    return F.when(sum_of(*rows).isNotNull(), F.least(*rows))


def greatest_of(*rows: Column) -> Column:
    return F.when(sum_of(*rows).isNotNull(), F.greatest(*rows))


def ordered(model: Model, inputs: list[str]) -> list[str]:
    """The rules' rows so that each comes after those it needs; raises for unknown rows and cycles."""
    known, out = set(inputs), []
    while len(out) < len(model):
        ready = [r for r in model if r not in known and known.issuperset(model[r][0])]
        if not ready:
            raise ValueError(f"unknown rows or a cycle: {sorted(set(model) - known)}")
        known.update(ready)
        out += ready
    return out


def evaluated(rows: DataFrame, model: Model, inputs: list[str]) -> DataFrame:
    """rows (submission, period, inputs and any others) with a column for each rule."""
    for r in ordered(model, inputs):
        needs, rule = model[r]
        rows = rows.withColumn(r, rule(*[F.col(f"`{x}`") for x in needs]))
    return rows


# ---- rules as texts

COLUMNS = SimpleNamespace(
    number=F.lit, divide=divided, power=F.pow, SUM=sum_of, MIN=least_of, MAX=greatest_of, ABS=F.abs, IFERROR=F.coalesce,
    ROUND=lambda x, n=0.0: F.round(x, int(n)))


def _quotient(a: Any, b: Any) -> np.ndarray:
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    return np.divide(a, b, out=np.full(a.shape, np.nan), where=b != 0)


def _power(a: Any, b: Any) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.power(np.asarray(a, float), b)


#: The same over numpy rows of one value a period, where NaN is missing.
ARRAYS = SimpleNamespace(
    number=float, divide=_quotient, power=_power, SUM=sum_of, MIN=lambda *x: reduce(np.minimum, x), MAX=lambda *x: reduce(np.maximum, x),
    ABS=np.abs, IFERROR=lambda x, y: np.where(np.isnan(x), y, x), ROUND=lambda x, n=0.0: np.sign(x) * np.floor(np.abs(x) * 10 ** int(n) + 0.5) / 10 ** int(n))
_INFIX = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul}
_FUNCTIONS = ("SUM", "MIN", "MAX", "ABS", "ROUND", "IFERROR")


class RuleError(ValueError):
    """A rule that is no arithmetic over rows of its sheet."""


def _rows_meant(inner: str, label: str, order: list[str]) -> list[str]:
    """The rows that a bracket of a rule means."""
    at = {x: k for k, x in enumerate(order)}
    if inner == "row":
        raise RuleError(f"{label}: refers to itself")
    if inner in ("block above", "block below"):
        return order[: at[label]] if inner == "block above" else order[at[label] + 1 :]
    ends = [inner] if inner in at else inner.split(" .. ")
    unknown = [x for x in ends if x not in at]
    if unknown or len(ends) > 2:
        raise RuleError(f"{label}: unknown rows {unknown or ends}")
    return order[at[ends[0]] : at[ends[-1]] + 1]


def compiled_rule(text: str, label: str, order: list[str], algebra: SimpleNamespace = COLUMNS) -> Rule:
    """A rule text such as "[volume]*[price]/1000" or "SUM([a .. b])" as (rows it needs, function of them)."""
    meant: list[list[str]] = []

    def name(m: re.Match[str]) -> str:
        meant.append(_rows_meant(m.group(1).strip(), label, order))
        return f"_{len(meant) - 1}_"

    bare = re.sub(r"\[([^\[\]]*)\]", name, text.lstrip("=").replace("^", "**").replace("\u00d7", "*").replace("\u2212", "-"))
    try:
        tree = ast.parse(bare.strip(), mode="eval").body
    except SyntaxError as e:
        raise RuleError(f"{label}: not understood: {text}") from e
    needs = list(dict.fromkeys(x for rows in meant for x in rows))

    def value(node: ast.expr, known: dict[str, Any]) -> Any:
        match node:
            case ast.Constant(value=int() | float() as number):
                return algebra.number(float(number))
            case ast.Name(id=given) if given.strip("_").isdigit() and len(meant[int(given.strip("_"))]) == 1:
                return known[meant[int(given.strip("_"))][0]]
            case ast.UnaryOp(op=ast.USub()):
                return -value(node.operand, known)
            case ast.UnaryOp(op=ast.UAdd()):
                return value(node.operand, known)
            case ast.BinOp(op=ast.Div()):
                return algebra.divide(value(node.left, known), value(node.right, known))
            case ast.BinOp(op=ast.Pow()):
                return algebra.power(value(node.left, known), value(node.right, known))
            case ast.BinOp() if type(node.op) in _INFIX:
                return _INFIX[type(node.op)](value(node.left, known), value(node.right, known))
            case ast.Call(func=ast.Name(id="ROUND"), args=[x, ast.Constant(value=digits)]):
                return algebra.ROUND(value(x, known), digits)
            case ast.Call(func=ast.Name(id=function), keywords=[]) if function in _FUNCTIONS:
                return getattr(algebra, function)(*[v for a in node.args for v in spread(a, known)])
        raise RuleError(f"{label}: not understood: {text}")

    def spread(node: ast.expr, known: dict[str, Any]) -> list[Any]:
        """A range is all its rows."""
        if isinstance(node, ast.Name) and node.id.strip("_").isdigit():
            return [known[x] for x in meant[int(node.id.strip("_"))]]
        return [value(node, known)]

    if algebra is COLUMNS:  # a rule that is not understood is found now, not when it is used
        value(tree, {x: F.lit(1.0) for x in needs})
    return needs, lambda *rows: value(tree, dict(zip(needs, rows, strict=True)))


def compiled(rules: list[tuple[str, str | None]], algebra: SimpleNamespace = COLUMNS) -> tuple[Model, list[str]]:
    """(label, rule text or null) of a sheet in its order -> the model and its inputs."""
    order = [label for label, _ in rules]
    return {label: compiled_rule(text, label, order, algebra) for label, text in rules if text}, [label for label, text in rules if not text]


SHEET = "submission {kind}, ord int, label string, vals array<double>, problem string"


def _sheet_values(sheet: pd.DataFrame) -> pd.DataFrame:
    """The values of one sheet's rows; of a sheet that can't be evaluated, the inputs and the reason."""
    sheet = sheet.sort_values("ord")
    rules = [(x, t if isinstance(t, str) else None) for x, t in zip(sheet["label"], sheet["formula"], strict=True)]
    given = {r.label: np.array([np.nan if v is None else v for v in r.vals], float) for r in sheet.itertuples() if not isinstance(r.formula, str)}
    problem = None
    try:
        model, inputs = compiled(rules, ARRAYS)
        for label in ordered(model, inputs):
            needs, rule = model[label]
            length = max(map(len, given.values()), default=0)
            given[label] = np.broadcast_to(np.asarray(rule(*[given[x] for x in needs]), float), length)
    except (ValueError, TypeError) as e:
        problem = str(e)
    out = sheet[["submission", "ord", "label"]].copy()
    out["vals"] = [[None if np.isnan(v) else float(v) for v in given[x]] if x in given else None for x in sheet["label"]]
    out["problem"] = problem
    return out


def evaluated_sheets(rows: DataFrame, most: int = 16) -> DataFrame:
    """submission, ord, label, vals, problem of sheets that each have rules of their own.

    rows: submission, ord, label (once a sheet), formula (a rule text, null for inputs), vals (one value a period). The rule sets that most sheets share, so
    many at most, are compiled once each to Columns; the other sheets are evaluated one by one in numpy, with the same rules. A cycle, an unknown row or a
    rule that is no arithmetic is the sheet's problem: its computed rows that are not known stay null.
    """
    rules = F.array_sort(F.collect_list(F.struct("ord", "label", "formula")))
    known = F.map_from_entries(F.collect_list(F.struct("label", F.when(F.col("formula").isNull(), F.col("vals")).alias("vals"))))
    sheets = rows.groupBy("submission").agg(rules.alias("rules"), known.alias("known"))
    sheets = sheets.withColumn("signature", F.xxhash64("rules"))
    common = sheets.groupBy("signature").agg(F.count("*").alias("n"), F.min("rules").alias("rules"), F.max("rules").alias("other")).filter("n > 1 and rules = other")
    parts, taken = [], []
    for r in common.orderBy(F.col("n").desc(), "signature").limit(most).collect():
        try:
            model, inputs = compiled([(x["label"], x["formula"]) for x in r["rules"]])
            steps = ordered(model, inputs)
        except ValueError:
            continue  # told sheet by sheet
        taken.append(r["signature"])
        parts.append(_shared_rules(sheets.filter(F.col("signature") == r["signature"]), model, inputs, steps, [(x["ord"], x["label"]) for x in r["rules"]]))
    kind = rows.schema["submission"].dataType.simpleString()
    left = sheets.filter(~F.col("signature").isin(taken)).select("submission", F.explode("rules").alias("r"), "known")
    left = left.select("submission", "r.ord", "r.label", "r.formula", F.col("known")[F.col("r.label")].alias("vals"))
    parts.append(left.groupBy("submission").applyInPandas(_sheet_values, SHEET.format(kind=kind)))
    return reduce(DataFrame.unionByName, parts)


def _shared_rules(sheets: DataFrame, model: Model, inputs: list[str], steps: list[str], order: list[tuple[int, str]]) -> DataFrame:
    """One plan for all sheets of one rule set: a row a period, a column a row of the sheet."""
    length = F.array_max(F.transform(F.map_values("known"), lambda v: F.coalesce(F.size(v), F.lit(0))))
    wide = sheets.select("submission", "known", F.explode(F.sequence(F.lit(0), length - 1)).alias("period"))
    names = {label: f"r{k}" for k, (_, label) in enumerate(order)}
    wide = wide.select("submission", "period", *[F.get(F.col("known")[label], F.col("period")).alias(names[label]) for label in inputs])
    for label in steps:
        needs, rule = model[label]
        wide = wide.withColumn(names[label], rule(*[F.col(names[x]) for x in needs]).cast("double"))
    long = wide.select("submission", "period", F.explode(F.array(*[
        F.struct(F.lit(k).alias("ord"), F.lit(label).alias("label"), F.col(names[label]).alias("v")) for k, label in order])).alias("x"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("period", "x.v"))), lambda s: s["v"])
    return long.groupBy("submission", "x.ord", "x.label").agg(values.alias("vals")).select("submission", "ord", "label", "vals", F.lit(None).cast("string").alias("problem"))


def discovered_rows(table: DataFrame, rules: DataFrame) -> DataFrame:
    """submission, ord, label, formula, vals: the rows of discovered sheets that a model takes. Rows with formulas are computed by their rule, or inputs where it
    links to another book; inputs without a value in some period go.

    table: sheet, row, label, period, value, has_formula (period_table); rules: sheet, row, rule. Of rows with equal labels the first counts.
    """
    per = table.groupBy("sheet", "row", "label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda s: s["value"]).alias("vals"), F.max("has_formula").alias("has_formula"))
    per = per.join(rules.select("sheet", "row", "rule"), ["sheet", "row"], "left")
    formula = F.when(F.col("has_formula") & ~F.regexp_like("rule", F.lit(EXTERNAL)), F.col("rule"))
    per = per.withColumn("formula", formula).filter(F.col("formula").isNotNull() | F.forall("vals", lambda v: v.isNotNull()))
    first = Window.partitionBy("sheet", "label").orderBy("row")
    per = per.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    return per.select(F.col("sheet").alias("submission"), F.col("row").alias("ord"), "label", "formula", "vals")


def totals(rows: DataFrame, model: Model, inputs: list[str], target: str) -> DataFrame:
    """submission, total of a row over all periods."""
    return evaluated(rows, model, inputs).groupBy("submission").agg(F.coalesce(F.sum(target), F.lit(0.0)).alias("total"))


def sensitivities(rows: DataFrame, model: Model, inputs: list[str], target: str, pct: float = 0.01, digits: int = 4) -> DataFrame:
    """submission, input, per_pct, per_unit, rank: what the target's total gains by each input's pct and unit more; inputs without effect go."""
    cases = F.array(*[F.struct(F.lit(i).alias("input"), F.lit(k).alias("kind")) for i in inputs for k in ("pct", "unit")], F.struct(F.lit("").alias("input"), F.lit("base").alias("kind")))
    moved = rows.withColumn("case_", F.explode(cases))

    def changed(i: str) -> Column:
        mine = F.col("case_.input") == i
        return F.when(mine & (F.col("case_.kind") == "pct"), F.col(i) * (1 + pct)).when(mine, F.col(i) + 1).otherwise(F.col(i))

    moved = evaluated(moved.withColumns({i: changed(i) for i in inputs}), model, inputs)
    summed = moved.groupBy("submission", "case_").agg(F.coalesce(F.sum(target), F.lit(0.0)).alias("v"))
    base = F.max(F.when(F.col("case_.kind") == "base", F.col("v"))).over(Window.partitionBy("submission"))  # two rows an input
    effect = summed.withColumn("effect", F.col("v") - base).filter("case_.kind <> 'base'")
    out = effect.groupBy("submission", F.col("case_.input").alias("input")).agg(
        F.max(F.when(F.col("case_.kind") == "pct", F.col("effect"))).alias("p"), F.max(F.when(F.col("case_.kind") == "unit", F.col("effect"))).alias("u"))
    out = out.filter("abs(p) > 1e-12 or abs(u) > 1e-12").select("submission", "input", rounded(F.col("p"), digits).alias("per_pct"), rounded(F.col("u"), digits).alias("per_unit"))
    order = Window.partitionBy("submission").orderBy(F.abs("per_pct").desc(), "input")
    return out.withColumn("rank", F.row_number().over(order).cast("bigint"))


def mark_to_market(rows: DataFrame, market: DataFrame, inputs: list[str]) -> DataFrame:
    """rows with the inputs that market (period, inputs) has for the period; the others as submitted."""
    named = market.select("period", *[F.col(i).alias(f"m_{i}") for i in inputs])
    return rows.join(named, "period", "left").withColumns({i: F.coalesce(f"m_{i}", i) for i in inputs}).drop(*[f"m_{i}" for i in inputs])


def shapley(before: DataFrame, after: DataFrame, model: Model, inputs: list[str], target: str, digits: int = 6) -> DataFrame:
    """submission, input, contribution, total_change, unexplained: the exact split of the target's change, whatever the order of changes.

    Every subset of the inputs is one row of 2 ** n; an input that did not change gets nothing.
    """
    n = len(inputs)
    if n > MOST_CHANGED:
        raise ValueError("too many inputs for an exact split; group them first")
    both = before.select(*KEY, *[F.col(i).alias(f"b_{i}") for i in inputs]).join(after.select(*KEY, *[F.col(i).alias(f"a_{i}") for i in inputs]), KEY)
    masks = both.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
    has = lambda k: F.col("mask").bitwiseAND(1 << k) != 0
    chosen = masks.select(*KEY, "mask", *[F.when(has(k), F.col(f"a_{i}")).otherwise(F.col(f"b_{i}")).alias(i) for k, i in enumerate(inputs)])
    value = evaluated(chosen, model, inputs).groupBy("submission", "mask").agg(F.coalesce(F.sum(target), F.lit(0.0)).alias("v"))
    weight = F.array(*[F.lit(math.factorial(s) * math.factorial(n - s - 1) / math.factorial(n)) for s in range(n)])
    size = F.bit_count("mask")

    def share(k: int) -> Column:
        return F.sum(F.when(has(k), F.get(weight, size - 1) * F.col("v")).otherwise(-F.get(weight, size) * F.col("v")))

    full = (1 << n) - 1
    per = value.groupBy("submission").agg(*[share(k).alias(i) for k, i in enumerate(inputs)],
                                          (F.max(F.when(F.col("mask") == full, F.col("v"))) - F.max(F.when(F.col("mask") == 0, F.col("v")))).alias("total_change"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("input"), F.col(i).alias("c")) for i in inputs]))
    out = per.withColumn("unexplained", F.col("total_change") - sum_of(*map(F.col, inputs))).select("submission", "total_change", "unexplained", each.alias("e"))
    return out.select("submission", "e.input", rounded(F.col("e.c"), digits).alias("contribution"), rounded(F.col("total_change"), digits).alias("total_change"),
                      rounded(F.col("unexplained"), digits).alias("unexplained"))


def model_rows(found: DataFrame) -> DataFrame:
    """Rows of a discovered sheet (submission, label, role, formula, values) that a model takes: computed ones without links to other
    books by their formula, the rest as inputs, if all their values are there."""
    formula = F.when((F.col("role") == "computed") & ~F.regexp_like("formula", F.lit(EXTERNAL)), F.col("formula"))
    full = F.forall("values", lambda v: v.isNotNull())
    return found.withColumn("formula", formula).filter(F.col("formula").isNotNull() | full).select("submission", "label", "formula", F.col("formula").isNull().alias("is_input"))


def override_gaps(overrides: DataFrame, computed: DataFrame) -> DataFrame:
    """submission, period, row, typed, by_formula, gap of the values typed over a formula."""
    return overrides.join(computed, [*KEY, "row"]).select(*KEY, "row", "typed", "by_formula", (F.col("typed") - F.col("by_formula")).alias("gap"))
