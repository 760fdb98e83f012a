"""Profit models, formulas and identities on small literal inputs."""

import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import formulas, pnl

MODEL = {"margin": (["revenue", "cost"], lambda r, c: r - c), "revenue": (["volume", "price"], lambda v, p: v * p), "cost": (["volume", "unit"], lambda v, u: v * u),
         "rate": (["margin", "revenue"], pnl.divided)}
INPUTS = ["volume", "price", "unit"]


def _rows(spark, rows):
    return spark.createDataFrame(rows, "submission string, period int, volume double, price double, unit double")


def test_rules_may_need_later_rows_and_division_by_zero_is_null(spark):
    got = {r["period"]: (r["margin"], r["rate"]) for r in pnl.evaluated(_rows(spark, [("a", 1, 10.0, 3.0, 1.0), ("a", 2, 0.0, 3.0, 1.0)]), MODEL, INPUTS).collect()}
    assert got == {1: (20.0, 20 / 30), 2: (0.0, None)}
    with pytest.raises(ValueError, match="cycle"):
        pnl.ordered({"a": (["b"], None), "b": (["a"], None)}, [])


def test_shapley_adds_up_and_unchanged_inputs_get_nothing(spark):
    before, after = _rows(spark, [("a", 1, 10.0, 3.0, 1.0), ("a", 2, 5.0, 2.0, 1.0)]), _rows(spark, [("a", 1, 12.0, 4.0, 1.0), ("a", 2, 5.0, 2.5, 1.0)])
    got = {r["input"]: r["contribution"] for r in pnl.shapley(before, after, MODEL, INPUTS, "margin").collect()}
    # volume: 2 * (mean price 3.5 - unit 1); price: 1 * mean volume 11 + 0.5 * 5
    assert got == {"volume": 5.0, "price": 13.5, "unit": 0.0}


def test_market_values_win_where_there_are_any(spark):
    market = spark.createDataFrame([(1, 9.0), (2, None)], "period int, price double")
    got = {r["period"]: r["price"] for r in pnl.mark_to_market(_rows(spark, [("a", k, 1.0, 3.0, 1.0) for k in (1, 2, 3)]), market, ["price"]).collect()}
    assert got == {1: 9.0, 2: 3.0, 3: 3.0}


def test_identities_of_a_budget(spark):
    volume, price, fixed = [10.0, 20.0, 45.0], [3.0, 5.0, 4.0], [7.0, 7.0, 7.0]
    revenue = [a * b for a, b in zip(volume, price)]
    cost = [0.4 * v for v in volume]
    rows = [("volume", "volume", None, volume), ("price", "price", "p", price), ("sales", "revenue", None, revenue), ("acid", "cost", "i", cost), ("rent", "fixed_cost", None, fixed),
            ("result", "margin", None, [r - c - 7 for r, c in zip(revenue, cost)]), ("other", "unknown", None, [1.0, 5.0, 2.0]), ("gap", "cost", None, [1.0, None, 2.0])]
    table = spark.createDataFrame([("s", k, *r) for k, r in enumerate(rows)], "submission string, ord int, label string, driver string, concept string, vals array<double>")
    found = formulas.identities(table)
    got = {r["label"]: (r["kind"], r["expr"], r["k"]) for r in found.collect()}
    assert got == {"rent": ("flat", "constant", 7.0), "result": ("sum", "+[sales]-[acid]-[rent]", None), "sales": ("product", "[volume]*[price]", 1.0), "acid": ("ratio", "[volume]", pytest.approx(0.4))}
    marked = table.select("submission", "label", (F.col("label") == "result").alias("has_formulas"))
    roles = {r["label"]: r["role"] for r in formulas.roles(marked, found).collect()}
    assert (roles["result"], roles["sales"], roles["rent"], roles["other"]) == ("computed", "computed (identity)", "input", "input")


def _near(a, b):
    return all(abs(x - y) <= 0.005 * max(abs(x), abs(y), 1e-9) for x, y in zip(a, b))


def _plain_identities(rows):
    """By trying everything, a row (label, driver, concept, values) after the other."""
    rank = ["margin", "revenue", "cost", "fixed_cost", "freight", "unknown"]
    values = {r[0]: r[3] for r in rows if len(r[3]) >= 3 and None not in r[3]}
    driver, concept = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    level = lambda v: _near(v, [v[0]] * len(v))
    out = {x: ("flat", "constant") for x, v in values.items() if level(v)}
    told = set()

    def total(t):
        for size in (2, 3, 4):
            for combo in itertools.combinations([x for x in values if x != t and driver[x] in rank], size):
                for signs in itertools.product((1, -1), repeat=size - 1):
                    both = list(zip((1, *signs), combo))
                    rows_of = frozenset((t, *combo))
                    if rows_of not in told and _near(values[t], [sum(s * values[x][k] for s, x in both) for k in range(len(values[t]))]):
                        told.add(rows_of)
                        return "sum", "".join(("+" if s > 0 else "-") + f"[{x}]" for s, x in both)
        return None

    def factor(t):
        volumes = [x for x in values if driver[x] == "volume" and 0 not in values[x]]
        prices = [x for x in values if driver[x] == "price" and 0 not in values[x] and (driver[t] == "revenue" or not concept[t] or concept[x] == concept[t])]
        if driver[t] in ("revenue", "cost", "unknown"):
            for v, p in itertools.product(volumes, prices):
                if level([a / b / c for a, b, c in zip(values[t], values[v], values[p])]):
                    return "product", f"[{v}]*[{p}]"
        if driver[t] in ("cost", "unknown", "freight"):
            for v in volumes:
                if v not in out and level([a / b for a, b in zip(values[t], values[v])]):
                    return "ratio", f"[{v}]"
        return None

    flat = set(out)
    for t in sorted((x for x in values if driver[x] in rank and x not in flat), key=lambda x: rank.index(driver[x])):
        if hit := total(t) or factor(t):
            out[t] = hit
    for t, v in values.items():
        if t not in out and 0 not in v[:-1] and level([b / a for a, b in zip(v, v[1:])]):
            out[t] = ("growth", "per period")
    return out


def _random_sheet(rng, n):
    """Amounts that are sums, products and shares of each other, and others that are not."""
    periods, rows = int(rng.integers(3, 7)), []
    for k in range(n):
        kind = str(rng.choice(["margin", "revenue", "cost", "fixed_cost", "freight", "unknown", "volume", "price", "fx"]))
        v = rng.integers(1, 9000, periods).astype(float)
        made = [np.array(r[3], float) for r in rows if None not in r[3]]
        case = rng.integers(0, 10)
        if case < 4 and len(made) > 3:
            picked = rng.choice(len(made), int(rng.integers(2, 5)), replace=False)
            v = sum(s * made[i] for s, i in zip(rng.choice([1, -1], len(picked)), picked))
        elif case == 4:
            v = np.full(periods, v[0])
        elif case == 5:
            v = v[0] * 1.05 ** np.arange(periods)
        elif case == 6 and len(made) > 1:
            v = 0.3 * made[0] * made[-1]
        rows.append((f"row {k}", kind, str(rng.choice(["a", "b", ""])) or None, [float(x) for x in v] if case < 9 else [float(v[0]), None, 2.0]))
    return rows


def test_identities_are_those_of_trying_everything(spark):
    rng = np.random.default_rng(17)
    sheets = {f"s{k}": _random_sheet(rng, int(rng.integers(4, 15))) for k in range(40)}
    table = spark.createDataFrame([(s, k, *r) for s, rows in sheets.items() for k, r in enumerate(rows)], "submission string, ord int, label string, driver string, concept string, vals array<double>")
    got = collections.defaultdict(dict)
    for r in formulas.identities(table.repartition(5)).collect():
        assert r["label"] not in got[r["submission"]]
        got[r["submission"]][r["label"]] = (r["kind"], r["expr"])
    kinds = collections.Counter()
    for s, rows in sheets.items():
        expected = _plain_identities(rows)
        assert got[s] == expected
        kinds.update(k for k, _ in expected.values())
    assert set(kinds) == {"flat", "sum", "product", "ratio", "growth"} or kinds["sum"] > 20


def test_sums_that_begin_with_nothing(spark):
    rows = [("big", "cost", None, [4e12, 7e12, 1e12]), ("bigger", "cost", None, [4e12, 5e12, 9e12]), ("gap", "margin", None, [0.0, 2e12, -8e12]), ("none", "cost", None, [0.0, 0.0, 0.0]), ("late", "cost", None, [0.0, 0.0, 5.0])]
    table = spark.createDataFrame([("s", k, *r) for k, r in enumerate(rows)], "submission string, ord int, label string, driver string, concept string, vals array<double>")
    got = {r["label"]: (r["kind"], r["expr"]) for r in formulas.identities(table).collect()}
    assert got == _plain_identities(rows) and got["gap"] == ("sum", "+[big]-[bigger]")


def test_a_long_sheet_is_searched_by_joins(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(10**6, 10**9, (120, 4)).astype(float)
    rows = [(f"row {k}", "cost", None, v.tolist()) for k, v in enumerate(base)]
    rows.append(("total", "margin", None, (base[3] - base[50] + base[51] - base[119]).tolist()))
    table = spark.createDataFrame([("s", k, *r) for k, r in enumerate(rows)], "submission string, ord int, label string, driver string, concept string, vals array<double>")
    got = {r["label"]: r["expr"] for r in formulas.identities(table).filter("label = 'total'").collect()}
    assert got == {"total": "+[row 3]-[row 50]+[row 51]-[row 119]"}


CELLS = "sheet string, row int, col int, v_str string, v_num double, formula string"


def _sheets(spark, labels, formulas_):
    cells = [(sheet, r, 0, t, None, None) for sheet, texts in labels.items() for r, t in enumerate(texts) if t]
    return spark.createDataFrame(cells + [(s, r, c, None, None, f) for s, r, c, f in formulas_], CELLS)


def test_formulas_become_rules_over_labels(spark):
    table = _sheets(spark, {"Volumes": ["DAP", "MAP"], "Prices": ["DAP price"], "Revenue": ["DAP revenue", "Total"]},
                    [("Revenue", 0, c, f"=Volumes!{x}1*Prices!{x}2") for c, x in ((1, "B"), (2, "C"), (4, "E"))] + [("Revenue", 1, 1, "=SUM(B1:B1)*1.5+[1]Book!A1")])
    table = table.unionByName(spark.createDataFrame([("Revenue", 0, 3, None, 5.0, None)], CELLS))
    texts = formulas.abstracted(table)
    assert {r["rule"]: r["n"] for r in formulas.row_rules(texts).collect()} == {"Volumes[row]*Prices[row+1]": 3, "SUM([DAP revenue])*1.5+[1]Book[row-1]": 1}
    assert {(r["to_sheet"], r["external"], r["n"]) for r in formulas.dependencies(table).collect()} == {("Volumes", False, 3), ("Prices", False, 3), ("[1]Book", True, 1)}
    assert [(r["col"], r["v_num"]) for r in formulas.overrides(table).collect()] == [(3, 5.0)]
    assert texts.filter("row = 1").first()["constants"] == ["1.5"]


@pytest.mark.parametrize("formula,text", [
    ("=SUM(O!B1:B3)", "SUM(O[oth0 .. oth2])"), ("=SUM(B1:B3)", "SUM([block above])"), ("=SUM(B5:B9)", "SUM([block below])"), ("=SUM(B1:B2)", "SUM([own0 .. own1])"),
    ('=IF(B2="A1",1,0)', 'IF([own1]="A1",1,0)'), ('=B2&"say ""B1"" to A2:A3"', '[own1]&"say ""B1"" to A2:A3"'), ("=[1]Book!A4*2", "[1]Book[row]*2"), ("=[1]Book!A2:A9", "[1]Book[r2 .. r9]"),
    ("='[2]My book'!A3", "[2]My book[row-1]"), ("='It''s a sheet'!$B$2", "It's a sheet[row-2]"), ("=LOG10(B4)+A1B+x.C2", "LOG10([row])+A1B+x.C2"), ("=$B$2:$D$2", "[own1]"), ("=O!B4", "O[row]"), ("=O!B7", "O[row+3]"),
    ("=SUM(O!B7:B8)", "SUM(O[r7 .. r8])"), ("=Données!B1", "Données[row-3]"), ("=1.5E3+2", "1.5E3+2"), ("=#REF!A1", "#REF!A1"), ("5", "5")])
def test_pieces_of_formulas(spark, formula, text):
    table = _sheets(spark, {"S": ["own0", "own1", "own2", "own3"], "O": ["oth0", "oth1", "oth2", "oth3"]}, [("S", 3, 1, formula)])
    assert [r["text"] for r in formulas.abstracted(table).collect()] == [text]


def test_rules_that_are_not_relative_are_their_rows_own(spark):
    table = _sheets(spark, {"S": ["a", "b", "rate", "x", "y", "t", ""]}, [("S", 3, 1, "=B3*2"), ("S", 4, 1, "=B3*2"), ("S", 0, 1, "=O!B1"), ("S", 1, 1, "=O!B2"), ("S", 6, 1, "=B3*2")])
    got = {r["rule"]: (r["rows"], r["example"]) for r in formulas.sheet_rules(formulas.row_rules(formulas.abstracted(table)), formulas.labels(table)).collect()}
    assert got == {"x = [rate]*2": (1, "x"), "y = [rate]*2": (1, "y"), "r7 = [rate]*2": (1, "r7"), "O[row]": (2, "a")}


def test_constants_are_neither_text_nor_names_nor_units(spark):
    table = spark.createDataFrame([('=IF(B2="2024",B1*1.6*48/1000,0)+\'Plan 2025\'!A77+LOG10(3)+1e3',)], "f string")
    assert table.select(formulas.hidden_constants(F.col("f"))).first()[0] == ["1.6", "48", "3"]


def _rule_rows(*sheets):
    return [(s, k, label, text, vals) for s, rows in sheets for k, (label, text, vals) in enumerate(rows)]


RULES = "submission string, ord int, label string, formula string, vals array<double>"
PROFIT = [("Volume (kt)", None, [10.0, 0.0, 2.0]), ("Price.x", None, [3.0, 4.0, None]), ("Margin", "[Revenue]-MAX([Volume (kt)],2)^2/4", None), ("Revenue", "[Volume (kt)]×[Price.x]", None),
          ("Rate", "IFERROR([Margin]/[Revenue],-1)", None), ("All", "SUM([Volume (kt) .. Margin])+ABS(-ROUND([Volume (kt)]/3,1))+MIN([block above])", None)]
EXPECTED = {"Margin": [5.0, -1.0, None], "Revenue": [30.0, 0.0, None], "Rate": [5 / 30, -1.0, -1.0], "All": [10 + 3 + 5 + 3.3 + 5 / 30, 0 + 4 - 1 + 0 - 1, None]}


@pytest.mark.parametrize("most", [0, 16])
def test_rule_texts_in_columns_and_in_arrays(spark, most):
    bad = {"cycle": [("a", "[b]+1", None), ("b", "[a]", None)], "unknown": [("a", "[c]", None)], "self": [("a", "[row]*2", None)], "text": [("a", '"x"', None)], "call": [("a", "IF([i],1,2)", None), ("i", None, [1.0])],
           "open": [("a", "([i]", None), ("i", None, [1.0])], "code": [("a", "__import__('os')", None)]}
    rows = _rule_rows(("one", PROFIT), ("two", PROFIT), *bad.items())
    got = pnl.evaluated_sheets(spark.createDataFrame(rows, RULES), most).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["submission"] in bad:
            assert r["problem"] and (r["label"] == "i" or r["vals"] is None)
        else:
            assert r["problem"] is None and r["vals"] == pytest.approx(EXPECTED.get(r["label"], dict((x, v) for x, _, v in PROFIT)[r["label"]]))


def test_models_of_sheets_leave_out_links_and_gaps(spark):
    head = [("S", 0, c, None, float(y), None, f) for c, y, f in ((1, 2024, "0"), (2, 2025, '0 "f"'))]
    label = [("S", r, 0, t, None, None, None) for r, t in enumerate(["", "v", "w", "gap", "twice", "linked", "v"]) if t]
    body = [("S", 1, 1, None, 1.0, None, None), ("S", 1, 2, None, 2.0, None, None), ("S", 2, 1, None, 5.0, None, None), ("S", 2, 2, None, 6.0, None, None), ("S", 3, 1, None, 5.0, None, None),
            ("S", 4, 1, None, None, "=B2*2+B3", None), ("S", 4, 2, None, 9.0, None, None), ("S", 5, 1, None, None, "=[1]B!A1", None), ("S", 6, 1, None, 7.0, None, None), ("S", 6, 2, None, 7.0, None, None),
            ("S", 8, 1, None, 7.0, None, None)]
    cells = spark.createDataFrame(head + label + body, CELLS + ", number_format string")
    table = formulas.period_table(cells)
    assert {(r["period"], r["forecast"]) for r in table.collect()} == {("2024-01", False), ("2025-01", True)} and table.filter("row = 8").isEmpty()
    rows = pnl.discovered_rows(table, formulas.row_rules(formulas.abstracted(cells)))
    got = {r["label"]: (r["vals"], r["problem"]) for r in pnl.evaluated_sheets(rows).collect()}
    assert got == {"v": ([1.0, 2.0], None), "w": ([5.0, 6.0], None), "twice": ([7.0, 10.0], None)}
