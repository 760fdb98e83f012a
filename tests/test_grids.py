"""Cell grids on small literal sheets."""

import datetime as dt

from pyspark.sql import functions as F

from marlstone.operators import grids, replay

CELLS = "sheet string, row int, col int, v_str string, v_num double, fmt string"


def _sheet(spark, last=60.0):
    rows = [("s", 0, 1, "Price", None, None), ("s", 0, 2, None, None, None), ("s", 1, 1, "low", None, None), ("s", 1, 2, "high", None, None),
            ("s", 2, 0, "Year 2025", None, None), ("s", 3, 0, "Sep-25", None, "mmm-yy"), ("s", 4, 0, "Oct-25", None, 'mmm-yy "f"'),
            ("s", 5, 0, "Sum", None, None), ("s", 3, 1, None, 10.0, None), ("s", 3, 2, None, 20.0, None), ("s", 4, 1, None, 20.0, None),
            ("s", 4, 2, None, 40.0, None), ("s", 5, 1, None, 30.0, None), ("s", 5, 2, None, last, None)]
    return spark.createDataFrame(rows, CELLS)


def test_period_labels(spark):
    labels = ["2Q26", "Q3 2025", "Oct-25", "oct 1999", "Jan-70", "2027", "Export total", "Foo-25", "", None]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(labels)], "k int, v string").select("k", grids.period(F.col("v")).alias("p"))
    assert [r["p"] for r in got.orderBy("k").collect()] == [
        "2026-04", "2025-07", "2025-10", "1999-10", "1970-01", "2027-01", None, None, None, None]


def test_cell_names(spark):
    cols = [0, 25, 26, 51, 52, 701, 702, 728, 16383]
    got = spark.createDataFrame([(c,) for c in cols], "c int").select("c", grids.a1(F.lit(4), F.col("c")).alias("a")).orderBy("c").collect()
    assert [r["a"] for r in got] == ["A5", "Z5", "AA5", "AZ5", "BA5", "ZZ5", "AAA5", "ABA5", "XFD5"]


def test_facts_carry_headers_sections_and_status(spark):
    got = {r["cell"]: (r["header"], r["section"], r["label"], r["value"], r["status"]) for r in grids.facts(_sheet(spark), 2, "^Year ").collect()}
    assert got["C4"] == ("Price | high", "Year 2025", "Sep-25", 20.0, "actual")
    assert got["B5"] == ("Price | low", "Year 2025", "Oct-25", 20.0, "forecast") and len(got) == 6


def test_total_rows_must_fit_in_every_column(spark):
    assert [r["row"] for r in grids.total_rows(grids.facts(_sheet(spark), 2, "^Year ")).collect()] == [5]
    assert grids.total_rows(grids.facts(_sheet(spark, 61.0), 2, "^Year ")).count() == 0


def test_anchor_takes_the_nearest_within_reach(spark):
    cells = spark.createDataFrame([("s", r, 0, "Total ", None, None) for r in (3, 20, 90)] + [("t", 200, 0, "total", None, None)], CELLS)
    anchors = spark.createDataFrame([("s", 0, 18, "total"), ("t", 0, 1, "total"), ("u", 0, 1, "total")], "sheet string, col int, row int, text string")
    assert {r["sheet"]: r["offset"] for r in grids.located(cells, anchors).collect()} == {"s": 2, "t": None, "u": None}


def test_anchor_may_move_up_any_number_of_rows(spark):
    cells = spark.createDataFrame([("s", r, 0, "total", None, None) for r in (20, 191)] + [("t", 162, 0, "total", None, None)], CELLS)
    anchors = spark.createDataFrame([("s", 0, 110, "total"), ("t", 0, 101, "total")], "sheet string, col int, row int, text string")
    assert {r["sheet"]: r["offset"] for r in grids.located(cells, anchors).collect()} == {"s": -90, "t": None}


def test_checks_reject_disorder_and_texts(spark):
    cells = spark.createDataFrame(
        [("s", 2, 0, "Oct-25", None, None), ("s", 3, 0, "Sep-25", None, None), ("s", 2, 1, "NM", None, None), ("s", 3, 1, None, 1.0, None)], CELLS)
    checks = {"values": grids.value_check(cells, 2), "order": grids.period_order(cells, 2, "^Year ")}
    got = grids.report(checks).collect()
    assert {(r["check"], r["ok"], r["status"]) for r in got} == {("values", False, "rejected"), ("order", False, "rejected")}


SPEC = dict(spec_id="one", sheet="s", first_row=1, last_row=20, first_col=0, last_col=5, header_rows=[1, 2], label_columns=[0, 1], fill_header=True, fill_labels=True, drop_rows=[4], drop_columns=[5],
            skip_words=["total"], skip_kinds=["region"], subtitles=[(3, 0, "Old"), (5, 1, "North"), (7, 0, "New"), (9, 1, "South")], missing=["NM", "0"], published=dt.date(2024, 6, 1), unit="t",
            anchor_row=1, anchor_col=2, anchor_text="Price", row_dimensions=["group", "item"], column_dimension="year", section_dimension="part", fixed={"source": "x"})
SPECS = """spec_id string, sheet string, first_row int, last_row int, first_col int, last_col int, header_rows array<int>, label_columns array<int>, fill_header boolean, fill_labels boolean, drop_rows array<int>,
drop_columns array<int>, skip_words array<string>, skip_kinds array<string>, subtitles array<struct<row int, level int, name string>>, missing array<string>, published date, unit string, anchor_row int, anchor_col int,
anchor_text string, row_dimensions array<string>, column_dimension string, section_dimension string, fixed map<string,string>"""


def _specs(spark, *changes):
    return spark.createDataFrame([tuple({**SPEC, **c}.values()) for c in changes], SPECS)


def _grid(spark):
    """Everything stands two rows below where the specification says; years are numbers."""
    texts = {(1, 2): "price", (3, 0): "A", (3, 1): "first", (4, 0): "Z", (4, 1): "dropped", (5, 1): "second", (6, 0): "Total x", (6, 1): "third", (7, 1): "fourth", (8, 0): "B", (8, 1): "Asia", (9, 1): "France", (10, 1): "", (10, 2): "NM"}
    numbers = {(2, 2): 2023.0, (2, 3): 2024.0, (2, 4): 2025.5, (2, 5): 1.0, **{(r, c): 10.0 * r + c for r in range(3, 11) for c in range(2, 6) if (r, c) != (10, 2)}, (9, 3): 0.0}
    formats = {(2, 3): '0 "f"', (9, 1): '@ "F"'}
    return spark.createDataFrame([("s", r + 2, c, texts.get((r, c)), numbers.get((r, c)), formats.get((r, c))) for r, c in sorted({*texts, *numbers})], CELLS)


def _replayed(spark, *changes, kinds=None):
    cells = _grid(spark)
    return replay.replayed(cells, replay.placed(_specs(spark, *changes), cells), kinds)


def test_a_specification_is_moved_and_replayed(spark):
    kinds = spark.createDataFrame([("asia", "region"), ("france", "region"), ("France", "country")], "term string, kind string")
    got = {(r["row"] - 2, r["col"]): r for r in _replayed(spark, {}, kinds=kinds).collect()}
    # dropped row 4; skipped: row 6 by its label and row 7 by the one that it takes from it; 8 by its kind; 10 keeps the label above; NM and 0 are missing
    assert set(got) == {(r, c) for r in (3, 5, 9, 10) for c in (2, 3, 4)} - {(9, 3), (10, 2)}
    assert got[3, 2]["header"] == "price | 2023" and got[3, 3]["header"] == "price | 2024" and got[3, 4]["header"] == "price | 2025.5"
    assert [got[r, 4]["labels"] for r in (3, 5, 9, 10)] == [["A", "first"], ["A", "second"], ["B", "France"], ["B", "France"]]
    assert [got[r, 4]["sections"] for r in (3, 5, 9)] == ["Old", "Old | North", "New | South"]
    assert got[3, 2]["dims"] == {"source": "x", "part": "Old", "group": "A", "item": "first", "year": "price | 2023"}
    assert (got[3, 2]["status"], got[3, 3]["status"], got[9, 2]["status"], got[3, 4]["status"]) == ("actual", "forecast", "forecast", "actual")
    assert (got[3, 2]["cell"], got[3, 2]["value"], got[3, 2]["unit"]) == ("C6", 32.0, "t")


def test_headers_that_name_later_years_are_forecasts(spark):
    got = {r["col"]: r["status"] for r in _replayed(spark, {"published": dt.date(2022, 12, 31)}).filter("row = 5").collect()}
    assert got == {2: "forecast", 3: "forecast", 4: "actual"}


def test_blanks_are_not_filled_unless_told(spark):
    got = {(r["row"] - 2, r["col"]): (r["header"], r["labels"]) for r in _replayed(spark, {"fill_header": False, "fill_labels": False, "skip_kinds": [], "published": None}).collect()}
    assert got[3, 3][0] == "2024" and got[5, 2][1] == ["", "second"] and got[7, 2][1] == ["", "fourth"] and (6, 2) not in got


def test_without_its_anchor_a_specification_yields_nothing(spark):
    assert _replayed(spark, {"anchor_text": "Cost"}).count() == 0
    assert [r["offset"] for r in replay.placed(_specs(spark, {"spec_id": "none", "anchor_text": None}, {}), _grid(spark)).collect()] in ([0, 2], [2, 0])
    both = _replayed(spark, {}, {"spec_id": "two", "drop_columns": [2, 3, 5]})
    assert {r["spec_id"] for r in both.collect()} == {"one", "two"} and both.filter("spec_id = 'two' and col < 4").isEmpty()


def test_specifications_are_checked(spark):
    bad = {"unit": {"unit": "stone"}, "sheet": {"sheet": None}, "row": {"header_rows": [0, 1]}, "column": {"label_columns": [0, 9]}, "dims": {"row_dimensions": ["a"]}, "twice": {"column_dimension": "item"}, "drop": {"drop_columns": [0]},
           "sub": {"section_dimension": None}, "name": {"subtitles": [(3, 0, " ")]}, "anchor": {"anchor_text": " "}, "range": {"last_row": 0, "subtitles": [], "header_rows": [], "drop_rows": []}}
    got = {r["spec_id"]: r["problems"] for r in replay.spec_problems(_specs(spark, {}, *[{"spec_id": k, **c} for k, c in bad.items()]), ["t"]).collect()}
    assert got == {"one": "", "unit": "unknown unit", "sheet": "no sheet", "row": "row outside", "column": "column outside", "dims": "label columns and dimensions", "twice": "dimension twice", "drop": "label column dropped",
                   "sub": "subtitles without dimension", "name": "subtitle without name", "anchor": "anchor", "range": "range,no header row"}


def test_filled_labels_take_skipped_rows_too(spark):
    cells = spark.createDataFrame([("s", 1, 0, "A", None, None), ("s", 2, 0, "Total x", None, None), ("s", 3, 1, "v", None, None), ("s", 4, 0, None, 2024.0, None)], CELLS)
    assert [(r["row"], r["labels"]) for r in grids.filled_labels(cells, 1, 1, ["total"]).orderBy("row").collect()] == [(1, "A"), (4, "2024")]


def _checked(spark, cells, kinds=(), **changes):
    specs = _specs(spark, {"anchor_text": None, "fill_labels": False, "skip_words": [], "drop_rows": [], "drop_columns": [], "subtitles": [], "section_dimension": None, "published": None, "first_row": 0, "last_row": 5, "last_col": 3,
                           "header_rows": [0], "label_columns": [0], "row_dimensions": ["item"], **changes})
    grid = spark.createDataFrame([("s", r, c, v if isinstance(v, str) else None, v if not isinstance(v, str) else None, None) for r, row in enumerate(cells) for c, v in enumerate(row) if v is not None], CELLS)
    terms = spark.createDataFrame([(t, k) for t, k in kinds], "term string, kind string")
    return {r["check"]: (r["ok"], r["detail"], r["status"]) for r in replay.checked(grid, replay.placed(specs, grid), terms).collect()}


def test_all_checks_of_a_specification(spark):
    good = [["", "2023", "2024", "2025"], ["Jan-24", 1.0, 2.0, 4.0], ["Feb-24", 2.0, 4.0, 9.0], ["Mar-24", 3.0, 5.0, 1.0], ["Apr-24", 5.0, 7.0, 2.0], ["May-24", 7.0, 1.0, 2.0]]
    got = _checked(spark, good)
    assert all(ok and status == "proposed" for ok, _, status in got.values())
    assert got["values_parse"][1] == "15 numbers, 0 other" and len(got) == 11
    bad = [["", "2024", "2023", "9"], ["Feb-24", 1.0, 2.0, 3.0], ["Jan-24", 2.0, 4.0, 6.0], ["Asia", 3.0, 6.0, 9.0], ["France", "x", "y", 8.0], ["Sum total", 6.0, 12.0, 18.0], ["below", 4.0, None, None]]
    got = _checked(spark, bad, [("Asia", "region"), ("France", "country")], skip_kinds=[])
    assert {c for c, (ok, *_) in got.items() if not ok} == {"values_parse", "column_periods_in_order", "row_periods_in_order", "covers_whole_table", "no_subtotal_labels"}
    assert (got["column_periods_in_order"][1], got["row_periods_in_order"][1], got["covers_whole_table"][1]) == ("2023-01", "2024-01", "1 below, 0 right")
    assert got["no_subtotal_labels"][1] == "1 regions, 1 countries, 1 totals" and {s for *_, s in got.values()} == {"rejected"}


def test_totals_that_are_kept_or_dropped(spark):
    rows = [["", "a", "b", "all"], ["x", 1.0, 2.0, 3.0], ["y", 2.0, 5.0, 7.0], ["z", 4.0, 4.0, 8.0], ["sum", 7.0, 11.0, 18.0], ["w", 9.0, 9.0, 9.0]]
    got = _checked(spark, rows, last_row=4)
    assert got["no_total_rows"][:2] == (False, "5") and got["no_total_columns"][:2] == (False, "D") and got["covers_whole_table"][1] == "3 below, 0 right"
    got = _checked(spark, rows[:5], last_row=4, drop_rows=[4], drop_columns=[3])
    assert all(ok for ok, *_ in got.values())
    got = _checked(spark, rows, drop_rows=[4, 5], drop_columns=[2])
    assert got["dropped_rows_are_totals"][:2] == (False, "6") and got["dropped_columns_are_totals"][:2] == (False, "C")


def test_a_dropped_row_may_sum_its_subtotals(spark):
    rows = [["", "a", "b", "c"], ["Asia", 1.0, 2.0, 4.0], ["x", 5.0, 5.0, 3.0], ["Europe", 2.0, 5.0, 7.0], ["everything", 3.0, 7.0, 11.0], ["y", 1.0, 1.0, 6.0]]
    got = _checked(spark, rows, [("asia", "region"), ("europe", "region")], drop_rows=[4])
    assert got["dropped_rows_are_totals"][0] and got["no_subtotal_labels"][0]
