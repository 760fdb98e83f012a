"""Vocabulary, entities, extraction, cleaning, exposure and filters on small literal inputs."""

import datetime as dt

from pyspark.sql import functions as F

from marlstone.operators import cleaning, diagnosis, entities, exposure, extraction, filters, vocabulary, workbooks


def test_labels_match_terms_whose_words_they_have(spark):
    labels = spark.createDataFrame([(1, "Coût du soufre"), (2, "Soufre DAP export"), (3, "rien"), (4, None)], "label_id int, label string")
    terms = spark.createDataFrame([("soufre", "sulphur"), ("dap", "dap"), ("the soufre", "brimstone")], "term string, concept_id string")
    kinds = spark.createDataFrame([("sulphur", "input"), ("dap", "product"), ("brimstone", "metric")], "concept_id string, kind string")
    got = {r["label_id"]: (r["concept_id"], r["score"], r["decision"]) for r in vocabulary.matched(labels, terms, kinds, ["input", "product"]).collect()}
    assert got == {1: ("sulphur", 0.75, "accept"), 2: ("sulphur", 0.667, "accept"), 3: (None, 0.0, "unknown"), 4: (None, 0.0, "unknown")}


def test_driver_words_and_units(spark):
    texts = ["Marge brute", "Coûts fixes (M$)", "Prix DAP (USD/t)", "Volume kt", "x"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(vocabulary.driver_type(F.col("t")), vocabulary.unit_of(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("margin", None), ("fixed_cost", "M$"), ("price", "USD/t"), ("volume", None), ("unknown", None)]


def test_every_record_is_in_one_asset(spark):
    records = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "entity_id int, name string")
    assets = spark.createDataFrame([("x", "X", "plant", "s", True, "high", [1, 2]), ("y", "Y", "mine", "t", False, "low", [2, 9])],
                                   "canonical_id string, name string, kind string, site string, controlled boolean, confidence string, members array<int>")
    assert {(r["entity_id"], r["problem"]) for r in entities.partition_problems(records, assets).collect()} == {(2, "duplicated"), (3, "missing"), (9, "unknown")}
    assert {r["canonical_id"]: r["n"] for r in entities.completed(records, assets).collect()} == {"x": 2, "y": 2, "unassigned_3": 1}


def test_prices_are_held_against_their_quote(spark):
    items = spark.createDataFrame([("p1", 1, 300.0, 320.0, "DAP at  300-320"), ("p2", 1, 320.0, 300.0, "dap at 300-320"), ("p3", 1, 300.0, 321.0, "dap at 300-320"), ("p4", 1, 300.0, 320.0, "dap rose"), ("p5", 2, None, 1.0, None)],
                                  "id string, article_id int, low double, high double, quote string")
    articles = spark.createDataFrame([(1, "News. Dap AT 300-320 today")], "article_id int, text string")
    got = {r["id"]: (r["quote_ok"], r["price_ok"]) for r in extraction.priced(extraction.quoted(items, articles)).collect()}
    assert got == {"p1": (True, True), "p2": (True, False), "p3": (True, False), "p4": (False, False), "p5": (False, False)}


def test_dates_that_are_none_are_the_articles(spark):
    rows = [(1, "2026-02-29"), (2, "2026-02-28"), (3, "soon"), (4, None)]
    got = extraction.dated(spark.createDataFrame(rows, "k int, date string").withColumn("published", F.lit("2026-03-01")))
    assert {r["k"]: r["date"] for r in got.collect()} == {1: "2026-03-01", 2: "2026-02-28", 3: "2026-03-01", 4: "2026-03-01"}


def test_scarce_inputs_hurt_and_scarce_products_are_unclear(spark):
    events = spark.createDataFrame([(k, item, d) for k, (item, d) in enumerate((i, d) for i in ("sulphur", "dap") for d in ("up", "disrupted", "down", "restored"))], "incident int, concept string, direction string")
    roles = spark.createDataFrame([("sulphur", "bought"), ("dap", "sold")], "item string, role string")
    got = {(r["item"], r["effect"]): r["incidents"] for r in exposure.market_effects(events, roles).collect()}
    assert got == {("sulphur", "headwind"): 2, ("sulphur", "tailwind"): 2, ("dap", "tailwind"): 1, ("dap", "headwind"): 1, ("dap", "unclear"): 2}


def test_items_reach_products_through_what_is_made_of_them(spark):
    made = spark.createDataFrame([("acid", "sulphur"), ("dap", "acid"), ("loop", "dap"), ("dap", "loop")], "product string, input string")
    items = spark.createDataFrame([("sulphur",), ("dap",)], "item string")
    own = spark.createDataFrame([("dap",)], "product string")
    assert {(r["item"], r["product"]) for r in exposure.reached(items, made, own).collect()} == {("sulphur", "dap"), ("dap", "dap")}


def test_unconfigured_routes_fall_back_to_the_most_quoted(spark):
    day = dt.date.fromisoformat
    prices = spark.createDataFrame([("s", "a", "f", day("2026-01-01"), 1.0), ("s", "b", "f", day("2026-01-01"), 5.0), ("s", "b", "f", day("2026-01-02"), 7.0)], "product string, location string, incoterm string, date date, mid double")
    configured = spark.createDataFrame([("s", "a", "f")], "product string, location string, incoterm string")
    got = exposure.monthly_prices(prices, configured, "2026-01-01", "2026-12-31").collect()
    assert [(r["month"], r["mean"], r["source"]) for r in got] == [("2026-01", 6.0, "most quoted")]


def test_missing_markers_and_months(spark):
    cells = [(1, " nm ", None), (2, None, None), (3, None, 9999.0), (4, "x", None), (5, None, 1.0)]
    got = spark.createDataFrame(cells, "k int, t string, v double").filter(filters.is_missing(F.col("t"), F.col("v"), ["NM", 9999.0]))
    assert sorted(r["k"] for r in got.collect()) == [1, 2, 3]
    days = spark.createDataFrame([(dt.date(2026, 1, 31),), (dt.date(2026, 2, 1),), (dt.date(2025, 2, 1),)], "date date")
    assert filters.in_months(days, ["2026-02", "2026-02"]).count() == 1 and filters.as_of(days, "2026-01-31").count() == 2


def test_cleaning_of_dates_grades_and_headers(spark):
    texts = ["2020-02-29", "31/12/2020", "5 MAR 2021", "20210405", "TBC", "31/02/2020", None]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(cleaning.clean_date(F.col("t"), ["tbc"])).collect()
    assert [r[0] and r[0].isoformat() for r in got] == ["2020-02-29", "2020-12-31", "2021-03-05", "2021-04-05", None, None, None]
    row = spark.range(1).select(cleaning.freight(F.lit("Jorf to Paradip | Weekly")).alias("f"), cleaning.grade(F.lit("NPK 15-15-15")).alias("g")).first()
    assert tuple(row["f"]) == ("Jorf", "Paradip", "weekly") and tuple(row["g"]) == (15, 15, 15)


def test_a_rejected_review_erases_no_label(spark):
    docs = spark.createDataFrame([("a", "sulphur"), ("b", "ammonia"), ("c", None)], "file string, label string").selectExpr("*", "'m' as metric", "'p' as product", "'2025-06' as period")
    assert [r["label"] for r in diagnosis.reviewed_labels(docs).collect()] == ["ammonia"]


def test_changes_of_a_vocabulary(spark):
    concepts, terms, relations = "id string, kind string, name string, definition string", "term string, concept_id string", "src string, rel string, dst string"
    made = lambda c, t, r: {"concepts": spark.createDataFrame(c, concepts), "terms": spark.createDataFrame(t, terms), "relations": spark.createDataFrame(r, relations)}
    old = made([("a", "input", "A", None), ("b", "input", "B", "x"), ("c", None, "C", None)], [("one", "a"), ("two", "b")], [("a", "R", "b")])
    new = made([("a", "input", "A", None), ("b", "product", "B", None), ("d", "site", "D", "y")], [("one", "a"), ("three", "b")], [("b", "R", "a")])
    edges = spark.createDataFrame([("c", "MENTIONS", "z"), ("y", "MENTIONS", "c"), ("y", "MENTIONS", "a")], relations)
    additions = spark.createDataFrame([("more", "c"), ("other", "a")], terms)
    got = {tuple(r) for r in vocabulary.changes(old, new, edges, additions).collect()}
    assert got == {("+", "concept", "d (site)"), ("-", "concept", "c ()"), ("~", "concept", "b.kind: input -> product"), ("~", "concept", "b.definition: x -> nothing"), ("+", "term", "three -> b"), ("-", "term", "two -> b"),
                   ("+", "relation", "b R a"), ("-", "relation", "a R b"), ("!", "edges", "c out MENTIONS: 1"), ("!", "edges", "c in MENTIONS: 1"), ("!", "added term", "more -> c")}


def test_texts_of_a_sheet_by_zone(spark):
    cells = [("s", 0, 0, "A title"), ("s", 1, 0, " note "), ("s", 1, 1, "=x"), ("s", 3, 0, "Country"), ("s", 3, 1, "Jan"), ("s", 3, 2, "Feb"), ("s", 4, 0, "France"), ("s", 5, 0, "Spain"), ("s", 5, 3, "far right"), ("s", 6, 0, "France"), ("t", 0, 0, "only")]
    numbers = [("s", r, c, None) for r in (4, 5, 6) for c in (1, 2)]
    table = spark.createDataFrame([(*c, None if c[3] else 1.0, None) for c in cells + numbers], "sheet string, row int, col int, v_str string, v_num double, formula string")
    got = {r["sheet"]: (r["preamble"], r["header_cells"], r["row_labels"]) for r in workbooks.sheet_lists(table, workbooks.profiles(table)).collect()}
    assert got == {"s": (["A title", "note"], ["Country", "Feb", "Jan"], ["France", "Spain"]), "t": ([], ["only"], [])}
