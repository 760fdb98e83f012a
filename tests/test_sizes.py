"""Steps whose rows or memory must not grow faster than their input."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import lineage
from marlstone.jobs import extractions
from marlstone.operators import exposure, formulas, grids, terms, vocabulary


def most_rows(df):
    """The most rows that a step of the job puts out, and the result."""
    rows = df.collect()

    def walk(plan):
        if plan.nodeName() == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if "QueryStage" in plan.nodeName():
            return walk(plan.plan())
        found = plan.metrics().get("numOutputRows")
        kids = plan.children()
        return max([found.get().value() if found.isDefined() else 0, *(walk(kids.apply(k)) for k in range(kids.size()))])

    return walk(df._jdf.queryExecution().executedPlan()), rows


def test_labels_and_concepts_of_the_same_words_do_not_all_meet(spark):
    n = 400
    labels = spark.range(n).selectExpr("id as label_id", "if(id % 2 = 0, 'Large Ring', 'ring large, of the') as label")
    terms = spark.range(n).selectExpr("'large ring' as term", "concat('p', id) as concept_id").union(spark.createDataFrame([("ring", "p7"), ("ring", "x")], "term string, concept_id string"))
    kinds = spark.range(n).selectExpr("concat('p', id) as concept_id", "if(id % 3 = 0, 'product', if(id % 3 = 1, 'input', 'metric')) as kind")
    most, got = most_rows(vocabulary.matched(labels, terms, kinds, ["input", "product"]))
    assert {tuple(r)[1:] for r in got} == {("p1", 1.0, "accept")} and len(got) == n
    assert most < 10 * n  # was n * n


def test_an_id_at_several_labels_and_kinds_takes_the_best_of_all(spark):
    labels = spark.createDataFrame([(1, "ring big x"), (1, "ring"), (2, "ring big x"), (3, "bolt x"), (4, "bolt x y")], "label_id int, label string")
    terms = spark.createDataFrame([("ring", "a"), ("big", "b"), ("ring big", "b"), ("bolt", "c")], "term string, concept_id string")
    kinds = spark.createDataFrame([("a", "input"), ("b", "input"), ("b", "product"), ("c", "input"), ("c", "input")], "concept_id string, kind string")
    got = {(r["label_id"], r["concept_id"], r["score"], r["decision"]) for r in vocabulary.matched(labels, terms, kinds, ["input", "product"]).collect()}
    assert got == {(1, "a", 1.0, "accept"), (2, "b", 0.833, "accept"), (3, "c", 0.75, "accept"), (4, "c", 0.667, "review")}


def test_events_are_dealt_by_incident_not_by_item(spark):
    events = spark.range(3000).selectExpr("id div 2 as incident", "'a' as concept", "if(id % 2 = 0, 'up', 'down') as direction")
    roles = spark.createDataFrame([("a", "sold")], "item string, role string")
    got = exposure.market_effects(events, roles)
    assert {(r["effect"], r["incidents"]) for r in got.collect()} == {("tailwind", 1500), ("headwind", 1500)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan and "SortMergeJoin" not in plan and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("rows", [1, 7, 100])
def test_dealt_keeps_rows_and_makes_parts_by_their_number(spark, rows):
    got = lineage.dealt(spark.range(50), "id", rows=rows)
    assert got.rdd.getNumPartitions() == -(-50 // rows) and got.agg(F.sum("id")).first()[0] == 1225
    assert lineage.dealt(spark.range(0), "id").count() == 0


def test_runs_that_are_no_terms_do_not_reach_the_look_up(spark):
    texts = spark.createDataFrame([(k, "one two three, four " * 200 + "phosphate rock") for k in range(5)], "k int, text string")
    most, got = most_rows(terms.places(texts, ["k"], spark.createDataFrame([("Phosphate Rock",), ("rock",), ("one",)], "term string")))
    assert len(got) == 5 * 202 and most <= 5 * 202  # was 5 * 3,600 runs


def test_large_trees_are_weighed_like_small_ones():
    html_wrapper = pytest.importorskip("marlstone.llm.html_wrapper")

    def tree(labels, word, n=40):
        top = html_wrapper.Block("div", 0, 0)
        top.children = [html_wrapper.Block(label, 0, 1) for label in labels for _ in range(n)]
        for c in top.children:
            c.words, c.size, c.shape = [word], 1, 0
        top.size = 1 + len(top.children)
        return top

    assert html_wrapper._weight(tree("xy", "a"), tree("yx", "b")) == 2 + 40  # was 2 + 80: labels counted without their order
    assert len(html_wrapper._pairs(tree("xy", "a", 150).children, tree("yx", "b", 150).children)) == 150  # was 300, across each other


def test_formulas_meet_labels_once_and_are_read_once(spark):
    """Two ends of a range were two joins of all references, and formulas without references a further reading of all cells."""
    cells = spark.createDataFrame(
        [("s", 1, 0, "a", None, None), ("s", 2, 0, "b", None, None), ("s", 5, 3, None, None, "=SUM(B2:B3)+B2*[1]T!B9-C6"), ("s", 6, 3, None, None, "=7*3"), ("t", 5, 1, None, None, "=s!B3&\"B3\"")],
        "sheet string, row int, col int, v_str string, v_num double, formula string")
    got = formulas.abstracted(cells, formulas.labels(cells))
    assert {(r["sheet"], r["row"], r["text"], tuple(r["constants"])) for r in got.collect()} == {
        ("s", 5, "SUM([a .. b])+[a]*[1]T[row+3]-[row]", ()), ("s", 6, "7*3", ("7", "3")), ("t", 5, 's[b]&"B3"', ())}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1 and "Union" not in plan  # were two and a union


def test_labels_are_dealt_in_as_many_parts_as_the_cells_need(spark):
    cells = spark.range(60).selectExpr("concat('s', id % 2) as sheet", "cast(id as int) as row", "cast(id % 2 as int) as col", "concat('t', id) as v_str", "cast(null as double) as v_num", "cast(null as string) as formula")
    got = formulas.labels(cells, 13)  # was one number for any input
    assert got.rdd.getNumPartitions() == 13 and got.count() == 60


def test_rows_are_asked_about_in_one_reading(spark):
    rows = spark.range(6).selectExpr("id as submission", "concat('r', id) as label", "if(id < 4, 'input', 'computed') as role", "if(id = 5, array('7'), array()) as constants", "if(id = 1, null, 'u') as unit",
                                     "if(id < 2, null, 'c') as concept")
    none = spark.createDataFrame([], "submission bigint, label string")
    got = formulas.questions(rows, none, none, none.withColumnRenamed("label", "input"))
    assert {tuple(r) for r in got.collect()} == {(0, "r0", "concept"), (1, "r1", "unit"), (1, "r1", "concept"), (5, "r5", "hidden constant")}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1  # was read three times


def test_label_columns_are_filled_in_one_order_without_a_join(spark):
    cells = spark.createDataFrame([("s", 0, 0, "head"), ("s", 1, 0, "A"), ("s", 1, 1, "x"), ("s", 2, 1, "Total"), ("s", 3, 4, "far"), ("s", 4, 1, "y"), ("t", 1, 1, "z")], "sheet string, row int, col int, v_str string")
    got = grids.filled_labels(cells.withColumn("v_num", F.lit(None).cast("double")), 1, 2, ["total"])
    assert {tuple(r) for r in got.collect()} == {("s", 1, "A | x"), ("s", 4, "A | y"), ("t", 1, " | z")}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window [") == 1  # cells were read twice, joined and grouped again


def test_lines_and_verified_items_are_put_together_once(spark, monkeypatch):
    calls, made = [], extractions._price_lines
    monkeypatch.setattr(extractions, "_price_lines", lambda *args: calls.append(1) or made(*args))
    with lineage.scratch(spark):
        got = extractions.n5_outlier_items(spark, "/root/testdata/sf0.001")
        assert len(calls) == 1 and all("/cut-" in f for f in got.inputFiles())  # were two, and the prices of three branches
        del calls[:]
        extractions.n9_accounting(spark, "/root/testdata/sf0.001")
        assert len(calls) == 1  # were three
