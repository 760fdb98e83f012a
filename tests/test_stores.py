"""Stored layers, searches from seeds, and items counted while they are written."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import lineage
from marlstone.operators import extraction, news
from marlstone.sources import stores


@pytest.fixture
def layer(spark, tmp_path):
    return stores.Layer(spark, f"file://{tmp_path}/layer")


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_layer_is_replaced_as_a_whole(spark, layer):
    with pytest.raises(FileNotFoundError):
        layer.read()
    assert _rows(layer.replace(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))) == [(1, "a"), (2, "b")]
    assert layer.replace(spark.createDataFrame([], "k int, v string")).count() == 0  # an emptied layer is empty, and keeps its columns
    assert layer.read().columns == ["k", "v"] and _rows(layer.read(1)) == [(1, "a"), (2, "b")]
    assert _rows(layer.replace(spark.createDataFrame([("other",)], "name string"))) == [("other",)]


def test_a_failed_run_leaves_the_version_before(spark, layer, tmp_path):
    layer.replace(spark.createDataFrame([(1, "a")], "k int, v string"))
    broken = spark.range(1000).repartition(4).select(F.when(F.col("id") == 777, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("int")).cast("int").alias("k"), F.lit("x").alias("v"))
    with pytest.raises(Exception, match="lost"):
        layer.replace(broken)
    assert layer.versions() == [1] and _rows(layer.read()) == [(1, "a")]
    layer.replace(spark.createDataFrame([(2, "b")], "k int, v string"))
    layer.vacuum()
    assert layer.versions() == [2] and _rows(layer.read()) == [(2, "b")]
    assert len([p for p in (tmp_path / "layer").iterdir() if p.name.startswith("v-")]) == 1


def test_of_two_runs_from_one_version_the_second_fails(spark, layer):
    layer.replace(spark.createDataFrame([(1, "a")], "k int, v string"))
    late = stores.Layer(spark, layer.path)
    late.versions = lambda: [0]  # began before the first one ended
    with pytest.raises(Exception, match="exists"):
        late.replace(spark.createDataFrame([(3, "c")], "k int, v string"))
    assert _rows(layer.read()) == [(1, "a")]


def test_upserts_add_what_is_not_there(spark, layer):
    assert _rows(layer.upsert(spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string"), ["k"])) == [(1, "a"), (2, "c")]
    assert _rows(layer.upsert(spark.createDataFrame([(2, "z"), (3, "d")], "k int, v string"), ["k"])) == [(1, "a"), (2, "c"), (3, "d")]


EDGES = [("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d"), ("d", "a"), ("d", "e"), ("z", "a")]


def test_searches_grow_from_their_seeds(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("d",), ("e",), ("nowhere",)], "seed string")
    found = news.searched(edges, seeds)
    assert {(r["seed"], r["node"]): (r["steps"], r["before"]) for r in found.collect()} == {
        ("a", "a"): (0, None), ("a", "b"): (1, "a"), ("a", "x"): (1, "a"), ("a", "c"): (2, "b"), ("a", "d"): (3, "c"), ("a", "e"): (4, "d"),
        ("d", "d"): (0, None), ("d", "a"): (1, "d"), ("d", "e"): (1, "d"), ("d", "b"): (2, "a"), ("d", "x"): (2, "a"), ("d", "c"): (3, "b"), ("e", "e"): (0, None), ("nowhere", "nowhere"): (0, None)}
    ends = spark.createDataFrame([("a", "e"), ("d", "c"), ("e", "a"), ("d", "d")], "seed string, node string")
    assert {(r["seed"], r["node"]): r["path"] for r in news.walked(found, ends).collect()} == {("a", "e"): ["a", "b", "c", "d", "e"], ("d", "c"): ["d", "a", "b", "c"], ("d", "d"): ["d"]}


def test_searches_end_at_their_targets(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("d",)], "seed string")
    targets = spark.createDataFrame([("a", "b"), ("d", "unknown"), ("other", "b")], "seed string, node string")
    found = {(r["seed"], r["node"]) for r in news.searched(edges, seeds, targets).collect()}
    assert {n for s, n in found if s == "a"} == {"a", "b", "x"} and {n for s, n in found if s == "d"} == {"d", "a", "e", "b", "x", "c"}


def test_items_are_counted_while_they_are_written(spark):
    prices = spark.createDataFrame([(str(k), "p", "l", "i", float(v), float(v), ok) for k, (v, ok) in enumerate([(10, True), (11, True), (12, True), (90, True), (1, False)])],
                                   "id string, product string, location string, incoterm string, low double, high double, verified boolean")
    events = spark.createDataFrame([("e1", True), ("e2", False)], "id string, verified boolean")
    marked, kept, counted = extraction.accounted(prices, events)
    assert {tuple(r) for r in counted.collect()} == {("prices", 5, 1, 1), ("events", 2, 1, 0)}
    assert [r["id"] for r in marked.filter("outlier").collect()] == ["3"] and marked.count() == 4 and kept.count() == 1


def test_tables_of_a_scratch_block_go(spark):
    with lineage.scratch(spark):
        kept = lineage.cut(spark.range(5))
        files = kept.inputFiles()
        assert kept.count() == 5 and files
    with pytest.raises(Exception, match="(?i)not.exist|FILE_NOT"):
        spark.read.parquet(files[0]).count()
