"""Values against stored texts: what does not parse, nan, nulls and zeros."""

from marlstone.operators import news


def test_compared_counts_nan_and_unparseable_texts(spark):
    ours = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 0.0), ("a", 2.5), ("b", 3.0)], "sheet string, value double")
    stored = spark.createDataFrame([("a", "1"), ("a", "2.50"), ("a", "nan"), ("a", "n.a."), ("a", None), ("a", "0"), ("c", "4")], "sheet string, value string")
    got = {r["sheet"]: tuple(r)[1:] for r in news.compared(ours, stored).collect()}
    assert got == {
        "a": (3, 3, 2, 1, 66.7, 66.7, "inspect"), "b": (1, 0, 0, 0, 0.0, None, "nothing stored"), "c": (0, 1, 0, 0, None, 0.0, "agree")}
