"""Exposure and audits on small literal inputs."""

from pyspark.sql import functions as F

from marlstone.operators import audits, exposure, news

EVENT = "incident string, concept string, date string, state string"
LANE = "lane_id int, role string, item string, origin string, via array<string>, destination string"


def test_export_lanes_ignore_their_origin(spark):
    lanes = spark.createDataFrame([(1, "export", "dap", "ma", ["sea"], "in"), (2, "supply", "nh3", "tt", None, None)], LANE)
    assert {(r["lane_id"], r["concept"]) for r in exposure.touches(lanes).collect()} == {(1, "sea"), (1, "in"), (2, "tt")}
    events = spark.createDataFrame(
        [("a", "ma", "2026-01-01", "impaired"), ("b", "sea", "2026-01-02", "impaired"), ("b", "in", "2026-01-03", "impaired"),
         ("c", "tt", "2026-01-01", "eased"), ("d", "tt", "2026-01-05", None)], EVENT)
    got = {(r["effect"], r["role"], r["item"]): (r["incidents"], r["first_date"], r["last_date"]) for r in exposure.lane_links(events, lanes).collect()}
    # of incident b's two touches of the link the first counts, the route's, and gives its date
    assert got == {("headwind", "export", "dap"): (1, "2026-01-02", "2026-01-02"), ("tailwind", "supply", "nh3"): (1, "2026-01-01", "2026-01-01"),
                   ("unclear", "supply", "nh3"): (1, "2026-01-05", "2026-01-05")}


def test_numbers_in_text(spark):
    df = spark.createDataFrame([("1 769,9 and 1,769.9, 705.3; 12 345 678",), (None,)], "t string")
    assert [r["n"] for r in df.select(audits.numbers(F.col("t")).alias("n")).collect()] == [[1769.9, 1769.9, 705.3, 12345678.0], None]


def test_unsupported_numbers_equal_a_comparison_of_all(spark):
    answers = [(1, "165.0 and 250, not 1200 in 2026, 9"), (2, "10; 100.9; 101.1; 98.9; 5000"), (3, None), (4, "77")]
    evidence = [(1, "165; 249; 1100"), (2, "10.05; 100; 5050"), (2, "0")]
    got = audits.unsupported_numbers(*(spark.createDataFrame(x, "answer_id int, text string") for x in (answers, evidence)))
    # 2: 101.1 and 98.9 lie beyond 1 % of 100, 5000 lies within 1 % of 5050
    assert {r["answer_id"]: (r["n_checked"], r["n_unsupported"]) for r in got.collect()} == {1: (3, 1), 2: (5, 2), 3: (0, 0), 4: (1, 1)}


def test_quotes_ignore_case_and_spaces_only(spark):
    texts = spark.createDataFrame([(1, "Urea  rose\nto 300"), (2, None)], "article_id int, text string")
    items = spark.createDataFrame([(1, 0, "urea rose TO"), (1, 1, "urea fell"), (1, 2, " "), (2, 0, "x"), (3, 0, None)], "article_id int, item int, quote string")
    assert {(r["article_id"], r["item"]) for r in audits.quotes_found(items, texts).filter("found").collect()} == {(1, 0)}


def test_snapshot_diff_sees_nulls(spark):
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, None), (3, "c"), (4, "d")], [(1, "a"), (2, "b"), (3, None), (5, None)]))
    assert {(r["k"], r["change"]) for r in audits.snapshot_diff(old, new, "k").collect()} == {
        (2, "changed"), (3, "changed"), (4, "removed"), (5, "added")}


def test_mentions_are_found_beyond_any_prefix(spark):
    a = spark.createDataFrame([(1, "x " * 5000 + "urea")], "article_id long, text string")
    t = spark.createDataFrame([("urea", "u")], "term string, concept_id string")
    assert news.mentions(a, t, ["urea"]).count() == 1 and news.mentions(a, t, ["urea"], chars=3000).count() == 0
