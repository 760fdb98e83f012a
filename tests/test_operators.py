"""The library's own operators on small literal inputs."""

import datetime as dt

from marlstone.operators import news, series

PRICE = "product string, location string, incoterm string, date date, low double, high double, mid double"


def _prices(spark, rows):
    return spark.createDataFrame([("a", "x", "f", dt.date.fromisoformat(d), m, m, m) for d, m in rows], PRICE)


def test_price_move_needs_two_months_and_takes_the_first_peak(spark):
    p = _prices(spark, [("2026-01-05", 160.0), ("2026-02-05", 260.0), ("2026-03-05", 260.0), ("2026-04-05", 240.0)])
    row = series.price_move(series.monthly_means(p)).first()
    assert (row["pct"], row["peak_month"], row["n_months"]) == (50.0, "2026-02", 4)
    assert series.price_move(series.monthly_means(_prices(spark, [("2026-01-05", 1.0)]))).count() == 0


def test_outlier_guard_uses_the_upper_median(spark):
    row = series.outliers(_prices(spark, [("2026-01-01", v) for v in (1.0, 2.0, 3.0, 10.0)])).first()
    assert (row["n"], row["median"], row["n_outliers"]) == (4, 3.0, 2)


def test_naive_rank_skips_months_without_a_neighbour(spark):
    p = _prices(spark, [("2026-01-01", 1.0), ("2026-03-01", 2.0), ("2026-04-01", 3.0)])
    assert [r["month"] for r in series.naive_rank(series.monthly_means(p)).collect()] == ["2026-04"]


def test_mentions_take_whole_terms_in_any_case(spark):
    a = spark.createDataFrame([(1, "Urea, urea-ammonia UREAS"), (2, None), (3, "")], "article_id long, text string")
    t = spark.createDataFrame([("urea", "u"), ("ammonia", "n")], "term string, concept_id string")
    got = {(r["article_id"], r["concept_id"]): r["n"] for r in news.mentions(a, t, ["urea", "ammonia"]).collect()}
    assert got == {(1, "u"): 2, (1, "n"): 1}


def test_multiset_diff_is_symmetric_and_drops_zeros(spark):
    a = spark.createDataFrame([("s", 1.0), ("s", 1.0), ("s", 0.0), ("s", 2.5)], "sheet string, value double")
    b = spark.createDataFrame([("s", 1.0), ("s", 2.5), ("s", 9.0)], "sheet string, value double")
    x, y = news.multiset_diff(a, b).first(), news.multiset_diff(b, a).first()
    assert (x["n_ours"], x["n_stored"], x["n_common"]) == (3, 3, 2) == (y["n_stored"], y["n_ours"], y["n_common"])


def test_reachability_survives_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src int, dst int")
    got = {(r["src"], r["dst"]): r["steps"] for r in news.reachable(e).collect()}
    assert got[1, 3] == 2 and got[1, 1] == 3 and len(got) == 9


def test_reachability_has_no_limit(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(10)], "src int, dst int")
    got = {(r["src"], r["dst"]): r["steps"] for r in news.reachable(e).collect()}
    assert len(got) == 55 and got[0, 10] == 10


def test_reachability_shuffles_no_pair_twice(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(12)], "src int, dst int")
    sc, name = spark.sparkContext, "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, -1)  # pairs that are too many to be sent
    sc.setJobGroup("reachable", "")
    try:
        pairs = news.reachable(e).count()
        tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
        stages = {s for j in tracker.getJobIdsForGroup("reachable") for s in tracker.getJobInfo(j).stageIds}
        rows = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    finally:
        spark.conf.set(name, before)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert pairs == 78 and rows < 3 * pairs
