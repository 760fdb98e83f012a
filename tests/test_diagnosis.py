"""Evidence, scores and paths on small series with known answers."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from marlstone.operators import diagnosis

EDGES = [("p", "MADE_FROM", "i"), ("i", "MADE_FROM", "j"), ("m", "DEPENDS_ON", "f")]


def _series(spark, levels):
    """levels: {concept: value of each month of 2026}; four days a month, wobbling by one in a hundred."""
    rows = [(c, dt.date(2026, k + 1, d), v * (1.01 if d % 2 else 1.0))
            for c, vs in levels.items() for k, v in enumerate(vs) for d in (2, 9, 17, 25)]
    return spark.createDataFrame(rows, "concept string, date date, value double")


def _drivers(spark, s):
    return diagnosis.candidates(spark.createDataFrame(EDGES, "src string, rel string, dst string"), "m", "p", s)


def test_roles_and_the_way_down(spark):
    got = {r["concept"]: (r["role"], r["ord"], r["downstream"]) for r in _drivers(spark, _series(spark, {c: [1.0] for c in "pijf"})).collect()}
    assert got == {"p": ("primary", 0, []), "f": ("direct", 1, []), "i": ("direct", 2, ["p"]), "j": ("propagation", 3, ["i", "p"])}


def test_drivers_far_upstream_are_found(spark):
    e = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(7)] + [("n0", "n2"), ("n3", "n1")], "src string, dst string")
    got = {r["node"]: r["path"] for r in diagnosis.paths(e, spark.createDataFrame([("n0",)], "start string")).collect()}
    assert got["n7"] == ["n0", "n2", "n3", "n4", "n5", "n6", "n7"] and len(got) == 8


def test_evidence_follows_the_definition(spark):
    got = diagnosis.evidence(_series(spark, {"p": [10.0, 10.0, 10.0, 20.0]})).filter("mi = 2026 * 12 + 4 and win = 'month'").first()
    base = [10.0 * (1.01 if d % 2 else 1.0) for _ in range(3) for d in (2, 9, 17, 25)]
    r = [math.log(b / a) for a, b in zip(base, base[1:])]
    sigma = math.sqrt(sum((x - sum(r) / len(r)) ** 2 for x in r) / len(r))
    z = math.log(2) / (sigma * math.sqrt(4))
    assert (got["direction"], got["onset"], got["pct"], got["n"]) == (1, "2026-04-02", 100.0, 4) and abs(got["z"] - z) < 0.01


def test_no_evidence_without_a_baseline_or_with_a_value_that_is_not_positive(spark):
    assert diagnosis.evidence(_series(spark, {"p": [10.0]})).count() == 0
    assert diagnosis.evidence(_series(spark, {"p": [10.0, 10.0, 0.0]})).filter("mi = 2026 * 12 + 3").count() == 0


def test_an_input_that_moved_first_explains_the_product_away(spark):
    s = _series(spark, {"p": [10.0, 10.0, 10.0, 20.0], "i": [5.0, 5.0, 5.0, 15.0], "f": [1.0, 1.0, 1.0, 1.0]})
    ranked = diagnosis.ranking(diagnosis.evidence(s), _drivers(spark, s)).filter("month = '2026-04'").orderBy("rank").collect()
    assert [r["concept"] for r in ranked] == ["i", "p", "f"] and ranked[0]["votes"] > ranked[1]["votes"]


def test_evaluation_by_groups(spark):
    rows = [("a", 0.1, 1), ("a", 0.2, 3), ("b", 0.1, None)]
    got = {(r["driver"], r["size"]): (r["n"], r["top1"], r["top3"], r["mrr"]) for r in
           diagnosis.evaluation(spark.createDataFrame(rows, "driver string, size double, place int")).collect()}
    assert got[None, None] == (3, 0.3333, 0.6667, 0.4444) and got["a", None] == (2, 0.5, 1.0, 0.6667) and len(got) == 5


def _market(seed, shock=None):
    """A made-up market in which ore goes into acid, acid and gas into the product; a shock passes on after two and three weeks."""
    rng, days = np.random.default_rng(seed), 330
    noise = {c: np.cumsum(rng.normal(0, v, days)) for c, v in (("ore", 0.004), ("gas", 0.004), ("acid", 0.002), ("p", 0.002))}
    seen = {c: 1 + rng.normal(0, 0.004, days) for c in noise}

    def own(c):
        return np.exp(noise[c]) * (1 + (shock[2] * (np.arange(days) >= shock[1]) if shock and shock[0] == c else 0))

    late = lambda x, n: np.concatenate((np.full(n, x[0]), x[:-n]))
    price = {"ore": 100 * own("ore"), "gas": 300 * own("gas")}
    price["acid"] = (50 + 1.5 * late(price["ore"], 14)) * own("acid")
    price["p"] = (80 + 0.8 * late(price["acid"], 21) + 0.3 * late(price["gas"], 14)) * own("p")
    first = dt.date(2025, 1, 1)
    return [(c, first + dt.timedelta(k), float(round(x[k] * seen[c][k], 2))) for c, x in price.items() for k in range(days) if (first + dt.timedelta(k)).weekday() in (0, 3)]


MARKET = [("p", "MADE_FROM", "acid"), ("acid", "MADE_FROM", "ore"), ("p", "MADE_FROM", "gas")]


def test_the_whole_diagnosis_finds_injected_shocks(spark):
    base = _market(3)
    series = spark.createDataFrame(base, "concept string, date date, value double")
    drivers = diagnosis.candidates(spark.createDataFrame(MARKET, "src string, rel string, dst string"), "m", "p", series).cache()
    cases, moved, whole = [], [], {}
    for driver in ("ore", "acid", "gas", "p"):
        for month in range(6, 11):
            for size in (0.1, 0.3):
                for onset in (3, 10):
                    case, start = f"{driver}:{month}:{size}:{onset}", (dt.date(2025, month, onset) - dt.date(2025, 1, 1)).days
                    rows = _market(3, (driver, start, size))
                    cases.append((case, driver, f"2025-{month:02d}", size, onset))
                    changed = {c for (c, _, v), (_, _, w) in zip(base, rows) if v != w}
                    whole[case] = rows
                    moved += [(case, *r) for r in rows if r[0] in changed and dt.date(2025, month - 5, 1) <= r[1] < dt.date(2025, month + 1, 1)]
    case_table = spark.createDataFrame(cases, "case_id string, driver string, month string, size double, onset int")
    places = diagnosis.case_places(series, spark.createDataFrame(moved, "case_id string, concept string, date date, value double"), case_table, drivers).cache()
    # each case alone, its whole series diagnosed
    found = {(r["case_id"], r["method"]): r["place"] for r in places.collect()}
    assert len(found) == 4 * len(cases)
    for case, driver, month, *_ in cases[::17]:
        s = spark.createDataFrame([r for r in whole[case] if r[1] < dt.date(2025, int(month[5:]) + 1, 1)], "concept string, date date, value double")
        alone = {r["concept"]: r["rank"] for r in diagnosis.ranking(diagnosis.evidence(s), drivers).filter(F.col("month") == month).collect()}
        assert found[case, "full"] == alone.get(driver)
        naive = {r["concept"]: r["rank"] for r in diagnosis.naive_order(s, month).collect()}
        assert found[case, "naive"] == naive[driver]
    placed = places.join(case_table, "case_id")
    got = {(r["method"], r["driver"], r["size"], r["onset"]): r for r in diagnosis.evaluation(placed, ("driver", "size", "onset"), ("method",)).collect()}
    assert len(got) == 4 * (1 + 4 + 2 + 2)
    overall = {m: got[m, None, None, None] for m in diagnosis.METHODS}
    print({m: (r["n"], r["top1"], r["top3"], r["mrr"]) for m, r in overall.items()})
    assert overall["full"]["n"] == 80 and overall["full"]["top1"] >= 0.85 and overall["full"]["top3"] >= 0.97
    missed = diagnosis.confusions(places, case_table).collect()
    assert sum(r["n"] for r in missed) == sum(p != 1 for (_, m), p in found.items() if m == "full" and p is not None)


def test_requests_are_ranked_as_if_alone(spark):
    s = _series(spark, {"p": [10.0, 10.0, 10.0, 20.0, 10.0], "i": [5.0, 5.0, 5.0, 15.0, 5.0], "j": [2.0, 2.0, 2.0, 6.0, 9.0], "f": [1.0, 1.0, 1.0, 1.0, 3.0], "other": [7.0, 7.0, 7.0, 70.0, 700.0]})
    edges = spark.createDataFrame(EDGES, "src string, rel string, dst string")
    requests = [("m", "p", "2026-04"), ("m", "i", "2026-04"), ("m", "i", "2026-05"), ("other metric", "j", "2026-05"), ("m", "unknown", "2026-05")]
    found = diagnosis.evidence(s).cache()
    got = diagnosis.batch(found, s, edges, spark.createDataFrame(requests, "metric string, product string, month string")).collect()
    for metric, product, month in requests:
        alone = diagnosis.ranking(found, diagnosis.candidates(edges, metric, product, s)).filter(F.col("month") == month).collect()
        mine = [r for r in got if (r["metric"], r["product"], r["month"]) == (metric, product, month)]
        assert sorted(tuple(r)[2:] for r in mine) == sorted(map(tuple, alone))
    assert {(r["metric"], r["product"], r["month"]) for r in got} == set(requests)  # what the metric depends on is ranked even for an unknown product
    assert "other" not in {r["concept"] for r in got}


def test_series_that_are_no_drivers_do_not_make_months_alike(spark):
    s = _series(spark, {"p": [10.0, 10.0, 10.0, 20.0, 10.0, 10.0, 10.0, 10.0, 20.0], "noise": [1.0, 1.0, 1.0, 50.0, 1.0, 1.0, 1.0, 1.0, 1 / 50]})
    drivers, found = _drivers(spark, s), diagnosis.evidence(s)
    near = diagnosis.similarities(diagnosis.of_drivers(found, drivers)).filter("mi = 2026 * 12 + 9 and past = 2026 * 12 + 4").first()
    assert near["similarity"] == 1.0
