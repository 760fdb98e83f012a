"""Queries on why prices moved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.lineage import cut
from marlstone.functions.numbers import rounded
from marlstone.operators import diagnosis, series
from marlstone.sources.tables import ASSESSMENTS_SQL, assessments, table

METRIC, PRODUCT = "margin", "ECONOMY"
#: Demonstration graph: what the product is made from and what the metric depends on.
EDGES = [("ECONOMY", "MADE_FROM", "LARGE"), ("LARGE", "MADE_FROM", "MEDIUM"), ("ECONOMY", "MADE_FROM", "PROMO"),
         ("margin", "DEPENDS_ON", "SMALL"), ("margin", "DEPENDS_ON", "freight"), ("freight", "DEPENDS_ON", "STANDARD"),
         ("PROMO", "MADE_FROM", "sulphur"), ("LARGE", "MADE_FROM", "gas"), ("margin", "DEPENDS_ON", "fx"),
         ("LARGE", "TRANSITS", "suez"), ("LARGE", "TRANSITS", "cape"), ("SMALL", "TRANSITS", "suez")]
#: Demonstration ratios of a proxy margin.
RATIOS = [("ECONOMY", 1.0), ("LARGE", -0.5), ("PROMO", -0.25)]


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means with injected moves: an input jumps in every fifth month, the input of that input a month earlier; so does a series that is no driver."""
    daily = series.daily_series(assessments(spark, sf_dir))
    daily = daily.unionByName(daily.filter("concept = 'SMALL'").withColumn("concept", F.lit("BYSTANDER")))
    at = diagnosis.month_index() % 5
    jump = ((F.col("concept") == "LARGE") & (at == 0)) | ((F.col("concept") == "MEDIUM") & (at == 4)) | ((F.col("concept") == "ECONOMY") & (at == 0) & (F.dayofmonth("date") > 9)) | ((F.col("concept") == "BYSTANDER") & (at == 2))
    return daily.withColumn("value", F.when(jump, F.col("value") * 4000).otherwise(F.col("value")))


def _drivers(spark: SparkSession, daily: DataFrame) -> DataFrame:
    return diagnosis.candidates(spark.createDataFrame(EDGES, "src string, rel string, dst string"), METRIC, PRODUCT, daily)


def _state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Evidence and drivers, each computed once: rows number with drivers and months, not with prices."""
    daily = cut(_daily(spark, sf_dir))
    return cut(diagnosis.evidence(daily)), cut(_drivers(spark, daily))


def t3_proxy_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = series.monthly_means(assessments(spark, sf_dir))
    return series.proxy_margin(means, spark.createDataFrame(RATIOS, "concept string, ratio double"))


def t6_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = {c: F.array_join(c, ",") for c in ("downstream", "path", "routes")}
    return _drivers(spark, _daily(spark, sf_dir)).withColumns(joined)


def t8_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    # means of values with one digit over at most 31 days never fall half-way at five digits, so engines agree
    return diagnosis.evidence(_daily(spark, sf_dir), 5).withColumn("mi", F.col("mi").cast("bigint")).withColumn(
        "direction", F.col("direction").cast("bigint"))


def t10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.scores(*_state(spark, sf_dir)).withColumn("mi", F.col("mi").cast("bigint"))


def t13_analogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, drivers = _state(spark, sf_dir)
    near = diagnosis.analogs(diagnosis.of_drivers(found, drivers), diagnosis.episodes(diagnosis.scores(found, drivers)))
    return near.withColumns({"mi": F.col("mi").cast("bigint"), "past": F.col("past").cast("bigint")})


def t14_analog_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, drivers = _state(spark, sf_dir)
    near = diagnosis.analogs(diagnosis.of_drivers(found, drivers), diagnosis.episodes(diagnosis.scores(found, drivers)))
    return diagnosis.analog_support(near).select(F.col("mi").cast("bigint").alias("mi"), "concept", rounded(F.col("support"), 4).alias("support"))


def t15_weekly_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = diagnosis.votes(diagnosis.scores(*_state(spark, sf_dir)))
    return got.withColumn("mi", F.col("mi").cast("bigint"))


def t16_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.ranking(*_state(spark, sf_dir))


def t7_unrankable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.unrankable(spark.createDataFrame(EDGES, "src string, rel string, dst string"), METRIC, PRODUCT, _daily(spark, sf_dir), ["gas"])


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part type as a product, in two of three months that have orders."""
    types = table(spark, sf_dir, "part").select(F.col("p_type").alias("product")).distinct()
    months = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("d")).distinct().filter(F.month("d") % 3 > 0)
    return types.select(F.lit(METRIC).alias("metric"), "product").join(months.select(F.date_format("d", "yyyy-MM").alias("month")), how="cross")  # six types


def t17_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = cut(_daily(spark, sf_dir))
    edges = spark.createDataFrame(EDGES, "src string, rel string, dst string")
    return diagnosis.batch(cut(diagnosis.evidence(daily)), daily, edges, _requests(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviewed diagnoses; a third is approved, a third corrected, a third rejected."""
    k = F.col("o_orderkey")
    types = F.array(*map(F.lit, ("ECONOMY", "LARGE", "PROMO", "SMALL")))
    pick = lambda n: F.element_at(types, (n % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.lpad(k.cast("string"), 8, "0").alias("file"), F.element_at(F.array(*map(F.lit, ("approved", "corrected", "rejected"))), (k % 3 + 1).cast("int")).alias("status"), F.col("o_orderpriority").alias("metric"),
        F.col("o_orderstatus").alias("product"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), pick(k).alias("top1"), F.when(k % 5 > 0, F.array(pick(k + 1), pick(k))).otherwise(F.array().cast("array<string>")).alias("ranking"),
        F.when(k % 3 == 0, pick(k)).when(k % 3 == 1, pick(k + 1)).alias("label"))


def t18_reviewed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.reviewed_labels(_documents(spark, sf_dir))


def t19_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.listed(_documents(spark, sf_dir))


def t20_answer_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers; each rule is broken by some."""
    k = F.col("o_orderkey")
    texts = lambda *xs: F.array(*map(F.lit, xs))
    none = F.array().cast("array<string>")
    claim = lambda kind, evidence: F.struct(F.lit(kind).alias("kind"), F.lit("so").alias("text"), evidence.alias("evidence"))
    answers = table(spark, sf_dir, "orders").select(
        k.alias("answer_id"), F.when(k % 13 == 0, none).otherwise(texts("ECONOMY", "LARGE", "PROMO")).alias("ranking"), F.when(k % 2 == 0, "ECONOMY").otherwise("LARGE").alias("top1"),
        F.when(k % 3 == 0, texts("SMALL")).otherwise(texts("PROMO")).alias("top3"), F.when(k % 4 == 0, texts("MEDIUM", "ECONOMY")).otherwise(texts("MEDIUM", "LARGE", "ECONOMY")).alias("path"),
        texts("ev:1", "analog:2024-01").alias("known"), F.array(
            claim("top3", F.when(k % 5 == 0, texts("ev:9")).when(k % 5 == 1, none).otherwise(texts("ev:1"))), claim("outlook", F.when(k % 7 == 0, texts("ev:1")).otherwise(texts("analog:2024-01")))).alias("claims"),
        F.when(k % 11 == 0, "Deterministic first is ECONOMY").otherwise("none").alias("uncertainty"))
    return diagnosis.answer_problems(answers, spark.createDataFrame(EDGES, "src string, rel string, dst string").filter("rel = 'MADE_FROM'"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case a driver, month of 1997 and size: its level moves from a day of the month on."""
    days = table(spark, sf_dir, "part").select(F.col("p_type").alias("driver")).distinct()
    month = F.explode(F.sequence(F.lit(1), F.lit(12)))
    sized = days.select("driver", month.alias("m")).select("driver", "m", F.explode(F.array(F.lit(0.5), F.lit(3.0))).alias("size"))
    return sized.select(F.concat_ws(":", "driver", "m", "size").alias("case_id"), "driver", F.make_date(F.lit(1997), F.col("m"), F.lit(5)).alias("start"), "size")


def t22_shocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = diagnosis.shocked(series.daily_series(assessments(spark, sf_dir)), _cases(spark, sf_dir))
    return got.groupBy("case_id", "concept").agg(F.count("*").alias("n"), rounded(F.max("value"), 2).alias("most"))


def t23_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the naive rank by monthly change finds the injected driver: its place among the others' own changes."""
    daily = cut(series.daily_series(assessments(spark, sf_dir)))
    month = F.date_format("date", "yyyy-MM")
    moved = lambda df, *by: df.groupBy(*by, month.alias("month")).agg(F.avg("value").alias("mean"))
    cases = _cases(spark, sf_dir)
    hit = moved(diagnosis.shocked(daily, cases), "case_id").join(cases, "case_id")
    now, before = hit.filter(F.col("month") == F.date_format("start", "yyyy-MM")), hit.filter(F.col("month") == F.date_format(F.add_months("start", -1), "yyyy-MM"))
    own = now.join(before.select("case_id", F.col("mean").alias("old")), "case_id").select("case_id", "driver", "size", "month", (F.abs(F.col("mean") / F.col("old") - 1) * 100).alias("pct"))
    others = series.naive_rank(moved(daily, "concept")).select("month", "concept", F.col("pct").alias("theirs"))
    place = own.join(others, "month").groupBy("case_id", "driver", "size").agg((F.count_if((F.col("concept") != F.col("driver")) & (F.col("theirs") > F.col("pct"))) + 1).alias("place"))
    return diagnosis.evaluation(place)


def _full_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case a driver, month of orders, size and onset."""
    months = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("first")).distinct()
    drivers = table(spark, sf_dir, "part").select(F.col("p_type").alias("driver")).distinct()
    sizes = F.explode(F.array(*map(F.lit, (0.3, 3.0, 30.0)))).alias("size")
    made = drivers.join(F.broadcast(months), how="cross").select("driver", "first", sizes).withColumn("onset", F.explode(F.array(F.lit(3), F.lit(10))))  # a case a month and type
    return made.select(F.concat_ws(":", "driver", "first", "size", "onset").alias("case_id"), "driver", F.date_format("first", "yyyy-MM").alias("month"), F.date_add("first", F.col("onset") - 1).alias("start"), "size", "onset")


def _case_series(daily: DataFrame, cases: DataFrame) -> DataFrame:
    """What a case changes: its driver's series, from three months before."""
    near = diagnosis.shocked(daily, cases).join(cases.select("case_id", F.to_date(F.concat("month", F.lit("-01"))).alias("first")), "case_id")
    return near.filter((F.col("date") >= F.add_months("first", -diagnosis.BASELINE_MONTHS - 1)) & (F.col("date") < F.add_months("first", 1))).drop("first")


def t23_full_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole diagnosis, without analogs, without weekly votes, and the naive rank, on shocks of known driver, size and onset."""
    daily = cut(series.daily_series(assessments(spark, sf_dir)))
    cases = cut(_full_cases(spark, sf_dir))
    places = diagnosis.case_places(daily, cut(_case_series(daily, cases)), cases, cut(_drivers(spark, daily)))
    placed = places.join(cases.select("case_id", "driver", "size", "onset"), "case_id")
    return diagnosis.evaluation(placed, ("driver", "size", "onset"), ("method",))


def t23_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = cut(series.daily_series(assessments(spark, sf_dir)))
    cases = cut(_full_cases(spark, sf_dir))
    return diagnosis.confusions(diagnosis.case_places(daily, cut(_case_series(daily, cases)), cases, cut(_drivers(spark, daily))), cases)


def t24_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.report_lines(cut(t16_ranking(spark, sf_dir)))


def t24_full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with analogs, what the product's price did after them, dear orders as incidents, and drivers that cannot be ranked."""
    daily = cut(_daily(spark, sf_dir))
    found, drivers = cut(diagnosis.evidence(daily, 5)), cut(_drivers(spark, daily))
    scored = cut(diagnosis.scores(found, drivers))
    mine = cut(diagnosis.of_drivers(found, drivers))
    library = diagnosis.episodes(scored)
    near = cut(diagnosis.analogs(mine, library))
    means = daily.filter(F.col("concept") == PRODUCT).groupBy(diagnosis.month_index().alias("past")).agg(F.avg("value").alias("mean"))
    after = means.join(means.select((F.col("past") - 1).alias("past"), F.col("mean").alias("next_")), "past").select("past", rounded(F.col("next_") - F.col("mean"), 2).alias("next_change"))
    near = near.join(library.select(F.col("mi").alias("past"), "label"), "past").join(after, "past", "left")
    orders = table(spark, sf_dir, "orders").filter("o_totalprice > 400000")
    incidents = orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("type"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("summary"))
    unranked = diagnosis.unrankable(spark.createDataFrame(EDGES, "src string, rel string, dst string"), METRIC, PRODUCT, daily)
    return diagnosis.full_report(cut(diagnosis.ranked(mine, scored, near.drop("label", "next_change"))), found, drivers, near, incidents, unranked)


QUERIES = {f.__name__: f for f in (t3_proxy_margin, t6_candidates, t8_evidence, t10_scores, t13_analogs, t14_analog_support, t15_weekly_votes, t16_ranking,
                                   t7_unrankable, t17_batch, t18_reviewed_labels, t19_listed, t20_answer_problems, t22_shocked, t23_evaluation, t23_full_evaluation,
                                   t23_confusions, t24_report, t24_full_report)}

_RATIOS_SQL = ", ".join(f"('{c}', {r})" for c, r in RATIOS)
_DAILY = f"""
o AS (SELECT concept, date, mi, CASE WHEN (concept = 'LARGE' AND mi % 5 = 0) OR (concept = 'MEDIUM' AND mi % 5 = 4)
    OR (concept = 'ECONOMY' AND mi % 5 = 0 AND day(date) > 9) OR (concept = 'BYSTANDER' AND mi % 5 = 2) THEN v * 4000 ELSE v END AS v
  FROM (SELECT unnest(CASE WHEN concept = 'SMALL' THEN ['SMALL', 'BYSTANDER'] ELSE [concept] END) AS concept, date, v, mi
    FROM (SELECT product AS concept, date, floor(avg(mid) * 10 + 0.5) / 10 AS v, year(date) * 12 + month(date) AS mi FROM ({ASSESSMENTS_SQL}) GROUP BY ALL)))"""
_EVIDENCE = f"""
{_DAILY},
bp AS (SELECT k.concept, k.mi AS base, o.mi, o.date, o.v FROM (SELECT DISTINCT concept, mi FROM o) k
  JOIN o ON o.concept = k.concept AND o.mi BETWEEN k.mi - 3 AND k.mi - 1),
br AS (SELECT *, ln(v / lag(v) OVER (PARTITION BY concept, base ORDER BY date)) AS r, max(mi) OVER (PARTITION BY concept, base) AS last FROM bp),
b AS (SELECT concept, base AS mi, greatest(stddev_pop(r), 1e-4) AS sigma, avg(v) FILTER (mi = last) AS ref, count(*) FILTER (mi = last) AS recent
  FROM br GROUP BY concept, base HAVING count(*) >= 4 AND min(v) > 0),
w AS (SELECT o.concept, o.mi, o.date, o.v, unnest(['month', 'w' || least(CAST(ceil(day(o.date) / 7) AS INT), 4)]) AS win, sigma, ref, recent
  FROM o JOIN b ON b.concept = o.concept AND b.mi = o.mi),
ws AS (SELECT *, count(*) OVER g AS n, avg(v) OVER g AS mean, sigma * sqrt(greatest(1.0, (recent + count(*) OVER g) / 2)) AS scale
  FROM w WINDOW g AS (PARTITION BY concept, mi, win)),
ev AS (SELECT concept, mi, win, floor(ln(1 + least(30.0, 0.5 * abs(ln(any_value(mean) / any_value(ref))) / any_value(scale) + 0.5 * max(abs(ln(v / ref))) / any_value(scale))) / ln(31.0) * 1000 + 0.5) / 1000 AS abnormality,
    floor(abs(ln(any_value(mean) / any_value(ref))) / any_value(scale) * 100 + 0.5) / 100 AS z,
    floor(max(abs(ln(v / ref))) / any_value(scale) * 100 + 0.5) / 100 AS max_z,
    CAST(sign(ln(any_value(mean) / any_value(ref))) AS BIGINT) AS direction,
    strftime(min(date) FILTER (abs(ln(v / ref)) > 2 * scale), '%Y-%m-%d') AS onset,
    floor((any_value(mean) - any_value(ref)) * 1e5 + 0.5) / 1e5 AS delta, floor(100 * (any_value(mean) / any_value(ref) - 1) * 1e4 + 0.5) / 1e4 AS pct,
    floor(any_value(ref) * 1e5 + 0.5) / 1e5 AS reference, count(*) AS n
  FROM ws GROUP BY concept, mi, win HAVING min(v) > 0)"""
_EDGES_SQL = ", ".join(f"('{a}', '{r}', '{b}')" for a, r, b in EDGES)


def _candidates_sql(requests: str) -> str:
    """Candidates by a walk over the edges from every product and metric asked for; c and l have rq's columns as well."""
    return f"""
rq AS ({requests}), ed(src, rel, dst) AS (VALUES {_EDGES_SQL}),
wk(metric, product, rel, node, path) AS (
  SELECT metric, product, 'MADE_FROM', product, [product] FROM rq UNION ALL SELECT metric, product, 'DEPENDS_ON', metric, [metric] FROM rq
  UNION ALL SELECT w.metric, w.product, w.rel, e.dst, list_append(w.path, e.dst) FROM wk w JOIN ed e ON e.src = w.node AND e.rel = w.rel AND NOT list_contains(w.path, e.dst)),
sp AS (SELECT metric, product, rel, node, arg_min(path, (len(path), path)) AS path FROM wk GROUP BY ALL),
fd AS (SELECT metric, product, node AS concept, max(path) FILTER (rel = 'MADE_FROM') AS made, max(path) FILTER (rel = 'DEPENDS_ON' AND len(path) > 1) AS lean
  FROM sp WHERE node IN (SELECT p_type FROM part) GROUP BY ALL HAVING made IS NOT NULL OR lean IS NOT NULL),
rl AS (SELECT *, CASE WHEN len(made) = 1 THEN 'primary' WHEN len(made) = 2 OR lean IS NOT NULL THEN 'direct' ELSE 'propagation' END AS role FROM fd),
c AS (SELECT metric, product, concept, role, CASE role WHEN 'propagation' THEN 0.9::DOUBLE ELSE 1.0 END AS weight, coalesce(made, lean) AS path,
    row_number() OVER (PARTITION BY metric, product ORDER BY role = 'propagation', role = 'direct', concept) - 1 AS ord FROM rl),
l AS (SELECT * FROM (SELECT metric, product, concept AS up, unnest(made[:-2]) AS down FROM rl) WHERE down IN (SELECT p_type FROM part))"""


_CANDIDATES = _candidates_sql(f"SELECT '{METRIC}' AS metric, '{PRODUCT}' AS product")
_SCORES = f"""
{_EVIDENCE}, {_CANDIDATES},
past AS (SELECT mi + 1 AS mi, unnest(['month', 'w1', 'w2', 'w3', 'w4']) AS win, concept, abnormality AS pa, direction AS pway, onset AS ponset FROM ev WHERE win = 'month'),
st AS (SELECT * FROM (SELECT mi, win, concept, abnormality AS a, direction AS way, onset FROM ev) FULL JOIN past USING (mi, win, concept)),
raw AS (SELECT s.mi, s.win, s.concept, s.a, s.onset, s.pa, s.ponset,
    greatest(coalesce((SELECT max(u.a) FROM l JOIN st u ON u.concept = l.up WHERE l.down = s.concept AND u.mi = s.mi AND u.win = s.win AND u.onset <= coalesce(s.onset, '9999') AND u.way = s.way), 0.0),
      coalesce((SELECT max(u.pa) FROM l JOIN st u ON u.concept = l.up WHERE l.down = s.concept AND u.mi = s.mi AND u.win = s.win AND u.ponset IS NOT NULL AND u.pway = s.way), 0.0)) AS ex,
    coalesce((SELECT avg(d.a) FROM l JOIN st d ON d.concept = l.down WHERE l.up = s.concept AND d.mi = s.mi AND d.win = s.win AND d.onset >= s.onset AND d.way = s.way), 0.0) AS later,
    coalesce((SELECT avg(d.a) FROM l JOIN st d ON d.concept = l.down WHERE l.up = s.concept AND d.mi = s.mi AND d.win = s.win AND d.onset IS NOT NULL AND d.way = s.pway), 0.0) AS conf
  FROM st s),
sc AS (SELECT concept, role, ord, mi, win, onset, ponset,
    floor(greatest(coalesce(weight * a * (1 - 0.8 * CASE WHEN a > 0 THEN least(1.0, ex / a) ELSE 0.0 END) + 0.2 * a * later, 0.0),
      CASE WHEN ponset IS NOT NULL THEN pa * sqrt(conf) ELSE 0.0 END) * 10000 + 0.5) / 10000 AS score
  FROM raw JOIN c USING (concept))"""
_ANALOGS = f"""
{_SCORES},
v AS (SELECT concept, mi, z * direction AS z FROM ev WHERE win = 'month' AND concept IN (SELECT concept FROM c)),
nm AS (SELECT mi, sqrt(sum(z * z)) AS norm FROM v GROUP BY mi),
sim AS (SELECT mi, past, floor(dot / (x.norm * y.norm) * 1000 + 0.5) / 1000 AS similarity FROM (
    SELECT p.mi, q.mi AS past, sum(p.z * q.z) AS dot FROM v p JOIN v q ON p.concept = q.concept AND q.mi < p.mi GROUP BY ALL)
  JOIN nm x USING (mi) JOIN nm y ON y.mi = past WHERE x.norm > 0 AND y.norm > 0),
ep AS (SELECT mi, concept AS top FROM sc WHERE win = 'month' QUALIFY row_number() OVER (PARTITION BY mi ORDER BY score DESC, ord) = 1),
an AS (SELECT sim.mi, row_number() OVER (PARTITION BY sim.mi ORDER BY similarity DESC, past) AS place, past, similarity, top
  FROM sim JOIN ep ON ep.mi = past QUALIFY place <= 3 AND similarity > 0),
su AS (SELECT mi, concept, s / sum(s) OVER (PARTITION BY mi) AS support FROM (SELECT mi, top AS concept, sum(similarity) AS s FROM an GROUP BY ALL))"""
_VOTES = """
vo AS (SELECT mi, concept, CAST(sum(4 - place) AS BIGINT) AS votes FROM (
    SELECT mi, concept, row_number() OVER (PARTITION BY mi, win ORDER BY score DESC, ord) AS place FROM sc
    WHERE win <> 'month' AND (onset IS NOT NULL OR ponset IS NOT NULL)) WHERE place <= 3 GROUP BY ALL)"""

ORACLE_SQL = {
    "t3_proxy_margin": f"""
SELECT month, floor(sum(ratio * mean) * 100 + 0.5) / 100 AS margin FROM (
  SELECT product AS concept, strftime(date, '%Y-%m') AS month, avg(mid) AS mean FROM ({ASSESSMENTS_SQL}) GROUP BY ALL)
JOIN (VALUES {_RATIOS_SQL}) r(concept, ratio) USING (concept) GROUP BY month HAVING count(DISTINCT concept) = {len(RATIOS)}
""",
    "t6_candidates": f"""
WITH RECURSIVE {_CANDIDATES} SELECT concept, role, ord, coalesce((SELECT string_agg(down, ',' ORDER BY down) FROM l WHERE up = concept), '') AS downstream, array_to_string(path, ',') AS path,
  coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM ed WHERE src = concept AND rel = 'TRANSITS'), '') AS routes FROM c
""",
    "t8_evidence": f"WITH {_EVIDENCE} SELECT * FROM ev",
    "t10_scores": f"WITH RECURSIVE {_SCORES} SELECT * FROM sc",
    "t13_analogs": f"WITH RECURSIVE {_ANALOGS} SELECT * FROM an",
    "t14_analog_support": f"WITH RECURSIVE {_ANALOGS} SELECT mi, concept, floor(support * 10000 + 0.5) / 10000 AS support FROM su",
    "t15_weekly_votes": f"WITH RECURSIVE {_SCORES}, {_VOTES} SELECT * FROM vo",
    "t16_ranking": f"""
WITH RECURSIVE {_ANALOGS}, {_VOTES},
m AS (SELECT mi, concept, role, ord, score AS s_evid, onset, coalesce(support, 0.0) AS support, coalesce(votes, 0) AS votes,
    CASE WHEN mi IN (SELECT mi FROM an) THEN 0.8 ELSE 1.0 END::DOUBLE AS alpha
  FROM sc LEFT JOIN su USING (mi, concept) LEFT JOIN vo USING (mi, concept)
  WHERE win = 'month' AND mi IN (SELECT mi FROM ev WHERE win = 'month')),
t AS (SELECT *, floor((alpha * s_evid + (1 - alpha) * support) * 10000 + 0.5) / 10000 AS score FROM m)
SELECT printf('%04d-%02d', (mi - 1) // 12, (mi - 1) % 12 + 1) AS month,
  row_number() OVER (PARTITION BY mi ORDER BY votes DESC, score DESC, coalesce(onset, '9999'), ord) AS rank,
  concept, role, s_evid, floor(support * 1000 + 0.5) / 1000 AS s_ret, score, votes, onset FROM t
""",
}
_DOCS_SQL = """d AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS file, (['approved', 'corrected', 'rejected'])[o_orderkey % 3 + 1] AS status, o_orderpriority AS metric, o_orderstatus AS product, strftime(o_orderdate, '%Y-%m') AS period,
  (['ECONOMY', 'LARGE', 'PROMO', 'SMALL'])[o_orderkey % 4 + 1] AS top1, (['ECONOMY', 'LARGE', 'PROMO', 'SMALL'])[(o_orderkey + 1) % 4 + 1] AS next, o_orderkey AS k FROM orders)"""
_CASES_SQL = f"""dl AS (SELECT product AS concept, date, floor(avg(mid) * 10 + 0.5) / 10 AS value FROM ({ASSESSMENTS_SQL}) GROUP BY ALL),
ca AS (SELECT driver, m, size, driver || ':' || m || ':' || size AS case_id, make_date(1997, CAST(m AS INT), 5) AS start FROM (SELECT DISTINCT p_type AS driver FROM part), range(1, 13) r(m), (VALUES (0.5::DOUBLE), (3.0)) z(size)),
sh AS (SELECT case_id, driver, size, start, concept, date, floor(CASE WHEN date >= start THEN value * (1 + size) ELSE value END * 10000 + 0.5) / 10000 AS value FROM ca JOIN dl ON concept = driver)"""
ORACLE_SQL |= {
    "t7_unrankable": f"""WITH RECURSIVE {_CANDIDATES} SELECT DISTINCT node AS concept FROM sp WHERE node NOT IN (SELECT src FROM ed) AND node NOT IN (SELECT p_type FROM part) AND node NOT IN ('{METRIC}', '{PRODUCT}', 'gas')""",
    "t17_batch": f"""
WITH RECURSIVE {_EVIDENCE}, {_candidates_sql(f"SELECT DISTINCT '{METRIC}' AS metric, p_type AS product FROM part")},
pe AS (SELECT mi + 1 AS mi, unnest(['month', 'w1', 'w2', 'w3', 'w4']) AS win, concept, abnormality AS pa, direction AS pway, onset AS ponset FROM ev WHERE win = 'month'),
st AS (SELECT metric, product, role, weight, ord, e.* FROM (SELECT * FROM (SELECT mi, win, concept, abnormality AS a, direction AS way, onset FROM ev) FULL JOIN pe USING (mi, win, concept)) e JOIN c USING (concept)),
up AS (SELECT s.metric, s.product, s.concept, s.mi, s.win, max(CASE WHEN u.onset <= coalesce(s.onset, '9999') AND u.way = s.way THEN u.a END) AS x1, max(CASE WHEN u.ponset IS NOT NULL AND u.pway = s.way THEN u.pa END) AS x2
  FROM st s JOIN l ON l.metric = s.metric AND l.product = s.product AND l.down = s.concept JOIN st u ON u.metric = s.metric AND u.product = s.product AND u.concept = l.up AND u.mi = s.mi AND u.win = s.win GROUP BY ALL),
dn AS (SELECT s.metric, s.product, s.concept, s.mi, s.win, avg(CASE WHEN d.onset >= s.onset AND d.way = s.way THEN d.a END) AS later, avg(CASE WHEN d.onset IS NOT NULL AND d.way = s.pway THEN d.a END) AS conf
  FROM st s JOIN l ON l.metric = s.metric AND l.product = s.product AND l.up = s.concept JOIN st d ON d.metric = s.metric AND d.product = s.product AND d.concept = l.down AND d.mi = s.mi AND d.win = s.win GROUP BY ALL),
sc AS (SELECT metric, product, concept, role, ord, mi, win, onset, ponset,
    floor(greatest(coalesce(weight * a * (1 - 0.8 * CASE WHEN a > 0 THEN least(1.0, greatest(coalesce(x1, 0), coalesce(x2, 0)) / a) ELSE 0.0 END) + 0.2 * a * coalesce(later, 0), 0.0),
      CASE WHEN ponset IS NOT NULL THEN pa * sqrt(coalesce(conf, 0)) ELSE 0.0 END) * 10000 + 0.5) / 10000 AS score
  FROM st LEFT JOIN up USING (metric, product, concept, mi, win) LEFT JOIN dn USING (metric, product, concept, mi, win)),
v AS (SELECT metric, product, concept, mi, z * direction AS z FROM ev JOIN c USING (concept) WHERE win = 'month'),
nm AS (SELECT metric, product, mi, sqrt(sum(z * z)) AS norm FROM v GROUP BY ALL),
dt AS (SELECT p.metric, p.product, p.mi, q.mi AS past, sum(p.z * q.z) AS dot FROM v p JOIN v q ON p.metric = q.metric AND p.product = q.product AND p.concept = q.concept AND q.mi < p.mi GROUP BY ALL),
ep AS (SELECT metric, product, mi AS past, concept AS top FROM sc WHERE win = 'month' QUALIFY row_number() OVER (PARTITION BY metric, product, mi ORDER BY score DESC, ord) = 1),
an AS (SELECT dt.metric, dt.product, dt.mi, past, top, floor(dot / (x.norm * y.norm) * 1000 + 0.5) / 1000 AS similarity FROM dt JOIN nm x USING (metric, product, mi)
  JOIN nm y ON y.metric = dt.metric AND y.product = dt.product AND y.mi = past JOIN ep USING (metric, product, past) WHERE x.norm > 0 AND y.norm > 0
  QUALIFY row_number() OVER (PARTITION BY dt.metric, dt.product, dt.mi ORDER BY similarity DESC, past) <= 3 AND similarity > 0),
su AS (SELECT metric, product, mi, top AS concept, sum(similarity) / sum(sum(similarity)) OVER (PARTITION BY metric, product, mi) AS support FROM an GROUP BY metric, product, mi, top),
vo AS (SELECT metric, product, mi, concept, CAST(sum(4 - place) AS BIGINT) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY metric, product, mi, win ORDER BY score DESC, ord) AS place FROM sc
    WHERE win <> 'month' AND (onset IS NOT NULL OR ponset IS NOT NULL)) WHERE place <= 3 GROUP BY ALL),
m AS (SELECT sc.*, coalesce(support, 0.0) AS support, coalesce(votes, 0) AS votes, CASE WHEN EXISTS (SELECT 1 FROM an WHERE an.metric = sc.metric AND an.product = sc.product AND an.mi = sc.mi) THEN 0.8::DOUBLE ELSE 1.0 END AS alpha
  FROM sc LEFT JOIN su USING (metric, product, mi, concept) LEFT JOIN vo USING (metric, product, mi, concept)
  WHERE win = 'month' AND EXISTS (SELECT 1 FROM v WHERE v.metric = sc.metric AND v.product = sc.product AND v.mi = sc.mi)),
t AS (SELECT *, printf('%04d-%02d', (mi - 1) // 12, (mi - 1) % 12 + 1) AS month, floor((alpha * score + (1 - alpha) * support) * 10000 + 0.5) / 10000 AS total FROM m)
SELECT metric, product, month, row_number() OVER (PARTITION BY metric, product, mi ORDER BY votes DESC, total DESC, coalesce(onset, '9999'), ord) AS rank, concept, role, score AS s_evid,
  floor(support * 1000 + 0.5) / 1000 AS s_ret, total AS score, votes, onset FROM t WHERE month IN (SELECT strftime(o_orderdate, '%Y-%m') FROM orders WHERE month(o_orderdate) % 3 > 0)""",
    "t18_reviewed_labels": f"WITH {_DOCS_SQL} SELECT metric, product, period, arg_max(CASE WHEN k % 3 = 0 THEN top1 ELSE next END, file) AS label FROM d WHERE k % 3 < 2 GROUP BY ALL",
    "t19_listed": f"WITH {_DOCS_SQL} SELECT file, status, metric, product, period, top1, CASE WHEN k % 5 > 0 THEN next END AS deterministic_top1, CASE k % 3 WHEN 0 THEN top1 WHEN 1 THEN next END AS reviewed_top1 FROM d",
    "t20_answer_problems": """SELECT o_orderkey AS answer_id, concat_ws(',', CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 3 = 0 THEN 'driver not ranked' END, CASE WHEN o_orderkey % 4 = 0 THEN 'path not in the graph' END,
  CASE WHEN o_orderkey % 5 = 0 THEN 'unknown evidence' END, CASE WHEN o_orderkey % 5 = 1 THEN 'claim without evidence' END, CASE WHEN o_orderkey % 7 = 0 THEN 'outlook beyond analogs' END,
  CASE WHEN o_orderkey % 13 > 0 AND o_orderkey % 2 = 1 AND o_orderkey % 11 > 0 THEN 'first driver not told' END) AS problems FROM orders""",
    "t22_shocked": f"WITH {_CASES_SQL} SELECT case_id, concept, count(*) AS n, floor(max(value) * 100 + 0.5) / 100 AS most FROM sh GROUP BY ALL",
    "t23_evaluation": f"""WITH {_CASES_SQL}, mm AS (SELECT case_id, driver, size, start, strftime(date, '%Y-%m') AS month, avg(value) AS mean FROM sh GROUP BY ALL),
ow AS (SELECT a.case_id, a.driver, a.size, a.month, abs(a.mean / b.mean - 1) * 100 AS pct FROM mm a JOIN mm b USING (case_id) WHERE a.month = strftime(a.start, '%Y-%m') AND b.month = strftime(a.start - INTERVAL 1 MONTH, '%Y-%m')),
dm AS (SELECT concept, strftime(date, '%Y-%m') AS month, year(date) * 12 + month(date) AS mi, avg(value) AS mean FROM dl GROUP BY ALL),
nr AS (SELECT concept, month, floor(abs(mean / lag(mean) OVER w - 1) * 100 * 10000 + 0.5) / 10000 AS theirs, mi - lag(mi) OVER w AS gap FROM dm WINDOW w AS (PARTITION BY concept ORDER BY mi)),
pl AS (SELECT case_id, driver, size, count(*) FILTER (concept <> driver AND theirs > pct) + 1 AS place FROM ow JOIN nr USING (month) WHERE gap = 1 GROUP BY ALL)
SELECT driver, size, count(*) AS n, floor(avg(CASE WHEN place <= 1 THEN 1.0 ELSE 0.0 END) * 10000 + 0.5) / 10000 AS top1, floor(avg(CASE WHEN place <= 3 THEN 1.0 ELSE 0.0 END) * 10000 + 0.5) / 10000 AS top3,
  floor((avg(1 / place) + 1e-12) * 10000 + 0.5) / 10000 AS mrr FROM pl GROUP BY GROUPING SETS ((), (driver), (size))""",
    "t24_full_report": f"""
WITH RECURSIVE {_ANALOGS}, {_VOTES},
m AS (SELECT mi, concept, role, ord, score AS s_evid, onset, coalesce(support, 0.0) AS support, coalesce(votes, 0) AS votes, CASE WHEN mi IN (SELECT mi FROM an) THEN 0.8 ELSE 1.0 END::DOUBLE AS alpha
  FROM sc LEFT JOIN su USING (mi, concept) LEFT JOIN vo USING (mi, concept) WHERE win = 'month' AND mi IN (SELECT mi FROM v)),
t AS (SELECT *, floor((alpha * s_evid + (1 - alpha) * support) * 10000 + 0.5) / 10000 AS score FROM m),
rk AS (SELECT *, printf('%04d-%02d', (mi - 1) // 12, (mi - 1) % 12 + 1) AS month, row_number() OVER (PARTITION BY mi ORDER BY votes DESC, score DESC, coalesce(onset, '9999'), ord) AS rank FROM t),
e2 AS (SELECT concept, mi, onset, z, max_z, floor((delta * 100) + 0.5) / 100 AS delta, floor((pct * 100) + 0.5) / 100 AS pct, floor((reference * 100) + 0.5) / 100 AS reference FROM ev WHERE win = 'month'),
li AS (SELECT month, 0 AS part, lpad(CAST(rank AS VARCHAR), 9, '0') AS at_, printf('%d. %s [%s] ev:%s:%s: ', rank, rk.concept, role, rk.concept, month) || coalesce(printf('%+.2f (%+.2f%%) vs reference %.2f, z %.2f, max z %.2f, first abnormal %s', n.delta, n.pct, n.reference, n.z, n.max_z, coalesce(n.onset, 'none')), 'no data in the period')
    || coalesce(printf('; earlier move %+.2f%% (z %.2f, from %s)', p.pct, p.z, p.onset), '') || printf('; score %.4f, weekly votes %d; path ', score, votes) || array_to_string((SELECT path FROM c WHERE c.concept = rk.concept), ' <- ')
    || coalesce('; transits ' || (SELECT string_agg(dst, ', ' ORDER BY dst) FROM ed WHERE src = rk.concept AND rel = 'TRANSITS'), '') AS line
  FROM rk LEFT JOIN e2 n ON n.concept = rk.concept AND n.mi = rk.mi LEFT JOIN e2 p ON p.concept = rk.concept AND p.mi = rk.mi - 1 AND p.onset IS NOT NULL
  UNION ALL SELECT DISTINCT month, 1, '', 'Drivers in the graph without a series (not ranked, cannot be ruled out): ' || (SELECT string_agg(DISTINCT node, ', ' ORDER BY node) FROM sp WHERE node NOT IN (SELECT src FROM ed) AND node NOT IN (SELECT p_type FROM part) AND node NOT IN ('{METRIC}', '{PRODUCT}')) FROM rk
  UNION ALL SELECT printf('%04d-%02d', (mi - 1) // 12, (mi - 1) % 12 + 1), 2, lpad(CAST(place AS VARCHAR), 9, '0'), printf('analog:%04d-%02d: similarity %.3f, top driver then %s (automatic)', (past - 1) // 12, (past - 1) % 12 + 1, similarity, top)
    || coalesce((SELECT printf(', metric changed %+.2f the following month', floor((b.w - a.w) * 100 + 0.5) / 100) FROM (SELECT mi, avg(v) AS w FROM o WHERE concept = '{PRODUCT}' GROUP BY 1) a JOIN (SELECT mi, avg(v) AS w FROM o WHERE concept = '{PRODUCT}' GROUP BY 1) b ON b.mi = a.mi + 1 WHERE a.mi = past), '') FROM an
  UNION ALL SELECT strftime(o_orderdate, '%Y-%m'), 3, strftime(o_orderdate, '%Y-%m-%d') || ' order ' || o_orderkey, 'incident ' || strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderstatus || ': order ' || o_orderkey FROM orders
    WHERE o_totalprice > 400000 AND strftime(o_orderdate, '%Y-%m') IN (SELECT month FROM rk))
SELECT month, string_agg(line, chr(10) ORDER BY part, at_) AS report FROM li GROUP BY 1""",
    "t24_report": f"""SELECT month, string_agg(printf('%d. %s [%s]: first abnormal %s; score %.4f, weekly votes %d', rank, concept, role, coalesce(onset, 'none'), score, votes), chr(10) ORDER BY rank) AS report FROM ({ORACLE_SQL["t16_ranking"]}) GROUP BY 1""",
}
