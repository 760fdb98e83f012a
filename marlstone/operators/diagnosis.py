"""Which driver moved a metric: evidence, scores, analogs, weekly votes and the ranking, for all months in one job.

Series are (concept, date, value) with one row a day. Months are counted as 12 * year + month (mi). A driver's
rows of one window are a month's days at most; all joins are on (concept, month), (month, window) or config tables.

Many diagnoses run as one job: drivers may be told apart by requests (metric, product), evidence by cases (case_id). Every
step keeps whatever such columns its tables have and never mixes their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.lineage import cut
from marlstone.functions.numbers import rounded

#: Fixed values of the scoring rules.
ROLE_WEIGHT = {"primary": 1.0, "direct": 1.0, "propagation": 0.9}
EXPLAIN_AWAY = 0.8
PROPAGATION_SUPPORT = 0.2
K_SIGMA = 2
CLIP = 30
ALPHA = 0.8
TOP_ANALOGS = 3
BASELINE_MONTHS = 3
MIN_BASELINE = 4
MIN_SIGMA = 1e-4
WEEKS = ("w1", "w2", "w3", "w4")
NEVER = "9999"
#: Columns that tell diagnoses of one job apart.
KEYS = ("metric", "product", "case_id")


def keys(*tables: DataFrame) -> list[str]:
    return [k for k in KEYS if any(k in t.columns for t in tables)]


def month_index(date: str = "date"):
    return F.year(date) * 12 + F.month(date)


def month_label(mi: str = "mi"):
    return F.format_string("%04d-%02d", F.floor((F.col(mi) - 1) / 12).cast("int"), ((F.col(mi) - 1) % 12 + 1).cast("int"))


def week(date: str = "date"):
    """Days 1-7, 8-14, 15-21 and the rest of the month."""
    return F.concat(F.lit("w"), F.least(F.ceil(F.dayofmonth(date) / 7), F.lit(4)).cast("string"))


def paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Shortest path (start, node, path) from each start over edges (src, dst), of any length; of equal ones the first by name."""
    steps = edges.select("src", "dst").distinct()
    found = new = starts.select(F.col("start"), F.col("start").alias("node"), F.array("start").alias("path")).distinct()
    while not new.isEmpty():
        # one path a node and step is enough: a shortest path's beginnings are shortest themselves
        new = new.join(steps, (F.col("node") == F.col("src")) & ~F.array_contains("path", F.col("dst"))).select(
            "start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")).groupBy("start", "node").agg(
            F.min("path").alias("path")).join(found.select("start", "node"), ["start", "node"], "left_anti")
        new = cut(new)
        found = cut(found.unionByName(new))
    return found


def candidates(edges: DataFrame, metric: str, product: str, series: DataFrame) -> DataFrame:
    """The drivers of one metric and product: requested_candidates without its request."""
    one = edges.sparkSession.createDataFrame([(metric, product)], "metric string, product string")
    return requested_candidates(edges, one, series).drop("metric", "product")


def requested_candidates(edges: DataFrame, requests: DataFrame, series: DataFrame) -> DataFrame:
    """metric, product, concept, role, ord, downstream, path and routes of the drivers that have a series, for each request (metric, product); edges are (src, rel, dst).

    The product is primary; inputs one hop away, and what the metric depends on, are direct; farther
    inputs are propagation. downstream is the way back to the product, over concepts with a series; path the way from the product, or else
    from the metric; routes are what a driver TRANSITS. The graph is walked once from all products and all metrics together.
    """
    have = series.select("concept").distinct()
    asked = requests.select("metric", "product").distinct()
    walked = lambda rel, start: paths(edges.filter(F.col("rel") == rel), asked.select(F.col(start).alias("start"))).withColumnRenamed("start", start)
    made = asked.join(walked("MADE_FROM", "product"), "product").select("metric", "product", F.col("node").alias("concept"), (F.size("path") - 1).alias("hops"), "path")
    leans = asked.join(walked("DEPENDS_ON", "metric"), "metric").filter("size(path) > 1").select(
        "metric", "product", F.col("node").alias("concept"), F.lit(True).alias("leans"), F.col("path").alias("lean_path"))
    role = F.when(F.col("hops") == 0, "primary").when((F.col("hops") == 1) | F.col("leans"), "direct").otherwise("propagation")
    every = made.join(leans, ["metric", "product", "concept"], "full").join(have, "concept", "left_semi").withColumn("role", role)
    place = F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(ROLE_WEIGHT) for x in (r, k)]), F.col("role"))
    on_way = every.select("metric", "product", "concept", F.explode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("down")).join(
        have.withColumnRenamed("concept", "down"), "down", "left_semi").groupBy("metric", "product", "concept").agg(F.array_sort(F.collect_set("down")).alias("downstream"))
    # a request has tens of drivers
    order = Window.partitionBy("metric", "product").orderBy(place, "concept")
    routes = edges.filter("rel = 'TRANSITS'").groupBy(F.col("src").alias("concept")).agg(F.array_sort(F.collect_set("dst")).alias("routes"))
    none = F.array().cast("array<string>")
    return every.join(on_way, ["metric", "product", "concept"], "left").join(routes, "concept", "left").select(
        "metric", "product", "concept", "role", (F.row_number().over(order) - 1).cast("bigint").alias("ord"), F.coalesce("downstream", none).alias("downstream"),
        F.coalesce("path", "lean_path").alias("path"), F.coalesce("routes", none).alias("routes"))


def unrankable(edges: DataFrame, metric: str, product: str, series: DataFrame, covered: list[str] = ()) -> DataFrame:
    """concept: leaves that the graph reaches from product or metric and that have no series, nor are covered otherwise."""
    spark = edges.sparkSession
    ways = {"MADE_FROM": product, "DEPENDS_ON": metric}
    found = [paths(edges.filter(F.col("rel") == r), spark.createDataFrame([(s,)], "start string")).select(F.col("node").alias("concept")) for r, s in ways.items()]
    inner = edges.filter(F.col("rel").isin(*ways, "TRANSITS")).select(F.col("src").alias("concept")).distinct()
    leaves = found[0].unionByName(found[1]).distinct().join(inner, "concept", "left_anti").join(series.select("concept").distinct(), "concept", "left_anti")
    return leaves.filter(~F.col("concept").isin([metric, product, *covered]))


def reviewed_labels(documents: DataFrame) -> DataFrame:
    """metric, product, period, label: of a month's documents (file, label) that carry a label the last by file; others erase nothing."""
    held = documents.filter("label is not null").groupBy("metric", "product", "period").agg(F.max_by("label", "file").alias("label"))
    return held


def listed(documents: DataFrame) -> DataFrame:
    """Diagnoses with the model's, the deterministic and the reviewed first driver."""
    return documents.select("file", "status", "metric", "product", "period", "top1", F.try_element_at("ranking", F.lit(1)).alias("deterministic_top1"), F.col("label").alias("reviewed_top1"))


def answer_problems(answers: DataFrame, edges: DataFrame) -> DataFrame:
    """answer_id, problems of answers (answer_id, ranking, top1, top3, path, known, claims, uncertainty); claims are (kind, text, evidence).

    Drivers must be ranked, the path's links in the graph in either direction, evidence known, claims cited, the outlook's by analogs
    only, and another first driver than the ranking's told as such.
    """
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    linked = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("there", F.lit(True))
    steps = answers.select("answer_id", F.explode(F.filter(F.transform("path", lambda x, i: F.struct(x.alias("a"), F.get("path", i + 1).alias("b"))), lambda s: s["b"].isNotNull())).alias("s"))
    broken = steps.select("answer_id", "s.a", "s.b").join(linked, ["a", "b"], "left").groupBy("answer_id").agg(F.count_if(F.col("there").isNull()).alias("broken"))
    cited = F.flatten(F.transform("claims", lambda c: c["evidence"]))
    first = F.try_element_at("ranking", F.lit(1))
    rules = {
        "driver not ranked": F.size(F.array_except(F.concat(F.array("top1"), "top3"), "ranking")) > 0,
        "path not in the graph": F.coalesce("broken", F.lit(0)) > 0,
        "unknown evidence": F.size(F.array_except(cited, "known")) > 0,
        "claim without evidence": F.exists("claims", lambda c: F.size(c["evidence"]) == 0),
        "outlook beyond analogs": F.exists("claims", lambda c: (c["kind"] == "outlook") & F.exists(c["evidence"], lambda e: ~F.startswith(e, F.lit("analog:")))),
        "first driver not told": first.isNotNull() & (F.col("top1") != first) & ~F.contains(F.lower("uncertainty"), F.lit("deterministic"))}
    told = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))
    return answers.join(broken, "answer_id", "left").select("answer_id", F.array_join(told, ",").alias("problems"))


def report_lines(ranked: DataFrame) -> DataFrame:
    """month, report: a line a ranked driver, in order."""
    line = F.format_string("%d. %s [%s]: first abnormal %s; score %.4f, weekly votes %d", "rank", "concept", "role", F.coalesce("onset", F.lit("none")), "score", "votes")
    told = ranked.groupBy("month").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return told.select("month", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("report"))


def full_report(order: DataFrame, found: DataFrame, drivers: DataFrame, near: DataFrame, incidents: DataFrame, not_ranked: DataFrame) -> DataFrame:
    """month, report: all that is said of a month's diagnosis, a line each: the ranked drivers with their moves now and the month before, their way and routes; drivers that
    cannot be ranked; analogs; incidents.

    order: ranking(); found: evidence; drivers: candidates; near: analogs() with next_change; incidents: month, date, type, summary; not_ranked: concept. Lines of a
    kind are in order of rank, place, or date and summary.
    """
    signed = lambda c: F.format_string("%+.2f", rounded(c, 2))
    month = found.filter("win = 'month'")
    now = month.select(month_label().alias("month"), "concept", F.concat(
        signed(F.col("delta")), F.lit(" ("), signed(F.col("pct")), F.lit("%) vs reference "), F.format_string("%.2f", rounded(F.col("reference"), 2)), F.lit(", z "), F.format_string("%.2f", "z"), F.lit(", max z "), F.format_string("%.2f", "max_z"),
        F.lit(", first abnormal "), F.coalesce("onset", F.lit("none"))).alias("now"))
    before = month.filter("onset is not null").withColumn("mi", F.col("mi") + 1).select(month_label().alias("month"), "concept", F.concat(
        F.lit("; earlier move "), signed(F.col("pct")), F.lit("% (z "), F.format_string("%.2f", "z"), F.lit(", from "), "onset", F.lit(")")).alias("before"))
    ways = drivers.select("concept", F.array_join("path", " <- ").alias("way"), F.when(F.size("routes") > 0, F.concat(F.lit("; transits "), F.array_join("routes", ", "))).otherwise("").alias("transits"))
    both = order.join(now, ["month", "concept"], "left").join(before, ["month", "concept"], "left").join(ways, "concept")
    line = F.concat(F.format_string("%d. %s [%s] ev:%s:%s: ", "rank", "concept", "role", "concept", "month"), F.coalesce("now", F.lit("no data in the period")), F.coalesce("before", F.lit("")),
                    F.format_string("; score %.4f, weekly votes %d; path ", "score", "votes"), "way", "transits")
    lines = both.select("month", F.lit(0).alias("part"), F.lpad("rank", 9, "0").alias("at"), line.alias("line"))
    rest = not_ranked.agg(F.array_join(F.array_sort(F.collect_set("concept")), ", ").alias("names")).filter("names <> ''")
    missing = order.select("month").distinct().join(F.broadcast(rest), how="cross")  # one row
    lines = lines.unionByName(missing.select("month", F.lit(1).alias("part"), F.lit("").alias("at"), F.concat(F.lit("Drivers in the graph without a series (not ranked, cannot be ruled out): "), "names").alias("line")))
    told = F.concat(F.lit("analog:"), month_label("past"), F.format_string(": similarity %.3f, top driver then %s (%s)", "similarity", "top", "label"),
                    F.when(F.col("next_change").isNotNull(), F.concat(F.lit(", metric changed "), signed(F.col("next_change")), F.lit(" the following month"))).otherwise(""))
    lines = lines.unionByName(near.select(month_label().alias("month"), F.lit(2).alias("part"), F.lpad(F.col("place").cast("string"), 9, "0").alias("at"), told.alias("line")))
    said = F.concat(F.lit("incident "), F.date_format("date", "yyyy-MM-dd"), F.lit(" "), "type", F.lit(": "), "summary")
    lines = lines.unionByName(incidents.join(order.select("month").distinct(), "month", "left_semi").select("month", F.lit(3).alias("part"), F.concat_ws(" ", F.date_format("date", "yyyy-MM-dd"), "summary").alias("at"), said.alias("line")))
    return lines.groupBy("month").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "line"))), lambda x: x["line"]), "\n").alias("report"))


def batch(found: DataFrame, series: DataFrame, edges: DataFrame, requests: DataFrame) -> DataFrame:
    """metric, product and the ranking of the months that are asked for, of all requests (metric, product, month) in one job; evidence is shared."""
    drivers = cut(requested_candidates(edges, requests, series))
    ranked = ranking(found, drivers)
    return ranked.join(requests.select("metric", "product", "month").distinct(), ["metric", "product", "month"], "left_semi")


def baselines(series: DataFrame) -> DataFrame:
    """concept, mi, sigma, ref and recent: what the three months before a month say of a driver's level and volatility."""
    by = [*keys(series), "concept"]
    order = Window.partitionBy(*by).orderBy("date")
    points = series.withColumn("mi", month_index()).withColumns({"before": F.lag("value").over(order), "before_mi": F.lag("mi").over(order)})
    serves = points.withColumn("base", F.explode(F.sequence(F.col("mi") + 1, F.col("mi") + BASELINE_MONTHS)))
    inside = (F.col("before_mi") >= F.col("base") - BASELINE_MONTHS) & (F.col("value") > 0) & (F.col("before") > 0)
    found = serves.groupBy(*by, "base").agg(
        F.count("*").alias("n"), F.min("value").alias("least"), F.max("mi").alias("last"),
        F.stddev_pop(F.when(inside, F.log(F.col("value") / F.col("before")))).alias("sd"))
    level = points.groupBy(*by, F.col("mi").alias("last")).agg(F.avg("value").alias("ref"), F.count("*").alias("recent"))
    return found.filter((F.col("n") >= MIN_BASELINE) & (F.col("least") > 0)).join(level, [*by, "last"]).select(
        *by, F.col("base").alias("mi"), F.greatest("sd", F.lit(MIN_SIGMA)).alias("sigma"), "ref", "recent")


def evidence(series: DataFrame, digits: int = 2) -> DataFrame:
    """How far each driver is from its baseline in every month ("month") and week ("w1".."w4").

    delta, pct and reference have so many digits, pct one less. No row where the baseline has under four values, or any value is not positive.
    """
    by = [*keys(series), "concept"]
    points = series.withColumn("mi", month_index()).join(baselines(series), [*by, "mi"])
    points = points.withColumn("win", F.explode(F.array(F.lit("month"), week())))
    off = F.when(F.col("value") > 0, F.log(F.col("value") / F.col("ref")))
    day = F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), F.abs(off).alias("off"))
    found = points.groupBy(*by, "mi", "win").agg(
        F.first("sigma").alias("sigma"), F.first("ref").alias("ref"), F.first("recent").alias("recent"), F.count("*").alias("n"),
        F.avg("value").alias("mean"), F.min("value").alias("least"), F.max(F.abs(off)).alias("farthest"), F.array_sort(F.collect_list(day)).alias("days"))
    found = found.filter("least > 0").withColumn(
        "scale", F.col("sigma") * F.sqrt(F.greatest(F.lit(1.0), (F.col("recent") + F.col("n")) / 2)))
    move = F.log(F.col("mean") / F.col("ref"))
    found = found.withColumns({"z_raw": F.abs(move) / F.col("scale"), "max_raw": F.col("farthest") / F.col("scale"), "direction": F.signum(move).cast("int")})
    first = F.filter("days", lambda d: d["off"] > K_SIGMA * F.col("scale"))
    strength = F.log1p(F.least(F.lit(float(CLIP)), 0.5 * F.col("z_raw") + 0.5 * F.col("max_raw"))) / F.log1p(F.lit(float(CLIP)))
    return found.select(
        *by, "mi", "win", rounded(strength, 3).alias("abnormality"), rounded(F.col("z_raw"), 2).alias("z"),
        rounded(F.col("max_raw"), 2).alias("max_z"), "direction", F.try_element_at(first, F.lit(1))["date"].alias("onset"),
        rounded(F.col("mean") - F.col("ref"), digits).alias("delta"), rounded(100 * (F.col("mean") / F.col("ref") - 1), digits - 1).alias("pct"),
        rounded(F.col("ref"), digits).alias("reference"), "n")


def of_drivers(found: DataFrame, drivers: DataFrame) -> DataFrame:
    """Evidence on drivers only, once for each request that they belong to."""
    own = keys(drivers)
    return found.join(drivers.select(*own, "concept"), [*[k for k in own if k in found.columns], "concept"])


def scores(found: DataFrame, drivers: DataFrame) -> DataFrame:
    """concept, mi, win, score, own and earlier onset, under "moved now" or "passing through", the stronger one.

    An upstream driver that moved first and the same way, now or in the month before, explains a driver's move away;
    downstream ones that moved later support it.
    """
    found, own = of_drivers(found, drivers), keys(drivers)
    by = keys(found)
    now = found.select(*by, "mi", "win", "concept", F.col("abnormality").alias("a"), F.col("direction").alias("way"), "onset")
    past = found.filter("win = 'month'").select(
        *by, (F.col("mi") + 1).alias("mi"), F.explode(F.array(F.lit("month"), *map(F.lit, WEEKS))).alias("win"), "concept",
        F.col("abnormality").alias("pa"), F.col("direction").alias("pway"), F.col("onset").alias("ponset"))
    state = now.join(past, [*by, "mi", "win", "concept"], "full")
    downs = drivers.select(*own, F.col("concept").alias("up"), F.explode("downstream").alias("down"))
    links = downs.select(*own, F.col("up").alias("concept"), F.col("down").alias("other"), F.lit("down").alias("side")).unionByName(
        downs.select(*own, F.col("down").alias("concept"), F.col("up").alias("other"), F.lit("up").alias("side")))
    other = state.select(*by, "mi", "win", F.col("concept").alias("other"), *[F.col(c).alias("o_" + c) for c in ("a", "way", "onset", "pa", "pway", "ponset")])
    near = state.join(links, [*own, "concept"], "left").join(other, [*by, "mi", "win", "other"], "left")
    up, down = F.col("side") == "up", F.col("side") == "down"
    explains = F.when(up & (F.col("o_onset") <= F.coalesce("onset", F.lit(NEVER))) & (F.col("o_way") == F.col("way")), F.col("o_a"))
    explained = F.when(up & F.col("o_ponset").isNotNull() & (F.col("o_pway") == F.col("way")), F.col("o_pa"))
    later = F.when(down & (F.col("o_onset") >= F.col("onset")) & (F.col("o_way") == F.col("way")), F.col("o_a"))
    confirms = F.when(down & F.col("o_onset").isNotNull() & (F.col("o_way") == F.col("pway")), F.col("o_a"))
    seen = near.groupBy(*by, "mi", "win", "concept").agg(
        *[F.first(c).alias(c) for c in ("a", "onset", "pa", "ponset")],
        F.coalesce(F.greatest(F.max(explains), F.max(explained)), F.lit(0.0)).alias("explained"),
        F.coalesce(F.avg(later), F.lit(0.0)).alias("later"), F.coalesce(F.avg(confirms), F.lit(0.0)).alias("confirmed"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_WEIGHT.items() for x in kv]), F.col("role"))
    share = F.when(F.col("a") > 0, F.least(F.lit(1.0), F.col("explained") / F.col("a"))).otherwise(0.0)
    moved = F.coalesce(weight * F.col("a") * (1 - EXPLAIN_AWAY * share) + PROPAGATION_SUPPORT * F.col("a") * F.col("later"), F.lit(0.0))
    passing = F.when(F.col("ponset").isNotNull(), F.col("pa") * F.sqrt("confirmed")).otherwise(0.0)
    return seen.join(drivers.select(*own, "concept", "role", "ord"), [*own, "concept"]).select(
        *by, "concept", "role", "ord", "mi", "win", rounded(F.greatest(moved, passing), 4).alias("score"), "onset", "ponset")


def similarities(found: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """mi, past and similarity: cosine of the months' signed z over the drivers that found has, three digits, earlier months only.

    found (of_drivers) has evidence on drivers; earlier months come from history, which cases share, or from found itself.
    """
    history = found if history is None else history
    by, old_by = keys(found), keys(history)

    def vectors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        v = df.filter("win = 'month'").select(*keys(df), "concept", "mi", (F.col("z") * F.col("direction")).alias("z"))
        return v, v.groupBy(*keys(df), "mi").agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("norm"))

    (v, norm), (old, old_norm) = vectors(found), vectors(history)
    old = old.withColumnsRenamed({"mi": "past", "z": "y"})
    dots = v.join(old, [*old_by, "concept"]).filter("past < mi").groupBy(*by, "mi", "past").agg(F.sum(F.col("z") * F.col("y")).alias("dot"))
    dots = dots.join(norm, [*by, "mi"]).join(old_norm.withColumnsRenamed({"mi": "past", "norm": "past_norm"}), [*old_by, "past"])
    return dots.filter("norm > 0 and past_norm > 0").select(
        *by, "mi", "past", rounded(F.col("dot") / (F.col("norm") * F.col("past_norm")), 3).alias("similarity"))


def episodes(scored: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """mi, top and label: the best driver of each month; a reviewed label (mi, driver) wins."""
    by = keys(scored)
    best = scored.filter("win = 'month'").groupBy(*by, "mi").agg(F.max_by("concept", F.struct("score", -F.col("ord"))).alias("top"))
    if labels is None:
        return best.withColumn("label", F.lit("automatic"))
    return best.join(labels, [*keys(labels), "mi"], "left").select(
        *by, "mi", F.coalesce("driver", "top").alias("top"), F.when(F.col("driver").isNotNull(), "reviewed").otherwise("automatic").alias("label"))


def analogs(found: DataFrame, library: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """mi, place, past, similarity, top: the three most similar earlier months of the library, if similar at all. found: see similarities."""
    by = keys(found)
    order = Window.partitionBy(*by, "mi").orderBy(F.col("similarity").desc(), "past")
    near = similarities(found, history).join(library.select(*keys(library), F.col("mi").alias("past"), "top"), [*keys(library), "past"])
    return near.withColumn("place", F.row_number().over(order).cast("bigint")).filter(
        (F.col("place") <= TOP_ANALOGS) & (F.col("similarity") > 0)).select(*by, "mi", "place", "past", "similarity", "top")


def analog_support(near: DataFrame) -> DataFrame:
    """mi, concept, support: share of the similarities that speak for a driver."""
    by = [*keys(near), "mi"]
    per = near.groupBy(*by, F.col("top").alias("concept")).agg(F.sum("similarity").alias("s"))
    return per.select(*by, "concept", (F.col("s") / F.sum("s").over(Window.partitionBy(*by))).alias("support"))


def votes(scored: DataFrame) -> DataFrame:
    """mi, concept, votes: 3, 2 and 1 for the first three drivers of each week, abnormal then or the month before."""
    by = [*keys(scored), "mi"]
    order = Window.partitionBy(*by, "win").orderBy(F.col("score").desc(), "ord")
    weekly = scored.filter("win <> 'month' and (onset is not null or ponset is not null)").withColumn("place", F.row_number().over(order))
    return weekly.filter("place <= 3").groupBy(*by, "concept").agg(F.sum(4 - F.col("place")).alias("votes"))


def ranking(found: DataFrame, drivers: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The drivers of every month by weekly votes, score (evidence and analogs) and onset."""
    found = cut(of_drivers(found, drivers))
    scored = cut(scores(found, drivers))
    return ranked(found, scored, analogs(found, episodes(scored, labels)))


def ranked(found: DataFrame, scored: DataFrame, near: DataFrame | None, vote: bool = True) -> DataFrame:
    """The ranking from scores and analogs; without analogs (null) or weekly votes where they are not to count."""
    by = [*keys(scored), "mi"]
    months = found.filter("win = 'month'").select(*by).distinct()
    month = scored.filter("win = 'month'").join(months, by, "left_semi")
    if near is not None:
        alpha = near.select(*by).distinct().withColumn("alpha", F.lit(ALPHA))
        month = month.join(alpha, by, "left").join(analog_support(near), [*by, "concept"], "left")
    else:
        month = month.withColumns({"alpha": F.lit(1.0), "support": F.lit(0.0)})
    month = month.join(votes(scored), [*by, "concept"], "left").na.fill({"alpha": 1.0, "support": 0.0, "votes": 0})
    total = rounded(F.col("alpha") * F.col("score") + (1 - F.col("alpha")) * F.col("support"), 4)
    first = [F.col("votes").desc()] if vote else []
    order = Window.partitionBy(*by).orderBy(*first, F.col("total").desc(), F.coalesce("onset", F.lit(NEVER)), "ord")
    return month.withColumn("total", total).withColumn("rank", F.row_number().over(order).cast("bigint")).select(
        *keys(scored), month_label().alias("month"), "rank", "concept", "role", F.col("score").alias("s_evid"), rounded(F.col("support"), 3).alias("s_ret"),
        F.col("total").alias("score"), "votes", "onset")


METHODS = ("full", "no_analogs", "no_weekly_vote", "naive")


def case_places(series: DataFrame, moved: DataFrame, cases: DataFrame, drivers: DataFrame) -> DataFrame:
    """case_id, method, place, first: where each method ranks the driver of a case (null: nowhere), and whom it ranks first.

    cases: case_id, driver, month; moved: case_id, concept, date, value: the series that a case changes, as they are then, from three months before its month
    to its end. Everything else is shared by all cases: the other series' evidence, and the library of earlier months.
    """
    base = cut(of_drivers(evidence(series), drivers))
    scored = cut(scores(base, drivers))
    library = cut(episodes(scored))
    at = cases.select("case_id", (F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")).alias("at"))
    windows = at.select("case_id", F.explode(F.array("at", F.col("at") - 1)).alias("mi"), "at").filter("mi is not null")
    changed = moved.select("case_id", "concept").distinct()
    fit = (F.col("mi") == F.col("at")) | (F.col("win") == "month")  # of the month before only the whole
    own = evidence(moved).join(windows, ["case_id", "mi"]).filter(fit)
    shared = windows.join(base, "mi").filter(fit).join(changed, ["case_id", "concept"], "left_anti")
    # the month before is as it was, unless the case changes it
    found = cut(of_drivers(own.select(*shared.columns).unionByName(shared).drop("at"), drivers))
    mine = at.withColumnRenamed("at", "mi")
    rated = cut(scores(found, drivers).join(mine, ["case_id", "mi"], "left_semi"))
    now = found.join(mine, ["case_id", "mi"], "left_semi")
    near = cut(analogs(now, library, base))
    orders = {"full": ranked(now, rated, near), "no_analogs": ranked(now, rated, None), "no_weekly_vote": ranked(now, rated, near, vote=False), "naive": _naive(series, moved, cases, drivers)}
    out = None
    for method, order in orders.items():
        place = cases.select("case_id", "driver").join(order.select("case_id", "concept", "rank"), "case_id", "left").groupBy("case_id").agg(
            F.min(F.when(F.col("concept") == F.col("driver"), F.col("rank"))).alias("place"), F.min_by("concept", "rank").alias("first"))
        place = place.select("case_id", F.lit(method).alias("method"), "place", "first")
        out = place if out is None else out.unionByName(place)
    return out


def _naive(series: DataFrame, moved: DataFrame, cases: DataFrame, drivers: DataFrame) -> DataFrame:
    """case_id, concept, rank by the absolute change of the monthly mean against the month before."""
    mean = lambda df: df.groupBy(*keys(df), "concept", month_index().alias("mi")).agg(F.avg("value").alias("mean"))
    at = cases.select("case_id", (F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")).alias("at"))
    windows = at.withColumn("mi", F.explode(F.array("at", F.col("at") - 1)))
    known = drivers.select("concept", "ord")
    own = mean(moved).join(windows, ["case_id", "mi"])
    shared = windows.join(mean(series), "mi").join(moved.select("case_id", "concept").distinct(), ["case_id", "concept"], "left_anti")
    both = own.select(*shared.columns).unionByName(shared).join(known, "concept").groupBy("case_id", "concept", "ord").agg(
        F.max(F.when(F.col("mi") == F.col("at"), F.col("mean"))).alias("now"), F.max(F.when(F.col("mi") < F.col("at"), F.col("mean"))).alias("before"))
    change = F.abs(F.col("now") / F.col("before") - 1)
    order = Window.partitionBy("case_id").orderBy(change.desc(), "ord")
    return both.filter("now is not null and before <> 0").withColumn("rank", F.row_number().over(order).cast("bigint")).select("case_id", "concept", "rank")


def naive_order(series: DataFrame, month: str) -> DataFrame:
    """concept, rank of all series of one month by the absolute change of their monthly mean; of equal ones the first by name."""
    spark = series.sparkSession
    one = spark.createDataFrame([("", month)], "case_id string, month string")
    known = series.select("concept").distinct().withColumn("ord", F.col("concept"))
    nothing = spark.createDataFrame([], "case_id string, concept string, date date, value double")
    return _naive(series, nothing, one, known).select("concept", "rank")


def confusions(places: DataFrame, cases: DataFrame, most: int = 8) -> DataFrame:
    """driver, first, n: whom the full method ranks first in place of the driver, the most frequent ones."""
    missed = places.filter("method = 'full' and coalesce(place, 0) <> 1 and first is not null").join(cases.select("case_id", "driver"), "case_id")
    return missed.groupBy("driver", "first").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "driver", "first").limit(most)


def shocked(series: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, concept, date, value: a copy of the series for each case (driver, onset, size), its level shifted from the onset."""
    hit = (F.col("concept") == F.col("driver")) & (F.col("date") >= F.col("start"))
    return cases.select("case_id", "driver", "start", "size").join(series, F.col("concept") == F.col("driver")).select(
        "case_id", "concept", "date", rounded(F.when(hit, F.col("value") * (1 + F.col("size"))).otherwise(F.col("value")), 4).alias("value"))


def evaluation(placed: DataFrame, axes: tuple[str, ...] = ("driver", "size"), by: tuple[str, ...] = ()) -> DataFrame:
    """top1, top3 and mrr of placed (by, axes, place), over all and by each axis; place null: not ranked."""
    hit = lambda k: rounded(F.avg(F.when(F.col("place") <= k, 1.0).otherwise(0.0)), 4)
    return placed.groupingSets([[*by], *[[*by, a] for a in axes]], *by, *axes).agg(
        F.count("*").alias("n"), hit(1).alias("top1"), hit(3).alias("top3"),
        rounded(F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))) + 1e-12, 4).alias("mrr"))  # halves go up in whatever order places are added
