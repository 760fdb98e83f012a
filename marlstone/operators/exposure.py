"""Exposure: events on lanes, rolled up to headwinds and tailwinds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.lineage import dealt
from marlstone.operators.news import searched

#: Fixed values: (role of a lane, what happened on it) -> effect.
LANE_EFFECT = {
    ("supply", "impaired"): "headwind",
    ("supply", "eased"): "tailwind",
    ("export", "impaired"): "headwind",
    ("export", "eased"): "tailwind",
    ("competitor", "impaired"): "tailwind",
    ("competitor", "eased"): "headwind",
}


#: The same with the words that say why; who is the group that the exposure is about.
LANE_WHY = {
    ("supply", "impaired"): "less {item} reaching {who} from {origin}: availability risk and a higher {item} cost",
    ("supply", "eased"): "{item} supply from {origin} back to normal: lower cost pressure",
    ("export", "impaired"): "{who} {item} shipments to {destination} delayed or costlier (freight, longer route, duties)",
    ("export", "eased"): "{who} {item} shipments to {destination} easier",
    ("competitor", "impaired"): "less competing {item} from {origin} on the market: support for the price {who} gets",
    ("competitor", "eased"): "more competing {item} from {origin}: pressure on the price {who} gets",
}
UNCLEAR_WHY = "direction of the effect unclear"
#: Fixed value: events of one task, each of which may touch many lanes.
PER_TASK = 100_000
IMPAIRED, EASED = ("disrupted", "down"), ("restored", "up")


def effect(role, state):
    out = F.lit("unclear")
    for (r, s), e in LANE_EFFECT.items():
        out = F.when((role == r) & (state == s), e).otherwise(out)
    return out


def remapped(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """Events whose concept is an alias (alias, route) get the route."""
    return events.join(F.broadcast(aliases), F.col("concept") == F.col("alias"), "left").withColumn(
        "concept", F.coalesce("route", "concept")).drop("alias", "route")


def touches(lanes: DataFrame) -> DataFrame:
    """lane_id, role, item, concept, pos, kind: the places where news touches a lane, in order; an export lane's origin is none of them."""
    origin = F.when(F.col("role") != "export", F.col("origin"))
    places = F.concat(F.array(origin), F.coalesce("via", F.array().cast("array<string>")), F.array("destination"))
    kind = F.when(F.col("concept") == F.col("origin"), "origin").when(F.col("concept") == F.col("destination"), "destination").otherwise("route")
    return lanes.select("lane_id", "role", "item", "origin", "destination", F.posexplode(F.array_distinct(F.array_compact(places))).alias("pos", "concept")).select(
        "lane_id", "role", "item", "concept", "pos", kind.alias("kind"))


def lane_links(events: DataFrame, lanes: DataFrame) -> DataFrame:
    """effect, role, item: incidents, first and last date, lanes. Events: incident, date, concept, state.

    Of an incident's touches of a link the first counts, by lane, place on it and date. Events are reduced to one row an
    incident, concept and state before they meet the lanes.
    """
    touched = lambda few: few.join(touches(lanes), "concept").withColumn("effect", effect(F.col("role"), F.col("state")))
    few = dealt(events, "incident", rows=PER_TASK).groupBy("incident", "concept", "state").agg(F.min("date").alias("first"))
    per = touched(few).groupBy("effect", "role", "item", "incident").agg(F.min_by("first", F.struct("lane_id", "pos", "first")).alias("date"))
    lanes_ = touched(events.select("concept", "state").distinct()).groupBy("effect", "role", "item").agg(F.count_distinct("lane_id").alias("lanes"))
    return per.groupBy("effect", "role", "item").agg(
        F.count("*").alias("incidents"), F.min("date").alias("first_date"), F.max("date").alias("last_date")).join(lanes_, ["effect", "role", "item"])


def link_events(events: DataFrame, lanes: DataFrame, most: int = 8) -> DataFrame:
    """effect, role, item, touched (the kinds of touches) and events: the link's first incidents by date, as one text."""
    few = dealt(events, "incident", rows=PER_TASK).groupBy("incident", "concept", "state").agg(F.min("date").alias("first"))
    both = few.join(touches(lanes), "concept").withColumn("effect", effect(F.col("role"), F.col("state")))
    per = both.groupBy("effect", "role", "item", "incident").agg(F.min(F.struct("lane_id", "pos", "first", "kind")).alias("t"))
    told = F.concat_ws(" ", "t.first", "incident", "t.kind")
    ranked = per.withColumn("nth", F.row_number().over(Window.partitionBy("effect", "role", "item").orderBy("t.first", "incident")))
    return ranked.filter(F.col("nth") <= most).groupBy("effect", "role", "item").agg(
        F.array_join(F.array_sort(F.collect_set("t.kind")), ",").alias("touched"), F.array_join(F.array_sort(F.collect_list(told)), "; ").alias("events"))


def _worded(text: str, who: str, **columns: Column) -> Column:
    """A text with columns in the place of names in braces; null columns say nothing."""
    parts = re.split(r"\{(\w+)\}", text.replace("{who}", who))
    return F.concat(*[F.coalesce(columns[x], F.lit("")) if k % 2 else F.lit(x) for k, x in enumerate(parts)])


def explained_links(events: DataFrame, lanes: DataFrame, items: DataFrame, sites: DataFrame, who: str = "the group") -> DataFrame:
    """effect, link, item, incidents, first_date, last_date, why, lanes, lane_status of all links: lanes, markets of items, and own sites.

    events: incident, date, concept, direction; lanes: lane_id, role, item, origin, via, destination, to, status; items: item, side (bought or sold); sites: site.
    Of an incident's touches of a link the first counts, by lane, place on it and date. Reasons, lanes and statuses are sorted and joined by "; ". Events are
    reduced to one row an incident, concept and direction before they meet anything; what is said of a link does not depend on the incidents, so it is
    put together from the different concepts and directions.
    """
    few = dealt(events, "incident", rows=PER_TASK).groupBy("incident", "concept", "direction").agg(F.min("date").alias("first"))
    ways = events.select("concept", "direction").distinct().select(F.lit(None).cast("string").alias("incident"), "concept", "direction", F.lit(None).cast("string").alias("first"))
    hurt, helped, way = F.col("direction").isin(*IMPAIRED), F.col("direction").isin(*EASED), F.col("direction")
    state = F.when(hurt, "impaired").when(helped, "eased").otherwise("unclear")
    route = F.concat_ws(" -> ", "origin", F.when(F.size(F.coalesce("via", F.array().cast("array<string>"))) > 0, F.array_join("via", " -> ")).otherwise("direct"), F.coalesce("destination", "to", F.lit("world market")))
    named = lanes.select("lane_id", "origin", "destination", route.alias("lane"), F.coalesce("status", F.lit("public")).alias("status"))
    why = F.lit(UNCLEAR_WHY)
    for (role, s), text in LANE_WHY.items():
        why = F.when((F.col("role") == role) & (F.col("state") == s), _worded(text, who, item=F.col("item"), origin=F.col("origin"), destination=F.col("destination"))).otherwise(why)
    told = ["incident", "first"]
    bought = F.col("side") == "bought"
    market = (F.when(bought & way.isin("up", "disrupted"), "headwind").when(bought & way.isin("down", "restored"), "tailwind")
              .when(~bought & (way == "up"), "tailwind").when(~bought & (way == "down"), "headwind").otherwise("unclear"))
    dearer = F.when(F.col("effect") == "headwind", "tighter or dearer").when(F.col("effect") == "tailwind", "easier or cheaper").otherwise("moved")
    moved = F.when(way == "up", "price up").when(way == "down", "price down").otherwise(F.coalesce(way, F.lit("moved")))
    reason = F.when(bought, F.concat("item", F.lit(" market "), dearer, F.lit(f": {who} buys it"))).otherwise(F.concat("item", F.lit(" market "), moved, F.lit(f": {who} sells it")))
    none, alone = F.lit(None).cast("string").alias("lane"), F.struct(F.lit("").alias("lane_id"), F.lit(0).alias("pos"), "first").alias("order")
    at_site = F.concat(F.lit(f"event at {who} site "), "site", F.lit(": production of what it makes may be affected"))

    def touched(rows: DataFrame) -> DataFrame:
        on_lanes = rows.withColumn("state", state).join(touches(lanes), "concept").join(named, "lane_id")
        on_lanes = on_lanes.select(*told, effect(F.col("role"), F.col("state")).alias("effect"), F.col("role").alias("link"), "item", F.struct(F.col("lane_id").cast("string").alias("lane_id"), "pos", "first").alias("order"), why.alias("why"), "lane", "status")
        on_items = rows.join(F.broadcast(items.select("item", "side").distinct()), F.col("concept") == F.col("item")).withColumn("effect", market)
        on_items = on_items.select(*told, "effect", F.when(bought, "input market").otherwise("product market").alias("link"), "item", alone, reason.alias("why"), none, F.lit("graph").alias("status"))
        on_sites = rows.join(F.broadcast(sites.select("site").distinct()), F.col("concept") == F.col("site"))
        on_sites = on_sites.select(*told, F.when(hurt, "headwind").when(helped, "tailwind").otherwise("unclear").alias("effect"), F.lit("own site").alias("link"), F.col("site").alias("item"), alone, at_site.alias("why"), none, F.lit("graph").alias("status"))
        return on_lanes.unionByName(on_items).unionByName(on_sites)

    key = ["effect", "link", "item"]
    dates = touched(few).groupBy(*key, "incident").agg(F.min_by("first", "order").alias("date")).groupBy(*key).agg(F.count("*").alias("incidents"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    words = touched(ways).select(*key, "why", "lane", "status").distinct().groupBy(*key).agg(joined("why").alias("why"), joined("lane").alias("lanes"), joined("status").alias("statuses"))
    public = F.when(F.col("statuses") == "public", "public knowledge, not confirmed").otherwise(F.col("statuses"))
    return dates.join(words, key).withColumn("lane_status", public).drop("statuses")


def merged_events(reports: DataFrame, incidents: DataFrame) -> DataFrame:
    """incident, date, concept, direction, channel and article_ids of reports (event_id, date, concept, direction, channel, article_id).

    incidents: event_id, incident, incident_date; an event of none is its own. Of an incident's reports on a concept the most frequent direction and
    channel count, the first seen of equal ones, and the three least articles are named.
    """
    both = reports.join(incidents, "event_id", "left").withColumns({
        "incident": F.coalesce("incident", F.col("event_id").cast("string")), "date": F.coalesce("incident_date", "date")})
    key = ["incident", "concept"]

    def most(c: str) -> DataFrame:
        n = both.groupBy(*key, c).agg(F.count("*").alias("n"), F.min("event_id").alias("seen"))
        return n.groupBy(*key).agg(F.max_by(c, F.struct("n", -F.col("seen"))).alias(c))

    rest = both.groupBy(*key).agg(F.min_by("date", "event_id").alias("date"), F.array_join(F.slice(F.array_sort(F.collect_set("article_id")), 1, 3).cast("array<string>"), ",").alias("article_ids"))
    return rest.join(most("direction"), key).join(most("channel"), key)


def site_effects(events: DataFrame, made_at: DataFrame) -> DataFrame:
    """effect, site, product, incidents of events at sites, for what is made there (site, product)."""
    impaired, eased = F.col("direction").isin("disrupted", "down"), F.col("direction").isin("restored", "up")
    named = events.withColumn("effect", F.when(impaired, "headwind").when(eased, "tailwind").otherwise("unclear"))
    counted = dealt(named.select("effect", F.col("concept").alias("site"), "incident"), "incident").distinct().groupBy("effect", "site").agg(F.count("incident").alias("incidents"))
    return counted.join(made_at.distinct(), "site")


def reached(items: DataFrame, made_from: DataFrame, own: DataFrame) -> DataFrame:
    """item, product: the own products that an item reaches, as itself or through what is made from it (product, input)."""
    up = searched(made_from.select(F.col("input").alias("src"), F.col("product").alias("dst")), items.select(F.col("item").alias("seed")))
    return up.select(F.col("seed").alias("item"), F.col("node").alias("product")).join(own.select("product").distinct(), "product", "left_semi").select("item", "product")


def scoped(links: DataFrame, reach: DataFrame, scope: str | None = None) -> DataFrame:
    """links (effect, role, item, incidents) with the products they reach, as one text; with a scope only those that reach it."""
    told = reach.groupBy("item").agg(F.array_sort(F.collect_set("product")).alias("reached"))
    out = links.join(told, "item", "left").withColumn("reached", F.coalesce("reached", F.array().cast("array<string>")))
    out = out.filter(F.array_contains("reached", scope)) if scope else out
    return out.withColumn("reached", F.array_join("reached", ","))


def untouched(items: DataFrame, links: DataFrame, reach: DataFrame) -> DataFrame:
    """Items that no link is about, nor reaches."""
    hit = links.select("item").unionByName(links.join(reach, "item").select(F.col("product").alias("item"))).distinct()
    return items.select("item").distinct().join(hit, "item", "left_anti")


def status_label(statuses: DataFrame) -> DataFrame:
    """item, lane_status of lanes (item, status): a note where all are public, else the statuses."""
    held = statuses.groupBy("item").agg(F.array_sort(F.collect_set("status")).alias("s"))
    return held.select("item", F.when(F.size(F.array_except("s", F.array(F.lit("public")))) == 0, "public knowledge, not confirmed").otherwise(F.array_join("s", ",")).alias("lane_status"))


def lane_snapshot(lanes: DataFrame, hops: DataFrame) -> DataFrame:
    """lanes with via: the routes of hops (lane_id, nth, route) in order, as one text; "direct" without any."""
    told = hops.groupBy("lane_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "route"))), lambda x: x["route"]), " -> ").alias("via"))
    return lanes.join(told, "lane_id", "left").na.fill({"via": "direct"})


def monthly_prices(prices: DataFrame, configured: DataFrame, first: str, last: str) -> DataFrame:
    """concept, month, mean, source: each product's configured route (product, location, incoterm); where that has fewer than two
    months in the period, its most quoted route in it, of equal ones the first by name."""
    route = ["product", "location", "incoterm"]
    inside = prices.filter(F.col("date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    monthly = inside.groupBy(*route, F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum("mid").alias("s"), F.count("*").alias("n"))
    routes = monthly.groupBy(*route).agg(F.sum("n").alias("n"), F.count("*").alias("months")).join(configured.select(*route, F.lit(True).alias("own")), route, "left")
    good = F.col("own").isNotNull() & (F.col("months") >= 2)
    order = Window.partitionBy("product").orderBy(good.desc(), F.col("n").desc(), "location", "incoterm")
    best = routes.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select(*route, F.when(good, "configured").otherwise("most quoted").alias("source"))
    return monthly.join(best, route).select(F.col("product").alias("concept"), "month", (F.col("s") / F.col("n")).alias("mean"), "source")


def market_effects(events: DataFrame, roles: DataFrame) -> DataFrame:
    """effect, role, item, incidents of events on the items themselves: dearer inputs hurt, dearer products help.

    roles: item, role (bought or sold). A disrupted input is dearer, a restored one cheaper; for products these two, and other
    directions for both, are unclear.
    """
    up, down = F.col("direction") == "up", F.col("direction") == "down"
    scarce, plenty = F.col("direction").isin("up", "disrupted"), F.col("direction").isin("down", "restored")
    bought = F.col("role") == "bought"
    # a few items against many events: shuffled by item, one task would hold an item's events
    named = events.join(F.broadcast(roles), F.col("concept") == F.col("item")).withColumn(
        "effect", F.when((bought & scarce) | (~bought & down), "headwind").when((bought & plenty) | (~bought & up), "tailwind").otherwise("unclear"))
    return dealt(named.select("effect", "role", "item", "incident"), "incident").distinct().groupBy("effect", "role", "item").agg(F.count("incident").alias("incidents"))
