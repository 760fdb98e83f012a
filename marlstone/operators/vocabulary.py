"""Concepts, their terms and relations: checks, alias expansion, look-ups, and the match of labels with concepts.

Concepts are (id, kind, name), terms (term, concept_id), edges (src, rel, dst).
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.lineage import cut

#: Words that say nothing about a label, and aliases that stand for nothing.
STOP_WORDS = ["de", "du", "des", "la", "le", "les", "et", "en", "the", "of", "and", "per", "par", "a", "au", "aux", "t", "kt", "mt"]
PLACEHOLDERS = ["", "nan", "none", "null", "undefined"]
#: Scores from which a match is taken, taken if no other concept matches as well, or shown for review.
ACCEPT, ACCEPT_ALONE, REVIEW = 0.75, 0.6, 0.40
#: What a row of a budget is, by words of its label; the first that fits.
DRIVER_WORDS = [
    ("consumption_ratio", ["consommation specifique", "conso specifique", "ratio", "t/t", "par tonne de"]),
    ("margin", ["marge", "margin", "ebitda", "resultat", "ebit"]),
    ("revenue", ["chiffre d affaires", "revenue", "sales value", "ca "]),
    ("fixed_cost", ["couts fixes", "cout fixe", "fixed cost", "frais fixes"]),
    ("freight", ["fret", "freight", "transport"]),
    ("fx", ["taux de change", "usd/mad", "fx", "exchange rate"]),
    ("price", ["prix", "price", "netback", "$/t", "usd/t"]),
    ("cost", ["cout", "cost", "charges", "depenses", "achats", "consommee", "consumed"]),
    ("volume", ["production", "volume", "tonnage", "quantite", "ventes", "exports", "kt"]),
]
UNIT = r"(?i)\(([^)]*(?:\$|t|kt|m|mad|usd|%)[^)]*)\)"
ROLES, STATUSES = ["supply", "export", "competitor"], ["public", "confirmed"]


def _plain_letters() -> tuple[str, str]:
    """Accented Latin letters and the ASCII letter each is written with, by Unicode's decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) for c in range(0xC0, 0x250)]
    one = [(a, b) for a, b in pairs if len(b) == 1]
    return "".join(a for a, _ in one), "".join(b for _, b in one)


_ACCENTED, _PLAIN = _plain_letters()


def norm_words(text: Column) -> Column:
    """The words of a text: lower case, without accents, other signs and stop words."""
    plain = F.lower(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _ACCENTED, _PLAIN), r"[^\x00-\x7F]", ""))
    return F.filter(F.regexp_extract_all(plain, F.lit(r"([a-z0-9]+)"), F.lit(1)), lambda w: ~w.isin(STOP_WORDS))


def integrity(concepts: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """problem, id: ids that stand twice, kinds not known, concepts without id, kind or name, relations to nowhere."""
    named = lambda df, problem: df.select(F.lit(problem).alias("problem"), "id")
    twice = concepts.filter("id is not null").groupBy("id").count().filter("count > 1")
    unknown = concepts.filter(F.col("kind").isNotNull() & ~F.col("kind").isin(kinds))
    part = concepts.filter("id is null or kind is null or name is null")
    ids = concepts.select("id").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(ids, "id", "left_anti")
    return named(twice, "duplicate").unionByName(named(unknown, "unknown kind")).unionByName(named(part, "incomplete")).unionByName(named(ends, "dangling")).distinct()


def orphan_impact(removed: DataFrame, edges: DataFrame) -> DataFrame:
    """id, rel, side, n: the relations that go with removed concepts."""
    ends = edges.select(F.col("src").alias("id"), "rel", F.lit("out").alias("side")).unionByName(edges.select(F.col("dst").alias("id"), "rel", F.lit("in").alias("side")))
    return ends.join(removed.select("id").distinct(), "id", "left_semi").groupBy("id", "rel", "side").agg(F.count("*").alias("n"))


def region_dimension(countries: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts of all countries (country, region_id) and regions (region_id, region), and the IN_REGION relations."""
    both = countries.join(regions, "region_id", "left")
    ids = lambda kind, c: F.concat(F.lit(kind + "_"), F.lower(F.regexp_replace(c, " ", "_")))
    concepts = both.select(ids("country", F.col("country")).alias("id"), F.lit("country").alias("kind"), F.col("country").alias("name")).unionByName(
        regions.select(ids("region", F.col("region")).alias("id"), F.lit("region").alias("kind"), F.col("region").alias("name")))
    edges = both.filter("region is not null").select(ids("country", F.col("country")).alias("src"), F.lit("IN_REGION").alias("rel"), ids("region", F.col("region")).alias("dst"))
    return concepts.distinct(), edges.distinct()


def expanded(aliases: DataFrame, terms: DataFrame) -> DataFrame:
    """terms and those that aliases (alias, canonical) add: each alias gets the concepts of its canonical term; placeholders go."""
    human = lambda c: F.btrim(F.replace(c, F.lit("_"), F.lit(" ")))
    real = aliases.select(human(F.col("alias")).alias("term"), F.lower(human(F.col("canonical"))).alias("key_")).filter(~F.lower("term").isin(PLACEHOLDERS))
    known = terms.select(F.lower("term").alias("key_"), "concept_id").distinct()
    return terms.select("term", "concept_id").unionByName(real.join(known, "key_").select("term", "concept_id")).distinct()


def changes(old: dict[str, DataFrame], new: dict[str, DataFrame], edges: DataFrame, additions: DataFrame) -> DataFrame:
    """sign, what, said: what a reload of the vocabulary would change. + and - for concepts, terms and relations that come and go, ~ for each field of a concept
    that differs, and ! for what concepts that go would leave behind: their edges in other layers, by relation and side, and added terms.

    old and new: concepts (id, kind, name, definition), terms (term, concept_id), relations (src, rel, dst), each row once; edges: src, rel, dst; additions: term, concept_id.
    """
    line = lambda df, sign, what, said: df.select(F.lit(sign).alias("sign"), F.lit(what).alias("what"), said.alias("said"))
    fields = ("kind", "name", "definition")
    side = lambda d, s: d["concepts"].select("id", F.lit(True).alias(f"in_{s}"), *[F.col(f).alias(f"{f}_{s}") for f in fields])
    both = side(old, "old").join(side(new, "new"), "id", "full")
    told = lambda k: F.concat("id", F.lit(" ("), F.coalesce(k, F.lit("")), F.lit(")"))
    gone = both.filter("in_new is null")
    out = line(both.filter("in_old is null"), "+", "concept", told(F.col("kind_new"))).unionByName(line(gone, "-", "concept", told(F.col("kind_old"))))
    stay = both.filter("in_old and in_new")
    shown = lambda c: F.coalesce(c, F.lit("nothing"))
    moved = F.array_compact(F.array(*[
        F.when(~F.col(f"{f}_old").eqNullSafe(F.col(f"{f}_new")), F.concat("id", F.lit(f".{f}: "), shown(F.col(f"{f}_old")), F.lit(" -> "), shown(F.col(f"{f}_new")))) for f in fields]))
    out = out.unionByName(stay.select(F.lit("~").alias("sign"), F.lit("concept").alias("what"), F.explode(moved).alias("said")))
    for what, said in (("terms", F.concat("term", F.lit(" -> "), "concept_id")), ("relations", F.concat_ws(" ", "src", "rel", "dst"))):
        a, b = old[what].distinct(), new[what].distinct()
        out = out.unionByName(line(b.join(a, b.columns, "left_anti"), "+", what[:-1], said)).unionByName(line(a.join(b, a.columns, "left_anti"), "-", what[:-1], said))
    lost = orphan_impact(gone.select("id"), edges)
    out = out.unionByName(line(lost, "!", "edges", F.concat("id", F.lit(" "), "side", F.lit(" "), "rel", F.lit(": "), F.col("n").cast("string"))))
    orphans = additions.join(gone.select(F.col("id").alias("concept_id")), "concept_id", "left_semi")
    return out.unionByName(line(orphans, "!", "added term", F.concat("term", F.lit(" -> "), "concept_id")))


def looked_up(terms: DataFrame, query: str) -> DataFrame:
    """concept_id, exact of the concepts that a text names, exactly or as a part of a term; exact ones first."""
    q = F.lower(F.lit(query))
    hit = terms.filter(F.contains(F.lower("term"), q)).groupBy("concept_id").agg(F.bool_or(F.lower("term") == q).alias("exact"))
    return hit.orderBy(F.col("exact").desc(), "concept_id")


def neighbourhood(concepts: DataFrame, edges: DataFrame, terms: DataFrame) -> DataFrame:
    """id and its outgoing and incoming relations and terms, each as one sorted text."""
    told = lambda a, b: F.concat_ws(" ", a, b)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    out = edges.groupBy(F.col("src").alias("id")).agg(joined(told("rel", "dst")).alias("outgoing"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(joined(told("rel", "src")).alias("incoming"))
    named = terms.groupBy(F.col("concept_id").alias("id")).agg(joined("term").alias("terms"))
    return concepts.select("id").join(out, "id", "left").join(into, "id", "left").join(named, "id", "left").na.fill("", ["outgoing", "incoming", "terms"])


def matched(labels: DataFrame, terms: DataFrame, kinds: DataFrame, order: list[str] | None = None) -> DataFrame:
    """label_id, concept_id, score and decision of each label (label_id, label); kinds: concept_id, kind.

    A term matches when all its words are in the label, and scores by how much of the label it covers. Each term is looked for under
    its rarest word only, by the number of labels that have it; a term with a word that no label has is not looked for. So no
    pair meets on a common word unless a term has no other. order: allowed kinds, earlier ones win ties; then the least id.

    Labels of the same words are matched once. Concepts that share a term score alike by it, so a concept can only be a label's first or second
    if it is so among those of the term that it scores best by; no other concepts of a term meet the labels.
    """
    place = F.lit(0)
    if order:
        kinds = kinds.filter(F.col("kind").isin(order))
        place = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    kinds = kinds.groupBy("concept_id", "kind").agg(F.least(F.count("*"), F.lit(2)).alias("copies")).withColumn("p", place.cast("int"))
    held = cut(labels.filter("label_id is not null").select("label_id", F.array_sort(F.array_distinct(norm_words(F.col("label")))).alias("held")))
    sets = cut(held.select("held").distinct().withColumn("set_", F.monotonically_increasing_id()))
    words = sets.select("set_", F.explode("held").alias("word"))
    own = terms.select("concept_id", norm_words(F.col("term")).alias("w")).distinct().filter("size(w) > 0").join(kinds.groupBy("concept_id").agg(F.min("p").alias("p")), "concept_id")
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("w").orderBy("p", "concept_id"))).filter("nth <= 2")
    own = cut(own.groupBy("w").agg(F.collect_list("concept_id").alias("concepts")))
    parts = own.select("w", "concepts", F.explode(F.array_distinct("w")).alias("word"))
    often = words.join(parts.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("often"))
    rarest = parts.join(often, "word", "left").groupBy("w").agg(
        F.min_by("word", F.struct("often", "word")).alias("word"), F.min("concepts").alias("concepts"), F.count_if(F.col("often").isNull()).alias("absent"))
    met = words.join(rarest.filter("absent = 0"), "word").select("set_", "w", "concepts")
    hits = met.join(sets, "set_").filter(F.size(F.array_except("w", "held")) == 0).select(
        "set_", F.explode("concepts").alias("concept_id"), F.size("w").alias("n_term"), F.size("held").alias("n_label"))
    best = hits.groupBy("set_", "concept_id").agg(F.max(0.5 + 0.5 * F.col("n_term") / F.col("n_label")).alias("score")).join(kinds, "concept_id")
    ranked = best.withColumn("key_", F.struct((-F.col("score")).alias("s"), "p", F.col("concept_id").alias("c"), "kind", "copies"))
    few = ranked.groupBy("set_").agg(F.slice(F.array_sort(F.collect_list("key_")), 1, 2).alias("t"))  # the concepts of one label's terms, two a term
    each = held.join(sets, "held").select("label_id", "set_").join(few, "set_").select("label_id", F.explode("t").alias("key_"))
    each = each.groupBy("label_id", "key_.c", "key_.kind").agg(F.min("key_").alias("key_"))  # an id may stand at several labels
    twice = F.flatten(F.transform(F.array_sort(F.collect_list("key_")), lambda x: F.array_repeat(x, x["copies"].cast("int"))))
    two = each.groupBy("label_id").agg(F.slice(twice, 1, 2).alias("t"))
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    score = -first["s"]
    prefers = F.lit(bool(order)) & (first["kind"] != second["kind"])
    alone = F.coalesce(second.isNull() | (second["s"] > first["s"]) | prefers, F.lit(True))
    decision = F.when((score >= ACCEPT) | (alone & (score >= ACCEPT_ALONE)), "accept").when(score >= REVIEW, "review").otherwise("unknown")
    found = two.select("label_id", first["c"].alias("concept_id"), F.round(score, 3).alias("score"), decision.alias("decision"))
    return labels.select("label_id").join(found, "label_id", "left").na.fill({"score": 0.0, "decision": "unknown"})


def driver_type(label: Column) -> Column:
    text = F.concat_ws(" ", F.array_join(norm_words(label), " "), F.lower(label))
    out = F.lit("unknown")
    for kind, words in reversed(DRIVER_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, kind).otherwise(out)
    return out


def unit_of(label: Column) -> Column:
    """The unit that stands in parentheses; null without one."""
    return F.nullif(F.btrim(F.regexp_extract(label, UNIT, 1)), F.lit(""))


def clashes(terms: DataFrame, names: DataFrame) -> DataFrame:
    """term, concept_id, name_kind: terms that are names of places or companies (name, kind) too."""
    own = terms.select(F.lower(F.btrim("term")).alias("key_"), "term", "concept_id")
    return own.join(names.select(F.lower(F.btrim("name")).alias("key_"), F.col("kind").alias("name_kind")).distinct(), "key_").select("term", "concept_id", "name_kind").distinct()


def lane_problems(lanes: DataFrame, kinds: DataFrame) -> DataFrame:
    """lane_id (role:item:origin:end) and problems of each lane (row_id, role, status, item, origin, to, destination, via, share); kinds: id, kind."""
    kind_of = lambda c: kinds.select(F.col("id").alias(c), F.col("kind").alias(f"{c}_kind"))
    routes = lanes.select("row_id", F.explode("via").alias("route")).join(kinds.withColumnRenamed("id", "route"), "route", "left")
    routes = routes.groupBy("row_id").agg(F.bool_and(F.coalesce(F.col("kind") == "route", F.lit(False))).alias("routes_ok"))
    both = lanes.join(kind_of("item"), "item", "left").join(kind_of("to"), "to", "left").join(routes, "row_id", "left")
    no = lambda c: F.coalesce(~c, F.lit(True))
    share_ok = F.col("share").isNull() | ((F.col("status") == "confirmed") & F.col("share").between(0, 1))
    rules = {
        "role": no(F.col("role").isin(ROLES)), "status": no(F.col("status").isin(STATUSES)), "item": no(F.col("item_kind").isin("product", "input")),
        "via": ~F.coalesce("routes_ok", F.lit(True)), "origin": no(F.startswith("origin", F.lit("country_"))),
        "to": (F.col("role") == "supply") & no(F.col("to_kind") == "site"),
        "destination": (F.col("role") == "export") & no(F.startswith("destination", F.lit("country_"))), "share": no(share_ok)}
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    lane_id = F.concat_ws(":", F.lit("lane"), "role", "item", "origin", F.coalesce("to", "destination", F.lit("world")))
    same = F.count("*").over(Window.partitionBy("lane_id"))
    return both.select("row_id", lane_id.alias("lane_id"), found.alias("found")).withColumn("problems", F.array_join(
        F.concat("found", F.when(same > 1, F.array(F.lit("duplicate"))).otherwise(F.array().cast("array<string>"))), ",")).drop("found")


def expected_inputs(made_from: DataFrame, hops: int = 3) -> DataFrame:
    """product, input: what a product is made from (product, input) over so many hops, without itself."""
    step = found = made_from.select("product", "input").distinct()
    for _ in range(hops - 1):
        step = step.join(made_from.select(F.col("product").alias("input"), F.col("input").alias("next_")), "input").select("product", F.col("next_").alias("input")).distinct()
        found = found.unionByName(step)
    return found.filter("product <> input").distinct()


def missing_inputs(expected: DataFrame, seen: DataFrame) -> DataFrame:
    return expected.join(seen.select("product", "input").distinct(), ["product", "input"], "left_anti")
