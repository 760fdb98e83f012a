"""Quality rules at document and host level (DataFrame functions only).

A document's own rules are computed from its whole text. Their failures are then counted by host (the
source column); a host's failure rate is shrunk towards the corpus by a beta prior fitted to all hosts by the
method of moments, and hosts whose shrunk rate is over a limit have all their documents rejected.

Defined cases: null text has no words (and so fails); null source is a host of its own; an empty table
gives no rows; repeated rows are counted and returned as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Hosts are rejected when over half of their documents fail, after shrinking.
HOST_LIMIT = 0.5
#: The prior counts as so many documents at least and at most.
PRIOR_MIN, PRIOR_MAX = 1.0, 1000.0
SYMBOLS = "#*$%&|<>"


def repeated_words(w: Column) -> Column:
    """Words in windows of five that are found twice or more: windows are hashed, sorted with their
    place, and the places whose hash stands beside an equal one are merged."""
    n = F.size(w)
    hashes = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")))

    def places(s: Column) -> Column:
        near = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        twice = F.filter(F.transform(s, lambda x, i: F.when(near(i, i - 1) | near(i, i + 1), x["i"])), lambda x: x.isNotNull())
        return F.sort_array(twice)

    def covered(p: Column) -> Column:
        return F.aggregate(
            p, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n")),
            lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(x - a["last"], F.lit(WINDOW))).alias("n")),
            lambda a: a["n"])

    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  names a value once
    some = once(hashes, lambda h: F.when(
        F.size(F.array_distinct(F.transform(h, lambda x: x["h"]))) == F.size(h), F.lit(0).cast("bigint"))
        .otherwise(once(F.sort_array(h), lambda s: covered(places(s)))))
    return F.when(n <= WINDOW, F.lit(0).cast("bigint")).otherwise(some)


def document_rules(docs: DataFrame) -> DataFrame:
    """doc_id, host, the counts of each document and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id"), F.col("source").alias("host"), text.alias("t"), common.words(F.col("text")).alias("w"))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: F.btrim(x, F.lit(common.SPACES)) != "")
    out = base.select(
        "doc_id", "host",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.translate(F.col("t"), common.SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.translate(F.col("t"), SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"))
    return out.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(rules: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n, failed, rate (shrunk) and host_ok of each host."""
    hosts = rules.groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failed"))
    p = F.col("failed") / F.col("n")
    prior = hosts.agg(
        (F.sum("failed") / F.sum("n")).alias("m"),
        F.sum(F.col("failed") * p).alias("s2"), F.sum("n").alias("nn"))
    v = F.greatest(F.col("s2") / F.col("nn") - F.col("m") * F.col("m"), F.lit(0.0))
    raw = F.when(v > 0, F.col("m") * (1 - F.col("m")) / v - 1).otherwise(F.lit(PRIOR_MAX))
    m, k = prior.select("m", F.least(F.greatest(raw, F.lit(PRIOR_MIN)), F.lit(PRIOR_MAX)).alias("k")).first()
    if m is None:  # no documents
        m, k = 0.0, PRIOR_MAX
    rate = (F.col("failed") + F.lit(m * k)) / (F.col("n") + F.lit(k))
    return hosts.select("host", "n", "failed", rate.alias("rate"), (rate <= limit).alias("host_ok"))


@common.tidy("quality-rules")
def quality_rules(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Every document with its counts, base_failed, its host's rate and the verdict kept."""
    rules = common.written(document_rules(docs), "document-rules")
    verdicts = common.written(host_verdicts(rules, limit), "host-verdicts")
    total = rules.count()
    key = lambda df: df.withColumn("host_key", F.struct(F.col("host").alias("h")))  # noqa: E731  null is a host too
    found = common.lookup(key(rules), key(verdicts).drop("host", "failed"), ["host_key"], "n", total)
    return found.drop("host_key", "n").withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
