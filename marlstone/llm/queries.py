"""The registered queries of the training-data operators, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import (
    common,     digest_index, ftrl, host_rules, html_wrapper, mixing, near_vectors, packing, pseudonyms, resampling, rnn_lm, simhash, spelling,
    substring)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id", "same")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(_table(spark, sf_dir, "pages"))


def op4_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.quality_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digest_index.exact_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op9_rnn_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rnn_lm.score(_table(spark, sf_dir, "documents"))


def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    # the key is a secret of whoever runs the job; without one the made-up data of the tests get a known one
    return pseudonyms.pseudonymise(docs, spark.conf.get("marlstone.pseudonym.key", pseudonyms.DEMO_KEY))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(_table(spark, sf_dir, "documents"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_mixing, op3_html_wrapper, op4_host_quality_rules, op5_quality_classifier,
        op6_best_fit_packing, op7_substring_dedup, op8_exact_dedup, op9_rnn_lm_scoring, op10_feistel_pseudonyms,
        op11_spelling_variants, op12_embedding_near_dedup, op13_importance_resampling)
}

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: The CRC-32 of each byte value; a macro folds it over a text's UTF-8 bytes.
CRC_SQL = """
crc_steps AS (
  SELECT i, i::BIGINT AS c, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, step + 1 FROM crc_steps WHERE step < 8),
crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM crc_steps WHERE step = 8)"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text, in a query with crcs of crc_table."""
    digit = lambda at: f"(strpos('0123456789ABCDEF', hex(encode({text}))[2 * k + {at}]) - 1)"
    codes = f"list_transform(range(strlen({text})), lambda k: (16 * {digit(1)} + {digit(2)})::BIGINT)"
    fold = f"list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1]))"
    return f"xor(4294967295::BIGINT, {fold})"


def runs_sql(folded: str, signs: str) -> str:
    return f"list_filter(regexp_split_to_array({folded}, '[^{signs}]+'), lambda x: x <> '')"


FOLDED = f"translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}')"

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size,
         substr(sha256('{mixing.SEED}:' || CAST(doc_id AS VARCHAR)), 1, 16) AS key
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM totals),
weighed AS (
  SELECT *, ([5, 2, 1])[(nth - 1) % 3 + 1] AS w FROM ranked),
levels AS (
  SELECT *, row_number() OVER (ORDER BY CAST(source_size * 3 AS DOUBLE) / w, nth) AS pos,
    CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (
      ORDER BY CAST(source_size * 3 AS DOUBLE) / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(w) OVER (ORDER BY CAST(source_size * 3 AS DOUBLE) / w, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM weighed),
final AS (
  SELECT source, source_size,
    least(CAST(source_size * 3 AS DOUBLE), w * (SELECT min_by(lvl, pos) FROM levels WHERE w * lvl <= source_size * 3)) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, f.source_size, f.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CAST(round(f.target) AS BIGINT) AS budget
  FROM sized s JOIN final f ON s.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
    + least(greatest(budget % source_size - before, 0), size) END AS BIGINT) AS taken
FROM placed
""",
    "op4_host_quality_rules": rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
wins AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 4)) AS i, w FROM docs WHERE len(w) >= 5),
keyed AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS n FROM wins),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM keyed, (SELECT unnest(generate_series(0, 4)) AS k) WHERE n > 1 GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM docs d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < {host_rules.MIN_WORDS} OR 100 * n_repeat_words > {host_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base),
hosts AS (
  SELECT source, count(*) AS n, CAST(sum(CAST(base_failed AS BIGINT)) AS BIGINT) AS failed FROM judged GROUP BY source),
moments AS (
  SELECT sum(failed) / sum(n) AS m, greatest(sum(failed * (failed / n)) / sum(n) - (sum(failed) / sum(n)) * (sum(failed) / sum(n)), 0.0) AS v FROM hosts),
prior AS (
  SELECT m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE {host_rules.PRIOR_MAX} END, {host_rules.PRIOR_MIN}), {host_rules.PRIOR_MAX}) AS k FROM moments),
verdicts AS (
  SELECT source, (failed + m * k) / (n + k) <= {host_rules.HOST_LIMIT} AS host_ok FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept
FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source
""",
    "op11_spelling_variants": f"""
WITH RECURSIVE {CRC_SQL},
found AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest({runs_sql(FOLDED, "a-z\u00c0-\u00ff")}) AS run FROM documents) GROUP BY doc_id, run),
hashed AS (
  SELECT run, k, {crc_sql("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h FROM found, crc_table),
changed AS (
  SELECT CASE WHEN h % {spelling.EVERY} = 0
      THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k
  FROM hashed),
vocab AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM changed WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word
  HAVING sum(k) >= {spelling.LEAST_COUNT}),
cuts AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cuts c JOIN vocab v ON c.rest = v.word
  UNION SELECT v.word, c.word, c.n FROM cuts c JOIN vocab v ON c.rest = v.word),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {spelling.RATIO} * n THEN near END AS form,
    CASE WHEN near_n >= {spelling.RATIO} * n THEN near_n END AS form_n
  FROM vocab v LEFT JOIN best USING (word)),
walked AS (
  SELECT word, word AS last_word FROM forms
  UNION ALL SELECT w.word, f.form FROM walked w JOIN forms f ON f.word = w.last_word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.last_word AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walked w USING (word) JOIN forms e ON e.word = w.last_word AND e.form IS NULL
""",
    "op12_embedding_near_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= {near_vectors.THRESHOLD}),
reached AS (
  SELECT vec_id, vec_id AS seen FROM embeddings UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.seen),
tops AS (
  SELECT vec_id, min(seen) AS component_id FROM reached GROUP BY vec_id)
SELECT vec_id, coalesce(k, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM tops LEFT JOIN (SELECT a AS vec_id, count(*) AS k FROM links GROUP BY a) USING (vec_id)
""",
    "op13_importance_resampling": f"""
WITH RECURSIVE {CRC_SQL},
texts AS (
  SELECT 0 AS side, doc_id, {runs_sql(FOLDED, "0-9a-z\u0080-\U0010ffff")} AS w FROM documents
  UNION ALL SELECT 1, item_id, {runs_sql(FOLDED, "0-9a-z\u0080-\U0010ffff")} FROM benchmark),
counted AS (
  SELECT side, doc_id, word, count(*) AS k FROM (SELECT side, doc_id, unnest(w) AS word FROM texts) GROUP BY ALL),
hashed AS (
  SELECT word, {crc_sql("word")} % {resampling.BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM counted), crc_table),
sums AS (
  SELECT CAST(sum(k) FILTER (side = 0) AS DOUBLE) AS s, CAST(sum(k) FILTER (side = 1) AS DOUBLE) AS t FROM counted),
buckets AS (
  SELECT bucket, CAST(coalesce(sum(k) FILTER (side = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(k) FILTER (side = 1), 0) AS DOUBLE) AS t
  FROM counted JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000.0::DOUBLE * ln(((b.t + 1) * (a.s + {resampling.BUCKETS})) / ((b.s + 1) * (a.t + {resampling.BUCKETS})))) AS BIGINT) AS gain
  FROM buckets b, sums a),
weighed AS (
  SELECT doc_id, CAST(floor(sum(k * gain) / sum(k)) AS BIGINT) AS weight
  FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln(
      (CAST('0x' || sha256('{resampling.SEED}:' || CAST(doc_id AS VARCHAR))[:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM texts LEFT JOIN weighed USING (doc_id) WHERE side = 0),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_features >= {resampling.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {resampling.PERCENT} * (SELECT count(*) FROM ranked) // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
""",
    "op8_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""",
}
