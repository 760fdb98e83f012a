"""Importance resampling of documents towards a target text, on hashed n-grams.

A text's features are its runs of so many consecutive words, joined by one space. Their buckets come from CRC-32, composed
and never computed on a joined string: each distinct word of a batch has its CRC computed once, and the CRC of an n-gram is
the one of its first words, shifted by the length of the next word and its space, xor the CRC of those (crc.py). Bucket
counts of all documents and of the whole target give each bucket a gain; a document's weight is the mean gain of its
features, and the documents of the largest weight plus Gumbel noise are drawn without replacement.

Words are runs of [0-9a-z] and characters beyond ASCII, after A-Z are lower-cased.

Defined cases: null and empty texts have no features and weight 0; texts are whole, however long; a target without features
gives gains from the prior alone; equal scores go by doc_id (null last), then as they come; rows that repeat a doc_id share
the noise and are ranked one by one; a null doc_id takes the noise of an empty one; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common, crc

GRAMS = (1, 1)
BUCKETS = 10_000
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10


def _byte_map() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[:0x30] = out[0x3A:0x41] = out[0x5B:0x61] = out[0x7B:0x80] = 0
    return out


#: Each byte lower-cased, or 0 where it separates words.
BYTES = _byte_map()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and each text's first byte and the end; null is empty."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes that stay in one text: (first byte, length, each text's first run and the end)."""
    n = len(inside)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    texts = first[:-1][first[:-1] < n]
    begins[texts] = inside[texts]
    starts = np.flatnonzero(begins)
    # a run ends before the next byte that is not inside, or that begins another run
    stops = ~inside
    stops |= begins
    ends = np.append(np.flatnonzero(stops), n)
    ends = ends[np.searchsorted(ends, starts, "right")]
    return starts, ends - starts, np.searchsorted(starts, first)


def distinct_runs(folded: np.ndarray, starts: np.ndarray, lengths: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each run among the distinct ones, the distinct runs)."""
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    packed = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(folded[inside]))])
    coded = packed.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def gram_crcs(texts: pa.Array, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC of each n-gram, number of its text, number of words of each text)."""
    raw, first = text_bytes(texts)
    folded = BYTES[raw]
    inside = folded != 0
    starts, lengths, at = runs(inside, first)
    n_words = np.diff(at)
    text = np.repeat(np.arange(len(n_words)), n_words)
    code, words = distinct_runs(folded, starts, lengths, inside)
    one = np.array([zlib.crc32(w) for w in words], np.uint32)
    if most == 1:
        return one[code], text, n_words
    size = np.array([len(w) for w in words], np.int64)
    spaced = crc.joined(np.full(len(one), crc.BLANK), one, size)[code]  # of a space and the word
    now, found = one[code], []
    for n in range(1, most + 1):
        if n > 1:
            now = crc.joined(now[: len(code) - n + 1], spaced[n - 1 :], size[code[n - 1 :]] + 1)
        own = text[: len(now)] == text[n - 1 : n - 1 + len(now)]
        if n >= least:
            found.append((now[own], text[: len(now)][own]))
        if not len(now):
            break
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), n_words
    return np.concatenate([c for c, _ in found]), np.concatenate([t for _, t in found]), n_words


def bucket_counts(texts: DataFrame, grams: tuple[int, int] = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all texts, added up in each task before the shuffle; empty buckets have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(gram_crcs(batch.column(0), *grams)[0] % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    common.python_ready(texts.sparkSession)
    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: 1000 ln of the target's smoothed share over the source's, floored; a row for each bucket."""
    per = target.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    per = per.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    per = per.fillna(0, ["s", "t"])
    total = per.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    per = per.crossJoin(F.broadcast(total))  # one row
    up = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets).cast("double")
    down = (F.col("s") + 1).cast("double") * (F.col("all_t") + buckets).cast("double")
    return per.select("bucket", F.floor(F.lit(1000.0) * F.log(up / down)).cast("bigint").alias("gain"))


def weights(docs: DataFrame, gain: np.ndarray, grams: tuple[int, int] = GRAMS) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, text, n_words = gram_crcs(batch.column("text"), *grams)
            rows = len(n_words)
            n = np.bincount(text, minlength=rows)
            total = np.bincount(text, gain[found % np.uint32(len(gain))], rows).astype(np.int64)  # whole numbers, exact in doubles
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n_words, n, total // np.maximum(n, 1)))],
                names=["doc_id", "n_words", "n_features", "weight"])

    common.python_ready(docs.sparkSession)
    columns = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return columns.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: str = SEED):
    """1000 times a Gumbel variable from the document's id, floored."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


@common.tidy("resampled")
def resample(
        docs: DataFrame, target: DataFrame, grams: tuple[int, int] = GRAMS, buckets: int = BUCKETS, seed: str = SEED,
        least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where the row is not drawn) of each row of docs."""
    source = common.written(bucket_counts(docs, grams, buckets), "source-buckets")
    per = gains(source, bucket_counts(target, grams, buckets), buckets)
    gain = np.zeros(buckets, np.int64)
    for r in per.collect():  # one row a bucket, whose number is a parameter
        gain[r["bucket"]] = r["gain"]
    scored = common.written(weights(docs, gain, grams).withColumn("score", F.col("weight") + noise(seed)), "scored")
    fit = scored.filter(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    ranked = common.ranked(fit, F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest).select(
        "doc_id", "n_words", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, **settings: object) -> DataFrame:
    """The rows of docs that are drawn, whole; rows of one doc_id go or stay together by the smallest rank."""
    key, = common.free_names(docs, "drawn_key")
    ids = resample(docs, target, **settings).filter("rank is not null").select(F.struct("doc_id").alias(key)).distinct()
    named = docs.withColumn(key, F.struct(F.col("doc_id").cast("bigint").alias("doc_id")))
    return named.join(ids, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
