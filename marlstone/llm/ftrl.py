"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates.

Texts become sparse counts of hashed word 1- and 2-grams, in two views of a word: its lower-cased spelling and its
shape (letters, digits and signs with repeats folded), and of how much the text repeats its own 2-grams. Shards of
a bounded sample of labelled rows are trained apart, each in one task, and their weights are averaged; a
text is scored by a sparse dot product.

Fixed bounds: MAX_TRAIN labelled rows, drawn by a hash of doc_id; 2 ** BITS weights, so the model that
is gathered and broadcast does not grow with the corpus.

Defined cases: null and empty texts have the features of no words and get the score those give; a
corpus without labels, or with one label only, scores every text by the bias (0.5 without labels);
null labels are left out; a null doc_id is not held out; repeated rows are scored each; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common

BITS = 18
MAX_TRAIN = 24_000
SHARDS = 4
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
THRESHOLD = 0.3
KEPT_WORDS = 300_000
_MASK = (1 << BITS) - 1


def crc_mod(column: str, n: int):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def shape(word: str) -> str:
    s = re.sub(r"[^\W\d_]", "a", word) if not word.isupper() else re.sub(r"[^\W\d_]", "A", word)
    return re.sub(r"(.)\1+", r"\1\1", re.sub(r"\d", "0", s))


class Hashes(dict):
    """A word's two hashes in one number: of its spelling (high) and of its shape (low)."""

    def __missing__(self, w: str) -> int:
        found = zlib.crc32(w.lower().encode()) << 32 | zlib.crc32(shape(w).encode(), 7)
        if len(self) < KEPT_WORDS:
            self[w] = found
        return found


class Features:
    """Hashed n-grams of texts; the hashes of frequent words are kept."""

    def __init__(self):
        self.known = Hashes()

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values, of length one together; each view weighs the same."""
        w = (text or "").split()
        n = len(w)
        if not n:
            return np.array([1]), np.array([1.0])
        ids = np.fromiter(map(self.known.__getitem__, w), np.uint64, n)
        spelt, shaped = ids >> np.uint64(32), ids & np.uint64(0xFFFFFFFF)
        pair = lambda x, k: x[:-1] * np.uint64(0x9E3779B97F4A7C15 + k) + x[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        views = [spelt * np.uint64(0xD6E8FEB86659FD93), pair(spelt, 2), shaped * np.uint64(0xA0761D6478BD642F), pair(shaped, 4)]
        one, two = np.unique(spelt).size / n, np.unique(views[1]).size / max(1, n - 1)
        marks = np.array([2 + int(10 * two), 16 + min(15, int(np.log2(n))), 32 + int(10 * one)])
        out_i, out_v = [marks], [np.ones(3)]
        for v in views:
            if len(v):
                at, count = np.unique(((v ^ (v >> np.uint64(29))) >> np.uint64(11)) & np.uint64(_MASK), return_counts=True)
                x = np.log1p(count)
                out_i.append(at.astype(np.int64))
                out_v.append(x / np.sqrt((x * x).sum()))
        return np.concatenate(out_i), np.concatenate(out_v)


def train_shard(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = 1) -> np.ndarray:
    """FTRL-proximal weights; the last one is the bias."""
    make, rng = Features(), np.random.default_rng(seed)
    rows = [make.of(t) for t in texts]
    z, n = np.zeros(_MASK + 2), np.zeros(_MASK + 2)

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, v = rows[k]
            i, v = np.append(i, _MASK + 1), np.append(v, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - labels[k]) * v
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            np.add.at(z, i, g - sigma * w)
            np.add.at(n, i, g * g)
    return weights(np.arange(_MASK + 2))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> np.ndarray:
    """Averaged weights from a bounded sample of the labelled rows given."""
    common.python_ready(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    usable = usable.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    n = usable.count()
    drawn = usable.withColumn("draw", F.xxhash64(F.lit("draw"), "doc_id")).filter(
        F.pmod("draw", F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_train / max(n, 1))))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    texts = texts.withColumn("shard", F.pmod(F.shiftright("draw", 20), F.lit(SHARDS)))

    def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("draw", "ascending"), ("doc_id", "ascending")])
        w = train_shard(table.column("text").to_pylist(), table.column("label").to_pylist(), seed=int(key[0].as_py()) + 1)
        at = np.flatnonzero(w)
        return pa.table({"i": pa.array(at, pa.int64()), "w": w[at]})

    parts = texts.groupBy("shard").applyInArrow(fit, "i bigint, w double")
    means = parts.groupBy("i").agg(F.sum("w").alias("w"), F.count("*").alias("n")).toArrow()  # 2 ** BITS + 1 rows at most
    out = np.zeros(_MASK + 2, np.float64)
    out[means.column("i").to_numpy()] = means.column("w").to_numpy()
    # few labels may leave a shard without rows; every other one has learnt its constant
    return out / max(1, means.column("n").to_numpy().max(initial=0))


def score(docs: DataFrame, weights: np.ndarray, *keep: str, name: str = "score") -> DataFrame:
    """The columns keep and the score (0 to 1), under a name, of each row."""
    table = docs.sparkSession.sparkContext.broadcast(weights)
    common.python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, w = _features, table.value
        for batch in batches:
            dots = []
            for t in batch.column("text").to_pylist():
                i, v = make.of(t)
                dots.append(w[i] @ v + w[-1])
            p = 1 / (1 + np.exp(-np.clip(np.array(dots), -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(p, pa.float64())], names=[*keep, name])

    columns = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return columns.mapInArrow(run, f"{schema}, {name} double")


_features = Features()


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; rows held out are never learnt from."""
    weights = train(docs, labels.filter(crc_mod("doc_id", 5) != 0))
    return score(docs, weights, "doc_id").select(
        "doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score the threshold or more."""
    weights = train(docs, labels.filter(crc_mod("doc_id", 5) != 0))
    (name,) = common.free_names(docs, "quality_score")
    return score(docs, weights, *docs.columns, name=name).filter(F.col(name) >= threshold).drop(name)
