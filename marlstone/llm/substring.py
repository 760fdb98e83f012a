"""Substring dedup: seed on winnowed anchors, extend both ways, remove repeats of a window's length or more.

Seeds. Of the 20-word shingles of each 50-word window the one of least hash is its anchor (winnowing), so equal
windows have equal anchors at equal places. Windows beside each other mostly share their anchor; a run
is the windows of one anchor. Runs of all documents meet on the anchor; anchors of one document only go.

Extension. Around a shared anchor, the words that its run's windows cover are the widest extension.
Runs equal in all of it form a class: every member outside the class's smallest document is covered
whole. Where classes of one anchor differ, one document of each class extends its anchor left by l words
and right by 30 - l for each l, and the extensions, named by two hashes, meet: those also
found in a smaller document are covered. The union of what is covered is all maximal repeats of 50 words or more.
Nothing is made for pairs of documents, so the work grows with the number of windows.

Defined cases: null text has no words; shorter texts than a window lose nothing; repeats inside one document, or in rows of one
doc_id, are left alone; a null doc_id is neither smaller nor larger than any; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common

WINDOW = 50
SHINGLE = 20
TEN = 10  # both lengths are multiples of it
KEPT_WORDS = 300_000
_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


class WordHashes(dict):
    def __missing__(self, w: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(w)
        if len(self) < KEPT_WORDS:
            self[w] = h
        return h


_hashes = WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes split at the six ASCII spaces only


def rolled(words: list[bytes], lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all SHINGLE-word and all WINDOW-word sequences; at least WINDOW words."""
    h = np.fromiter(map(_hashes.__getitem__, words), _U, len(words))
    if lane:
        h = _mixed(h ^ _BASES[lane])
    base, n = _BASES[lane], len(h)
    ten = np.zeros(n - TEN + 1, _U)
    for j in range(TEN):
        ten = ten * base + h[j : n - TEN + 1 + j]
    step = _U(pow(int(base), TEN, 1 << 64))

    def longer(size: int) -> np.ndarray:
        out, m = np.zeros(n - size + 1, _U), n - size + 1
        for j in range(0, size, TEN):
            out = out * step + ten[j : j + m]
        return out

    return _mixed(longer(SHINGLE)), _mixed(longer(WINDOW))


def runs_of(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """anchor, extension hash, first window and number of windows of each run."""
    if len(words) < WINDOW:
        return (np.zeros(0, np.int64),) * 4
    shingles, windows = rolled(words, 0)
    near = np.lib.stride_tricks.sliding_window_view(shingles, WINDOW - SHINGLE + 1)
    at = near.argmin(1) + np.arange(len(near))
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.concatenate((first, [len(at)])))
    last, a = first + count - 1, at[first]
    extent = _mixed(windows[first] * _BASES[0] + _mixed(windows[last] + _U(1)) + (a - first).astype(_U) * _U(1 << 20) + count.astype(_U))
    return shingles[a].view(np.int64), extent.view(np.int64), first, count


def _doc_columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text"))


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, tie, n_words, sha of all words, and the runs of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"anchor": pa.int64(), "extent": pa.int64(), "first": pa.int32(), "count": pa.int16()}
        for batch in batches:
            words = [split_words(t) for t in batch.column("text").to_pylist()]
            found = [runs_of(w) for w in words]
            ends = np.concatenate(([0], np.cumsum([len(f[0]) for f in found]))).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([f[k] for f in found]) if found else [], pa.int64()).cast(t))
                for k, t in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), pa.array([len(w) for w in words], pa.int64()),
                 pa.array([_sha(w) for w in words], pa.string()), *lists],
                names=["doc_id", "tie", "n_words", "sha", *kinds])

    common.python_ready(docs.sparkSession)
    return _doc_columns(docs).mapInArrow(
        run, "doc_id bigint, tie bigint, n_words bigint, sha string, anchor array<bigint>, extent array<bigint>, first array<int>, count array<smallint>")


def extensions(work: DataFrame) -> DataFrame:
    """h1, h2, doc_id, tie and first of every window of the runs that a row of work has in `runs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tie, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "text", "runs")), strict=True):
                if not runs:
                    continue
                words = split_words(text)
                at = np.unique(np.concatenate([np.arange(r["first"], r["first"] + r["count"]) for r in runs]))
                one, two = (rolled(words, lane)[1][at].view(np.int64) for lane in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), pa.array(np.full(len(at), doc, np.int64)), pa.array(np.full(len(at), tie, np.int64)), pa.array(at.astype(np.int32))],
                    names=["h1", "h2", "doc_id", "tie", "first"])

    return work.select("doc_id", "tie", "text", "runs").mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint, tie bigint, first int")


def cut(work: DataFrame) -> DataFrame:
    """doc_id, tie, n_removed and sha of what is left, for rows with the intervals `gone` and windows `more`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas = [], []
            for text, gone, more in zip(*(batch.column(c).to_pylist() for c in ("text", "gone", "more")), strict=True):
                words = split_words(text)
                edge = np.zeros(len(words) + 1, np.int64)
                for r in gone or []:
                    edge[r["first"]] += 1
                    edge[r["first"] + r["count"] + WINDOW - 1] -= 1
                for s in more or []:
                    edge[s] += 1
                    edge[s + WINDOW] -= 1
                out = np.cumsum(edge[:-1]) > 0
                removed.append(int(out.sum()))
                shas.append(_sha([w for w, x in zip(words, out.tolist(), strict=True) if not x]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), pa.array(removed, pa.int64()), pa.array(shas, pa.string())],
                names=["doc_id", "tie", "n_removed", "sha"])

    return work.select("doc_id", "tie", "text", "gone", "more").mapInArrow(run, "doc_id bigint, tie bigint, n_removed bigint, sha string")


@common.tidy("substring-dedup")
def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""
    rows = common.written(scanned(docs), "runs")
    runs = rows.select("doc_id", "tie", F.explode(F.arrays_zip("anchor", "extent", "first", "count")).alias("r")).select("doc_id", "tie", "r.*")
    shared = runs.groupBy("anchor").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"),
        F.min("extent").alias("e0"), F.max("extent").alias("e1"))
    shared = common.written(shared.filter("lo < hi").select("anchor", "n", (F.col("e0") != F.col("e1")).alias("differ")), "shared-anchors")
    total = rows.agg(F.sum(F.size("anchor"))).first()[0] or 0
    found = common.written(common.lookup(runs, shared, ["anchor"], "n", total).drop("n"), "shared-runs")
    classes = common.written(
        found.groupBy("anchor", "extent").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("n")), "run-classes")
    members = common.lookup(found, classes, ["anchor", "extent"], "n", found.count())
    run = F.struct("first", "count")
    sides = members.groupBy("doc_id", "tie").agg(
        F.collect_list(F.when(F.col("doc_id") > F.col("smallest"), run)).alias("gone"),
        F.collect_list(F.when((F.col("doc_id") == F.col("smallest")) & F.col("differ"), run)).alias("runs"))
    sides = sides.filter("size(gone) > 0 or size(runs) > 0")
    work = common.written(_doc_columns(docs).join(sides, ["doc_id", "tie"]), "texts-with-repeats")
    windows = common.written(extensions(work), "windows")
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest"), F.count("*").alias("n"))
    least = common.written(least.filter("smallest < largest").drop("largest"), "shared-windows")
    later = common.lookup(windows, least, ["h1", "h2"], "n", windows.count()).filter("doc_id > smallest")
    more = later.groupBy("doc_id", "tie").agg(F.collect_set("first").alias("more"))
    changed = cut(work.join(more, ["doc_id", "tie"], "left")).dropDuplicates(["doc_id", "tie"])
    changed = changed.select("doc_id", "tie", "n_removed", F.col("sha").alias("left_sha"))
    return rows.select("doc_id", "tie", "n_words", "sha").join(changed, ["doc_id", "tie"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("left_sha", "sha").alias("kept_sha256"))
