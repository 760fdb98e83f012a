"""Grouping of spelling variants by a trie self-join with active-node sets.

Of two words at distance one the edit lies in the first or the second half of the shorter one, so the other half is a path
that both share: from the root of the trie of the words, or of the trie of the reversed words. The vocabulary is therefore
dealt by that path (a prefix of one of the tries; no pair crosses two parts), and each part is a subtrie. Down it goes the
active-node set of every node: the nodes that one edit or none turns it into. A child's set follows from its parent's, and
where both nodes end a word the pair comes out. Parts of more than MOST words are dealt again by the halves of what is left
of their words, so a prefix that a third of the vocabulary shares is no single task's, and nothing is dropped.

Words: runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased. One run in 97 by the CRC-32 of `<doc_id>:<run>` loses
the code point at CRC modulo its length, which plants known misspellings.

Defined cases: null and empty texts have no words; texts and words are whole, however long; a null doc_id counts as an empty
one; repeated rows count again; equal counts are resolved by code-point order; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import common, crc
from marlstone.llm.resampling import distinct_runs, runs, text_bytes

LEAST_LENGTH = 5
LEAST_COUNT = 3
EVERY = 97
#: A form occurs so many times as often as its variant, or more.
RATIO = 2
#: Words of a part from which it is dealt again.
MOST = 4096


def _byte_map() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for first in (65, 97):
        out[first : first + 26] = np.arange(97, 123)
    out[0xC3] = 0xC3
    return out


#: ASCII letters lower-cased, and the first byte of U+00C0 to U+00FF.
BYTES = _byte_map()


def without(word: bytes, at: int) -> bytes:
    """A word less the code point at a place."""
    text = word.decode()
    return (text[:at] + text[at + 1 :]).encode()


def counted_words(texts: pa.Array, doc_ids: list[str], every: int) -> dict[bytes, int]:
    """Occurrences of the words of some texts, after one run in so many has lost a code point."""
    raw, first = text_bytes(texts)
    second = np.concatenate(([False], raw[:-1] == 0xC3)) if len(raw) else np.zeros(0, bool)
    folded = np.where(second, raw, BYTES[raw])
    inside = folded != 0
    starts, lengths, at = runs(inside, first)
    code, words = distinct_runs(folded, starts, lengths, inside)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pairs, n = np.unique(text * max(1, len(words)) + code, return_counts=True)
    text, code = pairs // max(1, len(words)), pairs % max(1, len(words))
    one = np.array([zlib.crc32(w) for w in words], np.uint32)
    size = np.array([len(w) for w in words], np.int64)
    ids = np.array([zlib.crc32(d.encode() + b":") for d in doc_ids], np.uint32)
    h = crc.joined(ids[text], one[code], size[code]) if len(code) else np.zeros(0, np.uint32)
    hit = h % np.uint32(every) == 0
    total = np.bincount(code[~hit], n[~hit], len(words)).astype(np.int64)
    found = {w: int(k) for w, k in zip(words, total, strict=True) if k}
    for c, x, k in zip(code[hit].tolist(), h[hit].tolist(), n[hit].tolist(), strict=True):
        made = without(words[c], x % len(words[c].decode()))
        found[made] = found.get(made, 0) + k
    return found


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """word, n: distinct words of so many code points and occurrences at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = ["" if d is None else d for d in batch.column("d").to_pylist()]
            found = counted_words(batch.column("text"), ids, every)
            kept = {w.decode(): n for w, n in found.items()}
            kept = {w: n for w, n in kept.items() if len(w) >= least_length}
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])

    common.python_ready(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("string").alias("d"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def trie_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Numbers of the pairs of distinct words at distance one, each pair once.

    An active-node set is the node itself, at distance zero, and the nodes at distance one.
    """
    children: list[dict[str, int]] = [{}]
    ends = [-1]
    for k, word in enumerate(words):
        at = 0
        for c in word:
            below = children[at].get(c)
            if below is None:
                below = children[at][c] = len(children)
                children.append({})
                ends.append(-1)
            at = below
        ends[at] = k
    todo = [(0, list(children[0].values()))]  # the root's set: itself, and its children by an insertion
    while todo:
        node, active = todo.pop()
        for c, below in children[node].items():
            found = {node}  # c was deleted
            found.update(children[node].values())  # c was replaced
            found.discard(below)
            found.update(children[below].values())  # something was inserted behind c
            found.update(x for a in active if (x := children[a].get(c)) is not None)  # edited before, c matches
            found.discard(below)
            if ends[below] >= 0:
                yield from ((ends[below], ends[x]) for x in found if ends[x] > ends[below])
            if children[below]:
                todo.append((below, list(found)))


def _parts(path: Column, rest: Column, lengths: list[Column]) -> Column:
    """Up to four (path, least, rest): what is left of a word below each half that it may share with a word of distance one.

    least is the length of the shorter word of a pair; a word takes part as the shorter one, and as the longer one.
    """
    n = F.length(rest)
    out = []
    for least in lengths:
        half = F.floor(least / 2).cast("int")
        after = least - half
        named = lambda side, shared: F.concat_ws("\x01", path, F.lit(side), least.cast("string"), shared)
        fits = (least >= 1) & ((n == least) | (n == least + 1))
        out.append(F.when(fits, F.struct(
            named("<", F.substring(rest, F.lit(1), half)).alias("path"), after.cast("int").alias("least"),
            F.substring(rest, half + 1, n).alias("rest"))))
        out.append(F.when(fits, F.struct(
            named(">", F.substring(rest, n - after + 1, after)).alias("path"), half.alias("least"),
            F.reverse(F.substring(rest, F.lit(1), n - after)).alias("rest"))))
    return F.array_compact(F.array(*out))


def _dealt(df: DataFrame, rest: Column, path: Column, lengths: list[Column]) -> DataFrame:
    return df.withColumn("part", F.explode(_parts(path, rest, lengths))).select(
        "word", "n", F.col("part.path").alias("path"), F.col("part.least").alias("least"), F.col("part.rest").alias("rest"))


def near_pairs(vocab: DataFrame, most: int = MOST) -> DataFrame:
    """word, n, near, near_n: both directions of each pair of words at distance one, once each. vocab has distinct words."""
    length = F.length("word")
    now = common.written(_dealt(vocab.select("word", "n"), F.col("word"), F.lit(""), [length, length - 1]), "trie-parts")
    small = None
    while True:
        sizes = now.groupBy("path").agg(F.count("*").alias("many"), F.max("least").alias("left"))
        again = common.written(sizes.filter((F.col("many") > most) & (F.col("left") >= 2)).select("path"), "large-trie-parts")
        kept = now.join(again, "path", "left_anti")
        small = kept if small is None else small.unionByName(kept)
        if again.isEmpty():
            break
        now = common.written(_dealt(now.join(again, "path", "left_semi"), F.col("rest"), F.col("path"), [F.col("least")]), "trie-parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def emit(rows: list[dict]) -> pa.RecordBatch | None:
            out = []
            for a, b in trie_pairs([r["rest"] for r in rows]):
                u, v = rows[a], rows[b]
                out += [(u["word"], u["n"], v["word"], v["n"]), (v["word"], v["n"], u["word"], u["n"])]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            types = (pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["word", "n", "near", "near_n"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["path"] != row["path"]:
                    if len(held) > 1:
                        yield emit(held)
                    held = []
                held.append(row)
        if len(held) > 1:
            yield emit(held)

    common.python_ready(vocab.sparkSession, 10_000)
    parts = small.select("path", "word", "n", "rest").repartition(common.shuffles(vocab.sparkSession), "path")
    parts = parts.withColumn("many", F.count("*").over(Window.partitionBy("path"))).filter("many > 1").sortWithinPartitions("path")
    # an insertion at the middle keeps both halves, so such a pair comes out in two parts
    return parts.select("path", "word", "n", "rest").mapInArrow(run, "word string, n long, near string, near_n long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, form (no cycles) -> word, root: the end of the path of forms, whose length doubles with each join."""
    now = common.written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = now.join(step, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        after = common.written(longer, "roots")
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        now = after.drop("moved")


@common.tidy("spelling-variants")
def variant_groups(
        docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY, ratio: int = RATIO,
        most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of the vocabulary."""
    vocab = common.written(vocabulary(docs, least_length, least_count, every), "vocabulary")
    pairs = common.written(near_pairs(vocab, most), "near-words")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    near_n = -F.col("best.col1")
    takes = near_n >= F.col("n") * ratio
    found = vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(takes, F.col("best.near")).alias("form"),
        F.when(takes, near_n).alias("form_n"))
    found = common.written(found, "forms")
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
