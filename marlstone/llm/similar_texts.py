"""Near-dedup of whole texts at a similarity of 0.8: longer SimHash fingerprints under deletion-variant signatures.

The similarity of two texts is the Jaccard index of their sets of five-word shingles (A-Z lower-cased). A set has a
fingerprint of five words of 64 bits, cut into fifteen segments of 20 bits. Each segment is indexed under every variant of
itself with one bit wild; an equality join on the variants finds pairs in which some segment differs by one bit at most. First
the 64 bits of the first word and then all 320 rule out unrelated pairs, and the shingle sets themselves decide: no pair below 0.8 is linked.
At 0.8 two bits differ with a chance of 0.15, so a segment meets with 0.17 and one of fifteen with 0.94; at 0.9 it is more than 0.99.

Two exact bounds keep pairs that are somewhat alike, of which a dense group has about as many as its square, from being made at all:
a shingle that no other text has is in no intersection, so a text with more than a fifth of such shingles is like no other and is not
indexed, and for a pair the rest of either set must be large enough; and a set has a sketch of 512 bits, the parities of its shingles
in 512 cells, so that of two sketches no more bits differ than shingles are in one set only, which at 0.8 are a ninth of both sets' sizes.
Both look at a pair inside the join. They lose no pair; the sketch decides less where sets are far larger than it.

Nodes are the distinct shingle sets, whatever the number of copies; the text of smallest doc_id stands for its set.
Whole equal segments are linked first, each node with its neighbour in the order of fingerprints. The variants are then
searched for pairs in different components only, and rows of a variant's most frequent component are not compared with
each other, so that a large group of copies is compared with the rest but not with itself. Of the pairs between two components the closest is
decided first, and the rest only where it did not link them.

Defined cases: texts without words are alike; texts of fewer than five words have one shingle, the whole; a text may be of any
length; rows that repeat a doc_id each count; null doc_ids count as none when the smallest is taken; an empty table gives no rows; other
columns are ignored by similar() and kept by keep_one_of_each().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import common
from marlstone.llm.components import components
from marlstone.llm.simhash import shingle_hashes

SHINGLE = 5
WORDS, BITS, EACH = 5, 20, 3  #: words of a fingerprint, bits of a segment, segments of a word
#: Differing bits beyond which a pair is not looked at, of 64 and of 320: at 0.8 it is 9.7 +- 2.9 and 48 +- 6.4, unrelated 32 +- 4 and 160 +- 9.
MOST_OF_FIRST, MOST_OF_ALL = 21, 84
SKETCH = 8  #: words of a sketch
#: Rows of eight bytes that are broadcast at most, about 64 MB in a task's table.
MOST_SENT = 2_000_000
#: Shingles that a Python worker holds at once, about.
HELD = 1 << 20
PARTS, CELLS = [f"f{k}" for k in range(WORDS)], [f"s{k}" for k in range(SKETCH)]
#: What the join knows of a node: own is the number of its shingles that no other set has.
KNOWN = ["set_id", "size", "own", *PARTS, *CELLS]


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Five words for a set of 64-bit hashes: the majority of each bit over independent mixings of them; zero for none."""
    out = np.zeros(WORDS, "<u8")
    if len(hashes):
        for k in range(WORDS):
            ones = np.zeros(64, np.int64)
            for at in range(0, len(hashes), 1 << 16):
                z = hashes[at : at + (1 << 16)] * np.uint64(2 * k + 1) + np.uint64(k)
                z = (z ^ (z >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
                z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                z = (z ^ (z >> np.uint64(32))).astype("<u8")
                ones += np.unpackbits(z.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[k] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The parities of a set's number of hashes in each cell."""
    cells = (hashes >> np.uint64(20)).astype(np.int64) & (64 * SKETCH - 1)
    return np.packbits(np.bincount(cells, minlength=64 * SKETCH) & 1, bitorder="little").view("<u8")


def _set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def _id(hashes: np.ndarray) -> np.uint64:
    return np.bitwise_xor.reduce(hashes) if len(hashes) else np.uint64(0)


def _identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes = [], []
        for text in batch.column("text").to_pylist():
            s = _set(text)
            ids.append(_id(s))
            sizes.append(len(s))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tie"), pa.array(np.array(ids, "<u8").view(np.int64)), pa.array(sizes, pa.int64())],
            names=["doc_id", "tie", "set_id", "size"])


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles (40 bits; where two meet, both count as shared) with the id of a set that holds them; of some texts at a time a
    shingle has its smallest and its largest holder, and rows of a set stand together, which packs better."""

    def told(sets: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(sets) & np.uint64((1 << 40) - 1)
        owner = np.repeat(np.array([_id(s) for s in sets], "<u8").view(np.int64), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order].view(np.int64), owner[order]
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        low, high = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
        two = low != high
        shingle, holder = np.concatenate((flat[first], flat[first][two])), np.concatenate((low, high[two]))
        order = np.argsort(holder, kind="stable")
        return pa.RecordBatch.from_arrays([pa.array(shingle[order]), pa.array(holder[order])], names=["shingle", "holder"])

    sets, n = [], 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            s = _set(text)
            if len(s):
                sets.append(s)
                n += len(s)
            if n >= HELD:
                yield told(sets)
                sets, n = [], 0
    if sets:
        yield told(sets)


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [_set(t) for t in batch.column("text").to_pylist()]
        words = np.array([np.concatenate((long_fingerprint(s), sketch(s))) for s in sets], "<u8").reshape(-1, WORDS + SKETCH).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("set_id", "size", "own")), *(pa.array(np.ascontiguousarray(w)) for w in words.T),
             pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=[*KNOWN, "shingles"])


def _tie(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _segments() -> Column:
    mask = (1 << BITS) - 1
    return F.array(*[F.shiftrightunsigned(word, BITS * j).bitwiseAND(F.lit(mask)).cast("int") for word in PARTS for j in range(EACH)])


def _variants(nodes: DataFrame) -> DataFrame:
    """key (segment, place of the wild bit and the other bits), bit (the wild one), root and what is known: 300 rows a node."""
    cut = nodes.select("root", *KNOWN, F.posexplode(_segments()).alias("segment", "bits"))
    wild = cut.withColumn("wild", F.explode(F.array(*[F.lit(k) for k in range(BITS)])))
    one = F.expr("shiftleft(1, wild)")
    return wild.select(
        F.expr(f"shiftleft(segment * {BITS} + wild, {BITS})").bitwiseOR(F.col("bits").bitwiseAND(F.bitwise_not(one))).alias("key"),
        (F.col("bits").bitwiseAND(one) != 0).alias("bit"), "root", *KNOWN)


def _differing(words: list[str]) -> Column:
    return reduce(add, (F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in words))


def _possible() -> Column:
    """Whether a and b may be alike, by their fingerprints and by what bounds their intersection i from above.

    i / (m + n - i) >= 4 / 5 is 9 i >= 4 (m + n), and 9 (m + n - 2 i) <= m + n.
    """
    sizes = F.col("a.size") + F.col("b.size")
    return ((_differing(PARTS[:1]) <= MOST_OF_FIRST)
            & (9 * F.least(F.expr("a.size - a.own"), F.expr("b.size - b.own")) >= 4 * sizes)
            & (9 * _differing(CELLS) <= sizes) & (_differing(PARTS) <= MOST_OF_ALL))


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard index of 0.8 or more."""
    named = common.written(pairs.select(F.col("a").alias("set_id")).union(pairs.select(F.col("b"))).distinct(), "pair-sets")
    if named.count() <= MOST_SENT:  # other sets need not be shuffled
        sets = sets.join(F.broadcast(named), "set_id", "left_semi")
    both = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("s")), "a").join(
        sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("t")), "b")
    # i / (m + n - i) >= 4 / 5
    found = both.filter(9 * F.size(F.array_intersect("s", "t")) >= 4 * (F.size("s") + F.size("t"))).select("a", "b")
    return common.written(found, "alike")


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with root renewed by links between roots (a, b)."""
    found = components(links, "links").select(F.col("node").alias("root"), F.col("root").alias("top"))
    return common.written(nodes.join(common.written(found, "tops"), "root", "left").withColumn(
        "root", F.coalesce("top", "root")).drop("top"), "rooted")


def _between(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes have different roots, with them (ra, rb)."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("set_id").alias(side), F.col("root").alias(f"r{side}")), side)
    return pairs.filter("ra <> rb")


def _links(alike: DataFrame, nodes: DataFrame) -> DataFrame:
    return _between(alike, nodes).select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def near_classes(sets: DataFrame) -> DataFrame:
    """sets (KNOWN and shingles), a written table -> its nodes with root, equal in a component."""
    nodes = common.written(sets.select(*KNOWN, F.col("set_id").alias("root")), "nodes")
    # whole segments: neighbours in each one's order
    order = Window.partitionBy("segment", "bits").orderBy("b.f0", "b.set_id")
    whole = nodes.select(F.struct(*KNOWN).alias("b"), F.posexplode(_segments()).alias("segment", "bits"))
    chain = whole.select(F.lag("b").over(order).alias("a"), "b").filter(_possible())
    chain = common.written(chain.select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b")).distinct(), "chain")
    nodes = _rooted(nodes, _links(_alike(chain, sets), nodes))
    # variants: pairs between components; a pair meets once in a segment, where its bit differs or, if none does, at the first
    same, rooted = Window.partitionBy("key"), Window.partitionBy("key", "root")
    # one exchange by key serves both windows and both sides of the join
    index = _variants(nodes).repartition("key").withColumn("n", F.count("*").over(rooted))
    index = index.withColumns({"top": F.max(F.struct("n", "root")).over(same), "lo": F.min("root").over(same), "hi": F.max("root").over(same)})
    busy = index.filter("lo <> hi").select("key", "bit", "root", *KNOWN, (F.col("root") == F.col("top.root")).alias("top"))
    first = F.floor(F.shiftright("a.key", BITS) % BITS) == 0
    met = busy.filter("not top").alias("a").join(
        busy.hint("merge").alias("b"),  # the planner's estimate does not know how many rows explode() makes
        (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & (F.col("b.top") | (F.col("a.root") < F.col("b.root")))
        & _possible() & ((F.col("a.bit") != F.col("b.bit")) | first))
    met = met.select(F.least("a.set_id", "b.set_id").alias("a"), F.greatest("a.set_id", "b.set_id").alias("b"), _differing(PARTS).alias("bits"),
                     F.least("a.root", "b.root").alias("x"), F.greatest("a.root", "b.root").alias("y"))
    pairs = common.written(met.distinct(), "pairs")
    # the closest pair of two components, then those left between components
    nearest = pairs.groupBy("x", "y").agg(F.min(F.struct("bits", "a", "b")).alias("p"))
    nearest = common.written(nearest.select("p.a", "p.b"), "nearest")
    nodes = _rooted(nodes, _links(_alike(nearest, sets), nodes))
    rest = common.written(_between(pairs.select("a", "b").join(nearest, ["a", "b"], "left_anti"), nodes).select("a", "b"), "rest")
    return _rooted(nodes, _links(_alike(rest, sets), nodes))


def _likely(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """KNOWN and shingles of the distinct sets that may be like another: four fifths of their shingles or more occur in others."""
    held = docs.select("text").mapInArrow(_holders, "shingle bigint, holder bigint").repartition("shingle")
    alone = held.groupBy("shingle").agg(F.min("holder").alias("set_id"), F.max("holder").alias("high")).filter("set_id = high")
    alone = common.written(alone.groupBy("set_id").agg(F.count("*").alias("own")), "own-shingles")
    wanted = distinct.join(alone, "set_id", "left").withColumn("own", F.coalesce("own", F.lit(0))).filter("5 * own <= size")
    wanted = common.written(wanted.select(F.struct("doc_id").alias("row"), "tie", "set_id", "size", "own"), "likely")
    texts = docs.select(F.struct("doc_id").alias("row"), "text", _tie(F.col("text")).alias("tie"))
    if wanted.count() <= MOST_SENT:  # other texts need not be shuffled
        sent = wanted.select(F.xxhash64("tie").alias("hash")).distinct()
        texts = texts.withColumn("hash", F.xxhash64("tie")).join(F.broadcast(sent), "hash", "left_semi")
    texts = texts.join(wanted.hint("merge"), ["row", "tie"]).select("set_id", "size", "own", "text")
    words = ", ".join(f"{c} bigint" for c in KNOWN)
    return common.written(texts.mapInArrow(_printed, f"{words}, shingles array<bigint>").dropDuplicates(["set_id"]), "likely-sets")


@common.tidy("similar-texts")
def similar(docs: DataFrame) -> DataFrame:
    """doc_id, tie (SHA-256 of the text) and component_id (the smallest doc_id of texts linked to it) of each row."""
    common.python_ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    prints = docs.select("doc_id", "text", _tie(F.col("text")).alias("tie")).mapInArrow(
        _identified, "doc_id bigint, tie string, set_id bigint, size bigint")
    prints = common.written(prints, "shingle-sets")
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie", "size")).alias("one")
    distinct = prints.groupBy("set_id").agg(one, F.count("*").alias("n"))
    distinct = common.written(distinct.select("set_id", "n", *[f"one.{c}" for c in ("doc_id", "tie", "size")]), "distinct-sets")
    nodes = near_classes(_likely(distinct, docs))
    named = distinct.select("set_id", "n", "doc_id").join(nodes.select("set_id", "root"), "set_id", "left")
    named = common.written(named.withColumn("root", F.coalesce("root", "set_id")), "named")
    smallest = common.written(named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("m")), "smallest")
    classes = common.written(common.lookup(named, smallest, ["root"], "m", named.count()).select("set_id", "component_id", "n"), "classes")
    return common.lookup(prints.select("doc_id", "tie", "set_id"), classes, ["set_id"], "n", prints.count()).select("doc_id", "tie", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, but those whose component has a smaller doc_id.

    Rows go by doc_id and text, so of rows that share a doc_id only those linked to a smaller one go; a row without
    doc_id goes if its component has any.
    """
    gone = similar(docs.select("doc_id", "text")).filter("not component_id <=> doc_id")
    key, tie = common.free_names(docs, "near_key", "near_tie")
    gone = common.written(gone.select(F.struct("doc_id").alias(key), F.col("tie").alias(tie)).distinct(), "near-copies")
    rows = docs.withColumns({key: F.struct(F.col("doc_id").cast("bigint").alias("doc_id")), tie: _tie(F.col("text"))})
    return rows.join(gone, [key, tie], "left_anti").select(*[rows[c] for c in docs.columns])
