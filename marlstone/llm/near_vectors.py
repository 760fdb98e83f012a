"""Near-duplicate vectors by sorted projection passes.

Equal vectors of one label are one class first. In each pass every class has a key of 62 bits, the signs of random
projections one after the other, and all classes are sorted by label and key. A class is compared with the rows of its block
of BLOCK neighbours in that order and of the next block; pairs whose cosine reaches the threshold are links. Where a block
has as many links as rows with one of the farthest blocks that it was compared with, its window is doubled, again and again, so a
dense group larger than a window is compared whole. The union of all passes gives links and components.

Two vectors at the threshold agree in one bit with probability 1 - acos(threshold) / pi, and meet if they agree in so many
bits as part a label's rows into blocks; the number of passes follows from it, so that RECALL of such pairs meet in some pass,
whatever the number of rows.

Defined cases: a vector that is null, empty or zero, or holds null or non-finite components, and any vector without label
link with nothing; vectors of different lengths do not link; each row counts by itself, so rows that repeat a vec_id are linked like others; a
component without vec_id has none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common
from marlstone.llm.components import components

THRESHOLD = 0.93
BLOCK = 256
BITS = 62
RECALL = 0.99
LEAST_PASSES = 4
#: Blocks of the sorted order that one task compares at a time, besides the one after them.
SLAB = 16
SEED = 12


def passes(most: int, threshold: float = THRESHOLD, block: int = BLOCK, recall: float = RECALL) -> int:
    """Passes in which a pair at the threshold meets with probability recall, among so many rows of a label."""
    bits = max(0.0, math.log2(max(1, most) / block))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return LEAST_PASSES if meet >= 1 else max(LEAST_PASSES, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all components of the vectors scaled to length one in double precision, each vector's first component and the end)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy() - column.offsets[0].as_py()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = np.diff(at)
    if not len(n):
        return flat, at
    flat = flat / np.repeat(np.maximum.reduceat(np.abs(flat), at[:-1]), n)  # squares neither overflow nor vanish
    return flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, at[:-1])), n), at


def keyed(classes: DataFrame, times: int, seed: int = SEED) -> DataFrame:
    """A row for each class and pass: pass, label, dim, key, c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = unit_vectors(batch.column("v"))
            sizes = np.diff(at)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                x = flat[at[rows][:, None] + np.arange(dim)]
                for k in range(times):
                    planes = np.random.default_rng([seed, k, dim]).standard_normal((dim, BITS))
                    key = (x @ planes > 0) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), k, np.int32)), batch.column("label").take(pa.array(rows)), pa.array(np.full(len(rows), dim, np.int32)),
                         pa.array(key), batch.column("c").take(pa.array(rows))], names=["pass", "label", "dim", "key", "c"])

    common.python_ready(classes.sparkSession, 4096)
    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("c", "label", "v").mapInArrow(run, f"pass int, label {kind}, dim int, key long, c long")


LINKS = "pass int, a long, b long, first long, second long"


def _links(table: pa.Table, threshold: float, wanted) -> pa.Table:
    """Links between rows of one label, length and pass whose blocks are wanted(first, second), each pair once."""
    order = np.lexsort([table.column("rank").to_numpy()])
    table = table.take(pa.array(order))
    group, block, c = (table.column(k).to_numpy() for k in ("group", "block", "c"))
    flat, at = unit_vectors(table.column("v"))
    edges = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (block[1:] != block[:-1]), [True])))
    tiles = [(int(s), int(e)) for s, e in zip(edges[:-1], edges[1:], strict=True)]
    x = {s: flat[at[s] : at[e]].reshape(e - s, -1) for s, e in tiles}
    found = []
    for k, (s, e) in enumerate(tiles):
        for t, u in tiles[k:]:
            if group[t] != group[s]:
                break
            if not wanted(block[s], block[t]):
                continue
            near = x[s] @ x[t].T >= threshold
            i, j = np.nonzero(np.triu(near, 1) if s == t else near)
            found.append((c[s + i], c[t + j], np.full(len(i), block[s]), np.full(len(i), block[t])))
    columns = [np.concatenate(z) for z in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
    a, b = np.maximum(columns[0], columns[1]), np.minimum(columns[0], columns[1])
    number = table.column("pass")[0].as_py() if len(table) else 0
    return pa.table([pa.array(np.full(len(a), number, np.int32)), *(pa.array(z.astype(np.int64)) for z in (a, b, columns[2], columns[3]))],
                    names=["pass", "a", "b", "first", "second"])


def class_links(classes: DataFrame, times: int, threshold: float = THRESHOLD, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """a > b: classes whose vectors' cosine is threshold or more, each pair once. classes has c, label and v."""
    keys = common.written(keyed(classes, times, seed), "vector-keys")
    placed = common.ranked(keys, *map(F.col, ("pass", "label", "dim", "key", "c")))
    # a run of one pass, label and length has a number: its rows follow one another in the order
    placed = placed.withColumns({
        "block": F.floor((F.col("rank") - 1) / block), "group": F.xxhash64(F.struct("pass", "label", "dim"))})
    placed = common.written(placed.select("pass", "group", "block", "rank", "c"), "placed-vectors")
    vectors = classes.select("c", "v")

    slabs = F.array_distinct(F.array(F.floor(F.col("block") / SLAB), F.floor((F.col("block") - 1) / SLAB)))
    dealt = placed.withColumn("slab", F.explode(slabs)).filter("slab >= 0").join(vectors, "c")

    def near(key: tuple, table: pa.Table) -> pa.Table:
        slab = key[1].as_py()
        return _links(table, threshold, lambda p, q: p // SLAB == slab and q <= p + 1)

    common.python_ready(classes.sparkSession)
    columns = ["pass", "slab", "group", "block", "rank", "c", "v"]
    # a block may hold the end of one pass and the start of the next, so tasks are dealt by pass as well
    links = common.written(dealt.select(*columns).groupBy("pass", "slab").applyInArrow(near, LINKS), "vector-links")
    found, reach = links, 1
    while True:
        far = links.filter(F.col("second") - F.col("first") > reach // 2).groupBy("pass", "first", "second").count()
        far = far.filter(F.col("count") >= block).select("pass", F.col("first").alias("lo")).distinct()
        far = common.written(far, "dense-blocks")
        if far.isEmpty():
            return found.select("a", "b").distinct()
        tiles = far.withColumn("hi", F.explode(F.sequence(F.col("lo") + reach + 1, F.col("lo") + 2 * reach)))
        sides = tiles.withColumn("block", F.explode(F.array("lo", "hi")))
        rows = placed.join(sides, ["pass", "block"]).join(vectors, "c")

        def farther(key: tuple, table: pa.Table) -> pa.Table:
            return _links(table, threshold, lambda p, q: p != q)

        rows = rows.select("pass", "lo", "hi", "group", "block", "rank", "c", "v")
        links = common.written(rows.groupBy("pass", "lo", "hi").applyInArrow(farther, LINKS), "vector-links")
        found, reach = found.unionByName(links), 2 * reach


@common.tidy("near-vectors")
def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vec_id, label and embedding."""
    named = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("embedding").alias("v"))
    fit = F.col("label").isNotNull() & usable(F.col("v"))
    good = named.filter(fit)
    classes = good.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = common.written(classes.withColumn("c", F.monotonically_increasing_id()), "vector-classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    links = common.written(class_links(classes, passes(most, threshold, block), threshold, block, seed), "class-links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = classes.select(F.col("c").alias("b"), "n")
    linked = both.join(size, "b").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("others"))
    top = common.written(components(links, "vector-components"), "vector-tops")
    told = classes.join(linked, "c", "left").join(top.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    told = common.written(told.select("label", "v", "root", "least", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")), "told-classes")
    ids = common.written(told.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("many")), "component-ids")
    told = common.lookup(told, ids, ["root"], "many", told.count())
    told = common.written(told.select("label", "v", "n", "n_links", "component_id"), "vector-answers")
    found = common.lookup(good, told, ["label", "v"], "n", good.count()).select("vec_id", "n_links", "component_id")
    alone = named.filter(~fit).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
