"""SimHash near-dedup with deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments, so that of two fingerprints at four or fewer
differing bits one segment differs by one bit at most. Each segment is indexed under every variant of
itself with one bit wild; an equality join on the variants finds the pairs, and the whole fingerprints verify
them inside the join. A pair counts only at the first variant that both share, so it comes out once.

Variants that many fingerprints share are cut further: of the 42 or 43 bits outside the segment at most four differ, so one of
five pieces of them is equal, and pairs meet on the variant and a piece. Work then does not grow with the square of
the fingerprints that share 20 bits.

Only distinct fingerprints are indexed, whatever their number of copies. Links inside a dense group are
not all made: neighbours in each variant's order are linked first, and the join then looks only at
pairs that those links have left in different components, in variants that hold more than one
component. No link between components is lost, so the components are those of all links.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; fewer
words than a shingle are one shingle; a text may be of any length; rows that repeat a doc_id each get a row; null doc_ids count as none
when the smallest is taken; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import common

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Fingerprints of a variant from which pairs meet on a piece of the other bits as well.
MANY = 64
PIECES = MAX_BITS + 1
#: (first bit, bits) of the segments: 3 of them leave one with MAX_BITS // 3 = 1 differing bit at most.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_FOLD = bytes.maketrans(common.UPPER.encode(), common.LOWER.encode())


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 values of all shingles, repeats included; fewer words than a shingle are one, no words none."""
    import xxhash

    w = (text or "").encode().translate(_FOLD).split()  # bytes split at the six ASCII spaces only
    if len(w) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else [], "<u8")
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(w) - shingle + 1].tolist()
    hash_ = xxhash.xxh64_intdigest
    return np.array([hash_(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], "<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The majority of each bit over the XXH64 values of all shingles, as an unsigned number; zero for no words."""
    h = shingle_hashes(text, shingle)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *keep: str) -> DataFrame:
    """doc_id, the string columns keep and fp (the 64 bits as a bigint) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(c) for c in keep), pa.array(fp.view(np.int64))], names=["doc_id", *keep, "fp"])

    common.python_ready(docs.sparkSession)
    columns = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), *keep)
    return columns.mapInArrow(run, ", ".join(["doc_id bigint", *(f"{c} string" for c in keep), "fp bigint"]))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(fps: DataFrame) -> DataFrame:
    """64 rows a fingerprint: segment, wild (the bit that is left out) and rest (the segment without it)."""
    kinds = F.array(*[
        F.struct(F.lit(k).cast("tinyint").alias("segment"), F.lit(first + bit).cast("tinyint").alias("wild"),
                 F.lit(_signed(((1 << n) - 1 << first) & ~(1 << first + bit))).alias("mask"))
        for k, (first, n) in enumerate(SEGMENTS) for bit in range(n)])
    return (fps.withColumn("v", F.explode(kinds))
            .select(*fps.columns, F.col("v.wild").alias("wild"), F.col("fp").bitwiseAND(F.col("v.mask")).alias("rest")))


def pieces() -> Column:
    """The keys besides its variant under which a fingerprint meets others: none, or five pieces of the bits outside its segment."""
    none = F.array(F.struct(F.lit(-1).alias("nth"), F.lit(0).cast("bigint").alias("bits")))
    cut = none
    for first, n in SEGMENTS:
        outside = [b for b in range(64) if not first <= b < first + n]
        masks = [_signed(sum(1 << b for b in outside[k::PIECES])) for k in range(PIECES)]
        own = F.array(*[F.struct(F.lit(k).alias("nth"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks)])
        cut = F.when(F.col("wild").between(first, first + n - 1), own).otherwise(cut)
    return F.when(F.col("many"), cut).otherwise(none)


def _linked(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS


def _first_variant(a: Column, b: Column, wild: Column) -> Column:
    """Whether wild is the first variant that two linked fingerprints share."""
    x = a.bitwiseXOR(b)
    differ = [x.bitwiseAND(F.lit(_signed((1 << n) - 1 << first))) for first, n in SEGMENTS]
    # a lone differing bit's place is the number of bits below it
    place = lambda d: F.bit_count(d - 1)
    first = F.lit(-1)
    for d, (start, _) in reversed(list(zip(differ, SEGMENTS, strict=True))):
        lone = F.when(d == _signed(1 << 63), F.lit(63)).otherwise(place(d))
        first = F.when(d == 0, F.lit(start)).when(F.bit_count(d) == 1, lone).otherwise(first)
    return first == wild


def near_classes(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp, d: their smallest doc_id) -> fp, component_id."""
    index = variants(fps.select("fp"))
    order = Window.partitionBy("wild", "rest").orderBy("fp")
    chain = index.withColumn("b", F.lag("fp").over(order)).filter(_linked(F.col("fp"), F.col("b")))
    chain = common.written(chain.select(F.col("fp").alias("a"), "b").distinct(), "chain")
    from marlstone.llm.components import components

    first = common.written(components(chain, "chains"), "first-components")
    rooted = fps.select("fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))
    rooted = common.written(rooted, "rooted")
    index = variants(rooted)
    same = Window.partitionBy("wild", "rest")
    busy = index.withColumns({"lo": F.min("root").over(same), "hi": F.max("root").over(same), "many": F.count("*").over(same) >= MANY})
    busy = common.written(busy.filter("lo <> hi").drop("lo", "hi").withColumn("piece", F.explode(pieces())).drop("many"), "busy-variants")
    a, b = busy.alias("a"), busy.alias("b")
    links = a.join(
        b,
        (F.col("a.wild") == F.col("b.wild")) & (F.col("a.rest") == F.col("b.rest")) & (F.col("a.piece") == F.col("b.piece")) & (F.col("a.root") < F.col("b.root"))
        & _linked(F.col("a.fp"), F.col("b.fp")) & _first_variant(F.col("a.fp"), F.col("b.fp"), F.col("a.wild")))
    links = links.select(F.col("a.root").alias("a"), F.col("b.root").alias("b")).distinct()
    second = common.written(components(links, "links"), "second-components")
    named = rooted.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    named = named.select("fp", F.coalesce("top", "root").alias("top")).join(fps, "fp")
    named = common.written(named, "named")
    smallest = named.groupBy("top").agg(F.min("d").alias("component_id"), F.count("*").alias("n_fps"))
    smallest = common.written(smallest, "smallest")
    return common.lookup(named, smallest, ["top"], "n_fps", named.count()).select("fp", "component_id", "n")


@common.tidy("near-duplicates")
def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, *keep: str) -> DataFrame:
    """doc_id, the string columns keep, fp, component_id and same (rows with this very fingerprint) of each row."""
    prints = common.written(fingerprints(docs, shingle, *keep), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("d"), F.count("*").alias("n"))
    distinct = common.written(distinct, "distinct-fingerprints")
    classes = common.written(near_classes(distinct), "near-classes")
    return common.lookup(prints, classes, ["fp"], "n", prints.count()).withColumnRenamed("n", "same")


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, with all their columns, but those whose component has a smaller doc_id.

    Rows go by doc_id and text, so of rows that share a doc_id only those linked to a smaller one go; a row without
    doc_id goes if its component has any.
    """
    named = docs.select("doc_id", "text").withColumn("text_tie", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    gone = near_duplicates(named, shingle, "text_tie").filter("not component_id <=> doc_id").select(
        F.struct("doc_id").alias("k"), "text_tie").distinct()
    key, tie = common.free_names(docs, "near_key", "near_tie")
    gone = common.written(gone.select(F.col("k").alias(key), F.col("text_tie").alias(tie)), "near-copies")
    rows = docs.withColumns({key: F.struct(F.col("doc_id").cast("bigint").alias("doc_id")), tie: F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)})
    return rows.join(gone, [key, tie], "left_anti").select(*[rows[c] for c in docs.columns])
