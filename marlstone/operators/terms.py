"""Terms of a large vocabulary in many texts, by the places of their pieces.

A text and a term are cut into the same pieces: runs of ASCII letters and digits, and any other sign by itself, in lower case. A term is held at the places
where the text has its pieces one after the other, and no letter or digit of ASCII before or behind it; so runs of pieces as long as some term are looked up
in the vocabulary by equality. Neither is the vocabulary put into a pattern nor a text copied for its terms, and the work grows with the text and the number of
different lengths of terms, not with the number of terms. Before the look-up, which is a join, runs are held against a table of bits of the terms' checksums, of one
size for any vocabulary; it lets every term pass, and few other runs while the vocabulary has fewer terms than bits.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.lineage import cut
from marlstone.functions.ship import ship_package

LEAST = 3
#: Bits of the table, runs of a batch, first pieces of runs that a task remembers, and texts that it reads at a time.
BITS, PER_BATCH, KEPT, TEXTS = 1 << 22, 50_000, 200_000, 500
PIECES = "[a-z0-9]+|[^a-z0-9]"


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({PIECES})"), F.lit(1))


def _is_word(piece: Column) -> Column:
    return F.coalesce(F.regexp_like(piece, F.lit("^[a-z0-9]")), F.lit(False))


def _batch(batch: pa.RecordBatch, key: list[str], held: list[tuple]) -> pa.RecordBatch:
    """Runs (number of the row, at, size, term, before, behind) with their rows' keys."""
    rows, *rest = zip(*held, strict=True) if held else [()] * 6
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows, pa.int64())) for c in key), *(pa.array(v, t) for v, t in zip(rest, kinds, strict=True))],
                                      names=[*key, "at", "size", "term", "before", "behind"])


def places(texts: DataFrame, key: list[str], vocabulary: DataFrame) -> DataFrame:
    """key, term (in lower case), at, size: where the terms (term) of the vocabulary stand in the texts (key, text), by number of the first piece and of pieces.

    Terms of less than three characters are left out; null texts have none.
    """
    own = cut(vocabulary.select(F.lower("term").alias("term")).distinct().filter(F.length("term") >= LEAST).withColumn("size", F.size(pieces(F.col("term")))))
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())  # different lengths of terms
    code = lambda *c: F.pmod(F.crc32(F.concat_ws("\t", F.col("size").cast("string"), *c)), F.lit(BITS))
    marks = own.select(F.explode(F.array(code("term"), code(F.element_at(pieces(F.col("term")), 1), F.lit("")))).alias("bit")).distinct()
    bits = np.zeros(BITS, bool)
    bits[marks.toPandas()["bit"].to_numpy(np.int64)] = True  # at most BITS rows
    packed = np.packbits(bits, bitorder="little").tobytes()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked(n: int, *words: str) -> bool:
            k = zlib.crc32("\t".join((str(n), *words)).encode()) % BITS
            return packed[k >> 3] >> (k & 7) & 1 == 1

        cut_up, firsts = re.compile(PIECES).findall, {n: {} for n in sizes}
        for batch in batches:
            held: list[tuple] = []
            for row, text in enumerate(batch.column("text_").to_pylist()):
                p = cut_up(text)
                for n in sizes:
                    known, last = firsts[n], len(p) - n
                    for i, x in enumerate(p):
                        if i > last:
                            break
                        ok = known.get(x)
                        if ok is None:
                            if len(known) >= KEPT:
                                known.clear()
                            ok = known[x] = marked(n, x, "") and (n > 1 or marked(1, x))
                        if ok:
                            run = x if n == 1 else "".join(p[i:i + n])
                            if n == 1 or marked(n, run):
                                held.append((row, i, n, run, p[i - 1] if i else None, p[i + n] if i < last else None))
                if len(held) >= PER_BATCH:
                    yield _batch(batch, key, held)
                    held = []
            yield _batch(batch, key, held)

    ship_package(texts.sparkSession)
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS)
    rows = texts.select(*key, F.lower("text").alias("text_")).filter("text_ is not null")
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key)
    each = rows.mapInArrow(look, f"{kinds}, at int, size int, term string, before string, behind string")
    found = each.join(own, ["term", "size"])
    # words are maximal, so only a term that begins or ends with another sign can have one beside it
    clear = (_is_word(F.col("term")) | ~_is_word(F.col("before"))) & (F.regexp_like("term", F.lit("[a-z0-9]$")) | ~_is_word(F.col("behind")))
    return found.filter(clear).select(*key, "term", "at", "size")


def occurrences(texts: DataFrame, key: list[str], vocabulary: DataFrame) -> DataFrame:
    """key, term, n: how often each term stands in each text, every term by itself and without overlapping itself."""
    ends = F.array_sort(F.collect_list(F.struct("at", "size")))
    first = F.struct(F.lit(0).alias("free"), F.lit(0).cast("bigint").alias("n"))
    step = lambda s, x: F.when(x["at"] >= s["free"], F.struct((x["at"] + x["size"]).alias("free"), (s["n"] + 1).alias("n"))).otherwise(s)
    return places(texts, key, vocabulary).groupBy(*key, "term").agg(ends.alias("places_")).select(*key, "term", F.aggregate("places_", first, step, lambda s: s["n"]).alias("n"))


def longest_first(texts: DataFrame, key: list[str], vocabulary: DataFrame) -> DataFrame:
    """key, term, n: how often each term stands in each text, read from the left, the longest term at a place, without overlaps."""
    # only places that overlap, one by the other, need to be read in order: a run of them begins where all before it have ended
    by = Window.partitionBy(*key).orderBy("at", F.col("size").desc())
    ended = F.coalesce(F.max(F.col("at") + F.col("size")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) <= F.col("at")
    alone = F.col("begins_") & F.coalesce(F.lead("at").over(by) >= F.col("at") + F.col("size"), F.lit(True))
    marked = places(texts, key, vocabulary).withColumn("begins_", ended).withColumns(
        {"alone_": alone, "run_": F.sum(F.col("begins_").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))})
    marked = cut(marked.select(*key, "term", "at", "size", "alone_", "run_"))
    order = F.array_sort(F.collect_list(F.struct("at", (-F.col("size")).alias("less"), "term")))
    first = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("terms"))
    step = lambda s, x: F.when(x["at"] >= s["free"], F.struct((x["at"] - x["less"]).alias("free"), F.array_append(s["terms"], x["term"]).alias("terms"))).otherwise(s)
    read = marked.filter("not alone_").groupBy(*key, "run_").agg(order.alias("places_")).select(*key, F.explode(F.aggregate("places_", first, step, lambda s: s["terms"])).alias("term"))
    return read.unionByName(marked.filter("alone_").select(*key, "term")).groupBy(*key, "term").agg(F.count("*").alias("n"))
