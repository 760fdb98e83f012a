"""Shared pieces of the training-data operators."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.ship import ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Everything but these separates no words: the six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"
SPLIT_PATTERN = "[\\x20\\x09-\\x0D]+"
#: A group that holds 1/HOT_SHARE of the rows or more is hot; there are at most HOT_SHARE of them.
HOT_SHARE = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_made: list[list[str]] = []  # tables of the scratch() blocks that are open, the innermost last


def written(df: DataFrame, label: str, lasting: bool = False, codec: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    Inside scratch() the table goes when the block ends; a lasting one goes with the block around it. Tables of whole texts
    take less room under the codec zstd.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    blocks = _made[:-1] if lasting else _made
    if blocks:
        blocks[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes, at its end, the tables that written() made inside and that are not lasting."""
    _made.append([])
    try:
        yield
    finally:
        spark = SparkSession.active()
        for path in _made.pop():
            deleted(spark, path)


def tidy(label: str):
    """A function from DataFrames to a DataFrame whose result is written as a table, and its other tables deleted."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, **kwargs):
            with scratch():
                return written(f(*args, **kwargs), label, lasting=True)

        return run

    return wrap


def removed(df: DataFrame) -> None:
    """Deletes the files of a table made by written() that nothing will read again."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        deleted(df.sparkSession, parent)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that df does not have, whatever the case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The runs of [^\\x20\\x09-\\x0D] of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPLIT_PATTERN))


def coded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each word in all texts, the distinct words, each text's first place and the end), split at the six
    ASCII spaces; null has no words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    lists = pc.ascii_split_whitespace(texts)
    flat, first = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = np.flatnonzero(pc.not_equal(flat, "").to_numpy(zero_copy_only=False))
    flat, first = flat.take(pa.array(real)) if len(real) < len(flat) else flat, np.searchsorted(real, first)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, first


def ascii_lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def lookup(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """rows joined with the one row that groups has for their keys; n is a group's number of rows.

    Groups of total / HOT_SHARE rows or more number at most HOT_SHARE (their sizes add up to total),
    so that part is broadcast and its rows stay where they are; the rest is a shuffled join in which
    no key is hot. Both frames should be written tables, as each is read twice.
    """
    least = max(2, -(-total // HOT_SHARE))
    hot = groups.filter(F.col(n) >= least)
    cold = groups.filter(F.col(n) < least)
    few = rows.join(F.broadcast(hot), keys)
    many = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys)
    return few.unionByName(many)


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df, a written table, with each row's place from 1 in the order of all rows; rows that tie come in any order.

    Rows are dealt by ranges of the order and sorted inside; the driver adds up one count a range.
    """
    spark = df.sparkSession
    part, place, many = free_names(df, "range_part", "range_place", "range_many")
    tie = F.monotonically_increasing_id()  # lets ranges part rows that tie
    dealt = df.withColumn(place, tie).repartitionByRange(shuffles(spark), *order, F.col(place))
    dealt = dealt.sortWithinPartitions(*order, place).withColumns(
        {part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    dealt = written(dealt, "ranked")
    before, offsets = 0, []
    for r in dealt.groupBy(part).agg(F.count("*").alias(many)).orderBy(part).collect():
        offsets.append((r[part], before))
        before += r[many]
    known = F.broadcast(spark.createDataFrame(offsets, f"`{part}` int, `{many}` long"))  # one row a range
    return dealt.join(known, part).withColumn(name, F.col(many) + F.col(place) + 1).drop(part, place, many)


def python_ready(spark: SparkSession, rows: int = 500) -> None:
    """Python workers can import this package, and get so many texts at a time, so that long ones fit in memory."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
