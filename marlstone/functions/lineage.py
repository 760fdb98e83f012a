"""Tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in spark.checkpoint.dir (a temporary folder in local mode only)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_made: list[list[str]] = []  # tables of the scratch() blocks that are open, the innermost last


def cut(df: DataFrame) -> DataFrame:
    """df computed once and written as a table, which several branches of a job read; inside scratch() it goes when the block ends."""
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    if _made:
        _made[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, n: int, key: str) -> tuple[DataFrame, DataFrame]:
    """df written like cut() in n buckets by a key: to be joined by that key without a shuffle, and as a plain table."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "bucketed")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(n, key).write.bucketBy(n, key).format("parquet").option("path", path).saveAsTable(name)
    if _made:
        _made[-1].append(path)
    known = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # from the catalog; the files are not the catalog's, and known has what it needs
    return known, spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, rows: int = 1_000_000) -> DataFrame:
    """df by the hash of its keys, in as many partitions as keep some rows each, so that tables of one task don't grow with the input."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that cut() made inside. What is to stay must be written or collected before."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            deleted(spark, path)
