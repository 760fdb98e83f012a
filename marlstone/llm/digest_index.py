"""Exact dedup against a persistent digest index (DataFrame functions only).

The index is a table bucketed and sorted by digest. A batch is reduced to one row a digest before it
is shuffled, digests that the index has are removed by a sort-merge anti-join that reads the index
without a shuffle, and the rest is appended under the batch's name. A batch appended again under its name, after a
failure at whatever point, gives the rows of the first time: what the index has of the batch counts as its own.

Defined cases: null text counts as empty; texts are equal when they are identical after lower-casing
A-Z; of equal texts in a batch the row with the largest doc_id stays (null doc_id is smallest; of
fully repeated rows one stays, whichever); rows whose digest an earlier batch brought are all dropped, name
that batch's row and have that batch's group_size; an empty batch gives no rows and leaves the index as it is. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import common

SCHEMA = "digest string, keep_id bigint, group_size bigint, batch string"


class DigestIndex:
    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or common.scratch_path(spark, self.name)
        self.buckets = buckets or common.shuffles(spark)
        # an index written by an earlier session is found again by its path
        where = self.path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
                  f"INTO {self.buckets} BUCKETS LOCATION '{where}'")

    def drop(self) -> None:
        """Takes the table and its files away."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        common.deleted(self.spark, self.path)

    def _save(self, rows: DataFrame) -> None:
        (rows.write.format("parquet").mode("append").option("path", self.path)
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def digests(self, docs: DataFrame) -> DataFrame:
        """doc_id, row_id and digest of each row, written once and read by every later step."""
        return common.written(
            docs.select(
                F.col("doc_id").cast("bigint").alias("doc_id"),
                F.sha2(common.ascii_lower(F.col("text")).cast("binary"), 256).alias("digest"),
            ).withColumn("row_id", F.monotonically_increasing_id()),
            "digests",
        )

    def append(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Adds a batch; returns for each of its rows doc_id, digest, keep_id, group_size and kept.

        batch names it: give the same name when a batch that may have failed half-way is appended again.
        """
        batch = batch or uuid.uuid4().hex
        rows = self.digests(docs)
        groups = rows.groupBy("digest").agg(
            F.max(F.struct("doc_id", "row_id")).alias("top"), F.count("*").alias("group_size"))
        groups = common.written(groups.select(
            "digest", F.col("top.doc_id").alias("keep_id"), F.col("top.row_id").alias("keep_row"), "group_size"), "groups")
        fresh = groups.drop("keep_row").join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        fresh = common.written(fresh.withColumn("batch", F.lit(batch)), "fresh")
        self._save(fresh)
        total = rows.count()
        tops = groups.select("digest", F.col("keep_id").alias("top_id"), F.col("keep_row").alias("top_row"))
        known = self.table().withColumnRenamed("batch", "owner").join(tops.hint("merge"), "digest")
        found = self._owners(rows, known, total)
        return found.select(
            "doc_id", "digest", "keep_id", "group_size",
            ((F.col("owner") == batch) & (F.col("row_id") == F.col("top_row"))).alias("kept"))

    def _owners(self, rows: DataFrame, known: DataFrame, total: int) -> DataFrame:
        """Digests with many copies are few and go to the rows; the other rows go to the index's buckets."""
        sizes = rows.groupBy("digest").agg(F.count("*").alias("n_here"))
        hot = sizes.filter(F.col("n_here") >= max(2, -(-total // common.HOT_SHARE))).select("digest")
        hot = common.written(hot, "hot-digests")  # at most HOT_SHARE rows
        owners = F.broadcast(known.join(F.broadcast(hot), "digest"))
        few = rows.join(owners, "digest")
        many = rows.join(F.broadcast(hot), "digest", "left_anti").join(known.hint("merge"), "digest")
        return few.unionByName(many)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Documents of a batch against an index of their own, which goes afterwards; see DigestIndex.append."""
    index = DigestIndex(docs.sparkSession)
    with common.scratch():
        found = common.written(index.append(docs), "exact-classes", lasting=True)
    index.drop()
    return found


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact dedup keeps, with all their columns, whatever their names."""
    from pyspark.sql import Window

    key, digest, nth, copy, same = common.free_names(docs, "exact_key", "exact_digest", "exact_nth", "exact_copy", "exact_same")
    kept = exact_dedup(docs).filter("kept").select(F.struct("doc_id").alias(copy), F.col("digest").alias(same))
    named = docs.withColumns({
        key: F.struct(F.col("doc_id").cast("bigint").alias("doc_id")), digest: F.sha2(common.ascii_lower(F.col("text")).cast("binary"), 256)})
    once = Window.partitionBy(key, digest).orderBy(digest)
    both = named.join(kept, (F.col(key) == F.col(copy)) & (F.col(digest) == F.col(same)))
    return both.withColumn(nth, F.row_number().over(once)).filter(F.col(nth) == 1).select(*[named[c] for c in docs.columns])
