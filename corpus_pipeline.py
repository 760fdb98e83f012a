"""A corpus from raw documents: quality, exact and near duplicates, mixture, packing.

Each stage works on all rows that the one before kept and returns the columns of documents; the last
returns the packed pieces. run() writes every stage's rows to the shared folder and reads them again,
so a lost executor costs no more than its stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import common, digest_index, ftrl, mixing, packing, similar_texts

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return ftrl.keep_good(docs.select(*COLUMNS), labels)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return digest_index.keep_one_of_each(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose five-word shingles are 0.8 alike the smallest doc_id stays."""
    return similar_texts.keep_one_of_each(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes, repeated where a source is repeated."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packed),
]

#: The classifier is learnt, which SQL cannot express: tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; tables of a stage go when it is done, and its rows when the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with common.scratch():
            docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"), lasting=True)
        if before is not None:
            common.removed(before)
        before = docs
    return docs
