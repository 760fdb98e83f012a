"""Nested JSON records, reviewed documents, and the ways to write a layer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

AFFECTS = "array<struct<term:string,direction:string,channel:string>>"
ASSESSMENT = "struct<product:string,location:string,incoterm:string,low:double,high:double,quote:string>"
EVENT = f"struct<type:string,date:string,summary:string,quote:string,affects:{AFFECTS}>"
#: Extraction records, one JSON object a line.
RECORDS = f"kind string, article_id bigint, date string, output struct<assessments:array<{ASSESSMENT}>,events:array<{EVENT}>>"
DIAGNOSES = ("name string, status string, metric string, product string, period string, ranking array<struct<id:string,score:double>>, "
             "top1 string, decision string, label string")


def extraction_records(spark: SparkSession, path: str) -> DataFrame:
    """Cached extractions with an explicit schema, so no pass over the files infers one."""
    return spark.read.schema(RECORDS).json(path)


def diagnosis_documents(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed diagnoses, one JSON document a file, with the file's name."""
    return spark.read.schema(DIAGNOSES).option("multiLine", True).json(path).withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)$", 1))


def config_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small configuration as a table."""
    return spark.createDataFrame(rows, schema)


def reloaded(layer: DataFrame, path: str, by: str) -> DataFrame:
    """Writes a layer so that a second run leaves the same: only the partitions that the rows have are replaced."""
    layer.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return layer.sparkSession.read.parquet(path)


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing and those rows of incoming whose keys it has not, one row a key: that of the least other columns."""
    order = [c for c in incoming.columns if c not in keys] or keys
    one = incoming.withColumn("nth_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("nth_ = 1").drop("nth_")
    return existing.unionByName(one.join(existing.select(*keys), keys, "left_anti"))


def partitioned(facts: DataFrame, path: str, *by: str) -> DataFrame:
    """Facts written in partitions with their provenance columns, as read again."""
    facts.write.mode("overwrite").partitionBy(*by).parquet(path)
    return facts.sparkSession.read.schema(facts.schema).parquet(path)


class Layer:
    """A table in a folder of any file system of Spark's, replaced as a whole or not at all.

    Each version is a folder of its own; it counts from the moment its entry, named by the next number, is created in _entries. A run that fails before
    leaves the version before it, and of two runs that start from one version the second to end fails. Readers keep the version that they began with
    until vacuum() deletes it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    @property
    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        entries = self._at("_entries")
        return sorted(int(f.getPath().getName()) for f in self._files.listStatus(entries)) if self._files.exists(entries) else []

    def _entry(self, version: int) -> dict:
        found = self.spark.read.text(f"{self.path}/_entries/{version:09d}", wholetext=True).first()
        return json.loads(found["value"])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one unless another is named."""
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"nothing was ever written to {self.path}")
        entry = self._entry(known[-1] if version is None else version)
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{self.path}/{entry['folder']}")

    def replace(self, rows: DataFrame) -> DataFrame:
        """Makes rows, which may be none, the whole layer."""
        last = max(self.versions(), default=0)
        folder = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        self._files.mkdirs(self._at("_entries"))
        # creating a file that must not exist is the one step that decides
        out = self._files.create(self._at("_entries", f"{last + 1:09d}"), False)
        try:
            out.write(bytearray(json.dumps({"folder": folder, "schema": rows.schema.jsonValue()}).encode()))
        finally:
            out.close()
        return self.read(last + 1)

    def upsert(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Adds those rows whose keys the layer has not, one a key; a layer without versions begins with them."""
        known = self.versions()
        old = self.read() if known else rows.limit(0)
        return self.replace(upserted(old, rows, keys))

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all versions but the last ones, and what failed runs left behind."""
        known = self.versions()
        kept = {self._entry(v)["folder"] for v in known[-keep:]}
        for f in self._files.listStatus(self._at()):
            if f.getPath().getName() not in kept | {"_entries"}:
                self._files.delete(f.getPath(), True)
        for v in known[:-keep]:
            self._files.delete(self._at("_entries", f"{v:09d}"), False)
