"""The operation log: what was promised to writers, as JSON lines, and the expectations that follow from it.

Each batch of entries is a folder of JSON files; what became durable later is a file of its own with a position, so nothing
is rewritten.  An entry is durable if it was when it returned, or if a mark covers its position.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "v int, op string, key string, value_sha256 string, lsn long, durable_at_return boolean, tier string, ts_unix long"


class OpLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def append(self, entries: DataFrame) -> None:
        """Append (op, key, value, lsn, durable, tier, ts_unix); values are kept as digests."""
        digest = F.when(F.col("op") == "put", F.sha2(F.coalesce(F.col("value").cast("string"), F.lit("")), 256))
        entries.select(
            F.lit(1).alias("v"), "op", F.col("key").cast("string").alias("key"), digest.alias("value_sha256"), F.col("lsn").cast("long").alias("lsn"),
            F.col("durable").alias("durable_at_return"), "tier", F.col("ts_unix").cast("long").alias("ts_unix"),
        ).write.json(f"{self.folder}/entries/{uuid.uuid4().hex}")

    def mark_durable(self, lsn: int) -> None:
        """All entries up to a position are durable from now on."""
        row = self.spark.createDataFrame([(json.dumps({"durable_through": lsn}),)], "value string")
        row.coalesce(1).write.text(f"{self.folder}/marks/{uuid.uuid4().hex}")

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame:
        """All entries, with ``durable`` as it is now."""
        if not self._there("entries"):
            return self.spark.createDataFrame([], f"{SCHEMA}, durable boolean")
        entries = self.spark.read.schema(SCHEMA).json(f"{self.folder}/entries/*")
        mark = self.spark.read.schema("durable_through long").json(f"{self.folder}/marks/*").agg(F.max("durable_through")).first()[0] if self._there("marks") else None
        return entries.withColumn("durable", F.col("durable_at_return") | (F.lit(mark if mark is not None else -1) >= F.col("lsn")))


def expectations(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, value_sha256, durable) of keys whose last entry is a put, and (key) of all keys that were touched."""
    last = log.groupBy("key").agg(F.max_by(F.struct("op", "value_sha256", "durable"), "lsn").alias("e"))
    return last.where("e.op = 'put'").select("key", "e.value_sha256", "e.durable"), last.select("key")


def known_tables(expected: DataFrame, tables: DataFrame) -> DataFrame:
    """Expectations whose key, ``table:rest``, names one of the tables (id)."""
    named = expected.withColumn("_id", F.substring_index("key", ":", 1))
    return named.join(tables.select(F.col("id").cast("string").alias("_id")).distinct(), "_id", "left_semi").drop("_id")
