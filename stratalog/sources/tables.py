"""Parquet tables of a folder, and SQL over them without global view names."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """Run SQL whose ``{name}`` stand for tables of the folder; only those are opened."""
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: table(spark, folder, n) for n in names}) if names else spark.sql(text)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; one of our own only where all of them are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/checkpoints/stratalog-engine"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
