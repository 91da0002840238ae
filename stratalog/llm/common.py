"""What the corpus operators share: scratch tables, row packing, word rules."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule; a word is a maximal run of anything else.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where all of them are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file:///tmp/checkpoints/stratalog-{os.getuid()}"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffle_files_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run meanwhile are deleted as each of them ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends in files that outlive any executor."""
    path = scratch_path(df.sparkSession, name)
    with shuffle_files_dropped(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop_saved(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            delete_path(t.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """All input columns in one struct ``row``, so that no derived column can clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def column_or_null(docs: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in docs.columns else F.lit(None).cast(kind)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(17), t).alias("b"))


def word_array(text: Column) -> Column:
    """Words of a text, in order; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value to a name inside one expression, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows up to which a table that is keyed by groups may be broadcast, and bytes of its columns; larger ones are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 10 << 20


def row_bytes(groups: DataFrame) -> int:
    """About the bytes of a row; texts and lists count as so many that no more than ``BROADCAST_ROWS`` rows fit."""
    wide = BROADCAST_BYTES // BROADCAST_ROWS
    return sum({"bigint": 8, "double": 8, "int": 4, "boolean": 4}.get(f.dataType.simpleString(), wide) for f in groups.schema)


def join_groups(left: DataFrame, groups: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join a written table of groups: by broadcast if its counted rows allow it, else by shuffle."""
    small = groups.count() * row_bytes(groups) <= BROADCAST_BYTES
    return left.join(F.broadcast(groups) if small else groups, keys, how)
