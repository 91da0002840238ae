"""Versioned reads over a change log (key, value, lsn, ts, deleted, ...), the state of every mutable table.

The newest version of a key comes from ``max_by``, which sums partially before the shuffle: each task sends one
row for each key it has seen, however many versions a hot key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(log: DataFrame, keys: list[str], order: str = "lsn") -> DataFrame:
    """The row with the greatest ``order`` for each key, deleted ones too."""
    rest = [c for c in log.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.col(order)).alias("_row")
    return log.groupBy(*keys).agg(row).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def latest(log: DataFrame, keys: list[str]) -> DataFrame:
    """Live rows: the newest version of each key unless that is a deletion."""
    return newest(log, keys).where(~F.col("deleted"))


def as_of_lsn(log: DataFrame, keys: list[str], lsn: int | Column) -> DataFrame:
    """Live rows as they stood at a log position; the bound reaches the scan."""
    return latest(log.where(F.col("lsn") <= lsn), keys)


def as_of_token(log: DataFrame, keys: list[str], token: DataFrame, shard: str = "shard") -> DataFrame:
    """Live rows at a snapshot of one position for each shard (shard, lsn_at); as many rows as shards."""
    seen = log.join(F.broadcast(token), shard).where(F.col("lsn") <= F.col("lsn_at")).drop("lsn_at")
    return latest(seen, keys)


def as_of_ts(log: DataFrame, keys: list[str], checkpoints: DataFrame, ts: Column) -> DataFrame:
    """Live rows at the last checkpoint (cts, data_lsn) not after a time; none before the first one."""
    at = checkpoints.where(F.col("cts") <= ts).agg(F.max("data_lsn").alias("_at"))
    return latest(log.join(F.broadcast(at), F.col("lsn") <= F.col("_at")).drop("_at"), keys)


def committed(log: DataFrame, transactions: DataFrame) -> DataFrame:
    """Entries of committed transactions only."""
    return log.join(transactions, "txn_id", "left_semi")


def version_chain(log: DataFrame, keys: list[str]) -> DataFrame:
    """Each version with the position of the one before."""
    return log.withColumn("prev_lsn", F.lag("lsn").over(Window.partitionBy(*keys).orderBy("lsn")))


def version_floor(log: DataFrame, keys: list[str], lsn: int) -> DataFrame:
    """For each key, its newest version at or before a position (null if none), and its head."""
    return log.groupBy(*keys).agg(F.max(F.when(F.col("lsn") <= lsn, F.col("lsn"))).alias("floor"), F.max("lsn").alias("head"))


def key_range(log: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """Live rows of a closed key range, in key order."""
    if not low or high < low:
        raise ValueError("empty key or reversed range")
    return latest(log.where(F.col(key).between(low, high)), [key]).orderBy(key)


def fnv1a(key: Column) -> Column:
    """32-bit FNV-1a of a text of ASCII characters."""
    chars = F.when(F.length(key) > 0, F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.ascii(F.substr(key, i, F.lit(1))).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(chars, F.lit(2166136261).cast("bigint"), lambda h, x: (h.bitwiseXOR(x) * 16777619).bitwiseAND(4294967295))


def shard(key: Column, n: int) -> Column:
    return F.pmod(fnv1a(key), F.lit(n).cast("bigint"))


def compacted(log: DataFrame, keys: list[str], pin: int) -> DataFrame:
    """What has to stay for reads at or after ``pin``: later versions, and each key's newest one before."""
    later = log.where(F.col("lsn") > pin)
    floor = newest(log.where(F.col("lsn") <= pin), keys).where(~F.col("deleted"))
    return later.unionByName(floor.select(*later.columns))


def phantoms(tickets: DataFrame, fresh: DataFrame) -> DataFrame:
    """(id, k): fresh keys (k) inside the scanned ranges (id, lo, hi) of all tickets; ranges are short, so their keys are joined."""
    ranges = tickets.where("lo <= hi").select("id", F.explode(F.sequence("lo", "hi")).alias("k"))
    return ranges.join(fresh, "k").select("id", "k")
