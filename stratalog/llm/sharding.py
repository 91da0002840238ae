"""Shards of near equal bytes from sampled splitters.

A record's key has a hash of its text above a hash of the whole record: equal texts lie side by side, yet a group of
copies that is too large for that still has places to cut.  Keys are sampled with a chance in proportion to
their bytes; weighted quantiles of the sample are the first splitters.  Then all bytes are summed by range, and overfull
ranges are cut again: those of several texts between texts, those of one text within it only where the
text's copies hold more than ``GROUP_SHARE`` of a shard.  Equal records share a key; where they alone overfill a range, they
are dealt over cells of it.  Neighbouring ranges are joined to shards by running sums, so equal texts are in one shard
but for groups that are cut.

The sample and the table of ranges are bounded by parameters; nothing else reaches the driver.  Slots are
numbered within cells (a small part of a shard each), on top of the rows of the cells before.  Keys come from the records
alone, so neither shards nor slots depend on how the input is laid out.

Defined results: null text counts no bytes (a record has 16 of its own) and crc32 0, and its group is that of the empty
text; repeated rows are records of their own, interchangeable ones; ties of keys go by a hash of the whole record; a
shard may be empty when there are fewer groups than shards; texts of any length count whole; other columns pass
through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import packed, saved, text_key

SHARDS = 40
RANGES_PER_SHARD = 128
SAMPLES_PER_RANGE = 16
OVERHEAD = 16
#: Part of a shard that copies of one text may hold without being cut; low bits of a key that tell copies apart; parts of equal records.
GROUP_SHARE, LOW, DEALT = 0.05, 24, 1 << 20


def crc_of(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def sized(docs: DataFrame, text: str, carry: list[str] | None) -> DataFrame:
    """``row``, size, crc, the key, a finer hash of the record, and a number that deals out equal records."""
    rows = packed(docs, (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + OVERHEAD).cast("long").alias("size"), crc_of(F.col(text)).alias("crc"), text_key(F.col(text))["a"].alias("h"))
    record = F.xxhash64(*[F.col("row")[f.name] for f in docs.schema if not isinstance(f.dataType, MapType)])
    rows = rows.withColumn("tie", record).withColumn("dealt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(DEALT)))
    if carry is not None:
        rows = rows.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in carry]))
    key = F.shiftleft(F.shiftright("h", LOW), LOW) + F.pmod("tie", F.lit(1 << LOW))
    return rows.select("row", "size", "crc", key.alias("key"), "tie", "dealt")


def sample_splitters(records: DataFrame, total: int, ranges: int) -> np.ndarray:
    """Weighted quantiles of a sample drawn by size; about ``ranges * SAMPLES_PER_RANGE`` keys reach the driver."""
    rate = ranges * SAMPLES_PER_RANGE / max(total, 1)
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(rate))
    drawn = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 40)) < chance * (1 << 40)
    got = records.where(drawn).select("key", (F.col("size") / chance).alias("w")).toPandas().sort_values("key")
    if got.empty:
        return np.empty(0, np.int64)
    upto = np.cumsum(got["w"].to_numpy())
    cuts = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)
    return np.unique(got["key"].to_numpy()[np.minimum(cuts, len(got) - 1)] >> LOW << LOW)


def cell_of(splitters: np.ndarray, parts: np.ndarray | None = None) -> Column:
    """Index of the range that holds a key: splitters[i-1] <= key < splitters[i]; with parts, that of the cell in it."""
    first = None if parts is None else np.cumsum(parts) - parts

    @F.pandas_udf("int")
    def find(key: pd.Series, dealt: pd.Series) -> pd.Series:
        at = np.searchsorted(splitters, key.to_numpy(), side="right")
        return pd.Series((at if first is None else first[at] + (dealt.to_numpy() * parts[at] // DEALT)).astype(np.int32))

    return find(F.col("key"), F.col("dealt"))


def _sums(records: DataFrame, cell: Column) -> pd.DataFrame:
    """Bytes, rows and least and greatest key of each cell; a row for each cell at most."""
    return (
        records.groupBy(cell.alias("cell"))
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        .toPandas()
        .sort_values("cell", ignore_index=True)
    )


def refine(records: DataFrame, splitters: np.ndarray, most: float, most_group: float, rounds: int = 40, pieces: int = 32) -> tuple[np.ndarray, pd.DataFrame]:
    """Cut overfull ranges at equal steps between their least and greatest key, again and again.

    Each round leaves a range with a 32nd of its keys, so the rounds suffice for keys of 64 bits.
    """
    sums = _sums(records, cell_of(splitters))
    for _ in range(rounds):
        one_text = sums["hi"].to_numpy() >> LOW == sums["lo"].to_numpy() >> LOW
        over = sums[(sums["bytes"] > np.where(one_text, most_group, most)) & (sums["hi"] > sums["lo"])]
        if over.empty:
            return splitters, sums
        more = []
        for lo, hi in zip(over["lo"].tolist(), over["hi"].tolist(), strict=True):
            if hi >> LOW > lo >> LOW:  # between texts; the first of them may be cut off as a range of its own
                more += [((lo >> LOW) + ((hi >> LOW) - (lo >> LOW)) * i // pieces + 1) << LOW for i in range(pieces)]
            else:
                more += [lo + (hi - lo) * i // pieces + 1 for i in range(pieces)]
        splitters = np.unique(np.concatenate([splitters, np.array(more, np.int64)]))
        sums = _sums(records, cell_of(splitters))
    raise RuntimeError(f"ranges still overfull after {rounds} rounds")


def assign(docs: DataFrame, shards: int = SHARDS, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row``, size, text_crc32, law, shard, slot and grown_shard of each record."""
    records = saved(sized(docs, text, carry), "shard-records")
    total = records.agg(F.sum("size")).first()[0] or 0
    most = 2 * total / (shards * RANGES_PER_SHARD)
    splitters = sample_splitters(records, total, shards * RANGES_PER_SHARD)
    splitters, sums = refine(records, splitters, most, max(most, GROUP_SHARE * total / shards))
    # equal records that overfill a range are dealt over cells of it
    parts = np.ones(len(splitters) + 1, np.int64)
    alone = sums[(sums["hi"] == sums["lo"]) & (sums["bytes"] > GROUP_SHARE * total / shards)] if len(sums) else sums
    if len(alone):
        parts[alone["cell"]] = np.ceil(alone["bytes"] / most).astype(np.int64)
        sums = _sums(records, cell_of(splitters, parts))
    before = sums["bytes"].cumsum() - sums["bytes"]
    sums["shard"] = np.minimum(shards - 1, ((before + sums["bytes"] / 2) * shards / max(total, 1)).astype(np.int64)) if len(sums) else 0
    sums["base"] = sums.groupby("shard")["rows"].cumsum() - sums["rows"]
    places = records.sparkSession.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(sums["cell"], sums["shard"], sums["base"], strict=True)], "cell int, shard int, base long")
    order = Window.partitionBy("cell").orderBy("key", "tie", "dealt")
    placed = records.withColumn("cell", cell_of(splitters, parts)).withColumn("n", F.row_number().over(order))
    return placed.join(F.broadcast(places), "cell").select("row", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
