"""Audit reports over tables of expectations and live rows, the monitor that keeps the last verdict, and its write circuit."""

from __future__ import annotations

import hashlib
import hmac
import json
import queue
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import audit


def tier_violations(entries: DataFrame, allowed: DataFrame) -> DataFrame:
    """Entries whose (state, tier) isn't in the table of allowed ones."""
    return entries.join(F.broadcast(allowed.select("state", "tier").distinct()), ["state", "tier"], "left_anti")  # as many rows as states and tiers


def physical(log: DataFrame, shard: Column) -> DataFrame:
    """(shard, entries, keys, max_lsn, data_lsn, tail, digest, ordered) of each shard of a log (key, lsn, durable).

    ``data_lsn`` is the largest durable position, ``tail`` counts entries that aren't durable, ``digest`` doesn't depend on
    the order of entries, and ``ordered`` says that no durable position is beyond the log's.
    """
    durable = F.max(F.when(F.col("durable"), F.col("lsn")))
    digest = F.sha2(F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(F.xxhash64("key", "lsn")), F.sum(F.xxhash64("lsn", "key").cast("decimal(38,0)"))), 256)
    return log.groupBy(shard.alias("shard")).agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct("key").alias("keys"), F.max("lsn").alias("max_lsn"), durable.alias("data_lsn"),
        F.count_if(~F.col("durable")).alias("tail"), digest.alias("digest"), (F.coalesce(durable, F.lit(0)) <= F.max("lsn")).alias("ordered"),
    )


def statistics(shards: DataFrame) -> DataFrame:
    """One row with the sums of all counters over the shards, and the largest positions."""
    kinds = dict(shards.dtypes)
    largest = {c for c in shards.columns if c.endswith("lsn")}
    numbers = [c for c in shards.columns if kinds[c] in ("bigint", "int", "double") and c != "shard"]
    return shards.agg(*[(F.max if c in largest else F.sum)(c).alias(c) for c in numbers])


@dataclass
class Report:
    """The figures that the policy gate goes by; ``body`` is the same for equal figures."""

    missing: int = 0
    unexpected: int = 0
    pending: int = 0
    unexpected_path: int = 0
    tier: int = 0
    decompress: int = 0
    most_missing: int = 0
    verdict: str = ""

    def body(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)


def build(expected: DataFrame, live: DataFrame, unexpected_path: int = 0, tier: int = 0, decompress: int = 0, most_missing: int = 0) -> Report:
    """Hold live rows (key, value) against expectations (key, value_sha256, durable), and judge."""
    counts = {r.verdict: r["count"] for r in audit.contract(expected, live).groupBy("verdict").count().collect()}
    report = Report(counts.get("missing", 0), counts.get("unexpected", 0), counts.get("pending_uncommitted", 0), unexpected_path, tier, decompress, most_missing)
    report.verdict = verdict_of(report)
    return report


def verdict_of(r: Report) -> str:
    """The policy gate for one report: the first rule that applies."""
    rules = [("FAIL:unexpected_path", r.unexpected_path > 0), ("FAIL:tier", r.tier > 0), ("FAIL:decompress", r.decompress > 0), ("FAIL:missing", r.missing > r.most_missing), ("FAIL:unexpected", r.unexpected > 0), ("WARN:pending", r.pending > 0)]
    return next((name for name, applies in rules if applies), "PASS")


def sign(body: str, key: bytes) -> str:
    return hmac.new(key, body.encode(), hashlib.sha256).hexdigest()


def verify_signature(body: str, signature: str, key: bytes) -> bool:
    return hmac.compare_digest(sign(body, key), signature)


@dataclass
class Monitor:
    """Keeps what reports said; a FAIL opens the write circuit until a report passes."""

    unexpected_path_total: int = 0
    decompress_fail_total: int = 0
    rar_chain_drop_total: int = 0
    last_chain_sequence: int = 0
    last_anchor_sequence: int = 0
    last_anchor_hash: str = ""
    last_chain_verdict: str = ""
    last_chain_reason: str = ""
    startup_chain_consistent: bool = True
    worker_running: bool = False
    allows_write: bool = True

    def see(self, report: Report) -> None:
        self.unexpected_path_total += report.unexpected_path
        self.decompress_fail_total += report.decompress
        self.last_chain_verdict, _, self.last_chain_reason = report.verdict.partition(":")
        self.allows_write = self.last_chain_verdict != "FAIL"

    def status(self) -> dict[str, str]:
        names = ["allows_write", *(n for n in self.__dict__ if n != "allows_write")]
        return {n: str(int(v) if isinstance(v := getattr(self, n), bool) else v) for n in names}


@dataclass
class ChainWorker:
    """Appends report bodies to a chain in the background; what doesn't fit into its queue is dropped and counted."""

    append: Callable[[str], int]
    monitor: Monitor
    most: int = 64
    _queue: queue.Queue = field(init=False)
    _thread: threading.Thread | None = field(init=False, default=None)

    def __post_init__(self) -> None:
        self._queue = queue.Queue(self.most)

    def offer(self, body: str) -> bool:
        try:
            self._queue.put_nowait(body)
            return True
        except queue.Full:
            self.monitor.rar_chain_drop_total += 1
            return False

    def start(self) -> None:
        self.monitor.worker_running = True
        self._thread = threading.Thread(target=self._work, daemon=True)
        self._thread.start()

    def _work(self) -> None:
        while (body := self._queue.get()) is not None:
            self.monitor.last_chain_sequence = self.append(body)

    def stop(self) -> None:
        """Waits for what is queued."""
        if self._thread:
            self._queue.put(None)
            self._thread.join()
            self._thread = None
        self.monitor.worker_running = False
