"""Audit chains, their Merkle batches and anchors as JSON lines: append, rotate, publish, verify.

A chain file grows by one entry a report, so it is read and written by the driver; whole histories are verified as tables
(``audit.chain_errors``).
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .report import sign, verify_signature

CHAIN = "sequence long, checkpoint_lsn long, rar_sha256 string, prev_rar_sha256 string, op_log_head_sha256 string, generated_at_unix long, body_json string"


def _lines(path: str) -> Iterator[dict]:
    if os.path.exists(path):
        with open(path) as f:
            yield from (json.loads(x) for x in f if x.endswith("\n") and x.strip())  # a line cut short was never appended


def _append(path: str, value: dict) -> None:
    with open(path, "a") as f:
        f.write(json.dumps(value) + "\n")
        f.flush()
        os.fsync(f.fileno())


def last(path: str) -> dict | None:
    found = None
    for found in _lines(path):  # noqa: B007
        pass
    return found


def append(path: str, body: str, checkpoint_lsn: int = 0, op_log_head: str = "") -> int:
    """Append a report's body; its sequence number."""
    before = last(path)
    entry = {
        "sequence": (before["sequence"] if before else 0) + 1, "checkpoint_lsn": checkpoint_lsn, "rar_sha256": hashlib.sha256(body.encode()).hexdigest(),
        "prev_rar_sha256": before["rar_sha256"] if before else "", "op_log_head_sha256": op_log_head, "generated_at_unix": int(time.time()), "body_json": body,
    }
    _append(path, entry)
    return entry["sequence"]


def rotate(path: str, most: int) -> str | None:
    """Put a chain of ``most`` entries aside, so that the next one begins anew; its new name."""
    entry = last(path)
    if not most or not entry or entry["sequence"] < most:
        return None
    stem = path.removesuffix(".jsonl")
    n = 0
    while os.path.exists(new := f"{stem}.{int(time.time())}{f'-{n}' if n else ''}.bak.jsonl"):
        n += 1
    os.rename(path, new)
    return new


def table(spark: SparkSession, path: str) -> DataFrame:
    """A chain file as (sequence, prev_hash, hash, body) for ``audit.chain_errors``."""
    return spark.read.schema(CHAIN).json(path).selectExpr("sequence", "nullif(prev_rar_sha256, '') AS prev_hash", "rar_sha256 AS hash", "body_json AS body")


def errors(path: str) -> list[str]:
    """What is wrong with a chain file."""
    found, before, place = [], "", 0
    for place, e in enumerate(_lines(path), 1):
        if e["sequence"] != place:
            found.append(f"sequence {e['sequence']} at place {place}")
        if e["prev_rar_sha256"] != before:
            found.append(f"previous hash differs at {place}")
        if hashlib.sha256(e["body_json"].encode()).hexdigest() != e["rar_sha256"]:
            found.append(f"body hash differs at {place}")
        before = e["rar_sha256"]
    return found


def publish(chain: str, anchors: str, key: bytes | None = None) -> dict:
    """Anchor a chain's head in another file, signed if there is a key."""
    head = last(chain)
    if not head:
        raise ValueError("the chain is empty")
    anchor = {"chain_sequence": head["sequence"], "root_hash": head["rar_sha256"], "published_at_unix": int(time.time()), "chain_path": os.path.basename(chain)}
    if key:
        anchor["signature"] = sign(json.dumps(anchor, sort_keys=True), key)
    _append(anchors, anchor)
    return anchor


def anchored(chain: str, anchors: str, key: bytes | None = None) -> str:
    """How a chain stands to its latest anchor: ``ok``, or what differs."""
    anchor = last(anchors)
    if not anchor:
        return "no anchor"
    if key and not verify_signature(json.dumps({k: v for k, v in anchor.items() if k != "signature"}, sort_keys=True), anchor.get("signature", ""), key):
        return "signature differs"
    for e in _lines(chain):
        if e["sequence"] == anchor["chain_sequence"]:
            return "ok" if e["rar_sha256"] == anchor["root_hash"] else "hash differs"
    return "the chain is shorter than its anchor"
