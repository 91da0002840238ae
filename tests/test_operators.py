"""Change log and audit operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from stratalog.functions import compat
from stratalog.operators import audit, changelog

LOG = "key string, value string, lsn long, ts long, deleted boolean, txn_id int, durable boolean"


@pytest.fixture
def log(spark):
    return spark.createDataFrame([("a", "1", 1, 10, False, 1, True), ("b", "2", 2, 10, False, 1, True), ("a", "9", 3, 20, False, 2, False), ("b", None, 4, 30, True, 3, True)], LOG)


def pairs(df):
    return sorted((r.key, r.value) for r in df.collect())


def test_reads_at_positions(log):
    assert pairs(changelog.latest(log, ["key"])) == [("a", "9")]
    assert pairs(changelog.as_of_lsn(log, ["key"], 2)) == [("a", "1"), ("b", "2")]
    assert pairs(changelog.as_of_lsn(log, ["key"], 0)) == []
    assert {(r.key, r.floor, r.head) for r in changelog.version_floor(log, ["key"], 1).collect()} == {("a", 1, 3), ("b", None, 4)}
    with pytest.raises(ValueError):
        changelog.key_range(log, "key", "b", "a")


def test_flashback(spark, log):
    points = spark.createDataFrame([(10, 2), (20, 3), (30, 4)], "cts long, data_lsn long")
    at = lambda t: pairs(changelog.as_of_ts(log, ["key"], points, F.lit(t)))
    assert at(5) == []
    assert at(10) == [("a", "1"), ("b", "2")]
    assert at(29) == [("a", "9"), ("b", "2")]
    assert at(30) == [("a", "9")]


def test_compaction_keeps_reads(log):
    small = changelog.compacted(log, ["key"], 3)
    for lsn in (3, 4):
        assert pairs(changelog.as_of_lsn(small, ["key"], lsn)) == pairs(changelog.as_of_lsn(log, ["key"], lsn))


def test_phantoms_of_all_tickets(spark):
    tickets = [(i, i % 37, i % 37 + 3) for i in range(200)] + [(900, 5, 4), (901, 0, 99)]
    fresh = [(k,) for k in range(0, 60, 3)]
    got = changelog.phantoms(spark.createDataFrame(tickets, "id long, lo long, hi long"), spark.createDataFrame(fresh, "k long"))
    assert sorted((r.id, r.k) for r in got.collect()) == sorted((i, k) for i, lo, hi in tickets for (k,) in fresh if lo <= k <= hi)


def test_fnv(spark):
    r = spark.createDataFrame([("ab",), ("",)], "k string").select(changelog.fnv1a(F.col("k")).alias("h")).collect()
    assert [x.h for x in r] == [1294271946, 2166136261]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8])
def test_merkle_of_any_size(spark, n):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = [sha(audit.LEAF + f"h{i}") for i in range(n)]
    while len(level) > 1:
        level = [sha(audit.NODE + level[i] + level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
    leaves = spark.createDataFrame([(0, i, f"h{i}") for i in range(n)], "batch long, place long, h string")
    assert [r.root for r in audit.merkle_roots(leaves).collect()] == level


@pytest.mark.parametrize("n", [1, 3, 8, 13])
def test_merkle_proofs(spark, n):
    rows = [(b, p, f"{b}-{p}") for b in (1, 2) for p in range(n + b - 1)]
    leaves = spark.createDataFrame(rows, "batch long, place long, h string")
    roots = audit.merkle_roots(leaves, 14)
    assert sorted((r.batch, r.place, r.ok) for r in audit.inclusion(leaves, roots, 14).collect()) == [(b, p, True) for b, p, _ in rows]
    # a root kept from before a leaf of batch 2 changed
    changed = leaves.withColumn("h", F.when((F.col("batch") == 2) & (F.col("place") == n), "other").otherwise(F.col("h")))
    assert {(r.batch, r.ok) for r in audit.inclusion(changed, roots, 14).collect()} == {(1, True), (2, False)}


def test_chain_errors(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [(1, "", sha("a"), "a"), (2, sha("a"), sha("b"), "B"), (4, sha("x"), sha("d"), "d")]
    chain = spark.createDataFrame(rows, "sequence long, prev_hash string, hash string, body string")
    assert sorted((r.sequence, r.error) for r in audit.chain_errors(chain).collect()) == [(2, "body hash differs"), (4, "gap before")]


def test_compat(spark):
    df = spark.createDataFrame([("12ab",), (" 7",), ("x",), (None,), ("1.5",), ("",)], "t string")
    got = df.select(compat.cast_int_prefix(F.col("t")).alias("i"), compat.sqlite_typeof(F.col("t")).alias("k"), compat.glob(F.col("t"), "[1x]*").alias("g"), compat.truth(F.col("t")).alias("b")).collect()
    assert [r.i for r in got] == [12, 7, 0, None, 1, 0]
    assert [r.k for r in got] == ["text", "real", "text", "null", "real", "null"]
    assert [r.g for r in got] == [True, False, True, None, True, False]
