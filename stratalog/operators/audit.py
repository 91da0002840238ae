"""Verifiable history: digests, hash chains, Merkle batches, contracts, policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Prefixes of hashed leaves and nodes.
LEAF, NODE = "carl:leaf:", "carl:node:"
BATCH = 8


def digest(x: Column) -> Column:
    return F.sha2(x.cast("string"), 256)


#: Entries of a chain that one task looks at together.
BLOCK = 4096


def _blocks(entries: DataFrame) -> DataFrame:
    """Entries by blocks of their sequence, each block with its predecessor's last entries too (``own`` false)."""
    block = F.floor(F.col("sequence") / BLOCK)
    seen_by = F.when(F.col("sequence") % BLOCK == BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))
    return entries.select("*", block.alias("_own"), F.explode(seen_by).alias("_block")).withColumn("own", F.col("_own") == F.col("_block"))


def chain_errors(entries: DataFrame) -> DataFrame:
    """(sequence, error) for each violation in a chain (sequence, prev_hash, hash, body).

    The position in the chain comes from the sequence itself, so blocks of it are looked at apart, after one shuffle.
    """
    in_order = Window.partitionBy("_block").orderBy("sequence")
    of_before = in_order.rangeBetween(-1, -1)
    seen = _blocks(entries).select(
        "sequence", "prev_hash", "hash", "body", "own", F.first("hash").over(of_before).alias("_before"), F.count(F.lit(1)).over(of_before).alias("_n_before"),
        F.count(F.lit(1)).over(in_order.rangeBetween(0, 0)).alias("_n"), F.lag("sequence").over(in_order).alias("_last"),
    ).where("own")
    checks = [
        (F.col("sequence") < 1, "sequence below 1"),
        ((F.col("sequence") > 1) & (F.col("_n_before") == 0), "gap before"),
        ((F.col("_n_before") > 0) & ~F.col("prev_hash").eqNullSafe(F.col("_before")), "previous hash differs"),
        (digest(F.col("body")) != F.col("hash"), "body hash differs"),
        ((F.col("_n") > 1) & ~F.col("_last").eqNullSafe(F.col("sequence")), "sequence repeats"),
    ]
    found = F.filter(F.array(*[F.when(test, F.lit(text)) for test, text in checks]), lambda x: x.isNotNull())
    return seen.select("sequence", F.explode_outer(found).alias("error")).where("error is not null")


def chained(entries: DataFrame) -> DataFrame:
    """Entries (sequence, body) with hash and prev_hash (null for the first of them)."""
    hashed = _blocks(entries.withColumn("hash", digest(F.col("body"))))
    before = F.first("hash").over(Window.partitionBy("_block").orderBy("sequence").rangeBetween(-1, -1))
    return hashed.withColumn("prev_hash", before).where("own").drop("own", "_own", "_block")


def merkle_level(nodes: DataFrame) -> DataFrame:
    """One level up of (batch, place, x); an odd last node is paired with itself."""
    pair = nodes.groupBy("batch", (F.floor(F.col("place") / 2)).cast("bigint").alias("up")).agg(F.min_by("x", "place").alias("left"), F.max_by("x", "place").alias("right"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    joined = F.sha2(F.concat(F.lit(NODE), F.col("left"), F.col("right")), 256)
    # a batch that is down to one node has its root
    return pair.select("batch", F.col("up").alias("place"), F.when(F.col("size") == 1, F.col("left")).otherwise(joined).alias("x"), F.ceil(F.col("size") / 2).cast("bigint").alias("size"))


def merkle_roots(leaves: DataFrame, most: int = BATCH) -> DataFrame:
    """(batch, root) of leaves (batch, place, h), with ``most`` leaves in a batch at most; one shuffle for all levels."""
    in_batch = leaves.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("place", "h"))).alias("leaves"))
    level = in_batch.select("batch", F.transform("leaves", lambda e: F.sha2(F.concat(F.lit(LEAF), e["h"]), 256)).alias("x"))
    at = lambda i: F.get(F.col("x"), i.cast("int"))
    node = lambda i: F.sha2(F.concat(F.lit(NODE), at(2 * i), F.coalesce(at(2 * i + 1), at(2 * i))), 256)
    for _ in range((most - 1).bit_length()):  # a batch that is down to one node has its root
        up = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / 2).cast("int")), node)
        level = level.select("batch", F.when(F.size("x") > 1, up).otherwise(F.col("x")).alias("x"))
    return level.select("batch", F.element_at("x", 1).alias("root"))


def merkle_proofs(leaves: DataFrame, most: int = BATCH) -> DataFrame:
    """(batch, place, h, proof) of leaves (batch, place, h): the step of each level from a leaf to its batch's root.

    Takes the same levels as ``merkle_roots``: an odd last node is its own sibling, and a batch down to one node has no more steps.
    """
    sizes = leaves.groupBy("batch").agg(F.count(F.lit(1)).alias("size"))
    level = leaves.join(sizes, "batch").select("batch", F.col("place").cast("bigint").alias("place"), F.sha2(F.concat(F.lit(LEAF), F.col("h")), 256).alias("x"), "size")
    out = leaves.select("batch", F.col("place").cast("bigint").alias("place"), "h", F.array().cast("array<string>").alias("proof"), F.col("place").cast("bigint").alias("at"))
    for _ in range((most - 1).bit_length()):
        pair = level.groupBy("batch", F.floor(F.col("place") / 2).cast("bigint").alias("up")).agg(F.min_by("x", "place").alias("left"), F.max_by("x", "place").alias("right"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
        right = (F.col("n") == 1) | (F.col("at") % 2 == 0)
        step = F.when(F.col("size") > 1, F.when(right, F.concat(F.lit("R:"), "right")).otherwise(F.concat(F.lit("L:"), "left")))
        met = out.withColumn("up", F.floor(F.col("at") / 2).cast("bigint")).join(pair, ["batch", "up"])
        out = met.select("batch", "place", "h", F.when(step.isNull(), F.col("proof")).otherwise(F.concat("proof", F.array(step))).alias("proof"), F.col("up").alias("at"))
        level = merkle_level(level)
    return out.drop("at")


def inclusion(leaves: DataFrame, roots: DataFrame, most: int = BATCH) -> DataFrame:
    """(batch, place, ok): whether each leaf's proof leads to the root (batch, root) kept of its batch."""
    proofs = merkle_proofs(leaves, most).join(roots, "batch", "left")
    return proofs.select("batch", "place", F.coalesce(verify_proof(F.col("h"), F.col("proof"), F.col("root")), F.lit(False)).alias("ok"))


def verify_proof(leaf: Column, proof: Column, root: Column) -> Column:
    """Whether steps ``L:hash`` / ``R:hash`` lead from a leaf's digest to the root."""
    start = F.sha2(F.concat(F.lit(LEAF), leaf), 256)
    up = F.aggregate(proof, start, lambda x, s: F.sha2(F.concat(F.lit(NODE), F.when(s.startswith("L:"), F.concat(F.substr(s, F.lit(3)), x)).otherwise(F.concat(x, F.substr(s, F.lit(3))))), 256))
    return up == root


def contract(expected: DataFrame, live: DataFrame) -> DataFrame:
    """(key, verdict) where what was promised (key, value_sha256, durable) and what is there (key, value) differ."""
    have = live.select("key", digest(F.col("value")).alias("_have"))
    both = expected.select("key", "value_sha256", "durable").join(have, "key", "full_outer")
    verdict = (
        F.when(F.col("value_sha256").isNull(), "unexpected")
        .when(~F.col("durable"), "pending_uncommitted")
        .when(F.col("_have").isNull() | (F.col("_have") != F.col("value_sha256")), "missing")
    )
    return both.select("key", verdict.alias("verdict")).where("verdict is not null")


def policy(unexpected_path: Column, tier: Column, decompress: Column, missing: Column, most_missing: Column, unexpected: Column, pending: Column) -> Column:
    """The first rule that applies gives the verdict."""
    return (
        F.when(unexpected_path > 0, "FAIL:unexpected_path")
        .when(tier > 0, "FAIL:tier")
        .when(decompress > 0, "FAIL:decompress")
        .when(missing > most_missing, "FAIL:missing")
        .when(unexpected > 0, "FAIL:unexpected")
        .when(pending > 0, "WARN:pending")
        .otherwise("PASS")
    )


def chain_of(rows: DataFrame, order: str, body: Column, by: list[str]) -> DataFrame:
    """A hash chain for each group: sequence, body, hash, prev_hash."""
    w = Window.partitionBy(*by).orderBy(order)
    hashed = rows.select(*by, F.row_number().over(w).cast("bigint").alias("sequence"), body.alias("body")).withColumn("hash", digest(F.col("body")))
    return hashed.withColumn("prev_hash", F.coalesce(F.lag("hash").over(Window.partitionBy(*by).orderBy("sequence")), F.lit("")))
