"""Links between sets that share buckets, confirmed on the full sets, and their components.

1. In each bucket the class that shares most buckets is the hub, and the hub is compared with all others.  A hub's
   pairs are dealt out in salted parts; each gets the hub's set once, and the sets of its members stream past it.
2. Confirmed links give components.  In buckets that still hold several of them, every two members of different
   components are compared as well: members are dealt into blocks of bounded size, a task gets two blocks, counts
   the intersections of all pairs from what sets lack of the shingles that most have and have of others, and gives
   an edge for components that meet.  So no link between members of a bucket is lost, no pair becomes a row, and each
   task is bounded, however large the bucket.

Defined results: an empty table has no components; classes that share no bucket have no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, join_groups, saved
from .components import components
from .hashing import U

#: Pairs of a hub that meet in one task, members of a block, and bytes of its sets (about; one set may be larger).
PART, BLOCK, BLOCK_BYTES = 2048, 2048, 8 << 20
#: Entries of the expansion of shared shingles that are made at once, and pairs of a block that are counted at once.
CHUNK, PAIRS = 1 << 17, 1 << 16

EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    us, vs = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=EDGES)


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sets, given as distinct values."""
    x = np.concatenate([a, b])
    x.sort()
    return int((x[1:] == x[:-1]).sum())


def _pairs(elem_l: np.ndarray, own_l: np.ndarray, elem_r: np.ndarray, own_r: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """How many elements each left and each right owner have in common, from (element, owner) rows, the right ones by element."""
    out = np.zeros(shape[0] * shape[1], np.int32)
    lo, hi = np.searchsorted(elem_r, elem_l, "left"), np.searchsorted(elem_r, elem_l, "right")
    n = hi - lo
    some = n > 0
    own_l, lo, n = own_l[some], lo[some], n[some]
    upto = np.cumsum(n)
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CHUNK, "right")))
        m = n[i:j]
        at = np.arange(int(m.sum())) + np.repeat(lo[i:j] - (np.cumsum(m) - m), m)
        out += np.bincount(np.repeat(own_l[i:j], m) * shape[1] + own_r[at], minlength=len(out)).astype(np.int32)
        i = j
    return out.reshape(shape)


def _strip(n: int) -> int:
    """Left members that are compared with n right ones at once."""
    return max(1, PAIRS // max(1, n))


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """For sets numbered by left and by right, whether 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, elem, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # what most sets have; others are described by what they lack of it, and by what else they share
    common = np.flatnonzero(2 * count > len(sets))
    place = np.full(len(values), -1)
    place[common] = np.arange(len(common))
    have = np.zeros((len(common), len(sets)), bool)
    of_common = place[elem] >= 0
    have[place[elem[of_common]], owner[of_common]] = True
    lacks = len(common) - have.sum(axis=0)
    missing = np.argwhere(~have)
    other = ~of_common & (count[elem] > 1)
    parts = [(missing[:, 0], missing[:, 1]), (elem[other], owner[other])]
    # rows of (element, owner) by element, those of the left side and those of the right
    in_left, in_right = np.full(len(sets), -1), np.full(len(sets), -1)
    in_left[left], in_right[right] = np.arange(len(left)), np.arange(len(right))
    sides = []
    for e, o in parts:
        order = np.argsort(e, kind="stable")
        e, o = e[order], o[order]
        a, b = in_left[o] >= 0, in_right[o] >= 0
        sides.append((e[a], in_left[o[a]], e[b], in_right[o[b]]))
    met, step = np.empty((len(left), len(right)), bool), _strip(len(right))
    for i in range(0, len(left), step):
        rows = left[i : i + step]
        both = len(common) - lacks[rows].astype(np.int32)[:, None] - lacks[right].astype(np.int32)[None, :]
        for elem_l, own_l, elem_r, own_r in sides:
            mine = (own_l >= i) & (own_l < i + step)
            both += _pairs(elem_l[mine], own_l[mine] - i, elem_r, own_r, both.shape)
        met[i : i + step] = (100 + percent) * both.astype(np.int64) >= percent * (sizes[rows][:, None] + sizes[right][None, :])
    return met


def _joined(component: np.ndarray, met: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the components that meet: from each one to the least it can reach."""
    names, number = np.unique(component, return_inverse=True)
    root, step = np.arange(len(names)), _strip(len(right))
    for i in range(0, len(left), step):
        a, b = np.nonzero(met[i : i + step])
        a, b = root[number[left[a + i]]], root[number[right[b]]]
        while (a != b).any():
            a, b = a[a != b], b[a != b]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # both are roots, so there is no circle
            while (root[root] != root).any():
                root = root[root]
            a, b = root[a], root[b]
    return [(int(names[i]), int(names[r])) for i, r in enumerate(root) if i != r]


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): the pairs (hub, uid) of a written table whose sets are similar; ``sets`` is (uid, shingles)."""
    many = saved(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / PART).cast("long").alias("parts")).where("parts > 1"), "large-hubs")
    parted = join_groups(pairs, many, ["hub"]).select("hub", "uid", F.coalesce("parts", F.lit(1)).cast("long").alias("parts"))
    members = parted.select("hub", F.pmod(F.xxhash64("uid"), "parts").alias("part"), F.lit(1).alias("side"), "uid").join(sets, "uid")
    hubs = parted.select("hub", "parts").distinct().select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("hub").alias("uid")).join(sets, "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set, found = None, None, []
        for batch in batches:
            for side, uid, raw in zip(batch["side"].to_pylist(), batch["uid"].to_pylist(), batch["shingles"], strict=True):
                s = np.frombuffer(raw.as_buffer(), U)
                if side == 0:
                    hub, hub_set = uid, s.copy()
                elif (100 + percent) * shared_count(hub_set, s) >= percent * (len(hub_set) + len(s)):
                    found.append((hub, uid))
            yield _edges(found)
            found = []

    dealt = members.select("hub", "part", "side", "uid", "shingles").unionByName(hubs).repartition("hub", "part").sortWithinPartitions("hub", "part", "side")
    out = saved(dealt.select("side", "uid", "shingles").mapInArrow(run, "u long, v long"), "links")
    drop_saved(many)
    return out


def met_in_buckets(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): edges between the components of (bucket, uid, n, component) that a link between members of a bucket joins."""
    marks = [F.bit_xor(F.xxhash64("uid", F.lit(i))).alias(f"mark{i}") for i in range(2)]
    grouped = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("k"), F.sum(8 * F.col("n")).alias("bytes"), *marks)
    # of buckets with the same members one will do
    one = grouped.where("a <> b").groupBy("k", "mark0", "mark1").agg(F.min("bucket").alias("bucket"), F.first("bytes").alias("bytes"))
    parts = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("long").alias("parts")
    open_ = saved(one.select("bucket", parts), "open")
    member = join_groups(placed, open_, ["bucket"], "inner").select("bucket", "uid", "component", F.pmod(F.xxhash64("uid"), "parts").alias("p"), "parts")
    other = member.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("q"))
    dealt = other.select("bucket", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "uid", "component").join(sets, "uid")

    def ended(rows: list[tuple], i: int, j: int) -> list[tuple[int, int]]:
        p, component = (np.array([r[k] for r in rows]) for k in (0, 1))
        left, right = np.flatnonzero(p == i), np.flatnonzero(p == j)
        if (component == component[0]).all() or not len(left) or not len(right):
            return []
        apart = component[left][:, None] != component[right][None, :]
        return _joined(component, apart & similar([r[2] for r in rows], left, right, percent), left, right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, found = None, [], []
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("bucket", "i", "j", "p", "component")]
            for bucket, i, j, p, component, raw in zip(*columns, batch["shingles"], strict=True):
                if now != (bucket, i, j):
                    found += ended(rows, *now[1:]) if rows else []
                    now, rows = (bucket, i, j), []
                rows.append((p, component, np.frombuffer(raw.as_buffer(), U).copy()))
            yield _edges(found)
            found = []
        if rows:
            yield _edges(ended(rows, *now[1:]))

    by = ["bucket", "i", "j"]
    out = saved(dealt.select(*by, "p", "component", "shingles").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "u long, v long"), "edges")
    drop_saved(open_)
    return out


def linked(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, likely: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) of the classes that are linked, from a written table (uid, n, buckets) of distinct sets.

    ``sets_of`` gives (uid, shingles) for a table of uids: distinct 64-bit values, packed.  ``likely`` may drop pairs (hub, uid)
    that needn't be compared with the hub; where they share a bucket that stays open they are compared all the same.
    """
    in_bucket = classes.select("uid", "n", F.explode("buckets").alias("bucket"))
    shared = saved(in_bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "buckets")
    shares = saved(join_groups(in_bucket, shared, ["bucket"], "inner"), "shares")
    # the hub of a bucket is the member that shares most: what a group of near copies was copied from
    central = shares.groupBy("uid").agg(F.sum("members").alias("score"))
    hubs = shares.join(central, "uid").groupBy("bucket").agg(F.max(F.struct("score", "uid", "n")).alias("hub"))
    members = saved(shares.select("bucket", "uid", "n").join(hubs.select("bucket", F.col("hub.uid").alias("hub"), F.col("hub.n").alias("n_hub")), "bucket"), "members")
    drop_saved(shared, shares)
    sets = saved(sets_of(members.select("uid").distinct()), "sets")
    # sizes alone bound the similarity
    stars = members.where(f"uid <> hub and 100 * least(n, n_hub) >= {percent} * greatest(n, n_hub)").select("hub", "uid").distinct()
    stars = saved(likely(stars) if likely else stars, "pairs")
    links = compared(stars, sets, percent)
    labels = saved(components(links), "labels")
    placed = saved(members.join(labels, members["uid"] == labels["node"], "left").select("bucket", "uid", "n", F.coalesce("component", "uid").alias("component")), "placed")
    edges = met_in_buckets(placed, sets, percent)
    final = saved(components(links.unionAll(edges)), "labels")
    drop_saved(members, sets, stars, links, labels, placed, edges)
    return final
