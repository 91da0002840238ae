"""Near duplicates by SetSketch registers.

A text's set of five-word shingles gets registers K = floor(1 - log_b x) of the least x of exponentially
distributed hash values, truncated to 0..q+1.  Registers of a union are the maxima of the registers
(``merge``), and equal registers become likelier with the Jaccard similarity.  Then:

1. Equal sets become one class each, by a 128-bit hash of the set.
2. Registers are banded; a band's values name a bucket.  Members of a bucket are candidates, first those with its hub.
3. From the registers of a pair and the exact set sizes, the similarity is estimated by joint likelihood; pairs
   far below the threshold go.  The others are confirmed on their full sets (``linking``).
4. Buckets that still hold several components afterwards are compared in full, so no link that shares a bucket is lost.

With 44 bands of 5 registers a pair at similarity 0.75 shares no bucket with a chance of 7e-6.

Defined results: null or empty text has an empty set and is linked with nothing; rows with a null doc_id are linked
with nothing and kept; rows that repeat a doc_id are told apart by their texts; of repeated rows one stays; of equally
similar ones the least doc_id, then the least hash of the text, stays; texts of any length are hashed whole, in memory
that grows with one text at most; other columns pass through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, join_groups, packed, saved, text_key
from .hashing import U, binaries, lists, mixed, set_keys, slices, text_sets
from .linking import linked


@dataclass(frozen=True)
class Sketcher:
    bands: int = 44
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    limit: int = 65534
    seed: int = 1

    @property
    def m(self) -> int:
        return self.bands * self.rows

    def _keys(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.default_rng(self.seed)
        return r.integers(0, 1 << 32, self.m, np.uint32), r.integers(0, 1 << 32, self.m, np.uint32) | np.uint32(1)

    def registers(self, sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Registers of many sets of 64-bit hashes, a row each (zeros for an empty one)."""
        flip, times = self._cached()
        least = np.full((len(bounds) - 1, self.m), 0xFFFFFFFF, np.uint32)
        x = (sets >> U(32)).astype(np.uint32)
        for i in range(0, len(x), 1024):
            part = x[i : i + 1024, None] ^ flip
            part *= times
            first, last = np.searchsorted(bounds, i, "right") - 1, np.searchsorted(bounds, i + len(part), "left")
            own = np.arange(first, last)[np.diff(bounds[first : last + 1]) > 0]
            least[own] = np.minimum(least[own], np.minimum.reduceat(part, np.maximum(bounds[own] - i, 0), axis=0))
        value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / self.rate
        out = np.clip(np.floor(1 - np.log(value) / math.log(self.base)), 0, self.limit + 1).astype(np.uint16)
        out[np.diff(bounds) == 0] = 0
        return out

    def _cached(self) -> tuple[np.ndarray, np.ndarray]:
        if "_k" not in self.__dict__:
            object.__setattr__(self, "_k", self._keys())
        return self.__dict__["_k"]

    def buckets(self, registers: np.ndarray) -> np.ndarray:
        """A 64-bit name for the values of each band, for rows of registers."""
        r = registers.reshape(-1, self.bands, self.rows).astype(U)
        x = np.broadcast_to(mixed(np.arange(self.bands, dtype=U) + U(1)), r.shape[:2])
        for j in range(self.rows):
            x = mixed(x * U(0x9E3779B97F4A7C15) + r[:, :, j])
        return x.view(np.int64)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, base: float) -> np.ndarray:
    """Similarities of pairs by joint likelihood, from (pairs, m) registers and the known sizes of the sets.

    With shares u and v of the sizes, a register of the first set is larger with chance p(u - v J), of
    the second with p(v - u J), where p(x) = -log_b(1 - x (b - 1) / b); the rest are equal.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / math.log(base)
    grid = np.linspace(0, 1, 401)[:, None] * top
    p_more, p_less = np.maximum(p(u - v * grid), 1e-12), np.maximum(p(v - u * grid), 1e-12)
    like = more * np.log(p_more) + less * np.log(p_less) + same * np.log(np.maximum(1 - p_more - p_less, 1e-12))
    return np.take_along_axis(grid, like.argmax(axis=0)[None], 0)[0]


SKETCH = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_a", pa.int64()), ("text_b", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("n", pa.int64()), ("registers", pa.binary()), ("buckets", pa.list_(pa.int64()))])
SKETCH_COLUMNS = "row long, doc_id long, text_a long, text_b long, set_a long, set_b long, n long, registers binary, buckets array<long>"
GIVEN = ["row", "doc_id", "text_a", "text_b"]
SET = ["set_a", "set_b"]


def sketched(docs: DataFrame, sketcher: Sketcher, text: str) -> DataFrame:
    """Set key, size, registers and buckets of each row, under a number of its own and a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in slices(batch["text"]):
                x, at = text_sets(data, bounds)
                some, (a, b) = np.diff(at) > 0, set_keys(x, at)
                r = sketcher.registers(x, at)[some]
                upto = np.concatenate([[0], np.cumsum(some)])
                made = [pa.array(a), pa.array(b), pa.array(np.diff(at)), binaries(r.ravel(), upto * sketcher.m), lists(upto * sketcher.bands, pa.array(sketcher.buckets(r).ravel()))]
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(i, j - i) for c in GIVEN), *made], schema=SKETCH)

    key = text_key(F.col(text))
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), key["a"].alias("text_a"), key["b"].alias("text_b"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return given.mapInArrow(run, SKETCH_COLUMNS)


def full_sets(docs: DataFrame, wanted: DataFrame, text: str, repeats: bool) -> DataFrame:
    """(uid, shingles): the sets of the texts that are wanted (uid, doc_id, set_a, set_b), as packed 64-bit hashes."""
    schema = pa.schema([("uid", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in slices(batch["text"]):
                x, at = text_sets(data, bounds)
                a, b = set_keys(x, at)
                # another text of a doc_id that repeats isn't the one
                same = (a == batch["set_a"].to_numpy()[i:j]) & (b == batch["set_b"].to_numpy()[i:j])
                rows = pa.RecordBatch.from_arrays([batch["uid"].slice(i, j - i), binaries(x, at)], schema=schema)
                yield rows if same.all() else rows.filter(pa.array(same))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = join_groups(texts, wanted, ["doc_id"], "inner").select("uid", *SET, "text").mapInArrow(run, "uid long, shingles binary")
    return out.dropDuplicates(["uid"]) if repeats else out


def _likely(pairs: DataFrame, classes: DataFrame, sketcher: Sketcher, least: float) -> DataFrame:
    """The pairs (hub, uid) whose estimated similarity isn't far below the threshold."""
    side = lambda x: classes.select(F.col("uid").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                regs = [np.frombuffer(b"".join(b[c].to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("r_hub", "r_uid")]
                n = [b[c].to_numpy(zero_copy_only=False).astype(float) for c in ("n_hub", "n_uid")]
                keep = pa.array(estimate(*regs, *n, sketcher.base) >= least)
                yield pa.RecordBatch.from_arrays([b["hub"].filter(keep), b["uid"].filter(keep)], names=["hub", "uid"])

    sized = pairs.join(side("uid"), "uid").join(side("hub"), "hub")
    return sized.select("hub", "uid", "n_hub", "n_uid", "r_hub", "r_uid").mapInArrow(run, "hub long, uid long")


def labelled(docs: DataFrame, text: str, sketcher: Sketcher, percent: int = 75, slack: float = 0.15) -> DataFrame:
    """(doc_id, text_a, text_b, n, component, component_id) of every row: a name for what its set reaches by links, and the least doc_id there."""
    every = saved(sketched(docs, sketcher, text), "sketches")
    some = every.where("n > 0 and doc_id is not null")
    narrow = some.select("row", "doc_id", *SET)
    # sets that several rows have, and the one row that stands for each
    copied = saved(narrow.groupBy(*SET).agg(F.min("doc_id").alias("least"), F.min_by("row", "doc_id").alias("uid"), F.count(F.lit(1)).alias("k")).where("k > 1").select(*SET, "least", "uid"), "copied")
    others = saved(join_groups(narrow, copied, SET, "inner").where("row <> uid").select("row"), "others")
    first = join_groups(some, others, ["row"], "left_anti")
    classes = first.select(F.col("row").alias("uid"), "n", "registers", "buckets")
    repeats = not narrow.groupBy("doc_id").count().where("count > 1").isEmpty()

    def sets_of(ends: DataFrame) -> DataFrame:
        named = narrow.withColumnRenamed("row", "uid")
        return full_sets(docs, saved(named.join(ends, "uid"), "wanted"), text, repeats)

    labels = linked(classes, sets_of, percent, lambda pairs: _likely(pairs, classes, sketcher, percent / 100 - slack))
    named = labels.join(narrow.select(F.col("row").alias("node"), "doc_id"), "node")
    names = saved(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "names")
    of_class = saved(join_groups(labels, names, ["component"], "inner").select(F.col("node").alias("uid"), "component", "component_id"), "class-labels")
    rows = join_groups(every.select("row", "doc_id", "text_a", "text_b", "n", *SET), copied, SET)
    linkable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    rows = rows.select("doc_id", "text_a", "text_b", "n", F.when(linkable, F.coalesce("uid", "row")).alias("uid"), F.when(linkable, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("least"))
    out = saved(join_groups(rows, of_class, ["uid"]).select("doc_id", "text_a", "text_b", "n", F.coalesce("component", "uid").alias("component"), F.coalesce("component_id", "least").alias("component_id")), "labelled")
    drop_saved(every, copied, others, labels, names, of_class)
    return out


def near_duplicates(docs: DataFrame, text: str = "text", sketcher: Sketcher = Sketcher()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; ``kept``: it has the least doc_id of its component."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return labelled(docs, text, sketcher).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def keep_first(docs: DataFrame, text: str = "text", sketcher: Sketcher = Sketcher()) -> DataFrame:
    """One row of each component, with the columns the documents came with."""
    by = ["doc_id", "text_a", "text_b"]
    found = labelled(docs, text, sketcher).where("n > 0 and doc_id is not null")
    leads = found.where("doc_id = component_id")
    # texts of a component that share the least doc_id, and rows that are there twice
    several = saved(leads.groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(*by)).alias("one")).where("k > 1").select("component", "one"), "several")
    beside = join_groups(leads, several, ["component"], "inner").where(F.struct(*by) != F.col("one")).select(*by)
    gone = saved(found.where("doc_id <> component_id").select(*by).unionByName(beside).distinct(), "gone")
    key = text_key(F.col(text))
    rows = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), key["a"].alias("text_a"), key["b"].alias("text_b"))
    kept = join_groups(rows, gone, by, "left_anti")
    if not several.isEmpty():
        twice = several.select("one.*")
        kept = join_groups(kept, twice, by, "left_anti").unionByName(join_groups(kept, twice, by, "left_semi").dropDuplicates(by))
    return kept.select("row.*")
