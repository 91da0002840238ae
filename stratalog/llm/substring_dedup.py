"""Substring dedup by paragraph MinHash banding.

Texts that are equal word for word are one text; a copy of ``GRAM`` words or more is reported whole (kind ``text``).

Paragraphs are lines of at least ``MIN_LINE`` words.  Their sets of five-word shingles get MinHash values in ``BANDS``
bands of ``ROWS`` (a pair at similarity 0.75 shares no band with a chance of 0.4 %, one at 0.85 of 7 in 100,000), colliding
paragraphs are confirmed by exact Jaccard similarity of 0.75, and components of confirmed links are clusters (kind ``line``).

A passage can also repeat inside long lines that differ around it, or over several short ones.  So whole texts
are searched for equal runs of words too (kind ``run``):

1. Seeds: of every ``SPAN`` neighbouring grams (``GRAM`` words) the one with the least hash, the last of equal ones.
   Texts that share a run of ``GRAM + SPAN - 1`` words share a seed in it, repetitive text included.
2. Seeds that several documents hold cover a run but for its ends.  Where one of a seed's occurrences has no such
   seed next to it, all grams around all its occurrences are compared too, so that runs are reported whole.

So every run of 23 words or more is found to its last word; shorter ones (12 words at least) where they have a seed.
A run is a stretch whose grams all first occur in one document, named by the key of its first gram.

Only clusters that reach over two documents or more count.  The document with the least doc_id keeps its text as it
stands, the parts of all others are removals.  Places count words of the whole text.  A text's seeds and paragraphs depend
on that text alone, so results don't depend on how documents are dealt over tasks.

Defined results: null or empty text has no paragraphs; rows with a null doc_id can't be told apart and are left
out; repeated rows are one document; texts that share a doc_id are parts of one document; of equally good
documents the least doc_id keeps its text; texts of any length are searched whole, in memory that grows with one text
at most; other columns are not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, drop_saved, join_groups, saved
from .hashing import FACTORS, U, binaries, distinct, gram_keys, lists, mixed, set_keys, shingle_sets, slices, word_hashes
from .linking import linked

MIN_LINE, GRAM, SPAN = 25, 12, 12
BANDS, ROWS, PERCENT = 10, 3, 75
#: Low bits that hold a gram's place while the least of a span is searched.
PLACE = U((1 << 24) - 1)

BAND_COLUMNS = [f"b{k}" for k in range(BANDS)]
SEED = pa.struct([("pos", pa.int32()), ("key", pa.int64())])
LINE = pa.struct([("place", pa.int32()), ("n_words", pa.int32()), ("uid", pa.int64())])
SKETCH = pa.struct([*LINE, ("n", pa.int64()), *((c, pa.int64()) for c in BAND_COLUMNS)])
PARTS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("tid", pa.int64()), ("same", pa.int64()), ("n_words", pa.int64()), ("seeds", pa.list_(SEED)), ("lines", pa.list_(LINE)), ("sketches", pa.list_(SKETCH))])
PART_COLUMNS = (
    "row long, doc_id long, tid long, same long, n_words long, seeds array<struct<pos:int,key:long>>, lines array<struct<place:int,n_words:int,uid:long>>, "
    f"sketches array<struct<place:int,n_words:int,uid:long,n:long,{','.join(f'{c}:long' for c in BAND_COLUMNS)}>>"
)
GRAM_ROWS = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("pos", pa.int32()), ("key", pa.int64())])
SETS = pa.schema([("uid", pa.int64()), ("shingles", pa.binary())])

_RANDOM = np.random.default_rng(1)
#: The hash functions: x -> (x ^ FLIPS[j]) * TIMES[j] modulo 2^32.
FLIPS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
TIMES = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)


def seed_places(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of the seeds among the grams of many texts; ends[i] is the place after the last gram of gram i's text."""
    n = len(keys) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.int64)
    if len(keys) > int(PLACE):  # one text of so many words: in overlapping parts
        half = int(PLACE) // 2
        parts = [seed_places(keys[i : i + half + SPAN - 1], ends[i : i + half + SPAN - 1] - i) + i for i in range(0, len(keys), half)]
        return np.unique(np.concatenate(parts))
    least = (keys & ~PLACE) | (PLACE - np.arange(len(keys), dtype=U))
    width = 1
    while width < SPAN:
        step = min(width, SPAN - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    full = np.arange(n) + SPAN <= ends[:n]
    chosen = np.zeros(len(keys), bool)
    chosen[(PLACE - (least[full] & PLACE)).astype(np.int64)] = True
    return np.flatnonzero(chosen)


def band_values(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name for the MinHash values of each band, a row for each non-empty set."""
    high = (x >> U(32)).astype(np.uint32)
    least = np.full((len(bounds) - 1, BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(high), 4096):
        part = high[i : i + 4096, None] ^ FLIPS
        part *= TIMES
        first, last = np.searchsorted(bounds, i, "right") - 1, np.searchsorted(bounds, i + len(part), "left")
        own = np.arange(first, last)
        least[own] = np.minimum(least[own], np.minimum.reduceat(part, np.maximum(bounds[own] - i, 0), axis=0))
    values = least.reshape(-1, BANDS, ROWS).astype(U)
    out = np.broadcast_to(mixed(np.arange(BANDS, dtype=U) + U(1)), values.shape[:2])
    for j in range(ROWS):
        out = mixed(out * U(0x9E3779B97F4A7C15) + values[:, :, j])
    return out.view(np.int64)


def _lines(data: np.ndarray, begins: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all lines of ``MIN_LINE`` words or more; words are numbered over all texts."""
    cuts = np.unique(np.concatenate([at, np.searchsorted(begins, np.flatnonzero(data == 10))]))
    sizes = np.diff(cuts)
    long_ = sizes >= MIN_LINE
    first = cuts[:-1][long_]
    return np.searchsorted(at, first, "right") - 1, first, sizes[long_]


def parts_of(docs: DataFrame, text: str) -> DataFrame:
    """What each text has to show: seeds, paragraphs, and sketches of these; a row each, by one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = lambda kind, *columns: pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
        for batch in batches:
            for i, j, data, bounds in slices(batch["text"]):
                w, begins, at = word_hashes(data, bounds)
                n = np.diff(at)
                # the text's words in order, in a hash of 64 bits beside the text's own
                same = set_keys(mixed(w + (np.arange(len(w)) - np.repeat(at[:-1], n)).astype(U) * FACTORS[7]), at)[0]
                keys = gram_keys(w, GRAM)
                seeds = seed_places(keys, np.repeat(at[1:], n)[: len(keys)] - GRAM + 1)
                owner = np.searchsorted(at, seeds, "right") - 1
                own, first, sizes = _lines(data, begins, at, bounds)
                x, sets = shingle_sets(w, first, sizes)
                line = [first - at[own], sizes, set_keys(x, sets)[0]]
                bands = band_values(x, sets)
                per_text = lambda rows, count=j - i: np.searchsorted(rows, np.arange(count + 1))
                made = [
                    pa.array(same), pa.array(n, pa.int64()), lists(per_text(owner), struct(SEED, (seeds - at[owner]).astype(np.int32), keys[seeds].view(np.int64))),
                    lists(per_text(own), struct(LINE, *line)), lists(per_text(own), struct(SKETCH, *line, np.diff(sets), *bands.T)),
                ]
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(i, j - i) for c in ("row", "doc_id", "tid")), *made], schema=PARTS)

    return texts_of(docs, text).select(F.monotonically_increasing_id().alias("row"), "*").mapInArrow(run, PART_COLUMNS)


def texts_of(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, tid, text); documents that share an id are told apart by their text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), F.col(text).alias("text")).where("doc_id is not null and text is not null")


def line_sets(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(uid, shingles) of the paragraphs asked for: (doc_id, tid, lines), a list of (place, n_words, uid) for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in slices(batch["text"]):
                w, _, at = word_hashes(data, bounds)
                asked = batch["lines"].slice(i, j - i)
                place, n_words, uid = asked.flatten().flatten()
                begins = place.to_numpy() + np.repeat(at[:-1], np.diff(asked.offsets.to_numpy()))
                x, sets = shingle_sets(w, begins, n_words.to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([uid, binaries(x, sets)], schema=SETS)

    return join_groups(texts_of(docs, text), wanted, ["doc_id", "tid"], "inner").select("text", "lines").mapInArrow(run, "uid long, shingles binary")


def all_grams(texts: DataFrame) -> DataFrame:
    """(doc_id, tid, pos, key) of all grams within ``SPAN`` of the places before[] and after[] of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, tids = (batch[c].to_numpy() for c in ("doc_id", "tid"))
            for i, j, data, bounds in slices(batch["text"]):
                w, _, at = word_hashes(data, bounds)
                keys = gram_keys(w, GRAM)
                near = np.zeros(len(keys), bool)
                for column, step in (("before", -1), ("after", 1)):
                    asked = batch[column].slice(i, j - i)
                    owner = np.repeat(np.arange(j - i), np.diff(asked.offsets.to_numpy()))
                    place, lo, hi = asked.flatten().to_numpy() + at[owner], at[owner], at[owner + 1] - GRAM
                    for k in range(SPAN + 1):
                        there = place + step * k
                        near[there[(there >= lo) & (there <= hi)]] = True
                pos = np.flatnonzero(near)
                own = np.searchsorted(at, pos, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc_ids[i:j][own], tids[i:j][own], (pos - at[own]).astype(np.int32), keys[pos].view(np.int64))], schema=GRAM_ROWS)

    return texts.select("doc_id", "tid", "text", "before", "after").mapInArrow(run, "doc_id long, tid long, pos int, key long")


def shared(rows: DataFrame, key: str) -> DataFrame:
    """(key, kept_doc_id) of what several documents hold; a row for each key and task goes over the network."""
    return rows.groupBy(key).agg(F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("_last")).where("kept_doc_id < _last").drop("_last")


def _placed(rows: DataFrame, kind: str) -> DataFrame:
    removed = (F.col("doc_id") != F.col("kept_doc_id")).alias("removed")
    return rows.select("doc_id", F.lit(kind).alias("kind"), F.col("place").cast("long").alias("place"), F.col("n_words").cast("long").alias("n_words"), "cluster", "kept_doc_id", removed)


def runs(docs: DataFrame, found: DataFrame, text: str = "text", spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """(doc_id, place, n_words, cluster, kept_doc_id): whole runs of words that several documents hold, from seeds (doc_id, tid, pos, key).

    The written tables ``spent`` are deleted once the seeds have been read.
    """
    keys = saved(shared(found, "key").select("key"), "seed-keys")
    hits = join_groups(found, keys, ["key"], "inner")
    in_text = Window.partitionBy("doc_id", "tid").orderBy("pos")
    gap = lambda x: F.coalesce(x > GRAM, F.lit(True))
    marked = saved(hits.select("doc_id", "tid", "pos", "key", gap(F.col("pos") - F.lag("pos").over(in_text)).alias("begins"), gap(F.lead("pos").over(in_text) - F.col("pos")).alias("ends")), "seed-hits")
    drop_saved(keys, *spent)
    # an end of one occurrence: the grams there are needed of all occurrences
    edges = saved(marked.groupBy("key").agg(F.max("begins").alias("b"), F.max("ends").alias("e")).where("b or e"), "edges")
    at = lambda c: F.collect_set(F.when(F.col(c), F.col("pos")))
    zones = saved(join_groups(marked, edges, ["key"], "inner").groupBy("doc_id", "tid").agg(at("b").alias("before"), at("e").alias("after")), "zones")
    n_bytes = zones.agg(F.sum(32 + 4 * (F.size("before") + F.size("after")))).first()[0] or 0
    texts = join_groups(texts_of(docs, text), zones.select("doc_id", "tid"), ["doc_id", "tid"], "left_semi")
    dense = all_grams(texts.join(F.broadcast(zones) if n_bytes <= BROADCAST_BYTES else zones, ["doc_id", "tid"]))
    every = saved(marked.select("doc_id", "tid", "pos", "key").unionAll(dense), "grams")
    drop_saved(marked, edges, zones)
    held = join_groups(every, saved(shared(every, "key"), "gram-keys"), ["key"], "inner")
    by = ["doc_id", "tid", "kept_doc_id"]
    ordered = Window.partitionBy(*by).orderBy("pos")
    parts = held.select(*by, "pos", "key", F.when(F.col("pos") - F.lag("pos").over(ordered) <= GRAM, 0).otherwise(1).alias("new")).select(*by, "pos", "key", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("part"))
    return parts.groupBy(*by, "part").agg(F.min("pos").alias("place"), (F.max("pos") - F.min("pos") + GRAM).alias("n_words"), F.min_by("key", "pos").alias("cluster")).drop("part")


def paragraphs(docs: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, place, n_words, cluster, kept_doc_id) of paragraphs in clusters of several documents, from what texts have to show."""
    one = F.xxhash64("doc_id", "tid", "place")
    chosen = [F.min_by(c, "o").alias(c) for c in ("doc_id", "tid", "place", "n_words")]
    each = texts.select("doc_id", "tid", F.inline("sketches")).withColumn("o", one)
    classes = saved(each.groupBy("uid").agg(*chosen, *[F.min(c).alias(c) for c in ("n", *BAND_COLUMNS)]), "paragraphs")

    def sets_of(ends: DataFrame) -> DataFrame:
        asked = classes.join(ends, "uid").groupBy("doc_id", "tid").agg(F.sort_array(F.collect_list(F.struct("place", "n_words", "uid"))).alias("lines"))
        return line_sets(docs, saved(asked, "wanted"), text).dropDuplicates(["uid"])

    labels = linked(classes.select("uid", "n", F.array(*BAND_COLUMNS).alias("buckets")), sets_of, PERCENT)
    rows = join_groups(texts.select("doc_id", F.inline("lines")), labels.withColumnRenamed("node", "uid"), ["uid"])
    rows = rows.select("doc_id", "place", "n_words", F.coalesce("component", "uid").alias("cluster"))
    clusters = saved(shared(rows, "cluster"), "clusters")
    out = saved(join_groups(rows, clusters, ["cluster"], "inner").distinct(), "lines")
    drop_saved(classes, labels, clusters)
    return out


def repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, kind, place, n_words, cluster, kept_doc_id, removed): each part of a cluster, one row each."""
    every = saved(parts_of(docs, text), "parts")
    # texts equal word for word, and the one row that stands for each
    words = ["same", "n_words"]
    narrow = every.select("row", "doc_id", *words).where("n_words > 0")
    copied = saved(narrow.groupBy(*words).agg(F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("last"), F.min_by("row", "doc_id").alias("one"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "copied")
    copies = saved(join_groups(narrow, copied, words, "inner"), "copies")
    texts = join_groups(every, copies.where("row <> one").select("row"), ["row"], "left_anti")
    whole = copies.where((F.col("n_words") >= GRAM) & (F.col("kept_doc_id") < F.col("last"))).select("doc_id", F.lit(0).alias("place"), "n_words", F.col("same").alias("cluster"), "kept_doc_id").distinct()
    lines = paragraphs(docs, texts, text)
    spans = runs(docs, texts.select("doc_id", "tid", F.inline("seeds")), text, (every,))
    return _placed(whole, "text").unionAll(_placed(lines, "line")).unionAll(_placed(spans, "run"))
