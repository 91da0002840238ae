"""Mixing sources to target weights by entropy balancing.

Rates r of documents are wanted that change the corpus least, in relative entropy over its tokens, while the tokens of
each source meet a target T[s], and, as far as the targets allow, the mix keeps the corpus's mean log length of documents
(length f, in standard deviations from that mean, weighted by tokens).  That crosses the sources:

    minimise sum(size * (r ln r - r + 1)) + (sum(size * r * f))^2 / (2 R)   under  sum over s of (size * r) = T[s],  r <= 3

Its convex dual has a multiplier x[s] for each source and one, y, for the length: rates are exponentially tilted,
r = min(3, exp(x[s] + y * f)).  For a given y each source's x solves its own constraint, by Newton's iterations on the
source's sums.  Newton's iterations on y take gradient and Hessian (with the x eliminated) summed over all sources; only
these two numbers reach the driver, as decimals, so that the order of summing doesn't matter.

Documents enter by classes of size, two for each doubling, which all have one f; a source has ``CLASSES`` of them at most.
Rates become whole copies by error diffusion: within a source, cells of documents of one class (and alike in a
hash) go from the largest to the smallest; the fractions of a rate gather until a cell is rounded up. What is
left over at the end is half of the smallest cell at most, as long as small documents remain to balance
large ones. A source has ``CLASSES * BINS`` cells at most, however many documents it has; which of them are rounded
up is a bitmap in the row of the source and class, so documents are joined with ``CLASSES`` rows a source.

Defined results: null text has size 0; a null source is a source of its own, ordered last; sources of size 0
get target 0; repeated rows are counted as they stand, and each is taken as often; copies depend on doc_id, source and size
alone, so reruns agree, and documents alike in these (ties) are taken alike; sources are ordered by code point; a document
of any length is one unit, counted whole; other columns pass through, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_or_null, drop_saved, join_groups, let, packed, saved, word_array

MAX_RATE = 3
CLASSES, BINS = 64, 256
#: Newton's iterations for a source, those for the length at most, and R as a part of all tokens.
INNER, OUTER, RIDGE = 40, 40, 0.05


def n_words(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def _keyed(docs: DataFrame, text: str, source: str) -> DataFrame:
    """``row``, the source as a key that is never null, the size, and the document's class and bin."""
    name = column_or_null(docs, source, "string")
    rows = packed(docs, F.coalesce(F.concat(F.lit("s"), name), F.lit("n")).alias("skey"), name.alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(column_or_null(docs, "doc_id", "long")).alias("h"))
    kind = F.least(F.lit(CLASSES - 1), F.floor(2 * F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double"))).cast("int"))
    return rows.select("row", "skey", "source", "size", kind.alias("kind"), F.pmod("h", F.lit(BINS)).cast("int").alias("bin"))


def targets(sizes: DataFrame) -> DataFrame:
    """From (skey, source, source_size): each source's target, with weights 1, 2, 3 in order of the sources.

    Targets share all tokens by weight; they stop at ``MAX_RATE`` times the source's size, and what is above is
    shared again by weight.  That is one level L with target = min(cap, weight * L): sources are capped in
    order of cap / weight.  The tables here have a row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    weighed = sizes.select(
        "*",
        (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("double").alias("weight"),
        (MAX_RATE * F.col("source_size")).cast("double").alias("cap"),
        F.sum("source_size").over(all_rows).cast("double").alias("total"),
    )
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("skey"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levels = weighed.select(
        "*",
        ((F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
    )
    # the first source that isn't capped sets the level for itself and all after it
    free = F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level"))
    level = F.first(free, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return levels.select("skey", "source", "source_size", "weight", F.coalesce(F.least("cap", F.col("weight") * level), F.col("cap")).alias("target"))


class Tilt:
    """The rates for a multiplier y of the length, whose mean and deviation are given."""

    def __init__(self, y: float, mean: float, deviation: float) -> None:
        self.y, self.mean, self.deviation = y, mean, deviation
        self.reach = abs(y) * max(mean, CLASSES / 2 - mean) / deviation if deviation else 0.0

    def f(self, kind: Column) -> Column:
        return (kind / 2 - self.mean) / self.deviation if self.deviation else F.lit(0.0)

    def rate(self, x: Column, kind: Column) -> Column:
        return F.least(F.lit(float(MAX_RATE)), F.exp(x + self.y * self.f(kind)))

    def multiplier(self) -> Column:
        """x of a source (kinds, source_size, target) by Newton's iterations, between bounds that close in on it."""
        start = F.log(F.col("target") / F.col("source_size"))
        low, high = start - self.reach - 0.01, F.lit(math.log(MAX_RATE) + self.reach + 0.01)

        def sums(x: Column) -> Column:
            def add(acc: Column, c: Column) -> Column:
                r = self.rate(x, c["kind"])
                return F.struct((acc["g"] + c["size"] * r).alias("g"), (acc["h"] + F.when(r < MAX_RATE, c["size"] * r).otherwise(0.0)).alias("h"))

            return F.aggregate("kinds", F.struct((-F.col("target")).alias("g"), F.lit(0.0).alias("h")), add)

        def step(acc: Column, _: Column) -> Column:
            def moved(s: Column) -> Column:
                lo, hi = F.when(s["g"] < 0, acc["x"]).otherwise(acc["lo"]), F.when(s["g"] < 0, acc["hi"]).otherwise(acc["x"])
                newton = acc["x"] - s["g"] / F.greatest(s["h"], F.lit(1e-300))
                return F.struct(lo.alias("lo"), hi.alias("hi"), F.when((newton > lo) & (newton < hi), newton).when(s["g"] == 0, acc["x"]).otherwise((lo + hi) / 2).alias("x"))

            return let(sums(acc["x"]), moved)

        solved = F.aggregate(F.sequence(F.lit(1), F.lit(INNER)), F.struct(low.alias("lo"), high.alias("hi"), start.alias("x")), step, lambda acc: acc["x"])
        return F.when((F.col("source_size") > 0) & (F.col("target") > 0), solved)

    def derivatives(self, sources: DataFrame, total: float) -> tuple[float, float]:
        """Gradient and Hessian in y of the dual, with every source's x eliminated."""

        def add(acc: Column, c: Column) -> Column:
            r, f = self.rate(F.col("x"), c["kind"]), self.f(c["kind"])
            free = F.when(r < MAX_RATE, c["size"] * r).otherwise(0.0)
            return F.struct((acc["g"] + c["size"] * r * f).alias("g"), (acc["xx"] + free).alias("xx"), (acc["xy"] + free * f).alias("xy"), (acc["yy"] + free * f * f).alias("yy"))

        start = F.struct(*[F.lit(0.0).alias(c) for c in ("g", "xx", "xy", "yy")])
        by_source = sources.withColumn("x", self.multiplier()).where("x is not null").select(F.aggregate("kinds", start, add).alias("s"))
        curved = F.when(F.col("s.xx") > 0, F.col("s.yy") - F.col("s.xy") * F.col("s.xy") / F.col("s.xx")).otherwise(0.0)
        g, h = by_source.agg(F.sum(F.col("s.g").cast("decimal(38,10)")), F.sum(curved.cast("decimal(38,10)"))).first()
        return float(g or 0) + RIDGE * total * self.y, float(h or 0) + RIDGE * total


def balance(sources: DataFrame) -> Tilt:
    """Newton's iterations on the length's multiplier, over a table of sources (kinds, source_size, target)."""
    size, f = F.col("c.size"), F.col("c.kind") / 2
    sums = [F.sum(x.cast("decimal(38,10)")) for x in (size, size * f, size * f * f)]
    total, first, second = (float(x or 0) for x in sources.select(F.explode("kinds").alias("c")).agg(*sums).first())
    mean = round(first / total, 9) if total else 0.0
    deviation = round(math.sqrt(max(0.0, second / total - mean * mean)), 9) if total else 0.0
    y, low, high = 0.0, -math.inf, math.inf
    for _ in range(OUTER if deviation else 0):
        g, h = Tilt(y, mean, deviation).derivatives(sources, total)
        low, high = (y, high) if g < 0 else (low, y)
        after = y - g / h
        if not low <= after <= high:
            after = (low + high) / 2
        if abs(after - y) < 1e-8:
            break
        y = after
    return Tilt(round(y, 6), mean, deviation)


def _copies(tilt: Tilt) -> Column:
    """For each class of a source (x, kinds), its rate and which of its bins are rounded up, as bits of four words."""
    words = [f"w{j}" for j in range(BINS // 64)]

    def one(acc: Column, b: Column, part: Column, whole: Column) -> Column:
        due = acc["due"] + part * b["size"]
        take = (due >= b["size"] / 2) & (whole < MAX_RATE) & (b["size"] > 0)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), b["bin"] % 64)
        up = [F.when(take & (F.floor(b["bin"] / 64) == j), acc[w].bitwiseOR(bit)).otherwise(acc[w]).alias(w) for j, w in enumerate(words)]
        return F.struct(F.when(take, due - b["size"]).otherwise(due).alias("due"), *up)

    def of_class(acc: Column, c: Column) -> Column:
        # rates within rounding of a whole number are that number
        raw = tilt.rate(F.col("x"), c["kind"])
        exact = F.when(F.abs(raw - F.round(raw)) < 1e-9, F.round(raw)).otherwise(raw)

        def folded(r: Column) -> Column:
            whole = F.floor(r)
            start = F.struct(acc["due"].alias("due"), *[F.lit(0).cast("long").alias(w) for w in words])
            found = F.aggregate(c["bins"], start, lambda a, b: one(a, b, r - whole, whole))
            entry = lambda d: F.array(F.struct(c["kind"].alias("kind"), r.alias("rate"), *[d[w].alias(w) for w in words]))
            return let(found, lambda d: F.struct(d["due"].alias("due"), F.concat(acc["out"], entry(d)).alias("out")))

        return let(F.when(F.col("x").isNotNull(), exact).otherwise(0.0), folded)

    kind = f"array<struct<kind:int,rate:double,{','.join(f'{w}:bigint' for w in words)}>>"
    return F.aggregate(F.reverse("kinds"), F.struct(F.lit(0.0).alias("due"), F.array().cast(kind).alias("out")), of_class, lambda acc: acc["out"])


def plan(cells: DataFrame) -> DataFrame:
    """(skey, kind, source_size, target, rate, w0..w3) from summed cells (skey, source, kind, bin, size)."""
    kinds = cells.groupBy("skey", "source", "kind").agg(F.sum("size").cast("double").alias("size"), F.sort_array(F.collect_list(F.struct("bin", "size"))).alias("bins"))
    sources = kinds.groupBy("skey", "source").agg(F.sum("size").cast("long").alias("source_size"), F.sort_array(F.collect_list(F.struct("kind", "size", "bins"))).alias("kinds"))
    sources = saved(sources, "mix-sources")
    aimed = saved(join_groups(sources, targets(sources.select("skey", "source", "source_size")).select("skey", "target"), ["skey"], "inner"), "mix-targets")
    tilt = balance(aimed)
    tilted = aimed.withColumn("x", tilt.multiplier()).select("skey", "source_size", "target", F.explode(_copies(tilt)).alias("c"))
    out = saved(tilted.select("skey", "source_size", "target", "c.*"), "mix-plan")
    drop_saved(sources, aimed)
    return out


def plan_copies(docs: DataFrame, text: str = "text", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns named by ``carry``, all by default), size, source_size, target, rate and copies of each document."""
    keyed = _keyed(docs, text, source)
    if carry is None:
        base, summed = keyed, keyed
    else:  # narrow rows are kept, so that texts are read once
        base = saved(keyed.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in carry])), "mix-sizes")
        summed = base
    cells = saved(summed.groupBy("skey", "source", "kind", "bin").agg(F.sum("size").alias("size")), "mix-sums")
    planned = plan(cells)
    drop_saved(cells)
    out = join_groups(base, planned, ["skey", "kind"])
    word = F.coalesce(*[F.when(F.floor(F.col("bin") / 64) == j, F.col(f"w{j}")) for j in range(BINS // 64)])
    more = F.call_function("shiftright", word, F.col("bin") % 64).bitwiseAND(1)
    return out.select("row", "source", "size", "source_size", "target", "rate", (F.floor("rate").cast("long") + F.when(F.col("size") > 0, more).otherwise(0)).cast("long").alias("copies"))


def mix(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: each document as often as planned, with the columns it came with."""
    planned = plan_copies(docs, text, source).where("copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
