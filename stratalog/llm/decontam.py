"""Benchmark decontamination by canonical templates.

Texts become sequences of canonical tokens: numbers, units after numbers, and names (capitalised words within
a sentence) become typed placeholders, other words lower case.  Windows of ``WINDOW`` tokens of benchmark items
and of documents meet in a hash join, so a question asked again with other numbers or names still meets
its original.  Where windows have placeholders, their fillers are compared along the alignment, insertions of up to a
window's length included: one value of the item must stand for one value of the document throughout, and a name of the
document for one name of the item, else windows with that value don't count, unless all fillers of a window are the item's own.

An item's windows are indexed twice: with names as placeholders and as words, for documents in one case
throughout.  A window with fewer than ``MIN_WORDS`` words besides placeholders, or an item shorter than a window as a
whole, is indexed by its raw tokens in lower case instead, and only meets the very same ones.  A bitmap of all indexed
hashes, of fixed size, lets hardly any other window of a document become a row, however large the index is.  A document holds an item if the windows that match hold ``MIN_SHARE`` of the item's tokens, and ``WINDOW`` of its words or all it has (fillers
count as words where they are equal), or if ``MIN_RUN`` windows match.

Defined results: null or empty text holds nothing; items without tokens are not searched; items with fewer tokens than a
window, even a single one, are held by each text that has all of them in a row; items with equal windows (ties) are all
reported; copies of a text get equal rows, repeated rows one each; an item_id that repeats has the windows of all its texts;
texts of any length are searched whole; other columns pass through, whatever their names; without items every document
is clean; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, column_or_null, join_groups, packed, saved, text_key

WINDOW = 8
MIN_WORDS = 5
MIN_SHARE = 0.5
MIN_RUN = 20
#: 64-bit words of the bitmap of the index.
BITMAP = 1 << 16
#: Marks names in a text; a control character that is no part of any token.
MARK = "\x01"
NAME = r"(?<=[\p{Ll},;:] )\p{Lu}[\p{L}\p{M}]*"
TOKEN = r"\x01?[\p{L}\p{M}]+|\p{Nd}+(?:[.,]\p{Nd}+)*"
#: Units of measure, taken as such right after a number.
UNITS = [
    "mm", "cm", "m", "km", "mi", "ft", "inch", "inches", "feet", "miles", "meters", "metres", "g", "kg", "mg", "lb", "lbs", "oz", "grams", "pounds",
    "l", "ml", "liters", "litres", "gallons", "s", "sec", "seconds", "min", "minutes", "h", "hr", "hours", "days", "weeks", "months", "years",
    "dollars", "euros", "cents", "usd", "eur", "percent", "kmh", "mph", "degrees", "mb", "gb", "tb", "kb", "v", "w", "kw", "hz", "khz", "mhz", "ghz",
]


def tokens(text: Column) -> Column:
    """Raw tokens; names keep a leading mark."""
    plain = F.translate(F.coalesce(text, F.lit("")), MARK, " ")
    return F.regexp_extract_all(F.regexp_replace(plain, NAME, MARK + "$0"), F.lit(TOKEN), F.lit(0))


def _is_number(x: Column) -> Column:
    return (x >= "0") & (x < ":")


def canonical(raw: str, names: bool = True) -> Column:
    """Placeholders ``#`` (number), ``%`` (unit), ``@`` (name), or the word in lower case."""

    def one(x: Column, i: Column) -> Column:
        low = F.lower(F.ltrim(x, F.lit(MARK)))
        name = x.startswith(MARK) & F.lit(names)
        other = x.rlike(r"^\p{Nd}")  # digits beyond ASCII
        unit = low.isin(UNITS) & (i > 0) & F.coalesce(F.get(F.col(raw), i - 1).rlike(r"^\p{Nd}"), F.lit(False))
        return F.when(x < "0", F.when(name, "@").otherwise(F.when(unit, "%").otherwise(low))).when(_is_number(x) | ((x > "z") & other), "#").when(F.length(x) <= 7, F.when(unit, "%").otherwise(low)).otherwise(low)

    return F.transform(F.col(raw), one)


def windows(hashes: str, size: int = WINDOW) -> Column:
    """64-bit hashes of all windows of tokens, in order, from the hashes of the tokens."""
    at = lambda i: F.xxhash64(*[F.get(F.col(hashes), i + j) for j in range(size)])
    return F.when(F.size(hashes) >= size, F.transform(F.sequence(F.lit(0), F.size(hashes) - size), at))


def raw_windows(hashes: str, size: int) -> Column:
    """Hashes of windows of raw tokens, which never meet those of canonical ones."""
    at = lambda i: F.xxhash64(F.lit(-size), *[F.get(F.col(hashes), i + j) for j in range(size)])
    return F.when(F.size(hashes) >= size, F.transform(F.sequence(F.lit(0), F.size(hashes) - size), at))


def plain_tokens(raw: str) -> Column:
    return F.transform(F.col(raw), lambda x: F.lower(F.ltrim(x, F.lit(MARK))))


def _word(h: Column) -> Column:
    return F.shiftrightunsigned(h, 6).bitwiseAND(BITMAP - 1)


def bitmap(hashes: DataFrame) -> Column:
    """A bit for each hash h of a table, as a literal array of 64-bit words; ``BITMAP`` words at most reach the driver."""
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int")))
    words = dict(hashes.groupBy(_word(F.col("h"))).agg(bits).collect())
    return F.split(F.lit(",".join(str(words.get(i, 0)) for i in range(BITMAP))), ",").cast("array<bigint>")


def _maybe(bits: Column, h: Column) -> Column:
    return F.call_function("shiftright", F.get(bits, _word(h).cast("int")), h.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def _window_rows(rows: DataFrame, keep: list[str], raw_sizes: list[int] | None = None, bits: Column | None = None) -> DataFrame:
    """A row (*keep, pos, h) for each window of the column ``canon``, and for those of ``raw`` of the sizes given, that the bitmap lets pass.

    The outer form of the generator, since for the inner one Spark repeats its input in a filter further down.
    """
    placed = lambda w: F.coalesce(F.transform(w, lambda h, i: F.struct(i.alias("pos"), h.alias("h"))), F.array().cast("array<struct<pos:int,h:bigint>>"))
    sizes = raw_sizes or []
    more = [F.transform(plain_tokens("raw"), lambda x: F.xxhash64(x)).alias("raw_hashes")] if sizes else []
    hashed = rows.select(*keep, F.transform("canon", lambda x: F.xxhash64(x)).alias("hashes"), *more)
    both = F.concat(placed(windows("hashes")), *[placed(raw_windows("raw_hashes", k)) for k in sizes])
    both = F.filter(both, lambda w: _maybe(bits, w["h"])) if bits is not None else both
    return hashed.select(*keep, both.alias("w")).select(*keep, F.explode_outer("w").alias("w")).where("w is not null").select(*keep, "w.pos", "w.h")


def index(items: DataFrame) -> DataFrame:
    """(item_id, ipos, h, size, n, slots): windows of the items, how many each item has, and the fillers by offset.

    ``size`` is null for canonical windows, else the number of raw tokens.
    """
    raw = items.select("item_id", tokens(F.col("text")).alias("raw"))
    form = lambda names: raw.select("item_id", F.lit(names).alias("names"), "raw", canonical("raw", names).alias("canon"))
    keep = ["item_id", "names", "raw", "canon"]
    rows = _window_rows(form(True).unionAll(form(False)), keep).select("item_id", "names", F.col("pos").alias("ipos"), "h", *[F.slice(c, F.col("pos") + 1, WINDOW).alias(c) for c in ("raw", "canon")])
    slot = F.filter(F.transform("canon", lambda x, i: F.when(x.isin("#", "%", "@"), F.struct(i.alias("off"), F.concat(x, F.lower(F.ltrim(F.get(F.col("raw"), i), F.lit(MARK)))).alias("value")))), lambda s: s.isNotNull())
    kept = rows.select("item_id", "names", "ipos", "h", slot.alias("slots")).where(F.size("slots") <= WINDOW - MIN_WORDS)
    # raw tokens, where no window of the template has enough words
    words = raw.select("item_id", F.transform(plain_tokens("raw"), lambda x: F.xxhash64(x)).alias("raw_hashes"))
    exact = [words.where(F.size("raw_hashes") == k if k < WINDOW else F.size("raw_hashes") >= k).select("item_id", F.posexplode(raw_windows("raw_hashes", k)).alias("ipos", "h"), F.lit(k).alias("size")) for k in range(1, WINDOW + 1)]
    dense = reduce(DataFrame.unionAll, exact).join(kept.where("names").select("item_id", "ipos"), ["item_id", "ipos"], "left_anti")
    known = kept.select("item_id", "ipos", "h", F.lit(None).cast("int").alias("size"), "slots").unionAll(dense.withColumn("slots", F.slice(F.array(F.lit(None).cast(kept.schema["slots"].dataType.elementType)), 1, 0)).select("item_id", "ipos", "h", "size", "slots"))
    n = known.groupBy("item_id").agg(F.count_distinct("ipos").alias("n"))
    return known.distinct().join(n, "item_id").select("item_id", "ipos", "h", "size", "n", "slots")


def lengths(items: DataFrame) -> DataFrame:
    """(item_id, n_tokens, words): how many tokens each item has, and the places of those that are no placeholders."""
    canon = items.select("item_id", tokens(F.col("text")).alias("raw")).select("item_id", canonical("raw").alias("canon"))
    places = F.filter(F.transform("canon", lambda x, i: F.when(~x.isin("#", "%", "@"), i)), lambda i: i.isNotNull())
    whole = canon.groupBy("item_id").agg(F.max(F.struct(F.size("canon").alias("n_tokens"), places.alias("words"))).alias("item"))
    return whole.select("item_id", "item.n_tokens", "item.words")


def matches(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """(key, item_id, n_windows, n_matched, n_reset): for texts that hold items; ``n_reset`` windows had other fillers."""
    known = saved(index(items.select("item_id", "text")), "bench-windows")
    n_known = known.count()
    hint = F.broadcast if n_known <= BROADCAST_ROWS else lambda x: x
    sizes = sorted(r["size"] for r in known.where("size is not null").select("size").distinct().collect())
    texts = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("t"))
    canon = texts.select("key", tokens(F.col("t")).alias("raw")).select("key", "raw", canonical("raw").alias("canon"))
    hits = saved(_window_rows(canon, ["key"], sizes, bitmap(known.select("h"))).join(hint(known.select("h").distinct()), "h", "left_semi").distinct(), "bench-hits")
    met = hits.join(hint(known), "h").select("key", "item_id", "n", "ipos", "pos", (F.col("pos") - F.col("ipos")).alias("shift"), "slots")
    plain = met.where(F.size("slots") == 0).select("key", "item_id", "n", "ipos", F.lit(0).alias("reset"))
    # fillers: only for texts with a matched window that has some
    filled = met.where(F.size("slots") > 0)
    wanted = saved(filled.select("key").distinct(), "bench-filled")
    some = join_groups(texts.select("key", "t"), wanted, ["key"], "inner").groupBy("key").agg(F.first("t").alias("t")).select("key", tokens(F.col("t")).alias("raw"))
    pairs = filled.join(some, "key").select("key", "item_id", "n", "ipos", "shift", F.explode_outer("slots").alias("slot"), "raw", "pos")
    # windows along one alignment: shifts with no gap of over a window's length between them
    by_shift = Window.partitionBy("key", "item_id").orderBy("shift")
    apart = F.when(F.col("shift") - F.lag("shift").over(by_shift) <= WINDOW, 0).otherwise(1)
    runs = filled.select("key", "item_id", "shift").distinct().withColumn("apart", apart).select("key", "item_id", "shift", F.sum("apart").over(by_shift).alias("run"))
    pairs = pairs.join(runs, ["key", "item_id", "shift"])
    pairs = pairs.select("key", "item_id", "n", "ipos", "shift", "run", F.col("slot.value").alias("value"), F.lower(F.ltrim(F.get("raw", F.col("pos") + F.col("slot.off")), F.lit(MARK))).alias("filler"))
    along, back = Window.partitionBy("key", "item_id", "run", "value"), Window.partitionBy("key", "item_id", "run", "filler", F.col("value").startswith("@"))
    one = (F.min("filler").over(along) == F.max("filler").over(along)) & (~F.col("value").startswith("@") | (F.min("value").over(back) == F.max("value").over(back)))
    judged = pairs.select("*", one.alias("one"), (F.substr("value", F.lit(2)) == F.col("filler")).alias("equal"))
    by_window = judged.groupBy("key", "item_id", "n", "ipos", "shift").agg(F.min("one").alias("one"), F.min("equal").alias("equal"))
    refilled = by_window.where("one or equal").select("key", "item_id", "n", "ipos", F.when(F.col("equal"), 0).otherwise(1).alias("reset"))
    by_item = plain.unionAll(refilled).groupBy("key", "item_id", "n", "ipos").agg(F.min("reset").alias("reset"))
    summed = by_item.groupBy("key", "item_id", F.col("n").alias("n_windows")).agg(F.count(F.lit(1)).alias("n_matched"), F.sum("reset").alias("n_reset"), F.collect_list("ipos").alias("all"), F.collect_list(F.when(F.col("reset") == 0, F.col("ipos"))).alias("same"))
    held = summed.join(lengths(items), "item_id")
    tokens_at = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda i: F.sequence(i, F.least(i + WINDOW, F.col("n_tokens")) - 1))))
    held = held.select("*", tokens_at("all").alias("covered"), tokens_at("same").alias("equal"))
    n_words = F.size(F.array_union(F.array_intersect("covered", "words"), F.col("equal")))
    enough = (F.size("covered") >= MIN_SHARE * F.col("n_tokens")) & (n_words >= F.least(F.lit(WINDOW), F.greatest(F.size("words"), F.lit(1))))
    return held.where(enough | (F.col("n_matched") >= MIN_RUN)).select("key", "item_id", "n_windows", "n_matched", "n_reset")


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, n_reset) for each document and item it holds."""
    held = saved(matches(docs, items, text), "bench-held")
    named = packed(docs.where(F.col(text) != ""), column_or_null(docs, "doc_id", "long").alias("doc_id"), text_key(F.col(text)).alias("key")).select("doc_id", "key")
    return join_groups(named, held, ["key"], "inner").drop("key")


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no item, with the columns they came with."""
    held = saved(matches(docs, items, text).select("key").distinct(), "bench-held")
    return join_groups(packed(docs, text_key(F.col(text)).alias("key")), held, ["key"], "left_anti").select("row.*")
