"""Secret scans behind a trigram index.

From each rule's pattern follows a Boolean query: trigrams that any match must contain, with AND along the
pattern and OR over its alternatives (as clauses of ANDed trigrams; small character classes count as alternatives).  The
trigrams that some rule asks for are looked up in every whole text and give postings (trigram, text); postings of a
clause are intersected by counting them per text.  Texts that meet a clause of a rule are its candidates, and only these
are read again and matched.  A rule without mandatory trigrams runs over all texts, in the pass that makes the postings.

Texts are named by a 128-bit hash, so copies share their postings.  Spans count code points.

Defined results: null text is empty and has no spans; overlapping spans of different kinds all count, those that
start at one place in order of the rules; repeated rows get equal results; very long texts are searched whole, in time
proportional to the text and its matches; other columns pass through, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_groups, let, packed, saved, text_key


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` (0: all) has at least ``least`` characters; ``fold``: letters in either case."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.fold else "") + self.pattern


#: The base rules, in their order.  The last one asks for a whole run of 16 or more.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Public formats of issued credentials.
ISSUED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("api_key", r"AIza[0-9A-Za-z_-]{35}"),
)
RULES = BASE + ISSUED

Clauses = frozenset[frozenset[str]]
ANY: Clauses = frozenset([frozenset()])
#: Clauses of a query, texts of a run that are told apart, and characters of a class that counts as alternatives.
MOST_CLAUSES, MOST_TEXTS, MOST_CHARACTERS = 64, 64, 8
#: Matches whose places are summed up one by one; more are summed by parts.
PART = 256

Node = tuple  # ("one of", characters or None for many) or ("group", alternatives); alternatives are lists of (node, least, most)


class _Pattern:
    """A parser for patterns of literals, classes, groups, alternatives and greedy repeats."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def alternatives(self) -> list[list[tuple]]:
        out: list[list[tuple]] = [[]]
        while self.at < len(self.text) and self.text[self.at] != ")":
            if self.text[self.at] == "|":
                self.at += 1
                out.append([])
            else:
                node = self.node()
                out[-1].append((node, *self.repeat()))
        return out

    def node(self) -> Node:
        c = self.text[self.at]
        if c == "(":
            self.at += 1
            if self.text.startswith("?:", self.at):
                self.at += 2
            inner = self.alternatives()
            self.at += 1
            return "group", inner
        if c == "[":
            return "one of", self.characters()
        if c == ".":
            self.at += 1
            return "one of", None
        return "one of", self.character()

    def character(self) -> frozenset[str] | None:
        """A literal or an escaped one; None for classes such as those of digits."""
        c = self.text[self.at]
        self.at += 1
        if c != "\\":
            return frozenset(c)
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return frozenset(chr(int(self.text[self.at - 2 : self.at], 16)))
        return None if c.isalnum() else frozenset(c)

    def characters(self) -> frozenset[str] | None:
        self.at += 1
        negated, out, some = self.text[self.at] == "^", set(), False
        while self.text[self.at] != "]":
            one = self.character()
            some |= one is None
            if one and self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                last = self.character() or one
                one = frozenset(map(chr, range(ord(min(one)), ord(min(last)) + 1)))
            out |= one or set()
        self.at += 1
        return None if negated or some else frozenset(out)

    def repeat(self) -> tuple[int, int | None]:
        c = self.text[self.at : self.at + 1]
        if c and c in "?*+":
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c == "{":
            end = self.text.index("}", self.at)
            least, comma, most = self.text[self.at + 1 : end].partition(",")
            self.at = end + 1
            return int(least), (int(most) if most else None) if comma else int(least)
        return 1, 1


def _both(a: Clauses, b: Clauses) -> Clauses:
    out = frozenset(x | y for x, y in product(a, b))
    return out if len(out) <= MOST_CLAUSES else a


def _trigrams(texts: set[str]) -> Clauses:
    """A clause for each text of a run."""
    return frozenset(frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts)


def _query(alternatives: list[list[tuple]]) -> tuple[Clauses, set[str] | None]:
    """Clauses that any match meets, and the texts that match if they are few."""
    clauses, texts = [], set()
    for sequence in alternatives:
        query, run, whole = ANY, {""}, True
        for (kind, inner), least, most in sequence:
            if kind == "group":
                needed, found = _query(inner)
            else:
                needed, found = ANY, {c.lower() for c in inner} if inner and len(inner) <= MOST_CHARACTERS else None
            exact = found is not None and most is not None and len(found) ** most <= MOST_TEXTS
            if exact:
                found = {"".join(p) for n in range(least, most + 1) for p in product(sorted(found), repeat=n)}
                if len(run) * len(found) <= MOST_TEXTS:
                    run = {x + y for x in run for y in found}
                    continue
            query, whole = _both(query, _trigrams(run)), False
            if not exact:
                query = _both(query, needed if least else ANY)
            run = found if exact else {""}
        query = _both(query, _trigrams(run))
        clauses.append(query)
        texts = texts | run if whole and texts is not None else None
    return frozenset().union(*clauses), texts if texts and len(texts) <= MOST_TEXTS else None


def trigram_query(pattern: str) -> Clauses:
    """OR of ANDs of lower-case trigrams; ``ANY`` if some match may have none."""
    query, _ = _query(_Pattern(pattern).alternatives())
    if frozenset() in query:
        return ANY
    return frozenset(c for c in query if not any(d < c for d in query))


class Index:
    """The trigrams that rules ask for, and the rules that have none."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        queries = [trigram_query(r.pattern) for r in rules]
        self.free = [i for i, q in enumerate(queries) if q == ANY]
        asked = [(i, q) for i, q in enumerate(queries) if q != ANY]
        self.trigrams = sorted({t for _, q in asked for c in q for t in c})
        self.terms = [(i, k, len(c), self.trigrams.index(t)) for i, q in asked for k, c in enumerate(sorted(q, key=sorted)) for t in sorted(c)]

    def hits(self, text: Column) -> Column:
        """The numbers of the trigrams that a text contains, in lower case."""
        found = lambda low: F.filter(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(i)) for i, t in enumerate(self.trigrams)]), lambda x: x.isNotNull())
        return let(F.lower(text), found) if self.trigrams else F.array().cast("array<int>")

    def candidates(self, postings: DataFrame) -> DataFrame:
        """(key, rules) from postings (key, tri): for each text, the numbers of the rules of which it meets a clause."""
        asked = postings.sparkSession.createDataFrame(self.terms, "rule int, clause int, terms int, tri int")  # as many rows as the rules' trigrams
        hits = postings.join(F.broadcast(asked), "tri")
        met = hits.groupBy("key", "rule", "clause", "terms").agg(F.count_distinct("tri").alias("n")).where(F.col("n") == F.col("terms"))
        return met.groupBy("key").agg(F.collect_set("rule").alias("rules"))


SPANS = "array<struct<start:int,o:int,end:int>>"


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule's matches, leftmost first and not overlapping, from the matches and the gaps between them."""
    pattern = F.lit(rule.java)
    of = lambda group: F.regexp_extract_all(text, pattern, F.lit(group))
    zipped = F.arrays_zip(F.split(text, rule.java, -1).alias("gap"), of(0).alias("m"), *([of(rule.group).alias("g")] if rule.group else []))
    n = lambda x, name: F.length(x[name]).alias(name)
    pieces = F.transform(zipped, lambda x: F.struct(n(x, "gap"), n(x, "m"), F.length(x["g" if rule.group else "m"]).alias("g")))  # the last gap has no match after it
    none = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        one = F.struct(start.alias("start"), F.lit(order).alias("o"), (start + x["m"]).alias("end"))
        return F.struct((start + F.coalesce(x["m"], F.lit(0))).alias("pos"), F.when(x["g"] >= rule.least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def part(p: Column, acc: Column, i: Column) -> Column:
        done = F.aggregate(F.slice(p, i * PART + 1, F.lit(PART)), F.struct(acc["pos"].alias("pos"), none.alias("out")), step)
        return let(done, lambda r: F.struct(r["pos"].alias("pos"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    parts = lambda p: F.sequence(F.lit(0), F.floor((F.size(p) - 1) / PART).cast("int"))
    return let(pieces, lambda p: F.aggregate(parts(p), F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPANS}>").alias("out")), lambda acc, i: part(p, acc, i), lambda acc: F.flatten(acc["out"])))


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns named by ``carry``, all by default) and ``found``: all spans as structs (start, o: number of the rule, end), in order of start, then rule."""
    index = Index(rules)
    t = F.coalesce(F.col(text), F.lit(""))
    texts = packed(docs, t.alias("t"), text_key(F.col(text)).alias("key"))
    if carry is not None:
        texts = texts.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in carry]))
    matched = lambda i: F.when(F.col("t").rlike(rules[i].java), spans_of(F.col("t"), rules[i], i)).otherwise(F.array().cast(SPANS))
    free = F.concat(F.array().cast(SPANS), *[matched(i) for i in index.free]).alias("free")
    # one pass over all texts; rows are kept with it where they are narrow
    kept = ["row"] if carry is not None else []
    seen = saved(texts.select(*kept, "key", index.hits(F.col("t")).alias("hits"), free), "secret-index")
    met = saved(index.candidates(seen.select("key", F.explode("hits").alias("tri"))), "secret-candidates")
    # where texts are shuffled to their candidates' names, only those with postings are
    asked = texts if met.count() <= BROADCAST_ROWS else texts.where(F.size(index.hits(F.col("t"))) > 0)
    each = [F.when(F.array_contains("rules", i), spans_of(F.col("t"), r, i)).otherwise(F.array().cast(SPANS)) for i, r in enumerate(rules) if i not in index.free]
    candidates = join_groups(asked, met, ["key"], "inner").select("row", F.concat(free, *each).alias("found"))
    rest = join_groups(seen if kept else texts.select("row", "key", free), met, ["key"], "left_anti").select("row", F.col("free").alias("found"))
    return candidates.unionAll(rest).select("row", F.sort_array("found").alias("found"))


def joined_spans(found: Column, rules: tuple[Rule, ...], first: int | None = None) -> Column:
    """kind:start:end of the spans (of the first rules only, if asked for), joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    some = F.filter(found, lambda x: x["o"] < first) if first is not None else found
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", F.get(names, x["o"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(found: Column, order: int) -> Column:
    return F.size(F.filter(found, lambda x: x["o"] == order)).cast("long")
