"""Quality rules combined by weak supervision.

Every rule votes good (1), bad (-1) or abstains (0).  How reliable each rule is comes from the corpus
itself: expectation-maximisation over the table of vote patterns estimates, for each rule, the chance of
each vote given a good and given a bad document.  A document stays if its posterior of being good is at
least one half.  Two hard base rules come first.

The pattern table has at most 3^rules rows whatever the corpus, so only that goes to the driver.  All
features are built-in column expressions over the whole text.

Defined results: null or empty text has zero words and fails the base rule; ties of the posterior at exactly
one half stay; repeated rows get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, packed, saved, word_array

#: Frequent short function words of four languages, as votes for running prose.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "was", "it", "on", "are", "as", "be", "this", "an", "at", "by"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "est", "que", "qui", "dans", "pour", "par", "au", "sur"],
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine"],
    "es": ["el", "la", "los", "las", "de", "y", "en", "que", "un", "una", "es", "por", "con", "para", "se", "del", "al", "su"],
}

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


#: Up to so many distinct repeated windows, a window is looked up in their list; beyond, windows are sorted with
#: their positions. Both give the same counts; the list is cheaper for the many texts with few repeats.
FEW = 24


def matches(text: Column, pattern: str) -> Column:
    """How often a pattern of one character occurs."""
    return (F.size(F.split(text, pattern, -1)) - 1).cast("long")


def _covered(positions: Column) -> Column:
    """Words under three-word windows that start at the given ascending positions."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("words"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["words"] + F.least(F.lit(3), p - acc["last"])).cast("long").alias("words"))
    return F.aggregate(positions, start, step, lambda acc: acc["words"])


def _repeat_words(h: str) -> Column:
    """From the 64-bit hashes of a text's three-word windows in order, how many words lie in repeated ones."""
    hashes = F.col(h)
    twice = let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))
    few = lambda d: _covered(F.filter(F.transform(hashes, lambda x, i: F.when(F.array_contains(d, x), i)), lambda p: p.isNotNull()))
    placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    again = lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"]))
    many = let(placed, lambda s: _covered(F.sort_array(F.transform(again(s), lambda x: x["p"]))))
    zero = F.lit(0).cast("long")
    return F.coalesce(let(twice, lambda d: F.when(F.size(d) == 0, zero).when(F.size(d) <= FEW, few(d)).otherwise(many)), zero)


def base_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` and the counts of the base rules, all of whole texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    known = sorted({w for ws in FUNCTION_WORDS.values() for w in ws})
    words = packed(docs, t.alias("t"), word_array(F.col(text)).alias("w"), lines.alias("lines"))
    n = F.size("w")
    window = lambda i: F.xxhash64(F.get("w", i - 1), F.get("w", i), F.get("w", i + 1))
    counted = words.select(
        "row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        matches(F.col("t"), "[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        matches(F.col("t"), "[A-Z]").alias("n_upper"),
        (F.length("t") - F.length(F.replace(F.col("t"), F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(known))).cast("long").alias("n_function"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), window)).alias("h"),
    )
    return counted.select(*[c for c in counted.columns if c != "h"], _repeat_words("h").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A ratio with a good side and a bad side; between them the rule abstains."""

    name: str
    top: str
    bottom: str
    good: float
    bad: float

    def vote(self) -> Column:
        ratio = F.try_divide(F.col(self.top).cast("double"), F.col(self.bottom).cast("double"))
        low_is_good = self.good < self.bad
        good = ratio <= self.good if low_is_good else ratio >= self.good
        bad = ratio >= self.bad if low_is_good else ratio <= self.bad
        return F.when(good, 1).when(bad, -1).otherwise(0).cast("int")


RULES = (
    Rule("few_symbols", "n_symbols", "n_words", 0.05, 0.25),
    Rule("few_capitals", "n_upper", "word_chars", 0.15, 0.40),
    Rule("few_shouts", "n_shouts", "n_words", 0.05, 0.30),
    Rule("few_repeats", "n_repeat_words", "n_words", 0.10, 0.45),
    Rule("few_equal_lines", "n_dup_lines", "n_lines", 0.05, 0.50),
    Rule("function_words", "n_function", "n_words", 0.10, 0.01),
    Rule("word_length", "word_chars", "n_words", 9.0, 14.0),
)


@dataclass
class VoteModel:
    """Chances of each vote given a good (1) and a bad (0) document, and the share of good ones."""

    prior: float
    chances: list[dict[int, dict[int, float]]]  # rule -> class -> vote -> chance

    def log_odds(self, votes: list[int]) -> float:
        z = math.log(self.prior / (1 - self.prior))
        for rule, v in zip(self.chances, votes, strict=True):
            z += math.log(rule[1][v] / rule[0][v])
        return z


#: Where the estimates start: junk comes in kinds, and each kind trips few rules, so a bad vote says much
#: and a good one little.
START = {1: {1: 0.90, 0: 0.095, -1: 0.005}, 0: {1: 0.60, 0: 0.10, -1: 0.30}}


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, prior: float = 0.8, weight: float = 0.02) -> VoteModel:
    """Expectation-maximisation over (votes, how many documents) rows; the order of the rows doesn't matter.

    Prior evidence of ``weight`` times as many documents as there are, and of ten more, voting as ``START``
    says, holds each estimate: rules that never vote stay neutral and the classes can't swap.
    """
    patterns = sorted((tuple(v), n) for v, n in patterns)
    k = len(patterns[0][0]) if patterns else len(RULES)
    begin, weight = START, 10 + weight * sum(n for _, n in patterns)
    model = VoteModel(prior, [{c: dict(p) for c, p in begin.items()} for _ in range(k)])
    total = sum(n for _, n in patterns)
    for _ in range(rounds if patterns else 0):
        mass = [{c: {v: weight * begin[c][v] for v in (1, 0, -1)} for c in (1, 0)} for _ in range(k)]
        good = weight * prior
        for votes, n in patterns:
            z = model.log_odds(list(votes))
            p = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
            good += n * p
            for j, v in enumerate(votes):
                mass[j][1][v] += n * p
                mass[j][0][v] += n * (1 - p)
        chances = [{c: {v: m / sum(votes.values()) for v, m in votes.items()} for c, votes in rule.items()} for rule in mass]
        model = VoteModel(good / (total + weight), chances)
    return model


def posterior(model: VoteModel, rules: tuple[Rule, ...] = RULES) -> Column:
    """Chance of being good, from the vote columns ``v0``, ``v1``, ..."""
    z = F.lit(math.log(model.prior / (1 - model.prior)))
    for j, _ in enumerate(rules):
        odds = {v: math.log(model.chances[j][1][v] / model.chances[j][0][v]) for v in (1, 0, -1)}
        z = z + F.when(F.col(f"v{j}") == 1, odds[1]).when(F.col(f"v{j}") == -1, odds[-1]).otherwise(odds[0])
    return 1 / (1 + F.exp(-z))


def score(docs: DataFrame, text: str = "text", carry: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row`` (the columns named by ``carry``, all by default), base counts, ``base_failed``, ``posterior``, ``kept``.

    Texts are read and counted once; the counts go through a table in the shared folder, from which the vote
    patterns are summed and the verdicts made.
    """
    stats = base_stats(docs, text)
    if carry is not None:
        stats = stats.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in carry]))
    votes = [r.vote().alias(f"v{j}") for j, r in enumerate(rules)]
    counted = saved(stats.select("*", base_failed().alias("base_failed"), *votes), "quality")
    names = [f"v{j}" for j, _ in enumerate(rules)]
    patterns = counted.groupBy(*names).count().collect()  # at most 3^rules rows
    model = fit_votes([(tuple(r[n] for n in names), r["count"]) for r in patterns])
    chance = posterior(model, rules)
    return counted.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", chance.alias("posterior"), (~F.col("base_failed") & (chance >= 0.5)).alias("kept")
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return score(docs, text).where("kept").select("row.*")
