"""Quality rules under weak supervision, with DataFrame functions only.

Each rule looks at one statistic of a text and votes that it is bad, votes that it is good, or abstains. Most rules look for one fault, and
that a text lacks this fault says little, so they vote bad or abstain. Rules are not equally reliable and disagree, so no rule decides alone:
expectation-maximisation over the counts of vote patterns (3 ** number of rules at most) estimates how often each rule votes rightly, wrongly
and not at all on good and on bad texts, and a text is kept if its posterior probability of being good is high enough. Texts that fail the
base rules are decided already and are left out of the estimates.

A text's statistics come from its own row: there is no shuffle but that of the vote patterns.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgraph.llm.common import checkpointed

#: White space of the base rules, as a character class and as characters.
SPACE, SPACE_SIGNS = r"\x20\x09-\x0D", " \t\n\x0b\x0c\r"
SYMBOL = "[#*$%&|<>]"
WINDOW, MIN_WORDS, MAX_REPEATED_PERCENT = 5, 10, 20
ROUNDS, FIRST_GOOD_SHARE, KEEP_AT, DIGITS = 25, 0.9, 0.5, 4
GOOD, BAD, NONE = 1, 2, 0
#: Expected shares of bad and of good votes, on good and on bad texts, which count as so many texts: before any text is seen a rule finds one fault in five, and seldom errs.
ON_GOOD, ON_BAD, WEIGHT = {BAD: 0.01, GOOD: 0.6}, {BAD: 0.2, GOOD: 0.3}, 10.0


@dataclass(frozen=True)
class Rule:
    """Votes bad where the share of ``part`` in ``of`` is outside ``fair``, good where it is in ``good`` (ends included), and abstains elsewhere or where ``of`` is under ``least``."""

    name: str
    part: str
    of: str
    fair: tuple[float, float]
    good: tuple[float, float] | None = None
    least: int = 1

    @property
    def share(self) -> str:
        return f"CASE WHEN {self.of} >= {self.least} THEN CAST({self.part} AS DOUBLE) / {self.of} END"

    def expected(self, shares: dict[int, float]) -> dict[int, float]:
        found = {BAD: shares[BAD], GOOD: shares[GOOD] if self.good else 0.0}
        return found | {NONE: 1 - sum(found.values())}


RULES = (
    Rule("symbols", "n_symbols", "n_words", (0, 0.1)),
    Rule("symbol_characters", "n_symbols", "word_chars", (0, 0.03)),
    Rule("symbol_lines", "n_symbol_lines", "n_lines", (0, 0.4)),
    Rule("capitals", "n_upper", "word_chars", (0, 0.3)),
    Rule("exclamations", "n_exclamations", "n_words", (0, 0.2)),
    Rule("line_ends", "n_ended_lines", "n_lines", (0.3, 1), (0.8, 1)),
    Rule("variety", "n_distinct_words", "n_words", (0.2, 1), (0.5, 1)),
    Rule("repeats", "n_repeat_words", "n_words", (0, 0.15)),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", (0, 0.35), least=4),
    Rule("word_length", "word_chars", "n_words", (2, 13)),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though it is used in lambdas for every element of an array."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more. Equal windows have equal hashes, so where all hashes differ none is found again; elsewhere windows are ordered by hash, and neighbours are compared word by word."""
    n = F.size(words) - (window - 1)
    starts = F.sequence(F.lit(0), n - 1)
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(window))))

    def covered(places: Column) -> Column:
        return total(F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - p, F.lit(window))).cast("long")))

    def compared(h: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return (x["h"] == y["h"]) & (F.slice(words, x["i"] + 1, window) == F.slice(words, y["i"] + 1, window))

        def again(ordered: Column) -> Column:
            found = F.filter(ordered, lambda s, k: F.coalesce(same(s, F.get(ordered, k - 1)), F.lit(False)) | F.coalesce(same(s, F.get(ordered, k + 1)), F.lit(False)))
            return let(F.sort_array(F.transform(found, lambda s: s["i"])), covered)

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), again)

    return F.when(n < 2, 0).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(compared(h)))).cast("long")


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of counts for each row of ``docs``; a null text is an empty one."""
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(SPACE_SIGNS))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"), repeated_words(words).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        ended = F.filter(lines, lambda x: F.right(F.btrim(x, F.lit(SPACE_SIGNS)), F.lit(1)).isin(".", "!", "?"))
        marked = F.filter(lines, lambda x: F.regexp_like(x, F.lit(f"({SYMBOL}[^#*$%&|<>]*){{3}}")))
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(ended).cast("long").alias("n_ended_lines"), F.size(marked).cast("long").alias("n_symbol_lines"),
        )

    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACE_SIGNS)) != "")
    rows = docs.select(
        F.col(key).alias("doc_id"), let(words, of_words).alias("w"), let(lines, of_lines).alias("l"), F.regexp_count(body, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"), (F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
    )
    return rows.select("doc_id", "w.*", "l.*", "n_symbols", "n_upper", "n_exclamations")


def votes(rule: Rule) -> Column:
    """GOOD, BAD or NONE; a share of nothing (no words, no lines) is null and abstains."""
    x = F.expr(rule.share)
    bad = F.when((x < rule.fair[0]) | (x > rule.fair[1]), BAD)
    return (bad.when(x.between(*rule.good), GOOD) if rule.good else bad).otherwise(NONE)


@dataclass
class Reliability:
    """The share of good texts, and each rule's shares of votes (by vote) on good and on bad texts."""

    good_share: float
    on_good: list[dict[int, float]]
    on_bad: list[dict[int, float]]

    def posterior(self) -> Column:
        """Probability that a row with columns v0, v1, ... of votes is good."""
        odds = F.lit(math.log((1 - self.good_share) / self.good_share))
        for j, (good, bad) in enumerate(zip(self.on_good, self.on_bad, strict=True)):
            of_vote = {v: F.lit(math.log(bad[v] / good[v])) for v in good if good[v] > 0 and bad[v] > 0}
            odds += F.when(F.col(f"v{j}") == BAD, of_vote[BAD]).when(F.col(f"v{j}") == GOOD, of_vote.get(GOOD, F.lit(0.0))).otherwise(of_vote[NONE])
        return 1 / (1 + F.exp(odds))


def estimated(patterns: DataFrame, rounds: int = ROUNDS) -> Reliability:
    """Expectation-maximisation over (v0, v1, ..., n): each round weighs the patterns by their posterior and counts the votes of either side anew. Only sums leave Spark."""
    first_good, first_bad = ([r.expected(shares) for r in RULES] for shares in (ON_GOOD, ON_BAD))
    found = Reliability(FIRST_GOOD_SHARE, first_good, first_bad)
    for _ in range(rounds):
        rows = patterns.withColumn("g", F.col("n") * found.posterior()).withColumn("b", F.col("n") - F.col("g"))
        of_votes = [F.sum(F.when(F.col(f"v{j}") == vote, F.col(side)).otherwise(0.0)).alias(f"{side}{j}_{vote}") for j in range(len(RULES)) for vote in (GOOD, BAD, NONE) for side in ("g", "b")]
        got = rows.agg(F.sum("g").alias("g"), F.sum("b").alias("b"), *of_votes).first().asDict()
        if not got["g"]:
            break

        def shares(side: str, first: list[dict[int, float]], got: dict = got) -> list[dict[int, float]]:
            return [{v: (got[f"{side}{j}_{v}"] + WEIGHT * x) / (got[side] + WEIGHT) for v, x in f.items()} for j, f in enumerate(first)]

        found = Reliability((got["g"] + FIRST_GOOD_SHARE) / (got["g"] + got["b"] + 1), shares("g", first_good), shares("b", first_bad))
    return found


def judge_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior) of every row.

    Null and empty texts have no words and fail the base rules. Repeated rows keep a row each and count each in the estimates; null ids are
    kept as they are. An empty table gives an empty one. Other columns are not read.
    """
    counted = statistics(docs, key, text).select("*", *(votes(r).alias(f"v{j}") for j, r in enumerate(RULES)))
    rows = checkpointed(counted.drop("n_upper", "n_exclamations", "n_ended_lines", "n_symbol_lines", "n_distinct_words", "n_lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    patterns = checkpointed(rows.where(~failed).groupBy(*(f"v{j}" for j in range(len(RULES)))).agg(F.count("*").alias("n")).coalesce(1))
    judged = rows.withColumn("posterior", F.round(estimated(patterns).posterior(), DIGITS)).withColumn("base_failed", failed)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("posterior") >= KEEP_AT)).alias("kept"), "posterior",
    )
