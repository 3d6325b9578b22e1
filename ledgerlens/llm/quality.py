"""Operator 10: quality rules by weak supervision, in DataFrame functions only.

Rules vote good (1), bad (-1) or abstain (0) on every document. Expectation-maximisation over
the counts of vote patterns (3 to the power of the number of rules at most, whatever the size of
the corpus) estimates each rule's accuracy, and a document is kept for its posterior probability
of being good instead of for passing all rules.

Defined results: a null or empty text has no words, all counts are 0 and base_failed is true;
each row is judged by itself, repeated rows and null doc_ids included; further columns are not
looked at. On an empty table the estimates stay at their start and no row comes back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import SPACES, cut, words

#: Fixed by the contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20

RULES = ("word_length", "symbols", "marked_words", "dup_lines", "repeats", "length")
ROUNDS = 25
#: What is believed before the votes are seen: most documents are good; a good one seldom gets a bad vote, and a bad
#: one has one defect or two and passes most rules. Vote: (probability in good documents, in bad documents).
PRIOR = 0.8
BELIEF = {1: (0.95, 0.75), -1: (0.005, 0.2), 0: (0.045, 0.05)}
#: The weight of that belief in the estimates, as a share of the corpus. Without it a defect that only
#: one rule sees counts as that rule's error, since no other rule ever agrees with it.
STRENGTH = 0.5


def _let(value: Column, then) -> Column:
    """then(value), with value computed once a row although then() names it often."""
    return F.element_at(F.transform(F.array(value), then), 1)


def repeat_words(found: Column, n: int = WINDOW) -> Column:
    """Words in windows of n that occur twice or more; a window is known by 64-bit hashes of its words."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            twice = F.filter(p, lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        gaps = lambda s: F.transform(s, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(s, i + 1) - x, F.lit(n))))
        return F.aggregate(_let(_let(pairs, starts), gaps), F.lit(0), lambda a, x: a + x)

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))

    hashed = F.transform(found, lambda x: F.xxhash64(x))
    return F.when(F.size(found) <= n, F.lit(0)).otherwise(_let(_let(hashed, windows), count)).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the five counts of the contract."""
    text = F.coalesce("text", F.lit(""))
    spaces = " \t\n\x0b\f\r"
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, spaces, "")) > 0)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), words(F.col("text")).alias("found"))
    return base.select(
        "doc_id",
        F.size("found").cast("long").alias("n_words"),
        F.length(F.translate("text", spaces, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(F.length("text") == F.length(F.translate("text", SYMBOLS, "")), 0).otherwise(F.size(F.filter("found", lambda x: F.translate(x, SYMBOLS, "") != x))).cast("long").alias("n_marked_words"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, spaces, "")) > 0)).cast("long").alias("n_lines"),
        repeat_words(F.col("found")).alias("n_repeat_words"),
    )


def votes() -> dict[str, Column]:
    """Each rule's vote from the counts; between its two bounds a rule abstains."""

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    n, some = F.col("n_words"), F.col("n_words") > 0
    mean = F.when(some, F.col("word_chars") / n)
    symbols = F.when(F.col("word_chars") > 0, F.col("n_symbols") / F.col("word_chars"))
    marked = F.when(some, F.col("n_marked_words") / n)
    dup = F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines"))
    repeats = F.when(some, F.col("n_repeat_words") / n)
    return {
        "word_length": vote(mean.between(3, 10), (mean < 2) | (mean > 14)),
        "symbols": vote(symbols < 0.01, symbols > 0.1),
        "marked_words": vote(marked < 0.05, marked > 0.2),
        "dup_lines": vote(dup <= 0.05, dup > 0.3),
        "repeats": vote(repeats <= 0.02, repeats > 0.2),
        "length": vote(n >= 50, n < 10),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, dict[int, list[tuple[float, float]]]]:
    """EM over (votes, count): the share of good documents, and for each rule and vote its probability in good and in bad documents."""
    m = len(RULES)
    prior = PRIOR
    prob = {r: dict(BELIEF) for r in range(m)}
    for _ in range(rounds):
        good = total = 0.0
        sums = {r: {v: [0.0, 0.0] for v in BELIEF} for r in range(m)}
        for pattern, count in patterns:
            p = posterior(pattern, prior, prob)
            good += p * count
            total += count
            for r, v in enumerate(pattern):
                sums[r][v][0] += p * count
                sums[r][v][1] += (1 - p) * count
        if not total:
            break
        extra = STRENGTH * total
        prior = (good + extra * PRIOR) / (total + extra)
        for r in range(m):
            for v, belief in BELIEF.items():
                prob[r][v] = ((sums[r][v][0] + extra * belief[0]) / (good + extra), (sums[r][v][1] + extra * belief[1]) / (total - good + extra))
    return prior, prob


def posterior(pattern, prior: float, prob) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(prob[r][v][0] / prob[r][v][1]) for r, v in enumerate(pattern) if v)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def quality(spark: SparkSession, docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, posterior and kept."""
    counts = cut(spark, features(docs), "quality")
    voted = votes()
    found = counts.groupBy(*[c.alias(r) for r, c in voted.items()]).count().collect()
    prior, prob = fit(sorted((tuple(row[r] for r in RULES), row["count"]) for row in found))
    odds = F.lit(math.log(prior / (1 - prior)))
    for r, name in enumerate(RULES):
        weight = {v: math.log(prob[r][v][0] / prob[r][v][1]) for v in (1, -1)}
        odds = odds + F.when(voted[name] == 1, weight[1]).when(voted[name] == -1, weight[-1]).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (1 / (1 + F.exp(-odds))).alias("posterior")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep))
