"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at one side of a text and votes good, bad, or abstains. Expectation-maximisation over the counts of vote
patterns (3**rules at most) estimates, without any label, the share of good documents and each rule's two accuracies:
how often its votes on good documents are good, and on bad ones bad. An abstention says nothing. A document is kept if
the posterior probability that it is good reaches ``THRESHOLD``, so one rule may be overruled by the others; whatever
odds are learned stand, none is clamped. The prior is worth ``PRIOR`` of the documents for each rule: nine of ten votes on
good documents right, and half of those on bad ones. The base rules of the contract reject on their own.

Defined results: a null text has no words, fails the base rules and isn't kept; a text without words has zeros
throughout; null and repeated doc_ids are kept, one row out for each row in; an empty table gives an empty one; other
columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import SPACES, WORD_SPLIT, stage

WINDOW = 8
THRESHOLD = 0.5
SYMBOLS, ENDS = "#*$%&|<>", ".!?"
MARKS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PLAIN = "^\\p{L}+(?:['\u2019-]\\p{L}+)*[.,;:!?]*$"
#: The prior's weight, as a share of the documents, and its votes that are right on good and on bad documents.
PRIOR, PRIOR_GOOD, PRIOR_BAD = 0.05, 0.9, 0.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(at: Column, window: int) -> Column:
    """Words that windows starting at the ascending positions cover."""
    gaps = F.zip_with(F.slice(at, 2, F.size(at) - 1), F.slice(at, 1, F.size(at) - 1), lambda b, a: F.least(b - a, F.lit(window)))
    return F.lit(window) + F.aggregate(gaps, F.lit(0), lambda s, x: s + x)


def _repeated_words(hashes: Column, window: int) -> Column:
    """hashes of the words -> words within windows that occur twice or more in the text."""

    def by_rank(ranked: Column) -> Column:
        n = F.size(ranked)
        same = F.zip_with(F.slice(ranked, 2, n - 1), F.slice(ranked, 1, n - 1), lambda b, a: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return let(F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))), lambda at: _covered(at, window))

    def by_window(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ranked, by_rank))

    windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (window - 1)), lambda i: F.xxhash64(F.slice(hashes, i, window)))
    return F.when(F.size(hashes) <= window, F.lit(0)).otherwise(let(windows, by_window))


def statistics(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and for the rules n_lines, n_upper, n_ends,
    n_marks, n_distinct, n_plain."""
    text = F.coalesce(F.col("text"), F.lit(""))
    solid = F.translate(F.col("_text"), SPACES, "")
    words = F.filter(F.split("_text", WORD_SPLIT), lambda w: w != "")
    lines = F.filter(F.split("_text", "\n"), lambda x: F.translate(x, SPACES, "") != "")

    def of_words(hashes: Column) -> Column:
        return F.struct(F.size(hashes).cast("long").alias("n_words"), F.size(F.array_distinct(hashes)).cast("long").alias("n_distinct"), _repeated_words(hashes, window).cast("long").alias("n_repeat_words"))

    by_words = let(words, lambda x: F.struct(let(F.transform(x, lambda w: F.xxhash64(w)), of_words).alias("h"), F.size(F.filter(x, lambda w: w.rlike(PLAIN))).cast("long").alias("n_plain")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    count = lambda marks: (F.length("_text") - F.length(F.translate(F.col("_text"), marks, ""))).cast("long")
    counts = {"n_symbols": SYMBOLS, "n_upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "n_ends": ENDS, "n_marks": MARKS}
    return (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"))
        .select("doc_id", by_words.alias("w"), by_lines.alias("l"), F.length(solid).cast("long").alias("word_chars"), *[count(v).alias(k) for k, v in counts.items()])
        .select("doc_id", "w.h.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.h.n_repeat_words", "l.n_lines", "n_upper", "n_ends", "n_marks", "w.h.n_distinct", "w.n_plain")
    )


def votes() -> dict[str, Column]:
    """Rules over the statistics: 1 good, -1 bad, 0 abstains, as where a text is too short to tell."""
    words, chars, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    of = lambda name, whole: F.col(name) / whole
    mean, lengths, variety, ends = of("word_chars", words), F.col("n_words"), F.col("n_distinct") / F.sqrt(words), of("n_ends", words)
    rules = {  # enough to tell, good, bad
        "word_length": (lengths >= 20, mean.between(4, 6.2), (mean < 3) | (mean > 7)),
        "symbols": (lengths >= 1, of("n_symbols", words) <= 0.005, of("n_symbols", words) >= 0.05),
        "upper": (lengths >= 20, of("n_upper", chars) <= 0.08, of("n_upper", chars) >= 0.2),
        "lines": (F.col("n_lines") >= 3, of("n_dup_lines", lines) <= 0.05, of("n_dup_lines", lines) >= 0.3),
        "repeats": (lengths >= 50, of("n_repeat_words", words) <= 0.02, of("n_repeat_words", words) >= 0.2),
        "variety": (lengths >= 50, variety >= 5, variety < 2.5),
        "sentences": (lengths >= 20, ends.between(0.02, 0.3), (ends >= 0.5) | (F.col("n_ends") == 0)),
        "plain_words": (lengths >= 1, of("n_plain", words) >= 0.8, of("n_plain", words) < 0.6),
        "marks": (lengths >= 1, of("n_marks", chars) <= 0.08, of("n_marks", chars) >= 0.15),
    }
    return {k: F.when(enough & good, 1).when(enough & bad, -1).otherwise(0) for k, (enough, good, bad) in rules.items()}


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, prior: float = PRIOR) -> tuple[float, list[dict[int, float]]]:
    """Share of good documents and, for each rule, the log odds for "good" of each of its votes, from (votes, documents)
    by expectation-maximisation. It sets out from: the more good votes outnumber bad ones, the likelier good."""
    if not patterns:
        return 0.5, []
    rules, total = range(len(patterns[0][0])), sum(n for _, n in patterns)
    weight = prior * total
    good = [1 / (1 + math.exp(-sum(p))) for p, _ in patterns]
    for _ in range(rounds):
        share = (sum(g * n for g, (_, n) in zip(good, patterns)) + weight) / (total + 2 * weight)
        odds = []
        for j in rules:
            mass = {(c, v): sum((g if c > 0 else 1 - g) * n for g, (p, n) in zip(good, patterns) if p[j] == v) for c in (1, -1) for v in (1, -1)}
            right = (mass[1, 1] + PRIOR_GOOD * weight) / (mass[1, 1] + mass[1, -1] + weight)
            caught = (mass[-1, -1] + PRIOR_BAD * weight) / (mass[-1, 1] + mass[-1, -1] + weight)
            odds.append({1: math.log(right / (1 - caught)), 0: 0.0, -1: math.log((1 - right) / caught)})
        good = [posterior(p, share, odds) for p, _ in patterns]
    return share, odds


def posterior(pattern: tuple[int, ...], share: float, odds: list[dict[int, float]]) -> float:
    """Probability that a document with these votes is good."""
    x = math.log(share / (1 - share)) + sum(o[v] for v, o in zip(pattern, odds))
    return 1 / (1 + math.exp(-min(max(x, -700), 700)))


def judged(stats: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Statistics with base_failed, posterior and kept; stats should be a staged table, as it is read twice."""
    rules = votes()
    names = list(rules)
    cast = stats.withColumns({f"_{k}": v for k, v in rules.items()})
    counted = cast.groupBy(*[f"_{k}" for k in names]).agg(F.count(F.lit(1)).alias("_n")).collect()  # 3**rules rows at most
    patterns = sorted((tuple(r[f"_{k}"] for k in names), r["_n"]) for r in counted)
    share, weights = fit(patterns)
    odds = F.lit(math.log(share / (1 - share)))
    for k, w in zip(names, weights):
        odds = odds + F.when(F.col(f"_{k}") > 0, w[1]).when(F.col(f"_{k}") < 0, w[-1]).otherwise(w[0])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = cast.withColumns({"base_failed": failed, "posterior": 1 / (1 + F.exp(-odds))}).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    return scored.drop(*[f"_{k}" for k in names])


def op3_weak_supervision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, _ = stage(statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")), "op3-stats")
    return judged(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
