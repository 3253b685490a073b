"""Quality rules by weak supervision, with DataFrame functions only.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts of vote patterns
estimates, for either class, how often each rule casts each vote; the posterior probability of the
good class then replaces a demand that all rules pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, text_or_empty

#: rule -> (value, bad when, good when); a rule abstains in between.
RULES = {
    "symbols": ("100 * n_symbols / n_words", "> 10", "< 2"),
    "repeats": ("100 * n_repeat_words / n_words", "> 30", "< 10"),
    "lines": ("100 * n_dup_lines / n_lines", "> 40", "< 10"),
    "capitals": ("100 * n_upper / word_chars", "> 40", "< 15"),
    "word_length": ("word_chars / n_words", "not between 2 and 14", "between 3 and 11"),
    "letters": ("100 * n_other / word_chars", "> 30", "< 15"),
    "bars": ("100 * n_bars / n_words", "> 10", "< 1"),
    "marks": ("100 * n_marks / n_words", "> 20", "< 5"),
}


#: Separators of words, and characters that count as symbols.
SEPARATORS, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"


def _count(chars: str) -> Column:
    """How often the given characters occur in ``text``; plain replacing is far cheaper than a regex."""
    rest = F.col("text")
    for c in chars:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.char_length("text") - F.char_length(rest)).cast("long")


def _left(pattern: str) -> Column:
    """Characters of ``text`` outside the matches of ``pattern``."""
    return F.char_length(F.regexp_replace("text", pattern, "")).cast("long")


def window_hashes(words: Column) -> Column:
    """A 64-bit hash for each window of three words.

    Windows found at least twice come from sorting (hash, position) within the row; texts all of
    whose windows differ stop at the count of distinct hashes.
    """
    at = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts that the rules use, one row per input row."""
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    words = F.when(F.col("bare") != "", F.split("bare", r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    one = (
        base.withColumn("bare", F.trim("text", F.lit(SEPARATORS)))
        .withColumn("words", words)
        .withColumn("lines", lines)
        .withColumn("h", window_hashes(F.col("words")))
        .select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
            _count(SYMBOLS).alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.size("lines").cast("long").alias("n_lines"),
            _left(r"[\p{L}\x20\x09-\x0D]+").alias("n_other"),
            _left("[^A-Z]+").alias("n_upper"),
            _count("|").alias("n_bars"),
            _count("!").alias("n_marks"),
            F.when(F.size(F.array_distinct("h")) == F.size("h"), F.array().cast("array<bigint>")).otherwise(F.col("h")).alias("h"),
        )
        .withColumn("s", F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
        .withColumn(
            "hit",
            F.filter(
                F.transform("s", lambda v, k: F.when((F.get("s", k - 1)["x"] == v["x"]) | (F.get("s", k + 1)["x"] == v["x"]), v["i"])),
                lambda i: i.isNotNull(),
            ),
        )
        .withColumn("n_repeat_words", F.size(F.array_distinct(F.flatten(F.transform("hit", lambda i: F.array(i, i + 1, i + 2))))).cast("long"))
    )
    return one.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_other", "n_upper", "n_bars", "n_marks")


def vote(rule: str) -> Column:
    """1 good, -1 bad, 0 for an abstention (also where the rule's ratio is undefined)."""
    value, bad, good = RULES[rule]
    x = "try_divide(" + value.replace(" / ", ", ") + ")"
    return F.expr(f"case when {x} {bad} then -1 when {x} {good} then 1 else 0 end").cast("int")


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, smooth: float = 1.0) -> dict:
    """Expectation-maximisation over (votes, number of rows): prior and vote rates by class.

    The list has at most 3**rules entries, however many documents there are. Started from the view
    that a pattern is bad in proportion to the bad among its votes.
    """
    n_rules = len(patterns[0][0]) if patterns else 0
    good = [(1 + sum(v > 0 for v in p)) / (2 + sum(v > 0 for v in p) + 4 * sum(v < 0 for v in p) + (1e-9)) for p, _ in patterns]
    prior, rate = 0.5, {}
    for _ in range(rounds):
        total = sum(n for _, n in patterns) or 1
        mass = {1: sum(g * n for g, (_, n) in zip(good, patterns)), 0: sum((1 - g) * n for g, (_, n) in zip(good, patterns))}
        prior = min(max(mass[1] / total, 1e-6), 1 - 1e-6)
        rate = {(c, r, v): smooth for c in (0, 1) for r in range(n_rules) for v in (-1, 0, 1)}
        for g, (p, n) in zip(good, patterns):
            for r, v in enumerate(p):
                rate[1, r, v] += g * n
                rate[0, r, v] += (1 - g) * n
        rate = {k: x / (mass[k[0]] + 3 * smooth) for k, x in rate.items()}
        good = [1 / (1 + math.exp(min(700, -_log_odds(p, prior, rate)))) for p, _ in patterns]
    return {"prior": prior, "rate": rate}


def _log_odds(p: tuple[int, ...], prior: float, rate: dict) -> float:
    return math.log(prior / (1 - prior)) + sum(math.log(rate[1, r, v] / rate[0, r, v]) for r, v in enumerate(p))


def posterior(model: dict, votes: list[str]) -> Column:
    """Probability of the good class from the vote columns."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for r, name in enumerate(votes):
        part = {v: F.lit(math.log(model["rate"][1, r, v] / model["rate"][0, r, v])) for v in (-1, 0, 1)}
        odds = odds + F.when(F.col(name) < 0, part[-1]).when(F.col(name) > 0, part[1]).otherwise(part[0])
    return 1 / (1 + F.exp(-odds))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality, vote_*.

    ``kept`` is false where base_failed is true, else whether the posterior ``quality`` reaches
    ``threshold``. A null or empty text has counts of 0 and fails as too short; null or repeated
    ids are ordinary rows; extra columns are ignored; an empty table gives an empty result.

    The model is estimated from the vote patterns of all rows that the base lets pass; only counts
    by pattern (at most 3**rules rows) reach the driver.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    votes = [f"vote_{r}" for r in RULES]
    table = materialize(features(df, id_col, text_col).withColumn("base_failed", failed).withColumns({f"vote_{r}": vote(r) for r in RULES}))
    counts = table.filter(~F.col("base_failed")).groupBy(*votes).agg(F.count("*").alias("n")).collect()
    # Python's sort makes sums, and so the fit, the same in every run.
    model = fit(sorted((tuple(r[v] for v in votes), r["n"]) for r in counts))
    if not counts:
        return _result(table.withColumn("quality", F.lit(0.0)), threshold, votes)
    return _result(table.withColumn("quality", posterior(model, votes)), threshold, votes)


def _result(table: DataFrame, threshold: float, votes: list[str]) -> DataFrame:
    kept = ~F.col("base_failed") & (F.col("quality") >= threshold)
    return table.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "quality", *votes)
