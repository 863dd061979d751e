"""Quality rules as a short-circuit cascade; DataFrame expressions only.

Rules are columns over the text. On a bounded sample, drawn by seed from all rows, each rule is timed against a job that
asks nothing, after a warm-up and more than once, and its rejections are counted; the cascade then asks the rule with the most rejections per second first, and a document that one rule rejects is asked no
further. The order changes how much is computed, never which documents are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm.scratch import Scratch

SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Rows on which costs and rejections are estimated, about and at most twice as many; the seed that draws them; runs
#: of which the fastest counts, and seconds below which a cost isn't told from none.
SAMPLE_ROWS = 600
SEED = 11
RUNS = 3
LEAST_COST = 1e-3


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    trimmed = F.trim(whole(text), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(NOT_SPACE + "+"))


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(whole(text), SPACES, ""))


def n_symbols(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(r"[#*$%&|<>]"))


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(whole(text), "\n"), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")


def n_dup_lines(text: Column) -> Column:
    return bound(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def n_repeat_words(ws: Column) -> Column:
    """Words in windows of five words found twice or more: positions of equal windows, then the words that they cover."""

    def covered(at: Column) -> Column:
        gap = lambda p, k: F.least(F.lit(5), F.coalesce(F.get(at, k + 1) - p, F.lit(5)))
        return F.aggregate(F.transform(at, gap), F.lit(0), lambda a, x: a + x)

    def positions(z: Column) -> Column:
        same = lambda x, k: (F.get(z, k - 1)["h"] == x["h"]) | (F.get(z, k + 1)["h"] == x["h"])
        return bound(F.sort_array(F.transform(F.filter(z, lambda x, k: F.coalesce(same(x, k), F.get(z, k - 1)["h"] == x["h"], F.get(z, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])), covered)

    def windows(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bound(pairs, positions))

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
        return F.when(F.size(w) < 6, F.lit(0)).otherwise(bound(hashes, windows))

    return bound(ws, of)


@dataclass(frozen=True)
class Rule:
    """``fails(text)`` is true for texts that the rule rejects, and never null."""

    name: str
    fails: Callable[[Column], Column]


def few_words(least: int) -> Rule:
    return Rule("few_words", lambda t: n_words(t) < least)


def repeated_words(percent: int) -> Rule:
    return Rule("repeated_words", lambda t: bound(words(t), lambda w: 100 * n_repeat_words(w) > percent * F.size(w)))


def symbols(percent: int) -> Rule:
    return Rule("symbols", lambda t: 100 * n_symbols(t) > percent * n_words(t))


def word_length(least: int, most: int) -> Rule:
    return Rule("word_length", lambda t: ~bound(n_words(t), lambda n: word_chars(t).between(least * n, most * n)))


def repeated_lines(percent: int) -> Rule:
    return Rule("repeated_lines", lambda t: bound(lines(t), lambda x: 100 * (F.size(x) - F.size(F.array_distinct(x))) > percent * F.size(x)))


#: The rules of the contract, then those that the cascade adds.
BASE = (few_words(10), repeated_words(20))
MORE = (symbols(30), word_length(2, 24), repeated_lines(50))


def order_rules(documents: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS, scratch: Scratch | None = None) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, rejected share) on a sample of about ``sample_rows`` rows, most rejection per cost first."""
    scratch = scratch or Scratch(documents.sparkSession)
    n_rows = documents.count()
    texts = documents.select(F.col("text").cast("string").alias("text")).sample(min(1.0, sample_rows / max(1, n_rows)), SEED)
    sample = scratch.write(texts.limit(2 * sample_rows).coalesce(1))  # a bound only: drawing so many is out of the question
    n = max(1, sample.count())

    def timed(counted: Column) -> tuple[float, int]:
        took = []
        for _ in range(RUNS + 1):  # the first run warms up
            began = time.perf_counter()
            rejected = sample.agg(counted).first()[0]
            took.append(time.perf_counter() - began)
        return min(took[1:]), rejected

    idle, _ = timed(F.count_if(F.length("text") < 0))
    found = []
    for rule in rules:
        took, rejected = timed(F.count_if(rule.fails(F.col("text"))))
        found.append((rule, max(LEAST_COST, took - idle), rejected / n))
    scratch.drop(sample)
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1]))


def cascade(rules: list[Rule], text: Column) -> Column:
    """True where no rule rejects; a rule is asked only if those before it did not reject."""
    kept = F.lit(True)
    for rule in reversed(rules):
        kept = F.when(rule.fails(text), F.lit(False)).otherwise(kept)
    return kept


def keep_good(documents: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, all their columns unchanged.

    Null texts count as empty and are rejected by ``few_words``. Repeated rows are judged alike; an empty table
    stays empty.
    """
    ordered = [r for r, _, _ in order_rules(documents, rules, sample_rows)]
    return documents.where(cascade(ordered, F.col("text").cast("string")))


def judge(documents: DataFrame, rules: tuple[Rule, ...] = MORE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: the counts that the base rules use, whether one of these fails, and the cascade's verdict.

    Null texts have no words and fail. Each row is judged alone: null ids, repeated rows and further columns
    change nothing. Base rules: fewer than 10 words, or more than 20 % of the words in repeated windows.
    """
    ordered = [r for r, _, _ in order_rules(documents, rules, sample_rows)]
    text = F.col("text")
    counted = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("w", words(text))
        .select(
            "doc_id",
            "text",
            F.size("w").cast("long").alias("n_words"),
            word_chars(text).cast("long").alias("word_chars"),
            n_symbols(text).cast("long").alias("n_symbols"),
            n_dup_lines(text).cast("long").alias("n_dup_lines"),
            n_repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        )
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    )
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(ordered, text))
    return counted.withColumn("kept", kept).drop("text")
