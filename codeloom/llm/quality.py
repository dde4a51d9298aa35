"""Quality rules: a threshold table compiled into one projection.

Everything is a column expression over one row; nothing is shuffled and no user function
runs. A null text counts as an empty one: it has no words, so it fails. Repeated rows are
judged each on its own; a null ``doc_id`` is kept as it is.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import let
from codeloom.llm.common import WHITE, named, text_or_empty, words_column

SYMBOLS = "#*$%&|<>"
# Frequent function words of the four languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as", "be", "by", "at", "from",
    "this", "are", "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein", "eine", "für", "auf", "dem", "nicht",
    "le", "la", "les", "de", "des", "du", "et", "est", "un", "une", "que", "en", "pour", "dans", "qui", "par", "sur", "pas",
    "el", "los", "las", "y", "por", "con", "para", "se", "del", "al", "lo", "como", "su", "es",
)


class Rule(NamedTuple):
    """Holds where 100 * measure is at least ``least`` and at most ``most`` times ``per``."""

    name: str
    measure: str
    per: str
    least: int | None
    most: int | None


RULES = (
    Rule("word_length", "word_chars", "n_words", 250, 1000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("capitals", "n_capitals", "word_chars", None, 30),
    Rule("stop_words", "n_stop_words", "n_words", 4, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 40),
)
FEWEST_WORDS, MOST_REPEATED = 50, 50


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are in the regex class ``characters``."""
    return F.char_length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice."""
    def covered(positions: Column) -> Column:
        reach = F.transform(positions, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(positions, i + 1), p + 3) - p))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda total, x: total + x)

    def twice(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        found = let(ordered, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])),
            lambda x: x["at"],
        )))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(found, covered))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(windows, twice))


def measures(text: Column) -> Column:
    """All counts that the rules need, as one struct."""
    def of_words(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            count_of(text, SYMBOLS).alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            count_of(text, "A-Z").alias("n_capitals"),
            F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, WHITE, "") != "")
    return let(words_column(text), lambda words: let(lines, lambda some: of_words(words, some)))


def holds(rule: Rule) -> Column:
    value, unit = 100 * F.col(rule.measure), F.col(rule.per)
    tests = [value >= rule.least * unit] if rule.least is not None else []
    tests += [value <= rule.most * unit] if rule.most is not None else []
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: the counts, ``base_failed``, the names of broken rules and ``kept``."""
    counted = named(docs, "doc_id", "text").select("doc_id", measures(text_or_empty()).alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    broken = F.filter(F.array(*[F.when(~holds(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return counted.select(
        "*", failed.alias("base_failed"), broken.alias("broken_rules"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
