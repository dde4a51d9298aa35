"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import (
    classifier, decontamination, hidden_markov, importance, mixing, ngram_join, passages, pseudonyms, quality, sql, token_counts, token_files,
    toxicity, variants,
)
from codeloom.llm.common import documents, id_remainder

ENCODER = "word_bpe_49k.json"
COUNTER = "byte_bpe_50k.tiktoken"
# The key of the pseudonyms; a real run takes it from its own store of secrets.
PSEUDONYM_KEY = "codeloom"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_documents(documents(spark, folder))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.length_histogram(documents(spark, folder), public_tokenizers.path(COUNTER))


def op3_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.linked_components(documents(spark, folder)).select("doc_id", "n_shingles", "component_id")


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(documents(spark, folder), table(spark, folder, "benchmark"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    held_out = (id_remainder("doc_id", 3) == 1).alias("held_out")
    return toxicity.toxicity(docs, model).select("doc_id", held_out, "score", "predicted")


def op6_hidden_markov(spark: SparkSession, folder: str) -> DataFrame:
    return hidden_markov.model_scores(documents(spark, folder), id_remainder("doc_id", 10) == 0)


def op7_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, folder))


def op8_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonyms.pseudonymise(documents(spark, folder).select("doc_id", "text"), PSEUDONYM_KEY)


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_index(documents(spark, folder), public_tokenizers.path(ENCODER))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(documents(spark, folder))


def op12_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = classifier.fit(docs, table(spark, folder, "labels"), id_remainder("doc_id", 5) != 0)
    held_out = (id_remainder("doc_id", 5) == 0).alias("held_out")
    return classifier.classified(docs, model).select("doc_id", held_out, "score", "predicted")


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance.importance(documents(spark, folder), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mix_sources, op2_token_counts, op3_ngram_jaccard, op4_decontaminate, op5_toxicity, op6_hidden_markov,
        op7_repeated_passages, op8_pseudonyms, op9_quality_rules, op10_token_files,
        op11_spelling_variants, op12_quality_classifier, op13_importance_resampling,
    )
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
JACCARD_SQL = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * k >= 75 * (p.n + q.n - k)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reach.a, links.y FROM reach JOIN links ON links.x = reach.b
)
SELECT d.doc_id, CAST(coalesce(max(s.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.a = d.doc_id
GROUP BY d.doc_id
"""
STOP_LIST = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
RULES_SQL = " AND ".join(
    test for r in quality.RULES for test in (
        ([f"100 * {r.measure} >= {r.least} * {r.per}"] if r.least is not None else [])
        + ([f"100 * {r.measure} <= {r.most} * {r.per}"] if r.most is not None else [])
    )
)
QUALITY_SQL = rf"""
WITH base AS (
    SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), windows AS (
    SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)
), marked AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT doc_id, count(DISTINCT place) AS n_repeat_words
    FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM marked) GROUP BY doc_id
), counted AS (
    SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
        CAST(len(list_filter(w, lambda x: x IN ({STOP_LIST}))) AS BIGINT) AS n_stop_words
    FROM base b LEFT JOIN covered c ON c.doc_id = b.doc_id
), judged AS (
    SELECT *, (n_words < {quality.FEWEST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words) AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    (NOT base_failed AND {RULES_SQL}) AS kept
FROM judged
"""
ORACLES: dict[str, str] = {
    "op3_ngram_jaccard": JACCARD_SQL, "op9_quality_rules": QUALITY_SQL, "op11_spelling_variants": sql.VARIANTS,
    "op13_importance_resampling": sql.RESAMPLING,
}
