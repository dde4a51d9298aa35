"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts, digits and signs that stand
for letters to one form, drops invisible characters and turns punctuation to blanks, so
``1D10T`` and ``idiot`` are the same word.  A lexicon entry is the start of a word (or a whole
word) with the log odds of toxic against clean documents.  Phrases in which an entry is
mostly harmless are exceptions: entries inside them do not count.  A document's score
is a logistic function of its summed weight and of that sum divided by its length.

The lexicon, the exceptions and the two coefficients are learned from labelled rows, at
most ``FIT_ROWS`` of them (the lowest ids by hash; rows equal in text and label count once).  Scoring reads
every whole text.  A null or empty text has no entries and scores lowest.  Rows without a
label, or whose label is null, teach nothing; with no labelled rows every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from codeloom.llm.common import id_remainder, named, on_plain_names, pieces, text_or_empty, tune, written

# The documented bound on labelled rows that the fit reads.
FIT_ROWS = 20_000
SHORTEST, LONGEST = 3, 12
# An entry is in so many toxic rows and so much likelier there (log odds).
LEAST_ROWS, LEAST_WEIGHT = 5, 3.0
THRESHOLD = 0.7
# Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m",
    "н": "h", "т": "t", "в": "b", "ԁ": "d", "ɡ": "g", "һ": "h", "ո": "n", "ս": "u", "α": "a", "ε": "e", "ο": "o", "ρ": "p",
    "ν": "v", "υ": "u", "ι": "i", "κ": "k", "τ": "t", "χ": "x", "ı": "i", "ɩ": "i", "ⅼ": "i",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "l": "i"}
INVISIBLE = "­​‌‍⁠﻿"
FULL_WIDTH = {chr(0xFF41 + i): "i" if chr(97 + i) == "l" else chr(97 + i) for i in range(26)}
FOLD = str.maketrans(LOOKALIKES | SIGNS | FULL_WIDTH | {c: "" for c in INVISIBLE})
NOT_WORD = re.compile(r"[\W_]+")


def folded(text: str | None) -> str:
    """Folded words with one blank around each."""
    return " " + " ".join(NOT_WORD.sub(" ", (text or "").lower().translate(FOLD)).split()) + " "


@dataclass(frozen=True)
class Model:
    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, float, float]


@lru_cache(maxsize=4)
def automaton(entries: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    out = ahocorasick.Automaton()
    for phrase in exceptions:
        out.add_word(phrase, (len(phrase), None))
    for entry, weight in entries:
        out.add_word(entry, (len(entry), weight))
    if len(out):
        out.make_automaton()
    return out


def hits(text: str, entries, exceptions=()) -> list[tuple[int, float]]:
    """(position of the word's blank, weight) per matched word of a folded text; the highest weight counts."""
    machine = automaton(entries, exceptions)
    if not len(machine):
        return []
    found: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for last, (length, weight) in machine.iter(text):
        start = last + 1 - length
        if weight is None:
            spared.append((start, last))
        else:
            found[start] = max(weight, found.get(start, 0.0))
    if spared:
        found = {at: w for at, w in found.items() if not any(a <= at < b for a, b in spared)}
    return sorted(found.items())


def features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / (words + 20))], axis=1)


def starts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean rows each word start occurs."""
    for batch in pieces(batches):
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = set(folded(text).split())
            own = {f" {w[:k]}" for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}
            counts[toxic].update(own)
            counts[toxic].update(f" {w} " for w in words if len(w) <= LONGEST)
        keys = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_pydict({
            "entry": pa.array(keys, pa.string()), "clean": pa.array([counts[0][k] for k in keys], pa.int64()),
            "toxic": pa.array([counts[1][k] for k in keys], pa.int64()),
        })


def lexicon(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> tuple[tuple[str, float], ...]:
    """Entries from counts: of a chain of word starts, the longest that stands in nearly as many toxic rows."""
    weight = {e: math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1)) for e, t, c in rows}
    toxic = {e: t for e, t, _ in rows if weight[e] >= LEAST_WEIGHT}
    chosen: dict[str, str] = {}
    for entry in sorted(toxic, key=lambda e: (len(e), e)):
        root = next((entry[:k] for k in range(SHORTEST + 1, len(entry)) if entry[:k] in chosen), None)
        if root is None:
            chosen[entry] = entry
        elif toxic[entry] >= 0.9 * toxic[root] and weight[entry] >= weight[root] - 0.3:
            chosen[root] = entry
    return tuple(sorted((e, round(weight[e], 6)) for e in set(chosen.values())))


def contexts(entries):
    """Per labelled row: its words, its hits' weights, and the phrases of two words around each hit."""
    hit = pa.struct([("weight", pa.float64()), ("phrases", pa.list_(pa.string()))])

    def phrases(text: str, at: int) -> list[str]:
        end = text.index(" ", at + 1)
        before, after = text.rfind(" ", 0, at), text.find(" ", end + 1)
        return [text[at:end + 1]] + ([text[before:end + 1]] if before >= 0 else []) + ([text[at:after + 1]] if after >= 0 else [])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [folded(t) for t in batch.column("text").to_pylist()]
            found = [[{"weight": w, "phrases": phrases(t, at)} for at, w in hits(t, entries)] for t in texts]
            yield pa.RecordBatch.from_pydict({
                "toxic": batch.column("toxic"), "words": pa.array([len(t.split()) for t in texts], pa.int64()),
                "hits": pa.array(found, pa.list_(hit)),
            })

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the ridge keeps separable data finite."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (y - p) - ridge * b
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(b)), slope)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def labelled(docs: DataFrame, labels: DataFrame, held_out: int = 1, modulus: int = 3, rows: int = FIT_ROWS) -> DataFrame:
    """text and toxic of at most ``rows`` training rows; rows equal in whole text and label are one."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(id_remainder("doc_id", modulus) != held_out)
    known = known.groupBy(F.col("doc_id").alias("labelled_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    texts = named(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text")).withColumn("digest", F.sha2("text", 256))
    # Only ids and digests are shuffled; the limit counts rows that are there and differ.
    found = texts.select("doc_id", "digest").join(known, F.col("doc_id") == F.col("labelled_id"))
    distinct = found.groupBy("digest", "toxic").agg(F.min("doc_id").alias("labelled_id"))
    chosen = distinct.orderBy(F.xxhash64("labelled_id"), "labelled_id", "digest", "toxic").limit(rows)
    some = texts.join(
        F.broadcast(chosen.withColumnRenamed("digest", "own")), (F.col("doc_id") == F.col("labelled_id")) & (F.col("digest") == F.col("own"))
    )
    return some.groupBy("digest", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """Learn the model; what reaches the driver is bounded by the words of ``FIT_ROWS`` texts."""
    tune(docs.sparkSession)
    rows = written(labelled(docs, labels, **options), "labelled")
    sizes = dict(rows.groupBy("toxic").count().collect())
    counted = rows.mapInArrow(starts, "entry string, clean long, toxic long").groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    ratio = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5)
    least = math.exp(LEAST_WEIGHT) * (sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1)
    # No limit: candidates are at most the word starts of the toxic rows by LEAST_ROWS, whatever the table's size.
    found = counted.filter(F.col("toxic") >= LEAST_ROWS).filter(ratio >= 0.99 * least)
    entries = lexicon([(r.entry, r.toxic, r.clean) for r in found.collect()], sizes.get(1, 0), sizes.get(0, 0))
    seen = rows.mapInArrow(contexts(entries), "toxic int, words long, hits array<struct<weight:double,phrases:array<string>>>").collect()
    if not seen or not entries:
        return Model((), (), (-30.0, 0.0, 0.0))
    harmless, harmful = Counter(), Counter()
    for r in seen:
        (harmful if r.toxic else harmless).update({p for h in r.hits for p in h.phrases})
    exceptions = {p for p, n in harmless.items() if n >= 2 and n > 2 * harmful[p]}
    total = np.array([sum(h.weight for h in r.hits if not exceptions & set(h.phrases)) for r in seen])
    words = np.array([r.words for r in seen], dtype=float)
    x, y = features(total, words), np.array([r.toxic for r in seen], dtype=float)
    return Model(entries, tuple(sorted(exceptions)), tuple(float(v) for v in logistic(x, y)))


def scored(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            total, words, count = [], [], []
            for text in batch.column("text").to_pylist():
                own = folded(text)
                found = hits(own, model.entries, model.exceptions)
                total.append(sum(w for _, w in found))
                count.append(len(found))
                words.append(own.count(" ") - 1)
            z = features(np.array(total, dtype=float), np.array(words, dtype=float)) @ np.array(model.coefficients)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns)), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array(count, pa.int64())],
                names=[*batch.schema.names, "tox_score", "tox_hits"],
            )

    return run


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with tox_score and tox_hits added."""
    added = [StructField("tox_score", DoubleType()), StructField("tox_hits", LongType())]
    return docs.mapInArrow(scored(model), StructType(docs.schema.fields + added))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), n_hits and predicted (1 from ``THRESHOLD`` on)."""
    tune(docs.sparkSession)
    rows = with_scores(named(docs, "doc_id", "text"), model)
    score = F.col("tox_score")
    return rows.select("doc_id", score.alias("score"), F.col("tox_hits").alias("n_hits"), (score >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the toxic ones; each row is judged by its own text."""
    tune(docs.sparkSession)
    return on_plain_names(docs, ["text"], lambda rows: with_scores(rows, model).filter(F.col("tox_score") < THRESHOLD))
