"""A hidden Markov language model over word symbols.

Symbols: one for the end of a text, one for each of the most frequent training words, and
for all other words the hash class of their last letters.  Latent states emit symbols; a
word within a class has the share of its smoothed count in that class, one unknown word
per class included.  Word counts come from all training texts.  Baum-Welch collects
expected counts in every partition and adds them up; every round reads all training texts.

Texts are looked up once: their symbols are written as 16-bit numbers, from which all rounds and the
scores are taken.  Training and scoring are exact over whole texts (``recursion``): the score is the log10
probability under the model, and memory is bounded whatever a text's length.  Frequent
words are looked up in a table of fixed size, chosen by a histogram of the counts; the others join the word counts by hash.

Null texts are empty ones (only the end).  Repeated rows are scored each, and learned from
as often as they stand.  Without training texts every token has the smoothing's share.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Words, as_long, mixed, named, pieces, tune, written
from codeloom.llm.recursion import Parameters, expected, log_likelihood

STATES = 8
SMOOTHING = 0.1
CLASSES = 4096
# Frequent words with a symbol of their own, and words whose counts every task holds.
SYMBOL_WORDS = 16_384
TABLE_WORDS = 131_072
ROUNDS = 8
PIECE_BYTES, SYMBOL_BYTES = 4_000_000, 2_000_000
SEED = 7


def endings(words: Words) -> np.ndarray:
    """Class 1 .. CLASSES of each word, by its last three bytes."""
    packed = np.zeros(len(words.starts), dtype=np.uint64)
    for k in range(1, 4):
        at = words.ends - k
        byte = words.blob[np.maximum(at, 0)].astype(np.uint64)
        byte = np.where((byte >= 65) & (byte <= 90), byte + np.uint64(32), byte)
        packed = packed << np.uint64(8) | np.where(at >= words.starts, byte, np.uint64(0))
    return (mixed(packed + np.uint64(1)) % np.uint64(CLASSES)).astype(np.int64) + 1


def word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, most=PIECE_BYTES):
        words = Words(batch.column("text"))
        hashes, at, counts = np.unique(words.hash, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_pydict({
            "word": as_long(hashes), "class": pa.array(endings(words)[at].astype(np.int32)), "n": pa.array(counts.astype(np.int64)),
        })


@dataclass
class Table:
    """What every task holds: frequent words with their counts, and totals."""

    words: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray
    class_total: np.ndarray
    n_tokens: int
    n_types: int
    n_docs: int

    @property
    def symbols(self) -> int:
        return 1 + CLASSES + SYMBOL_WORDS

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word in the table, -1 if it isn't there."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)


def word_symbols(words: Words, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each word, and its place in the table."""
    at = table.find(words.hash)
    symbols = endings(words)
    own = np.where(at >= 0, table.symbol[np.maximum(at, 0)] if len(table.symbol) else 0, 0)
    return np.where(own > 0, own, symbols), at


def sequences(words: Words, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with an end (0) after each text, and where each text begins."""
    starts = words.first + np.arange(words.n_docs + 1)
    flat = np.zeros(len(symbols) + words.n_docs, dtype=np.int32)
    flat[np.arange(len(symbols)) + words.doc] = symbols
    return flat, starts


def joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a batch's texts one after the other, and where each text begins."""
    texts = batch.column("symbols").to_pylist()
    starts = np.concatenate([[0], np.cumsum([len(t) // 2 for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.int16), starts


def collected(p: Parameters):
    """One row per symbol with its expected counts by state, per task; negative symbols are starts and moves."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in pieces(batches, "symbols", SYMBOL_BYTES):
            part = expected(*joined(batch), p)
            if total is None:
                total = part
            else:
                for sums, more in zip(total, part):
                    sums += more
        if total is not None:
            first, moves, emitted = total
            used = np.flatnonzero(emitted.sum(axis=1) > 0)
            rows = np.concatenate([first[None], moves, emitted[used]])
            names = np.concatenate([[-1], -2 - np.arange(STATES), used])
            yield pa.RecordBatch.from_pydict({
                "symbol": pa.array(names.astype(np.int32)), **{f"s{k}": pa.array(rows[:, k].astype(np.float64)) for k in range(STATES)},
            })

    return run


def maximised(rows, unigram: np.ndarray) -> Parameters:
    """Parameters from summed counts; every probability stays above zero."""
    first, moves = np.ones(STATES), np.ones((STATES, STATES))
    emitted = np.zeros((len(unigram), STATES))
    for r in rows.itertuples(index=False):
        values = np.array(r[1:])
        if r[0] == -1:
            first = first + values
        elif r[0] < -1:
            moves[-2 - r[0]] += values
        else:
            emitted[r[0]] = values
    usual = emitted.sum(axis=0) + 1
    emit = emitted + 20 * unigram[:, None]
    return Parameters(
        (first / first.sum()).astype(np.float32), (usual / usual.sum()).astype(np.float32),
        (moves / moves.sum(axis=1, keepdims=True)).astype(np.float32), (emit / emit.sum(axis=0)).astype(np.float32),
    )


def beginning(unigram: np.ndarray) -> Parameters:
    """States that differ by noise and like to stay."""
    noise = np.random.default_rng(SEED).normal(0, 0.7, (len(unigram), STATES))
    emit = unigram[:, None] * np.exp(noise)
    even = np.full(STATES, 1 / STATES, dtype=np.float32)
    moves = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
    return Parameters(even, even, moves.astype(np.float32), (emit / emit.sum(axis=0)).astype(np.float32))


def encoded(table: Table):
    """One row per document with its symbols and what the table answers; one row per other word, to be joined."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_total = np.log10(table.n_tokens + SMOOTHING * (table.n_types + 1))
        logs = np.log10(table.counts + SMOOTHING) if len(table.counts) else np.zeros(0)
        class_total = np.log10(table.class_total)
        key = TaskContext.get().partitionId() << 33
        for batch in pieces(batches, most=PIECE_BYTES):
            words = Words(batch.column("text"))
            symbols, at = word_symbols(words, table)
            flat, starts = sequences(words, symbols)
            flat = flat.astype(np.int16)
            known = at >= 0
            own = symbols > CLASSES
            log_count = np.where(known, logs[np.maximum(at, 0)] if len(logs) else 0.0, 0.0)
            in_class = np.where(own, 0.0, log_count - class_total[np.minimum(symbols, CLASSES)])
            add = lambda values: np.bincount(words.doc, values, minlength=words.n_docs)
            n_tokens = words.counts + 1
            base = add(log_count) + np.log10(table.n_docs + SMOOTHING) - n_tokens * base_total
            keys = key + np.arange(words.n_docs)
            key += words.n_docs
            rest = np.flatnonzero(~known)
            columns = {
                "key": pa.array(np.concatenate([keys, keys[words.doc[rest]]])), "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "n_tokens": pa.array(n_tokens.astype(np.int64)), "n_known": pa.array((add(known) + (table.n_docs > 0)).astype(np.int64)),
                "base_score": pa.array(base), "in_class": pa.array(add(in_class)),
                "symbols": pa.array([flat[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary()),
            }
            full = [c if name == "key" else pa.concat_arrays([c, pa.nulls(len(rest), c.type)]) for name, c in columns.items()]
            yield pa.RecordBatch.from_arrays(
                [*full, pa.concat_arrays([pa.nulls(words.n_docs, pa.int64()), as_long(words.hash[rest])])], names=[*columns, "word"]
            )

    return run


def symbol_rows(texts: DataFrame, table: Table) -> DataFrame:
    """The encoded rows of (doc_id, text, held_out), written."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"key long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, in_class double, symbols binary, word long"
    return written(texts.select("doc_id", "text", "held_out").mapInArrow(encoded(table), schema), "encoded")


def scored(p: Parameters):
    """The rows with the log10 probability of their symbols added to what the table answered."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "symbols", SYMBOL_BYTES):
            likelihood = log_likelihood(*joined(batch), p)
            score = likelihood + batch.column("in_class").to_numpy()
            names = ["key", "doc_id", "held_out", "n_tokens", "n_known", "base_score"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(score)], names=[*names, "score"])

    return run


def make_table(vocabulary: DataFrame, n_docs: int) -> tuple[Table, np.ndarray]:
    """The table that tasks hold and the symbols' shares, from the counted words."""
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # Words of one count stay or go together; a histogram says from which count on they fit.
    least, fit = 1, 0
    for r in vocabulary.groupBy("n").count().orderBy(F.desc("n")).collect():
        fit += r["count"]
        if fit > TABLE_WORDS:
            least = r.n + 1
            break
    top = vocabulary.filter(F.col("n") >= least).toPandas().sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
    classes = vocabulary.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    n, v = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    n[classes["class"]], v[classes["class"]] = classes["n"], classes["v"]
    owned = top.iloc[:SYMBOL_WORDS]
    np.subtract.at(n, owned["class"].to_numpy(dtype=int), owned["n"].to_numpy(dtype=float))
    np.subtract.at(v, owned["class"].to_numpy(dtype=int), 1.0)
    unigram = np.concatenate([n, np.zeros(SYMBOL_WORDS)])
    unigram[0] = n_docs
    unigram[CLASSES + 1:CLASSES + 1 + len(owned)] = owned["n"]
    unigram = (unigram + SMOOTHING) / (unigram + SMOOTHING).sum()
    symbol = np.where(np.arange(len(top)) < SYMBOL_WORDS, CLASSES + 1 + np.arange(len(top)), 0)
    hashes = top["word"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Table(
        hashes[order], top["n"].to_numpy(dtype=float)[order], symbol[order], n + SMOOTHING * (v + 1),
        int(total.n) + n_docs, total.v + (n_docs > 0), n_docs,
    ), unigram


def trained(rows: DataFrame, unigram: np.ndarray) -> Parameters:
    """Parameters after ``ROUNDS`` rounds, each over the symbols of all rows that aren't held out."""
    p = beginning(unigram)
    schema = "symbol int, " + ", ".join(f"s{k} double" for k in range(STATES))
    training = rows.filter("word is null and not held_out").select("symbols")
    for _ in range(ROUNDS):
        sums = training.mapInArrow(collected(p), schema).groupBy("symbol").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES)]).toPandas()
        p = maximised(sums, unigram) if len(sums) else p
    return p


def model_scores(docs: DataFrame, held_out) -> DataFrame:
    """Learn from rows where ``held_out`` is false and score all rows."""
    spark = tune(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    texts = named(docs.withColumn("mkv_held_out", held_out), "doc_id", "text", "mkv_held_out").withColumnRenamed("mkv_held_out", "held_out")
    training = texts.filter(~F.col("held_out")).select("doc_id", "text")
    vocabulary = written(
        training.select("text").mapInArrow(word_counts, "word long, class int, n long").groupBy("word").agg(
            F.min("class").alias("class"), F.sum("n").alias("n")
        ), "vocabulary",
    )
    table, unigram = make_table(vocabulary, training.count())
    rows = symbol_rows(texts, table)
    p = trained(rows, unigram)
    kind = texts.schema["doc_id"].dataType.simpleString()
    main = rows.filter("word is null").select("key", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "in_class", "symbols").mapInArrow(
        scored(p), f"key long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    other = rows.filter("word is not null").select("key", "word")
    count = F.coalesce("n", F.lit(0))
    joined = other.join(vocabulary.select("word", "n"), "word", "left").groupBy("key").agg(
        F.sum(F.log10(count + SMOOTHING)).alias("logs"), F.count("n").alias("found")
    )
    full = main.join(joined, "key", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(table.n_tokens).cast("long").alias("train_tokens"), (F.col("base_score") + logs).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
