"""A quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters, of digits and of one kind of other sign (A-Z lower-cased); features are single
tokens and pairs, the text's begin and end included, hashed to ``WIDTH`` places.  A
feature's value is the root of its share in the text, so every text has length one.

Training goes over the labelled rows in streams of about ``SHARD_ROWS`` rows, at most ``MOST_SHARDS``, dealt by hash.  Each
stream updates the two sums of the leader (gradients and squares) row by row; after a round the
streams' changes are averaged and the next round begins from there.  The fit reads at most about ``FIT_ROWS`` labelled rows, drawn by hash of
their id when there are more; scoring reads every whole text as sparse dot products.

A null or empty text has one feature, the pair of begin and end.  Rows without a label, with a
null one, or whose id has labels that differ, teach nothing; rows that repeat an id teach each.  Without training rows all
scores are one half.  A text longer than ``CHUNK_BYTES`` is hashed alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Words, as_long, lists, mixed, named, pieces, tune, work_path, written

BITS = 18
WIDTH = 1 << BITS
# The documented bound on labelled rows that the fit reads.
FIT_ROWS = 50_000
SHARD_ROWS, MOST_SHARDS = 4_000, 8
# Every row is learned from in each round; few rows are gone over more often, until so many steps are taken.
ROUNDS, MOST_ROUNDS, STEPS = 6, 30, 30_000
# Learning rate and its smoothing; weights below the first penalty are zero.
RATE, SMOOTH, SPARSE, SHRINK = 2.0, 1.0, 0.05, 0.001
UNIT = 2.0 ** -40
THRESHOLD = 0.3
# The end of a text, which is also the begin of it: a token that no text holds.
EDGE = np.uint64(0x9E3779B97F4A7C15)
# A token twice in a row is one feature, whichever token it is; so is the pair of edges of a text without tokens.
TWICE, EMPTY = mixed(np.array([1, 2], dtype=np.uint64))
_KIND = np.full(256, 3, dtype=np.int16)
_KIND[[ord(c) for c in " \t\n\x0b\x0c\r"]] = 0
_KIND[ord("0"):ord("9") + 1] = 1
for _first, _last in ((ord("A"), ord("Z")), (ord("a"), ord("z")), (128, 255)):
    _KIND[_first:_last + 1] = 2
# Other signs are a kind each, so a run holds one sign.
_KIND[_KIND == 3] = np.arange(10, 10 + int((_KIND == 3).sum()))


class Tokens(Words):
    """Words cut where the kind of sign changes."""

    def _hashes(self) -> np.ndarray:
        kind = _KIND[self.blob]
        begins = np.flatnonzero((kind != 0) & np.concatenate([[True], kind[1:] != kind[:-1]]))
        stops = np.flatnonzero((kind != 0) & np.concatenate([kind[1:] != kind[:-1], [True]])) + 1
        word = np.searchsorted(self.starts, begins, side="right") - 1
        self.doc = self.doc[word] if len(begins) else np.empty(0, dtype=np.int64)
        self.starts, self.ends = begins, stops
        self.counts = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        return super()._hashes()


def places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of each feature, by row."""
    tokens = Tokens(texts)
    n, rows = len(tokens.hash), np.arange(tokens.n_docs)
    # Tokens with an edge before each text and one at the very end.
    flat = np.full(n + tokens.n_docs + 1, EDGE, dtype=np.uint64)
    flat[np.arange(n) + tokens.doc + 1] = tokens.hash
    row = np.repeat(rows, tokens.counts + 1)
    pairs = np.where(flat[:-1] == flat[1:], TWICE, mixed(flat[:-1] * np.uint64(3) + mixed(flat[1:])))
    pairs[np.flatnonzero(flat[:-1] == EDGE)[tokens.counts == 0]] = EMPTY
    place = (np.concatenate([tokens.hash, pairs]) >> np.uint64(64 - BITS)).astype(np.int64)
    at, count = np.unique(np.concatenate([tokens.doc, row]) << BITS | place, return_counts=True)
    row = at >> BITS
    return row, at & (WIDTH - 1), np.sqrt(count / (2 * tokens.counts + 1)[row])


def sparse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of training rows as lists."""
    for batch in pieces(batches):
        row, place, value = places(batch.column("text"))
        offsets = np.searchsorted(row, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays([
            batch.column("turn"), batch.column("label"), lists(place.astype(np.int32), offsets, pa.int32()),
            lists(value.astype(np.float32), offsets, pa.float32()),
        ], names=["turn", "label", "place", "value"])


def weights(z: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """The leader's weights, from its sums."""
    return np.where(np.abs(z) <= SPARSE, 0.0, (np.sign(z) * SPARSE - z) / ((SMOOTH + np.sqrt(squares)) / RATE + SHRINK))


def logistic(x: np.ndarray | float):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fixed(values: np.ndarray) -> pa.Array:
    """Whole numbers of ``UNIT``, whose sum doesn't depend on the order of the shards."""
    return pa.array(np.rint(values / UNIT).astype(np.int64))


def stream(z0: np.ndarray, squares0: np.ndarray):
    """The rows of each shard in turn, one shard after the other; yields what a shard changed."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, squares, current = z0.copy(), squares0.copy(), None
        for batch in batches:
            for shard, label, place, value in zip(*[batch.column(c) for c in ("shard", "label", "place", "value")]):
                if shard != current:
                    if current is not None:
                        yield changes(z, squares)
                        z, squares = z0.copy(), squares0.copy()
                    current = shard
                at, x = place.values.to_numpy(), value.values.to_numpy().astype(np.float64)
                old = squares[at]
                w = weights(z[at], old)
                slope = (logistic(float(w @ x)) - label.as_py()) * x
                new = old + slope * slope
                z[at] += slope - (np.sqrt(new) - np.sqrt(old)) / RATE * w
                squares[at] = new
        yield changes(z, squares)

    def changes(z: np.ndarray, squares: np.ndarray) -> pa.RecordBatch:
        changed = np.flatnonzero((z != z0) | (squares != squares0))
        return pa.RecordBatch.from_arrays([
            pa.array(changed.astype(np.int32)), fixed((z - z0)[changed]), fixed((squares - squares0)[changed]),
        ], names=["place", "z", "squares"])

    return run


def sample(labels: DataFrame, learn, name: str, most: int = FIT_ROWS) -> DataFrame:
    """doc_id, label of the training rows: one row per id whose labels agree, about ``most`` at most, by hash."""
    rows = named(labels, "doc_id", name).withColumnRenamed(name, "label").filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    rows = written(rows.filter(learn).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter(
        "label = other").select("doc_id", "label"), "training_labels")
    share = most / max(rows.count(), 1)
    if share >= 1:
        return rows
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, learn, name: str = "quality", most: int = FIT_ROWS) -> np.ndarray:
    """Weights of all places, learned from the rows of ``labels`` for which ``learn`` (over doc_id) holds."""
    tune(docs.sparkSession)
    chosen = sample(labels, learn, name, most)
    # At most about ``most`` rows, so the side that is broadcast is bounded; texts stay where they are.
    rows = named(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        F.xxhash64("doc_id", "text").alias("turn"), F.col("label").cast("double").alias("label"), "text")
    spark = docs.sparkSession
    number = chosen.count()
    shards = min(MOST_SHARDS, 1 + number // SHARD_ROWS)
    shard = F.pmod(F.shiftright("turn", 7), F.lit(shards))
    # One file per shard in its order, dealt once; a shard is far below a row group, so a file is read as one stream.
    dealt = work_path(spark, "shards")
    features = rows.mapInArrow(sparse, "turn long, label double, place array<int>, value array<float>").withColumn("shard", shard)
    features.repartition(shards, "shard").sortWithinPartitions("shard", "turn").drop("turn").write.partitionBy("shard").parquet(dealt)
    dealt_rows = spark.read.schema("label double, place array<int>, value array<float>, shard long").parquet(dealt)
    z, squares = np.zeros(WIDTH), np.zeros(WIDTH)
    for _ in range(max(ROUNDS, min(MOST_ROUNDS, STEPS // max(number, 1)))):
        # The changes of a shard are at most WIDTH rows.
        changed = dealt_rows.select("shard", "label", "place", "value").mapInArrow(stream(z, squares), "place int, z long, squares long")
        summed = changed.groupBy("place").agg(F.sum("z").alias("z"), F.sum("squares").alias("squares")).toArrow()
        at = summed.column("place").to_numpy()
        z[at] += summed.column("z").to_numpy() * (UNIT / shards)
        squares[at] += summed.column("squares").to_numpy() * (UNIT / shards)
    return weights(z, squares)


def scored(model: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            row, place, value = places(batch.column("text"))
            score = logistic(np.bincount(row, model[place] * value, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)),
            ], names=["doc_id", "score", "predicted"])

    return run


def classified(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id, score, predicted of every row."""
    tune(docs.sparkSession)
    rows = named(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scored(model), f"doc_id {kind}, score double, predicted int")
