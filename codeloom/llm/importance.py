"""Importance resampling: draw documents whose hashed word n-grams look like a target text.

Words (A-Z lower-cased) and their runs of up to three are found by one regular expression
over the collapsed text: separators become single spaces, and overlapping matches that may
only begin behind a space yield the spans of the one, two and three words there.  A run's
bucket is the CRC-32 of its bytes.  Bucket totals of the corpus and of the target give every bucket a
gain, a document weighs the sum of its gains, and adding Gumbel noise keyed by its id
turns the largest scores into a draw without replacement.

Buckets of each text are written once, two bytes a run, and read for the totals and for the
weights.  Ranks come from a range-partitioned sort: the place within a slice plus the rows of
the slices before it, so neither equal scores nor the drawn share meet in one task.

A null or empty text has no features, weighs 0 and can't be drawn; a null id counts as an
empty one.  Rows that agree in score and id are ranked by their number of features and weight,
repeated rows one after the other.  Long texts are scanned ``STEP`` words at a time.  With no
documents the result is empty; with an empty target its counts are zero.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import named, pieces, tune, written

BUCKETS = 10_000
SEED = 42
# Documents with at least so many words can be drawn, and so many of a hundred are.
LEAST_WORDS, PERCENT = 20, 5
STEP = 65_536
# Word bytes are 0-9, a-z and everything beyond ASCII; capitals are lower-cased first.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
# Begins behind a space or at the start; the groups end after one, two and three words.
RUNS = regex.compile(rb"(?<![^ ])((([^ ]+)(?: [^ ]+)?)(?: [^ ]+)?)")


def buckets(text: str) -> tuple[np.ndarray, int]:
    """Buckets of all runs of one to three words of a text, and its number of words."""
    line = regex.sub(rb" +", b" ", text.encode().translate(_FOLD)).strip(b" ")
    ones, twos, threes = [], [], []
    for found in batched((m.groups() for m in RUNS.finditer(line, overlapped=True)), STEP):
        for runs, out in zip(zip(*found), (threes, twos, ones)):
            sums = np.fromiter(map(zlib.crc32, runs), np.uint32, len(found))
            out.append((sums % BUCKETS).astype(np.uint16))
    n = sum(map(len, ones))
    if not n:
        return np.empty(0, np.uint16), 0
    # The last word starts no pair and the last two no triple: their longer groups repeat shorter runs.
    return np.concatenate([*ones, np.concatenate(twos)[:n - 1], np.concatenate(threes)[:max(n - 2, 0)]]), n


def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows = [buckets(text or "") for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("key"), pa.array([n for _, n in rows], pa.int64()),
            pa.array([b.tobytes() for b, _ in rows], pa.binary()),
        ], names=["doc_id", "key", "n_words", "buckets"])


def totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs by bucket, one row per bucket and task."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for row in batch.column("buckets"):
            total += np.bincount(np.frombuffer(row.as_buffer(), np.uint16), minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])


def counted(table: DataFrame) -> np.ndarray:
    """Runs by bucket over all rows; ``BUCKETS`` numbers, whatever the table's size."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    for row in table.select("buckets").mapInArrow(totals, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the log ratio of a bucket's smoothed shares, rounded down."""
    s_all, t_all = int(corpus.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([
        math.floor(1000 * math.log((t + 1) * float(s_all) / ((s + 1) * float(t_all)))) for s, t in zip(corpus.tolist(), target.tolist())
    ], dtype=np.int64)


def noise(key: str, seed: int = SEED) -> int:
    """Thousand times a Gumbel number keyed by seed and id, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(gain: np.ndarray, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(row.as_buffer(), np.uint16) for row in batch.column("buckets")]
            weight = np.array([int(gain[b].sum()) for b in found], dtype=np.int64)
            drawn = np.array([noise(k, seed) for k in batch.column("key").to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("n_words"), pa.array([len(b) for b in found], pa.int64()),
                pa.array(weight), pa.array(weight + drawn),
            ], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn) of each document.

    ``target`` holds the texts of the wanted distribution in ``text``.  Of the documents with at least
    ``least_words`` words, ``percent`` of a hundred with the largest scores are drawn.
    """
    spark = tune(docs.sparkSession)
    rows = named(docs, "doc_id", "text").withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, key string, n_words long, buckets binary"
    corpus = written(rows.mapInArrow(features, schema), "features")
    wanted = named(target, "text").select(F.lit(None).cast(kind).alias("doc_id"), "text", F.lit("").alias("key"))
    gain = gains(counted(corpus), counted(wanted.mapInArrow(features, schema)))
    scored = written(corpus.mapInArrow(weighed(gain, seed), f"doc_id {kind}, n_words long, n_features long, weight long, score long"), "scores")
    can = F.col("n_words") >= least_words
    most = percent * scored.filter(can).count() // 100
    order = [can.desc(), F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")]
    placed = written(
        scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "places"
    )
    # One row per slice of the sort: as many as the shuffle has partitions.
    slices = placed.groupBy(F.shiftright("place", 33).alias("slice")).agg(F.count("*").alias("n"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("slice", F.shiftright("place", 33)).join(F.broadcast(offsets), "slice").select(
        "doc_id", "n_words", "n_features", "weight", "score", F.when(can & (rank <= most), rank).alias("rank")
    )
