"""Passages that repeat across documents, by shared minimisers and the windows around them.

Of all positions only minimisers are kept: in every window of ``PASSAGE`` words, the run of
``RUN`` words with the lowest hash.  A passage of that length in two documents has the same
minimiser in both, so minimisers of two documents or more give every candidate.  Every window
around a shared minimiser is then compared by its own hash, and windows found in two documents
or more are joined to maximal spans.

No suffixes are sorted.  Neighbours in the order of suffixes share the longest match to the right,
while the document with the longest match to the left may stand far from them in that order, so
extending neighbours alone would lose spans of ``PASSAGE`` words.

Words are compared with A-Z lower-cased.  Null, empty and shorter texts have no spans.
Repetition inside one document alone is none; rows that share a ``doc_id`` are one
document whose spans are those of all its rows, and null ids count as one id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import let
from codeloom.llm.common import Words, as_long, named, pieces, tune, written

PASSAGE = 50
RUN = 8
NO_ID = -(1 << 63)


def lowest_runs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each window of PASSAGE words: the lowest hash of its runs, and whether it stays in one text."""
    runs, _ = words.windows(RUN)
    n = len(words.hash) - PASSAGE + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    width, span = PASSAGE - RUN + 1, 1
    low = runs
    while span * 2 <= width:
        low = np.minimum(low[:len(low) - span], low[span:])
        span *= 2
    rest = width - span
    low = np.minimum(low[:n], low[rest:rest + n])
    return low, words.doc[:n] == words.doc[PASSAGE - 1:]


def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct minimisers of each document."""
    for batch in pieces(batches):
        words = Words(batch.column("text"))
        low, inside = lowest_runs(words)
        at = np.flatnonzero(inside)
        # Neighbouring windows mostly share theirs.
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (low[at[1:]] != low[at[:-1]]) | (words.doc[at[1:]] != words.doc[at[:-1]])
        at = at[fresh]
        ids = batch.column("doc_key").to_numpy()
        yield pa.RecordBatch.from_pydict({"run": as_long(low[at]), "doc_key": pa.array(ids[words.doc[at]])})


def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and first word of each window whose minimiser stands in ``runs`` of its row."""
    for batch in pieces(batches):
        words = Words(batch.column("text"))
        low, inside = lowest_runs(words)
        hashes, _ = words.windows(PASSAGE)
        shared = [np.array(r, dtype=np.int64).view(np.uint64) for r in batch.column("runs").to_pylist()]
        picked = []
        for i, own in enumerate(shared):
            lo, hi = words.first[i], max(words.first[i], min(len(low), words.first[i + 1] - PASSAGE + 1))
            picked.append(lo + np.flatnonzero(np.isin(low[lo:hi], own)))
        at = np.concatenate(picked) if picked else np.empty(0, np.int64)
        ids = batch.column("doc_key").to_numpy()
        yield pa.RecordBatch.from_pydict({
            "window": as_long(hashes[at]), "doc_key": pa.array(ids[words.doc[at]]),
            "first": pa.array((at - words.first[words.doc[at]]).astype(np.int32)),
        })


def spans(firsts: Column) -> Column:
    """Maximal spans [start, end) from the first words of repeated windows."""
    def joined(s: Column) -> Column:
        opens = F.filter(s, lambda x, i: (i == 0) | (x - F.get(s, i - 1) > PASSAGE))
        closes = F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1) - x > PASSAGE))
        return F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("start"), (b + PASSAGE).alias("end")))

    return let(F.sort_array(firsts), joined)


def covered(found: Column) -> Column:
    return F.aggregate(found, F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Per document: its repeated spans and words, and the words that a document of smaller id has too."""
    tune(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    texts = named(docs, "doc_id", "text").select(key.alias("doc_key"), "text")
    found = written(texts.mapInArrow(anchors, "run long, doc_key long").distinct(), "minimisers")
    shared = found.groupBy("run").agg(F.min("doc_key").alias("lo"), F.max("doc_key").alias("hi")).filter("lo < hi").select("run")
    runs = found.join(shared, "run").groupBy("doc_key").agg(F.collect_list("run").alias("runs"))
    near = texts.join(runs, "doc_key").mapInArrow(windows, "window long, doc_key long, first int")
    near = written(near, "windows")
    twice = near.groupBy("window").agg(F.min("doc_key").alias("lo"), F.max("doc_key").alias("hi")).filter("lo < hi").select("window", "lo")
    placed = near.join(twice, "window").groupBy("doc_key").agg(
        F.collect_set("first").alias("all"), F.collect_set(F.when(F.col("lo") < F.col("doc_key"), F.col("first"))).alias("later"),
    )
    made = placed.select("doc_key", spans(F.col("all")).alias("spans"), spans(F.col("later")).alias("later"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = texts.select("doc_key").distinct().join(made, "doc_key", "left").select(
        F.nullif("doc_key", F.lit(NO_ID)).alias("doc_id"), F.coalesce("spans", none).alias("spans"), F.coalesce("later", none).alias("later_spans"),
    )
    return out.select(
        "doc_id", F.size("spans").cast("long").alias("n_spans"), covered(F.col("spans")).alias("repeated_words"),
        covered(F.col("later_spans")).alias("later_words"), "spans", "later_spans",
    )
