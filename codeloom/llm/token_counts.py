"""Exact histogram of encoded lengths, with sums for every context limit.

Documents are counted by their number of tokens; running sums over the few distinct
lengths then answer, for each length L taken as the context limit: how many documents
and tokens fit, how many are longer, what is left if longer ones are cut at L, and which
share of documents is no longer than L (so quantiles are a lookup).

A null text counts as empty (length 0); repeated rows count as often as they stand; an
empty table gives an empty histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import named, pieces

# Lengths are summed in groups of so many; only group totals meet in one window.
GROUP = 256


@lru_cache(maxsize=4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def lengths(path: str):
    """Per batch, how many texts have each number of tokens."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in pieces(batches):
            sizes = np.array([len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()], dtype=np.int64)
            values, counts = np.unique(sizes, return_counts=True)
            yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(values), "n_docs": pa.array(counts.astype(np.int64))})

    return run




def length_histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per occurring length, see the module's text."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    counted = named(docs, "text").mapInArrow(lengths(tokenizer), "n_tokens long, n_docs long")
    table = counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")).withColumn(
        "tokens", F.col("n_tokens") * F.col("n_docs")
    ).withColumn("grp", F.floor(F.col("n_tokens") / GROUP))
    totals = table.groupBy("grp").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    order = Window.orderBy("grp")
    after = Window.orderBy("grp").rowsBetween(1, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    totals = totals.select(
        "grp", (F.sum("d").over(order) - F.col("d")).alias("docs_before"), (F.sum("t").over(order) - F.col("t")).alias("tokens_before"),
        F.coalesce(F.sum("d").over(after), zero).alias("docs_after"), F.coalesce(F.sum("t").over(after), zero).alias("tokens_after"),
    )
    up = Window.partitionBy("grp").orderBy("n_tokens")
    down = Window.partitionBy("grp").orderBy(F.col("n_tokens").desc())
    joined = table.join(totals, "grp")
    joined = joined.select(
        "n_tokens", "n_docs",
        (F.col("docs_before") + F.sum("n_docs").over(up)).alias("docs_within"),
        (F.col("tokens_before") + F.sum("tokens").over(up)).alias("tokens_within"),
        (F.col("docs_after") + F.sum("n_docs").over(down)).alias("docs_at_least"),
        (F.col("tokens_after") + F.sum("tokens").over(down)).alias("tokens_at_least"),
    )
    longer = F.col("docs_at_least") - F.col("n_docs")
    everything = F.col("docs_within") + longer
    return joined.select(
        "*", (F.col("tokens_within") + longer * F.col("n_tokens")).alias("truncated_total"),
        (F.col("docs_within") / everything).alias("share_within"),
    )


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The smallest length that covers ``share`` of the documents."""
    return histogram.filter(F.col("share_within") >= share).agg(F.min("n_tokens").alias("n_tokens"))
