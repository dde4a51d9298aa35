"""Words, shared work tables and small column helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import checkpoint_folder

# A word is a run of anything but these six ASCII characters.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Texts are handed to numpy in pieces of about so many bytes.
CHUNK_BYTES = 2_000_000


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def named(docs: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names; others may differ from them by case or hold dots."""
    have = docs.columns
    places = [f"c{i}" for i in range(len(have))]
    return docs.toDF(*places).select(*[F.col(places[have.index(n)]).alias(n) for n in names])


def on_plain_names(docs: DataFrame, roles: Iterable[str], stage: Callable[[DataFrame], DataFrame], added: Iterable[str] = ()) -> DataFrame:
    """``stage`` run on ``docs`` whose other columns have plain names, so none can clash with its own or hold a dot.

    The result has the columns of ``docs`` by their names again, then those that the stage adds.
    """
    roles, added = set(roles), list(added)
    plain = [c if c in roles else f"other{i}" for i, c in enumerate(docs.columns)]
    return stage(docs.toDF(*plain)).select(*plain, *added).toDF(*docs.columns, *added)


def words_column(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, WHITE_RUN), lambda w: w != "")


def id_remainder(name: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % modulus, F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else that of ``spark.codeloom.work.dir``, which a running session can set."""
    return checkpoint_folder(spark)


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that ``column`` holds about ``most`` bytes; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i, size in enumerate(sizes):
            if i > at and total + size > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(size)
        yield batch.slice(at)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[[ord(c) for c in WHITE]] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[ord("A"):ord("Z") + 1] += np.uint64(32)
_BYTE_CODES = mixed(_FOLD * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Word positions and 64-bit hashes (A-Z lower-cased) of the texts of one batch.

    ``starts`` and ``ends`` are byte positions in ``blob``, which joins the texts by line
    feeds; ``doc`` is the row of each word; words of row i are ``first[i]`` to ``first[i + 1]``.
    The hash of a word is a polynomial over random byte codes, taken from running sums.
    """

    SEGMENT = 1 << 18
    _up = _powers(_BASE, 1)
    _down = _powers(_INVERSE, 1)

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        self.n_docs = len(texts)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.blob = np.frombuffer("\n".join(texts.to_pylist()).encode(), dtype=np.uint8)
        at = np.concatenate([[0], np.cumsum(sizes + 1)])
        white = _IS_WHITE[self.blob]
        edge = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.first = np.searchsorted(self.starts, at)
        self.first[-1] = len(self.starts)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=np.uint64)
        i = 0
        while i < len(self.starts):
            lo = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, lo + self.SEGMENT, side="right")))
            n = int(self.ends[j - 1] - lo)
            if len(Words._up) < n:
                Words._up, Words._down = _powers(_BASE, n), _powers(_INVERSE, n)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE_CODES[self.blob[lo:lo + n]] * Words._up[:n], out=sums[1:])
            s, e = self.starts[i:j] - lo, self.ends[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * Words._down[s]
            i = j
        return mixed(out + (self.ends - self.starts).astype(np.uint64))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``size`` words, and a mask of those that stay in one text."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        if size <= 8:
            h = np.zeros(n, dtype=np.uint64)
            for j, p in enumerate(_powers(_BASE, size)):
                h += self.hash[j:j + n] * p
        else:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * _powers(_BASE, len(self.hash)))])
            h = (sums[size:] - sums[:n]) * _powers(_INVERSE, n)
        return mixed(h), self.doc[:n] == self.doc[size - 1:]


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


# Large documents: Spark hands Python few rows at a time.
ARROW_ROWS = "1000"


def tune(spark: SparkSession) -> SparkSession:
    """Arrow batches that stay small with long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark
