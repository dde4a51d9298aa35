"""Token ids in wavelet-matrix shards.

A shard holds the ids of consecutive documents as bit planes: plane k has bit 15 - k of
every id, where each plane is ordered by the planes before it, zeros first.  With running
counts of ones per plane, one id is read, one id is counted in a prefix, and the n-th
occurrence of an id is found, each in one step per plane and without decoding the shard.

The file format is Parquet with zstd: one file has whole shards, one row per plane with
its bits (packed), the ones before each block of 512 bits, and the number of zeros; row
``plane = -1`` has the documents' ids and lengths.  Spark writes it, so a task that is run
again replaces its file, and any store that Spark reaches will do.

Nulls: a null text is an empty one (only the end id); null ``doc_id`` come first.  Repeated
rows are encoded each.  An empty table gives files without shards.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import named, pieces, work_path

END_ID = 2
# Planes of ids below 65,536; a larger vocabulary gets as many as its ids need.
PLANES = 16
BLOCK_BITS = 512
# A shard is closed at the first document end after so many ids.
SHARD_TOKENS = 1 << 18
# Encoded words, and runs of letters in them, that a worker remembers; later ones are encoded each time.
CACHED_WORDS = 200_000
# Texts are encoded in pieces of about so many bytes: the longer, the more words repeat.
ENCODED_BYTES = 8_000_000
SCHEMA = (
    "part int, shard int, plane int, n_planes int, n_tokens long, zeros long, bits binary, ones binary, "
    "doc_ids array<long>, lengths array<long>"
)
# A word of plain letters with closing marks (no apostrophes) is encoded by its two runs.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)")


class WordEncoder(dict):
    """Ids (as little-endian 32-bit bytes) of texts, word by word; words are remembered.

    White space never joins tokens of this tokenizer, so words can be encoded one by one.
    """

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in set(keep)]
        self.runs: dict[str, bytes] = {}
        self.shown = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(moved)}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            shown = run if run.isascii() else "".join([self.shown[b] for b in run.encode()])
            ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(self.runs) < CACHED_WORDS:
                self.runs[run] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        short = len(word) < 64
        if short and word.isalpha():
            out = self._run(word.lower().decode())
        elif short and (plain := PLAIN.fullmatch(word.decode())):
            letters, marks = plain.groups()
            out = self._run(letters.lower()) + self._run(marks) if marks else self._run(letters.lower())
        else:
            out = array("I", self.whole.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        if short and len(self) < CACHED_WORDS:
            self[word] = out
        return out

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))

    def ids_of(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, each distinct word looked up once; a null text has none."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(list(map(self.__getitem__, distinct)), pa.large_binary()).take(words.indices)
        _, ends, data = ids.buffers()
        at = np.frombuffer(ends, np.int64)[split.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        return [bytes(data[a:b]) for a, b in zip(at, at[1:])]


def gathered(batches: Iterable[pa.RecordBatch], least: int = ENCODED_BYTES) -> Iterator[pa.Table]:
    """Rows of some batches at once, with texts of about ``least`` bytes together."""
    held, total = [], 0
    for batch in pieces(batches, most=least):
        held.append(batch)
        total += batch.column("text").nbytes
        if total >= least:
            yield pa.Table.from_batches(held)
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def build_planes(ids: np.ndarray, planes: int = PLANES) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(packed bits, ones before each block, zeros) of the planes from the highest bit down."""
    out = []
    if len(ids) and int(ids.max()) >> planes:
        raise ValueError(f"an id needs more than {planes} planes")
    for k in range(planes - 1, -1, -1):
        bits = (ids & (1 << k)).astype(bool)
        packed = np.packbits(bits)
        per_byte = np.bitwise_count(packed)
        per_block = np.add.reduceat(per_byte, np.arange(0, len(packed), BLOCK_BITS // 8), dtype=np.int64) if len(bits) else np.empty(0, np.int64)
        ones = np.concatenate([[0], np.cumsum(per_block)]).astype("<u4")
        out.append((packed, ones, len(bits) - int(ones[-1])))
        # Positions are several times faster than masks here, as bits are hard to predict.
        ids = ids[np.concatenate([np.flatnonzero(~bits), np.flatnonzero(bits)])]
    return out


class WaveletMatrix:
    """Reads a shard's planes: ``access``, ``rank`` and ``select`` without decoding it."""

    def __init__(self, planes: list[tuple[bytes, bytes, int]], n_tokens: int):
        self.planes = [(np.frombuffer(b, np.uint8), np.frombuffer(o, "<u4"), z) for b, o, z in planes]
        self.n = n_tokens

    def _ones(self, plane: int, at: int) -> int:
        """Ones of a plane before position ``at``."""
        bits, ones, _ = self.planes[plane]
        block = at // BLOCK_BITS
        part = np.unpackbits(bits[block * BLOCK_BITS // 8:(at + 7) // 8])[:at - block * BLOCK_BITS]
        return int(ones[block]) + int(part.sum())

    def access(self, at: int) -> int:
        """The id at a position."""
        value = 0
        for k, (bits, _, zeros) in enumerate(self.planes):
            bit = int(bits[at >> 3]) >> (7 - (at & 7)) & 1
            ones = self._ones(k, at)
            at = zeros + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        for k, (_, _, zeros) in enumerate(self.planes):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (zeros + a, zeros + b) if value >> (len(self.planes) - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, at: int) -> int:
        """How often an id occurs before a position."""
        lo, hi = self._range(value, 0, at)
        return hi - lo

    def select(self, value: int, nth: int) -> int | None:
        """The position of the n-th (from 0) occurrence of an id, None if there are fewer."""
        lo, hi = self._range(value, 0, self.n)
        if nth >= hi - lo:
            return None
        at = lo + nth
        for k in range(len(self.planes) - 1, -1, -1):
            bit, zeros = value >> (len(self.planes) - 1 - k) & 1, self.planes[k][2]
            at = self._find(k, bit, at - zeros if bit else at)
        return at

    def _find(self, plane: int, bit: int, nth: int) -> int:
        bits, ones, _ = self.planes[plane]
        starts = np.arange(len(ones), dtype=np.int64) * BLOCK_BITS
        before = ones.astype(np.int64) if bit else starts - ones
        block = int(np.searchsorted(before, nth, side="right")) - 1
        block = min(block, max(0, (self.n - 1) // BLOCK_BITS))
        first = block * BLOCK_BITS
        part = np.unpackbits(bits[first // 8:(first + BLOCK_BITS) // 8])[:self.n - first]
        return first + int(np.flatnonzero(part == bit)[nth - int(before[block])])

    def decode(self) -> np.ndarray:
        """All ids in order: from the lowest plane up, each undoes its plane's order."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        ids = np.zeros(self.n, dtype=kind)
        for k in range(len(self.planes) - 1, -1, -1):
            bits, _, zeros = self.planes[k]
            plane = np.unpackbits(bits, count=self.n).view(bool)
            before = np.empty(self.n, dtype=kind)
            before[np.flatnonzero(~plane)] = ids[:zeros]
            before[np.flatnonzero(plane)] = ids[zeros:] | kind(1 << (len(self.planes) - 1 - k))
            ids = before
        return ids.astype(np.uint32)


def shard_rows(part: int, shard: int, doc_ids: list, texts: list[bytes], planes: int = PLANES) -> Iterator[dict]:
    ids = np.frombuffer(b"".join(texts), dtype="<u4")
    ids = ids.astype(np.uint16) if planes <= 16 else ids
    base = {"part": part, "shard": shard, "n_planes": planes, "n_tokens": len(ids), "zeros": None, "bits": None, "ones": None, "doc_ids": None, "lengths": None}
    yield base | {"plane": -1, "doc_ids": doc_ids, "lengths": [len(t) // 4 for t in texts]}
    for k, (bits, ones, zeros) in enumerate(build_planes(ids, planes)):
        yield base | {"plane": k, "zeros": zeros, "bits": bits.tobytes(), "ones": ones.tobytes()}


def encoded(path: str):
    """Sorted documents of one partition to rows of shards."""
    schema = pa.schema([
        ("part", pa.int32()), ("shard", pa.int32()), ("plane", pa.int32()), ("n_planes", pa.int32()), ("n_tokens", pa.int64()), ("zeros", pa.int64()),
        ("bits", pa.binary()), ("ones", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ])
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, size = TaskContext.get().partitionId(), 0, 0
        doc_ids, texts, encoder = [], [], WordEncoder.of(path)
        planes = max(PLANES, (encoder.whole.get_vocab_size() - 1).bit_length())

        def closed() -> Iterator[pa.RecordBatch]:
            for row in shard_rows(part, shard, doc_ids, texts, planes):
                yield pa.RecordBatch.from_pylist([row], schema)

        for rows in gathered(batches):
            for doc_id, ids in zip(rows["doc_id"].to_pylist(), encoder.ids_of(rows["text"].cast(pa.large_string()).combine_chunks())):
                doc_ids.append(doc_id)
                texts.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= SHARD_TOKENS:
                    yield from closed()
                    shard, size, doc_ids, texts = shard + 1, 0, [], []
        if doc_ids:
            yield from closed()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> str:
    """Encode all documents in ascending ``doc_id`` order into shard files under ``path``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = named(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).repartitionByRange(
        parts, F.col("doc_id").asc_nulls_first()
    ).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(encoded(tokenizer), SCHEMA).write.option("compression", "zstd").parquet(path)
    return path


def shard_starts(files: DataFrame) -> DataFrame:
    """part, shard and the number of ids in all shards before; window sums stay within a part."""
    heads = files.filter("plane = -1").select("part", "shard", "n_tokens")
    before = heads.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")
    )
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    return heads.withColumn("inside", inside).join(F.broadcast(before), "part").select(
        "part", "shard", (F.col("before") + F.col("inside")).alias("shard_start")
    )


def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shards, planes in order, to one row per document."""
    planes, head = [], None

    def documents() -> pa.RecordBatch:
        ids = WaveletMatrix(planes, head["n_tokens"]).decode().astype("<u4")
        ends = np.cumsum(head["lengths"])
        starts = ends - head["lengths"]
        sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
        return pa.RecordBatch.from_pydict({
            "part": pa.array([head["part"]] * len(ends), pa.int32()), "shard": pa.array([head["shard"]] * len(ends), pa.int32()),
            "doc_id": pa.array(head["doc_ids"], pa.int64()), "offset": pa.array(starts, pa.int64()),
            "n_tokens": pa.array(head["lengths"], pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
        })

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["plane"] < 0:
                planes, head = [], row
            else:
                planes.append((row["bits"], row["ones"], row["zeros"]))
                if row["plane"] == row["n_planes"] - 1:
                    yield documents()


def read_tokens(spark, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens and the checksum of its ids."""
    files = spark.read.schema(SCHEMA).parquet(path)
    # A shard's planes are brought together by its key, however the files are split for reading.
    rows = files.repartition("part", "shard").sortWithinPartitions("part", "shard", "plane")
    docs = rows.mapInArrow(decoded, "part int, shard int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    starts = shard_starts(files)
    return docs.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_index(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents as shards to the shared folder and read the files back."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return read_tokens(spark, write_tokens(docs, tokenizer, work_path(spark, "tokens")))
