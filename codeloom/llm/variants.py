"""Spelling variants: words one edit apart, found by scanning the sorted vocabulary.

Words that differ by one edit share their first half or their last half (halves of the
shorter one), so the vocabulary is sorted twice, as it is and reversed.  Each sorted list is cut into
slices by a range partitioning; a word visits the slices that can hold words with its first
half.  There it walks the sorted words: the three edit-matrix cells beside the diagonal are kept for
every prefix, a word reuses those of the prefix that it shares with the one before, and where
a prefix has no cell below two edits, all words with that prefix are skipped.  Slices are
skipped alike by the prefix that all of their words share.

A pair is found once: by the shorter word, by the first of two of one length, and reversed
only if the first halves differ.  Vocabulary counts are added up in every task before
they are shuffled, so frequent words and hot sources are small.

Null texts have no words; a null id counts as an empty one.  Repeated rows count each.  Runs are read as
Latin-1 bytes, as all their letters are below U+0100.  An empty table gives no words.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import named, tune, written

SHORTEST, LEAST_COUNT = 6, 5
# A form is so many times as frequent as the word.
RATIO = 5
# One in so many (document, run) loses a letter.
LOSS = 199
# Words of one sorted slice, and counts that a task holds before it hands them on.
SLICE_WORDS, HELD_WORDS = 10_000, 500_000
# Chains of forms grow by RATIO a step, so 64 steps hold any count; each round doubles the steps.
MOST_ROUNDS = 8
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_BEYOND = "\U0010ffff"


def damaged(run: bytes, before: int, loss: int = LOSS) -> bytes:
    """The run without one letter if ``loss`` divides the CRC-32 of id and run; ``before`` is that of the id."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), before)
    if h % loss:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "word": pa.array([w.decode("latin-1") for w in held], pa.string()), "n": pa.array(held.values(), pa.int64()),
        })

    held: Counter[bytes] = Counter()
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            if not text:
                continue
            runs = text.encode("latin-1", "replace").translate(_LETTERS).split()
            before = zlib.crc32(f"{key}:".encode())
            for run, n in Counter([r for r in runs if len(r) >= SHORTEST]).items():
                word = damaged(run, before)
                if len(word) >= SHORTEST:
                    held[word] += n
            if len(held) > HELD_WORDS:
                yield rows()
                held.clear()
    yield rows()


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of at least ``SHORTEST`` letters that occur ``least`` times."""
    rows = named(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text")
    return rows.mapInArrow(word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


Cells = tuple[int, int, int]


def next_cells(cells: Cells, word: str, i: int, letter: str) -> Cells:
    """Edit-matrix cells after ``i + 1`` letters of a listed word, against i, i + 1 and i + 2 letters of ``word``."""
    low, mid, high = cells
    n = len(word)
    a = min(mid + 1, low + (i < 1 or word[i - 1] != letter)) if i <= n else 2
    b = min(mid + (word[i] != letter), a + 1, high + 1) if i < n else 2
    c = min(high + (word[i + 1] != letter), b + 1) if i + 1 < n else 2
    return min(a, 2), min(b, 2), min(c, 2)


def shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def near_prefix(word: str, prefix: str, start: int) -> bool:
    """Can a word with this prefix, whose first ``start`` letters are those of ``word``, be one edit away?"""
    cells: Cells = (1, 0, 1) if start else (2, 0, 1)
    for i in range(start, len(prefix)):
        cells = next_cells(cells, word, i, prefix[i])
        if min(cells) > 1:
            return False
    return True


def scan(word: str, words: list[str], common: list[int]) -> Iterator[int]:
    """Places of the listed words one edit from ``word`` that share its first half and are as long or one longer.

    ``words`` is sorted; ``common[i]`` is the length of the prefix that ``words[i]`` shares with the one before.
    """
    n, half = len(word), len(word) // 2
    at = bisect_left(words, word[:half])
    end = bisect_right(words, word[:half] + _BEYOND)
    # rows[d]: the cells after half + d letters of the current word.
    rows: list[Cells] = [(1, 0, 1)]
    shares = half
    while at < end:
        listed = words[at]
        del rows[shares - half + 1:]
        last = min(len(listed), n + 1)
        for i in range(half + len(rows) - 1, last):
            cells = next_cells(rows[-1], word, i, listed[i])
            rows.append(cells)
            if min(cells) > 1:
                break
        done = half + len(rows) - 1
        if min(rows[-1]) > 1 or len(listed) > done:
            # No word with these letters is near, or all with them are too long: go past them.
            following = bisect_left(words, listed[:done] + _BEYOND, at + 1, end)
        else:
            if len(listed) >= n and rows[-1][n - len(listed) + 1] == 1:
                yield at
            following = at + 1
        if following < end:
            shares = common[following] if following == at + 1 else shared(listed, words[following])
            shares = max(half, min(shares, half + len(rows) - 1))
        at = following


def slice_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of slices that come one after the other: first a slice's sorted words, then the words that visit it."""
    current = None
    words: list[str] = []
    counts: list[int] = []
    common: list[int] = []
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        cols = [batch.column(c).to_pylist() for c in ("slice", "visits", "reversed", "s", "n")]
        for number, visits, backwards, s, n in zip(*cols):
            if number != current:
                current, words, counts, common = number, [], [], []
            if not visits:
                common.append(shared(words[-1], s) if words else 0)
                words.append(s)
                counts.append(n)
                continue
            half = len(s) // 2
            for at in scan(s, words, common):
                a, b = (s[::-1], words[at][::-1]) if backwards else (s, words[at])
                if (len(a) < len(b) or a < b) and not (backwards and a[:half] == b[:half]):
                    for values, value in zip(out, (a, n, b, counts[at])):
                        values.append(value)
        yield pa.RecordBatch.from_arrays([
            pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64()),
        ], names=["a", "a_n", "b", "b_n"])


def visitors(bounds: list[tuple[int, bool, str, str]]):
    """The slices that each word visits; ``bounds`` has number, list, first and last word of every slice."""
    lists = {}
    for backwards in (False, True):
        of_list = sorted((first, last, number) for number, b, first, last in bounds if b == backwards)
        lists[backwards] = (of_list, [first for first, _, _ in of_list], [last for _, last, _ in of_list])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for backwards, s, n in zip(*[batch.column(c).to_pylist() for c in ("reversed", "s", "n")]):
                slices, firsts, lasts = lists[backwards]
                start = s[:len(s) // 2]
                for first, last, number in slices[bisect_left(lasts, start):bisect_right(firsts, start + _BEYOND)]:
                    prefix = first[:shared(first, last)]
                    if len(prefix) <= len(start) or near_prefix(s, prefix[:len(s) + 1], len(start)):
                        for values, value in zip(out, (number, backwards, s, n)):
                            values.append(value)
            yield pa.RecordBatch.from_arrays([
                pa.array(out[0], pa.int32()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64()),
            ], names=["slice", "reversed", "s", "n"])

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: each pair of words one edit apart, once."""
    both = words.select(
        F.explode(F.array(F.struct(F.lit(False).alias("reversed"), F.col("word").alias("s")),
                          F.struct(F.lit(True).alias("reversed"), F.reverse("word").alias("s")))).alias("x"), "n",
    ).select("x.*", "n")
    number = max(1, -(-2 * words.count() // SLICE_WORDS))
    # Written with its slice numbers: the bounds and the slices must come from one and the same sort.
    listed = written(both.repartitionByRange(number, "reversed", "s").withColumn("part", F.spark_partition_id()), "lists")
    # A slice is of one list only; one row per slice reaches the driver.
    slice_number = (F.col("part") * 2 + F.col("reversed").cast("int")).alias("slice")
    listed = listed.select(slice_number, "reversed", "s", "n")
    bounds = [tuple(r) for r in listed.groupBy("slice", "reversed").agg(F.min("s"), F.max("s")).collect()]
    visiting = listed.select("reversed", "s", "n").mapInArrow(visitors(bounds), "slice int, reversed boolean, s string, n long")
    met = listed.withColumn("visits", F.lit(False)).unionByName(visiting.withColumn("visits", F.lit(True)))
    return met.repartition(number, "slice").sortWithinPartitions("slice", "visits", "s").select(
        "slice", "visits", "reversed", "s", "n"
    ).mapInArrow(slice_pairs, "a string, a_n long, b string, b_n long")


def rooted(forms: DataFrame) -> DataFrame:
    """word, root of words with a form: the end of the chain of forms, by doubling steps."""
    steps = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(MOST_ROUNDS):
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = written(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                  F.col("further").isNotNull().alias("moved")), "roots")
        moved = longer.filter("moved").limit(1).count()
        steps = longer.drop("moved")
        if not moved:
            return steps
    raise RuntimeError("chains of forms did not end")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    tune(docs.sparkSession)
    words = written(vocabulary(docs), "words")
    pairs = written(near_pairs(words), "pairs")
    ends = [F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in (("a", "b"), ("b", "a"))]
    best = pairs.select(F.explode(F.array(*ends)).alias("e")).select("e.*").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    near = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.less") >= RATIO * F.col("n"), F.col("best")).alias("best"),
    )
    judged = written(near.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")), "forms")
    roots = rooted(judged.filter("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
