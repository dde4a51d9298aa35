"""Benchmark items inside documents, by pigeonhole edit matching.

Texts are lower-cased and everything but letters and digits becomes one blank.  An item of
m characters may differ by a budget of k edits, so at least one of its k + 1 pieces stands
unchanged in the document.  Pieces are found together by an Aho-Corasick automaton.  A hit
climbs a tree of pieces: a node over c pieces may have c - 1 edits, and where the whole
item is within its budget, every node from some hit piece up to the root is within its
own.  Each step is checked by Myers' bit-parallel distance, so false hits fail early and
no match within the budget is lost.

Items come in blocks of bounded size, one pass over the documents per block; the number of
items is not limited.  Null or empty texts and items match nothing.  ``contamination`` has
one row per ``doc_id``, for all rows that share it (null ids count as one id);
``decontaminated`` judges each row by its own text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import named, on_plain_names, pieces, tune, written

ERROR_RATE = 0.08
# Pieces are at least so long; the budget shrinks for short items.
PIECE_CHARS = 10
BLOCK_CHARS = 4_000_000
OTHER = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    return OTHER.sub(" ", (text or "").lower()).strip()


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return max(0, min(int(rate * length), length // PIECE_CHARS - 1))


def best_end(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern of m characters to any substring of ``text``, and where it ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    get = masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = (minus | ~(horizontal | plus)) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, i + 1
        up, down = up << 1 & full, down << 1 & full
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical
    return best, end


class Item:
    """An item's pieces and the tree above them, with character masks made on first use."""

    def __init__(self, item_id: int, text: str):
        self.item_id, self.text = item_id, text
        self.k = budget(len(text))
        n = self.k + 1
        self.bounds = [len(text) * i // n for i in range(n + 1)]
        self.masks: dict[tuple[int, int], dict[str, int]] = {}
        self.paths = [self._path(i) for i in range(n)]

    def _path(self, piece: int) -> list[tuple[int, int]]:
        """Ranges of pieces from the leaf's parent to the root."""
        lo, hi, path = 0, self.k + 1, []
        while hi - lo > 1:
            path.append((lo, hi))
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if piece < mid else (mid, hi)
        return path[::-1]

    def mask(self, node: tuple[int, int]) -> dict[str, int]:
        if node not in self.masks:
            out: dict[str, int] = {}
            for i, c in enumerate(self.text[self.bounds[node[0]]:self.bounds[node[1]]]):
                out[c] = out.get(c, 0) | 1 << i
            self.masks[node] = out
        return self.masks[node]

    def match(self, piece: int, text: str, at: int) -> tuple[int, int] | None:
        """(distance, end) of the item around a hit of one piece at ``at``, if within budget."""
        found = (0, at + len(self.text))
        for lo, hi in self.paths[piece]:
            start, stop, most = self.bounds[lo], self.bounds[hi], hi - lo - 1
            begin = max(0, at - (self.bounds[piece] - start) - most)
            window = text[begin:at + (stop - self.bounds[piece]) + most]
            distance, end = best_end(self.mask((lo, hi)), stop - start, window)
            if distance > most:
                return None
            found = (distance, begin + end)
        return found


@lru_cache(maxsize=2)
def machine(block: tuple[tuple[int, str], ...]):
    """The items of a block and the automaton of all their pieces."""
    items = [Item(item_id, text) for item_id, text in block]
    owners: dict[str, list[tuple[int, int]]] = {}
    for n, item in enumerate(items):
        for piece in range(item.k + 1):
            owners.setdefault(item.text[item.bounds[piece]:item.bounds[piece + 1]], []).append((n, piece))
    automaton = ahocorasick.Automaton()
    for piece, owner in owners.items():
        automaton.add_word(piece, (len(piece), owner))
    automaton.make_automaton()
    return items, automaton


def matches(text: str, block: tuple[tuple[int, str], ...]) -> list[dict]:
    """The best match of each item in a plain text: item_id, distance, start (about) and end."""
    items, automaton = machine(block)
    best: dict[int, tuple[int, int]] = {}
    done: dict[int, int] = {}
    for last, (length, owners) in automaton.iter(text):
        at = last + 1 - length
        for n, piece in owners:
            # The rest of a match already found needs no second look.
            if done.get(n, -1) > at or best.get(n, (1,))[0] == 0:
                continue
            found = items[n].match(piece, text, at)
            if found:
                done[n] = found[1]
                best[n] = min(best.get(n, found), found)
    return [
        {"item_id": items[n].item_id, "distance": d, "start": max(0, e - len(items[n].text)), "end": e}
        for n, (d, e) in sorted(best.items())
    ]


HIT = pa.struct([("item_id", pa.int64()), ("distance", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
HITS = "array<struct<item_id:long,distance:long,start:long,end:long>>"


def searched(block: tuple[tuple[int, str], ...]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [matches(plain(t), block) if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "hits": pa.array(found, pa.list_(HIT)),
            })

    return run


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[tuple[tuple[int, str], ...]]:
    """Items with text, in id order, in blocks of about ``most`` characters; one block is held at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        text = plain(row.text)
        if text:
            block.append((row.item_id, text))
            size += len(text)
        if size >= most:
            yield tuple(block)
            block, size = [], 0
    if block:
        yield tuple(block)


def same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per ``doc_id``: contaminated, n_items, least distance, and the matches."""
    tune(docs.sparkSession)
    texts = named(docs, "doc_id", "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = None
    for block in blocks(benchmark):
        one = texts.mapInArrow(searched(block), f"doc_id {kind}, hits {HITS}").filter("size(hits) > 0")
        found = one if found is None else found.unionByName(one)
    ids = texts.select("doc_id").distinct()
    if found is None:
        joined = ids.withColumn("hits", F.array().cast(HITS))
    else:
        hits = written(found, "hits").select("doc_id", F.explode("hits").alias("hit"))
        best = hits.groupBy("doc_id", "hit.item_id").agg(F.min(F.struct("hit.distance", "hit.start", "hit.end")).alias("b"))
        grouped = best.groupBy("doc_id").agg(F.sort_array(F.collect_list(
            F.struct("item_id", "b.distance", "b.start", "b.end")
        )).alias("hits")).withColumnRenamed("doc_id", "hit_id")
        joined = ids.join(grouped, same("doc_id", "hit_id"), "left").select(
            "doc_id", F.coalesce("hits", F.array().cast(HITS)).alias("hits")
        )
    return joined.select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"),
        F.array_min(F.transform("hits", lambda h: h["distance"])).alias("least_distance"), "hits",
    )


def clean(block: tuple[tuple[int, str], ...]):
    """The rows whose own text holds no item of the block."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(pa.array([not (t and matches(plain(t), block)) for t in batch.column("text").to_pylist()], pa.bool_()))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; each row is judged by its own text."""
    tune(docs.sparkSession)

    def without(rows: DataFrame) -> DataFrame:
        for block in blocks(benchmark):
            rows = rows.mapInArrow(clean(block), rows.schema)
        return rows

    return on_plain_names(docs, ["text"], without)
