"""Jaccard join of documents on word shingles, by a size-aware heavy-light scheme.

Documents with equal shingle sets are one class.  Classes with few shingles (light) list
every subset of the size that a link needs; linked light classes share one.  Larger
classes (heavy), and light ones that may link with them, stand in inverted lists under
the first shingles of their set, rare ones first: linked classes share one of those.  The
boundary between light and heavy is where the estimated cost is least.

Lists of near copies are long, so pairs are not taken from them directly.  First each
member meets only the list's leader; verified links give components.  Then members
outside the leader's component meet the rest of the list, with bounds on size and
position.  Pairs inside one component need no look, so components come out exact.

Sets are compared as 64-bit hashes of shingles (A-Z lower-cased); a document with fewer
words than a shingle has its whole sequence as its one element, one without words has an
empty set and links with nothing.  A null text is an empty one.  Repeated rows, and rows
that share a ``doc_id``, count each by its own text.  Null ids never become a component's
name while a document with an id is in it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from codeloom.llm.common import Words, as_long, lists, mixed, named, on_plain_names, pieces, tune, written
from codeloom.llm.components import components

SHINGLE = 5
# Links need 100 * intersection >= 75 * union.
PERCENT = 75
# Light sets have at most so many shingles, wherever the cost estimate puts the boundary.
LIGHT_LIMIT = 10
# Shingles known to be frequent come last in every set; only speed depends on them.
FREQUENT = 1 << 16
FREQUENT_IN_PIECE, COUNTED_TOGETHER = 4, 4_000_000
# Ids of classes to verify are broadcast up to this count (8 MB), and shuffled beyond it.
BROADCAST_IDS = 1_000_000


def needed(n: int, m: int) -> int:
    """Least intersection of linked sets of n and m elements."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def shortest_overlap(n: int) -> int:
    """Least intersection with any linked set."""
    return -(-PERCENT * n // 100)


def subset_sizes(n: int, light: int) -> list[int]:
    """Sizes of the subsets that a light set of n elements lists."""
    mates = [m for m in range(1, light + 1) if 100 * min(n, m) >= PERCENT * max(n, m)]
    return sorted({needed(n, m) for m in mates})


def sets_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(batch.column("text"))
    hashes, _ = words.windows(SHINGLE)
    for i in range(words.n_docs):
        lo, hi = words.first[i], words.first[i + 1]
        if hi - lo >= SHINGLE:
            yield np.unique(hashes[lo:hi - SHINGLE + 1])
        elif hi > lo:
            whole = np.array([hi - lo], np.uint64)
            for h in words.hash[lo:hi]:
                whole = mixed(whole * np.uint64(0x9E3779B97F4A7C15) + h)
            yield whole
        else:
            yield np.empty(0, np.uint64)


def node_of(elements: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63)


def described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its set's size and class; per some millions of shingles the frequent ones."""
    met, held = set(), []
    for batch in pieces(batches):
        sets = list(sets_of(batch))
        nodes = [node_of(s) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").cast(pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()),
            "node": pa.array(nodes, pa.int64()), "is_doc": pa.array([True] * len(sets)),
        })
        for node, s in zip(nodes, sets):
            if node is not None and node not in met:
                met.add(node)
                held.append(s)
        if sum(map(len, held)) >= COUNTED_TOGETHER:
            yield often_in(held)
            met, held = set(), []
    if held:
        yield often_in(held)


def often_in(sets: list[np.ndarray]) -> pa.RecordBatch:
    """Shingles that stand in FREQUENT_IN_PIECE of the sets or more."""
    shingles, counts = np.unique(np.concatenate(sets), return_counts=True)
    often = counts >= FREQUENT_IN_PIECE
    k = int(often.sum())
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.nulls(k, pa.int64()), "n": pa.array(counts[often].astype(np.int64)),
        "node": as_long(shingles[often]), "is_doc": pa.array([False] * k, pa.bool_()),
    })


def postings(frequent: np.ndarray, light: int):
    """Entries of the inverted lists: key, class, size, place in the set (-1 for a subset)."""
    def heavy(s: np.ndarray) -> np.ndarray:
        n = len(s)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
            common = frequent[at] == s
            s = np.concatenate([s[~common], s[common]])
        return s[:n - shortest_overlap(n) + 1]

    def subsets(s: np.ndarray) -> np.ndarray:
        sizes = subset_sizes(len(s), light)
        rows = [sum(int(x) * 3 ** i for i, x in enumerate(c)) + k for k in sizes for c in combinations(s, k)]
        return mixed(np.array([r & (2**64 - 1) for r in rows], np.uint64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keys, nodes, sizes, places = [], [], [], []
            seen = set()
            for s in sets_of(batch):
                n = len(s)
                if not n or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                parts = []
                if n <= light:
                    k = subsets(s)
                    parts.append((k, np.full(len(k), -1)))
                # Light sets meet heavy ones in the lists.
                if n > light or 100 * n >= PERCENT * (light + 1):
                    k = heavy(s)
                    parts.append((k, np.arange(len(k))))
                for k, at in parts:
                    keys.append(k)
                    places.append(at)
                    nodes.append(np.full(len(k), node))
                    sizes.append(np.full(len(k), n))
            if keys:
                yield pa.RecordBatch.from_pydict({
                    "key": as_long(np.concatenate(keys)), "node": pa.array(np.concatenate(nodes).astype(np.int64)),
                    "n": pa.array(np.concatenate(sizes).astype(np.int32)), "at": pa.array(np.concatenate(places).astype(np.int32)),
                })

    return run


def set_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sets = list(sets_of(batch))
        prints = [fingerprint(s) for s in sets]
        ends = lambda arrays: np.concatenate([[0], np.cumsum([len(x) for x in arrays])])
        yield pa.RecordBatch.from_pydict({
            "node": pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
            "elements": lists(np.concatenate(sets).view(np.int64), ends(sets), pa.int64()),
            "print": lists(np.concatenate(prints), ends(prints), pa.int64()),
        })


def fingerprint(elements: np.ndarray) -> np.ndarray:
    """A bit per hash slot: whether an odd number of elements falls in it; about four slots an element.

    Two prints differ in no more bits than their sets differ in elements.  Halves added bit
    by bit give the print of half as many slots.
    """
    slots = 1 << max(6, (4 * len(elements) - 1).bit_length())
    odd = np.bincount((elements & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """The light limit of least cost: rows written plus rows met in the lists."""
    def cost(light: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            if n <= light:
                total += count * sum(comb(n, k) for k in subset_sizes(n, light))
            if n > light or 100 * n >= PERCENT * (light + 1):
                total += count * (n - shortest_overlap(n) + 1) * (1 + list_length)
        return total

    return min(range(LIGHT_LIMIT + 1), key=cost)


def may_link(n: str, at: str, m: str, to: str):
    """Bounds on two list entries: sizes, and what can still be shared from their places on."""
    a, b = F.col(n), F.col(m)
    sizes = (100 * F.least(a, b) >= PERCENT * F.greatest(a, b))
    left = F.least(F.when(F.col(at) < 0, a).otherwise(a - F.col(at)), F.when(F.col(to) < 0, b).otherwise(b - F.col(to)))
    return sizes & ((100 + PERCENT) * left >= PERCENT * (a + b))


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets link; only texts of the classes in question are read again."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(classes, "node").select(F.col("first_id").alias("wanted_id")).distinct()
    wanted = written(wanted, "wanted")
    # Few ids are sent to the texts; many meet them in a shuffle.
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    chosen = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    sets = written(chosen.mapInArrow(set_rows, "node long, elements array<long>, print array<long>").filter("node is not null"), "sets")
    def with_both(some: DataFrame, column: str) -> DataFrame:
        one = sets.select(F.col("node").alias("a"), F.col(column).alias("left"), F.size("elements").alias("n"))
        two = sets.select(F.col("node").alias("b"), F.col(column).alias("right"), F.size("elements").alias("m"))
        return some.join(one, "a").join(two, "b")

    def halved(bits: str, other: str) -> Column:
        half = F.floor(F.size(bits) / 2).cast("int")
        folded = F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(bits) > F.size(other), folded).otherwise(F.col(bits))

    # Sizes differ by a third at most, so one halving brings two prints to one length.
    differ = F.aggregate(
        F.zip_with(halved("left", "right"), halved("right", "left"), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0), lambda total, x: total + x,
    )
    most = F.col("n") + F.col("m") - 2 * F.ceil(PERCENT * (F.col("n") + F.col("m")) / (100 + PERCENT))
    likely = written(with_both(pairs, "print").filter(differ <= most).select("a", "b"), "likely")
    shared = F.size(F.array_intersect("left", "right"))
    return with_both(likely, "elements").filter(100 * shared >= PERCENT * (F.col("n") + F.col("m") - shared)).select("a", "b")


def ordered_pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct()


def linked_components(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, the class of its set (``node``) and its component's smallest class (``root``).

    Ids must be whole numbers, as the component is named by the smallest.
    """
    spark = tune(docs.sparkSession)
    texts = named(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    facts = written(texts.mapInArrow(described, "doc_id long, n long, node long, is_doc boolean"), "described")
    members = facts.filter("is_doc").drop("is_doc")
    often = facts.filter("not is_doc").groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(FREQUENT).collect()
    frequent = np.sort(np.array([r.node for r in often], dtype=np.int64).view(np.uint64))
    classes = written(members.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("n").alias("n")), "classes")
    small = classes.filter(F.col("n") <= 2 * LIGHT_LIMIT).groupBy("n").count().collect()
    light = boundary({r["n"]: r["count"] for r in small}, sum(r.n for r in often) / max(1, len(often)))

    entries = texts.mapInArrow(postings(frequent, light), "key long, node long, n int, at int")
    shared = entries.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key")
    listed = written(entries.join(shared, "key").distinct(), "listed")

    links, tried, roots = None, None, None
    for k in range(2):
        current = listed if roots is None else listed.join(roots, "node", "left")
        root = F.col("node") if roots is None else F.coalesce("root", "node")
        current = current.withColumn("root", root)
        leaders = current.groupBy("key").agg(
            F.min(F.struct("at", "n", "node", "root")).alias("head"), F.min("root").alias("lo"), F.max("root").alias("hi")
        ).filter("lo < hi").select(
            "key", F.col("head.node").alias("y"), F.col("head.n").alias("m"), F.col("head.at").alias("to"), F.col("head.root").alias("head")
        )
        outside = current.join(leaders, "key").filter("root <> head").select(
            "key", F.col("node").alias("x"), "n", "at", "root", "y", "m", "to", "head"
        )
        if k:
            rest = current.select("key", F.col("node").alias("y"), F.col("n").alias("m"), F.col("at").alias("to"), F.col("root").alias("head"))
            outside = outside.select("key", "x", "n", "at", "root").join(rest, "key").filter("root <> head")
        pairs = ordered_pairs(outside.filter(may_link("n", "at", "m", "to")))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        new = written(verified(pairs, classes, texts), "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = new if links is None else links.unionByName(new)
        if not k or not new.isEmpty():
            roots = written(components(links), "roots")

    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    rooted = rooted.join(names, "root").select(F.col("node").alias("of"), "component_id", "root")
    out = members.join(rooted, F.col("node") == F.col("of"), "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "node", "root"
    )


def with_class(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the class of their own set in ``dup_class``."""
    for batch in pieces(batches):
        nodes = [node_of(s) if len(s) else None for s in sets_of(batch)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(batch.num_columns)), pa.array(nodes, pa.int64())], names=[*batch.schema.names, "dup_class"]
        )


def without_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: one of smallest id.

    Each row counts by its own set, also where rows share an id.  Rows without words are
    kept; rows without an id are kept too, as no group can name them.
    """
    return on_plain_names(docs, ["doc_id", "text"], _first_of_components)


def _first_of_components(docs: DataFrame) -> DataFrame:
    found = linked_components(docs).filter("doc_id is not null").withColumnRenamed("doc_id", "dup_id")
    # A component is named by one of its ids; of that id's classes in it, the first one stays.  An id may name several components.
    stays = found.filter("component_id = dup_id and node is not null").groupBy("dup_id", "root").agg(F.min("node").alias("dup_stays"))
    stays = written(stays.select("dup_id", "dup_stays"), "stays")
    verdicts = written(found.groupBy("dup_id").agg(
        F.count("*").alias("rows"), F.count(F.when(F.col("node").isNull() | (F.col("component_id") == F.col("dup_id")), 1)).alias("standing"),
    ).filter("standing = 0 or rows > 1"), "verdicts")
    same = F.col("doc_id") == F.col("dup_id")
    kept = docs.join(verdicts.select("dup_id"), same, "left_anti")
    several = verdicts.filter("standing > 0").select("dup_id")
    if several.isEmpty():
        return kept
    classed = docs.join(several, same, "left_semi").mapInArrow(with_class, StructType([*docs.schema.fields, StructField("dup_class", LongType())]))
    standing = classed.join(stays, same & (F.col("dup_class") == F.col("dup_stays")), "left_semi")
    # One of the rows that agree in id and set: combined before the shuffle, so a repeated row is no hot key.
    one = standing.groupBy("doc_id", "dup_class").agg(F.min_by(F.struct(*docs.columns), "text").alias("row")).select("row.*")
    return kept.unionByName(one).unionByName(classed.filter("dup_class is null").select(*docs.columns))
