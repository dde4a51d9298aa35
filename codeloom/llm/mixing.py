"""Mixing sources to target weights, block by block, with column expressions only.

The words of a source, documents in a fixed order, are one long tape cut into blocks of
``block_words``.  A mix takes as many words of a source as its target says, in passes over
the tape; each pass has the blocks in a pseudorandom order of its own, and the last one
ends where the target is met.  Slot i of pass p has the number p * blocks + i.  Every slot
draws its output shard by a keyed hash, so the counts of sources in a shard are a
multinomial draw while the totals stay exact.  Slots find their block through a keyed
permutation of the source's block numbers and join the blocks by number.

Nulls: a null text has no words and is never taken; a null source is a source of its own,
the last one.  Repeated rows count as often as they stand.  Empty tables give empty mixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import let
from codeloom.llm.common import named, on_plain_names, text_or_empty, words_column, written

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 512
SLOTS_PER_SHARD = 4096
# Running sums go over groups of documents first; only the group totals meet in one window.
GROUPS = 512
SLOT_CHUNK = 4096
SEED = 20240


def sized(docs: DataFrame) -> DataFrame:
    return named(docs, "doc_id", "source", "text").select("doc_id", "source", F.size(words_column(text_or_empty())).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Per source: size, weight and target words.

    A target is ``min(most * size, rate * weight)`` with one rate for all, chosen so that
    targets add up to ``share`` of all words; that is where resharing the excess ends.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sources.withColumn("turn", F.row_number().over(turn) - 1).withColumn(
        "weight", F.get(F.array(*map(F.lit, weights)), F.col("turn") % len(weights)).cast("long")
    ).withColumn("cap", most * F.col("source_size"))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    whole = Window.partitionBy()
    level = listed.withColumn("next", F.lead(F.col("cap") / F.col("weight")).over(by_need)).withColumns({
        "capped": F.sum("cap").over(by_need), "weighed": F.sum("weight").over(by_need),
        "all_words": F.sum("source_size").over(whole), "all_weights": F.sum("weight").over(whole),
    }).withColumn("goal", F.col("all_words") * share)
    # The rate if all sources up to this one are at their cap, and the first one may be none.
    none = F.col("goal") / F.col("all_weights")
    rate = (F.col("goal") - F.col("capped")) / F.nullif(F.col("all_weights") - F.col("weighed"), F.lit(0))
    fits = rate <= F.col("next")
    place = F.row_number().over(by_need)
    level = level.withColumn("first", F.when(fits, F.struct(place.alias("place"), rate.alias("rate")))).withColumn("none", none).withColumn(
        "lowest", F.min(F.col("cap") / F.col("weight")).over(whole)
    ).withColumn(
        "rate", F.when(F.col("none") <= F.col("lowest"), F.col("none")).otherwise(F.min("first").over(whole)["rate"])
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("rate"), F.lit(0.0)) * F.col("weight"))
    return level.select("source", "turn", "source_size", "weight", target.alias("target"))


def on_tape(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with words, with their source's ``turn`` and their first word's place on its tape."""
    group = F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)).alias("grp")
    placed = sizes.filter("size > 0").join(
        F.broadcast(sources.select(F.col("source").alias("s"), "turn")), F.col("source").eqNullSafe(F.col("s"))
    ).select("doc_id", "size", "turn", group)
    before = placed.groupBy("turn", "grp").agg(F.sum("size").alias("n")).select(
        "turn", "grp", (F.sum("n").over(Window.partitionBy("turn").orderBy("grp")) - F.col("n")).alias("before")
    )
    inside = Window.partitionBy("turn", "grp").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long"))).join(
        before, ["turn", "grp"]
    ).select("doc_id", "size", "turn", (F.col("before") + F.col("inside")).alias("start"))


def shuffled(index: Column, n: Column, turn: Column, seed: int) -> Column:
    """A keyed permutation of 0 .. n - 1: a four-round Feistel network on a square, walked until inside."""
    def step(side: Column, x: Column) -> Column:
        def mix(k: int, value: Column) -> Column:
            return F.pmod(F.xxhash64(F.lit(seed), F.lit(k), turn, value), side)

        def pair(left: Column, right: Column) -> Column:
            return F.struct(left.alias("l"), right.alias("r"))

        state = pair(F.floor(x / side).cast("long"), F.pmod(x, side))
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(4)), state,
            lambda s, k: pair(s["r"], F.pmod(s["l"] + F.pmod(F.xxhash64(F.lit(seed), k, turn, s["r"]), side), side)),
            lambda s: s["l"] * side + s["r"],
        )

    def walked(side: Column) -> Column:
        # At most 2 * side - 1 numbers of the square are outside; beyond 64 steps the odds are nil.
        return F.aggregate(
            F.sequence(F.lit(1).cast("long"), F.least(2 * side, F.lit(64).cast("long"))),
            F.struct(step(side, index).alias("x")),
            lambda s, _: F.when(s["x"] < n, s).otherwise(F.struct(step(side, s["x"]).alias("x"))),
            lambda s: s["x"],
        )

    return let(F.ceil(F.sqrt(n.cast("double"))).cast("long"), walked)


def slots(sources: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """Slots of the whole target of each source: turn, pass, slot, shard, block and words taken of it."""
    wanted = F.round("target").cast("long")
    size, left = F.col("source_size"), F.col("left")
    rows = sources.filter("source_size > 0").withColumn("wanted", wanted).filter("wanted > 0").withColumn(
        "n_blocks", F.ceil(size / block_words).cast("long")
    ).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("wanted") - 1) / size).cast("long"))))
    rows = rows.withColumn("left", F.least(size, F.col("wanted") - F.col("pass") * size)).withColumn(
        "n_slots", F.least(F.floor(left / block_words).cast("long") + 2, F.col("n_blocks"))
    )
    shards = F.ceil(F.sum("n_slots").over(Window.partitionBy()) / SLOTS_PER_SHARD).cast("long")
    rows = rows.withColumn("shards", shards)
    chunks = rows.withColumn("chunk", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / SLOT_CHUNK).cast("long")
    ))).repartition("turn", "pass", "chunk")
    first, last = F.col("chunk") * SLOT_CHUNK, F.least((F.col("chunk") + 1) * SLOT_CHUNK, F.col("n_slots")) - 1
    each = chunks.withColumn("nth", F.explode(F.sequence(first, last)))
    each = each.withColumn("block", shuffled(F.col("nth"), F.col("n_blocks"), F.struct("turn", "pass"), seed))
    # The last block may be short; slots of its pass after it begin earlier by what it lacks.
    tail = size - (F.col("n_blocks") - 1) * block_words
    short = each.filter(F.col("block") == F.col("n_blocks") - 1).select(
        F.col("turn").alias("t"), F.col("pass").alias("p"), F.col("nth").alias("short_nth")
    )
    each = each.join(F.broadcast(short), (F.col("turn") == F.col("t")) & (F.col("pass") == F.col("p")), "left")
    begin = F.col("nth") * block_words - F.when(F.col("nth") > F.col("short_nth"), block_words - tail).otherwise(0)
    length = F.when(F.col("block") == F.col("n_blocks") - 1, tail).otherwise(block_words)
    words = F.least(length, left - begin)
    each = each.withColumn("slot", F.col("pass") * F.col("n_blocks") + F.col("nth"))
    shard = F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "turn", "slot"), F.col("shards"))
    return each.select("turn", "pass", "slot", shard.alias("shard"), "block", words.alias("words")).filter("words > 0")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2,
    block_words: int = BLOCK_WORDS, seed: int = SEED,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources with targets, slots, takings).

    Takings have doc_id, start (its place on the tape), size, taken (words) and ``parts``,
    the word ranges taken, as (pass, from, count, slot, shard).  Slots say which block
    stands where in which output shard, for every word of the mix.
    """
    sizes = written(sized(docs), "sizes")
    sources = written(targets(sizes, weights, share, most), "sources")
    tape = on_tape(sizes, sources)
    drawn = slots(sources, block_words, seed)
    whole = tape.join(F.broadcast(sources.select("turn", "source", "source_size", "target")), "turn")
    end = F.col("start") + F.col("size")
    held = whole.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words)
    )))
    # A document of many blocks is many rows here; a block is in one slot of each pass at most.
    at = F.col("block") * block_words
    took = F.least(at + F.col("words"), end) - F.greatest(at, F.col("start"))
    joined = held.join(drawn, ["turn", "block"], "left").withColumn(
        "count", F.when(F.col("words").isNull(), F.lit(0)).otherwise(F.greatest(took, F.lit(0)))
    )
    part = F.when(F.col("count") > 0, F.struct(
        "pass", (F.greatest(at, F.col("start")) - F.col("start")).alias("from"), "count", "slot", "shard",
    ))
    takings = joined.groupBy("turn", "start", "doc_id", "size", "source", "source_size", "target").agg(
        F.sum("count").cast("long").alias("taken"), F.sort_array(F.collect_list(part)).alias("parts"),
    )
    return sources, drawn, takings


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per document: size, its source's size and target, and the words the mix takes."""
    options = dict(options)
    sources, _, takings = mix(docs, **options)
    some = takings.select("doc_id", "size", "source", "source_size", "target", "taken")
    sizes = sized(docs).filter("size = 0").join(
        F.broadcast(sources.select(F.col("source").alias("s"), "source_size", "target")), F.col("source").eqNullSafe(F.col("s"))
    )
    return some.unionByName(sizes.select("doc_id", "size", "source", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with their own columns and the text it takes of them.

    A pass whose slots hold all words of a document gives its text as it is; else the words
    taken stand in order, with single blanks.  Texts taken more than once follow each other after a line feed, so that
    ``doc_id`` stays unique; ``n_chars`` is counted anew.
    """
    roles = ["doc_id", "source", "text", "n_chars"]
    return on_plain_names(docs, roles, lambda rows: _mixed_rows(rows, **options))


def _mixed_rows(docs: DataFrame, **options) -> DataFrame:
    _, _, takings = mix(docs, **options)
    # All passes but the last hold every word, so the words taken say which pass holds a part.
    passes = F.floor(F.col("taken") / F.col("size")).cast("long")
    key = takings.filter("taken > 0").select(
        F.col("doc_id").alias("mix_id"), F.col("size").alias("mix_size"), F.col("source").alias("mix_source"),
        passes.alias("mix_passes"), F.filter("parts", lambda p: p["pass"] >= passes).alias("mix_parts"),
    )
    # Rows that agree in id, source and size are the same for the tape; each takes one of the takings.
    like = ["mix_id", "mix_source", "mix_size"]
    key = key.withColumn("mix_copy", F.row_number().over(Window.partitionBy(*like).orderBy("mix_passes", "mix_parts")))
    words = F.size(words_column(text_or_empty())).cast("long")
    rows = docs.withColumns({"mix_doc_size": words}).withColumn("mix_nth", F.row_number().over(
        Window.partitionBy("doc_id", "source", "mix_doc_size").orderBy("text")
    ))
    joined = rows.join(
        key, F.col("doc_id").eqNullSafe(F.col("mix_id")) & F.col("source").eqNullSafe(F.col("mix_source"))
        & (F.col("mix_doc_size") == F.col("mix_size")) & (F.col("mix_nth") == F.col("mix_copy")),
    )

    def part(words: Column) -> Column:
        return F.array_join(F.flatten(F.transform(
            F.col("mix_parts"), lambda p: F.slice(words, (p["from"] + 1).cast("int"), p["count"].cast("int"))
        )), " ")

    partly = F.when(F.size("mix_parts") > 0, let(words_column(F.col("text")), part))
    copies = F.array_repeat(F.col("text"), F.col("mix_passes").cast("int"))
    text = F.array_join(F.concat(copies, F.when(partly.isNotNull(), F.array(partly)).otherwise(F.array().cast("array<string>"))), "\n")
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)
