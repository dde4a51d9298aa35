"""Window-like results that survive one key holding a large share of the rows.

A window over a hot key runs in one task.  The helpers here split a key's rows into
ordered slots (a coarse, monotone function of the ordering), solve each slot alone
and carry only one small row per slot across the slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPREAD_SETTING = "spark.codeloom.input.partitions"
# Rows a task gets where much work is made of each: some seconds of parsing, and some ten MB of rows to sort.
ROWS_A_TASK = 5_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for rows that much work is made of: the session's, four a core at least, and one for ROWS_A_TASK rows."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


def spread(df: DataFrame, *keys: str, always: bool = False) -> DataFrame:
    """Redistribute an input over as many partitions as the session asks for.

    Without the setting the input stays as it was scanned.
    It is meant for files of one row group, which no scan can split.  ``always`` is for narrow rows
    that much work is made of, such as texts to parse: without the setting they go to the session's
    shuffle partitions, to four a core at least, and to as many more as their number asks for, so that
    a task's time and memory don't grow with the input.
    """
    spark = df.sparkSession
    wanted = spark.conf.get(SPREAD_SETTING, None)
    if wanted is None and always:
        wanted = parts_for(spark, df.count())
    return df.repartition(int(wanted), *keys) if wanted else df


def rank_within(
    df: DataFrame, keys: list[str], order_by: list[Column], slot: Column, name: str = "position"
) -> DataFrame:
    """Exact ``row_number`` per key without bringing a key into one task.

    ``slot`` must not decrease along ``order_by``.  It should be coarse: a key's slots are
    counted in one task, its rows never are.
    """
    slotted = df.withColumn("_slot", slot)
    sizes = slotted.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_slot").alias("_kslot"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    local = Window.partitionBy(*keys, "_slot").orderBy(*order_by)
    numbered = slotted.withColumn("_rn", F.row_number().over(local))
    same = F.col("_slot").eqNullSafe(F.col("_kslot"))
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_k{i}"))
    ranked = numbered.join(offsets, same, "left").withColumn(
        name, (F.col("_rn") + F.col("_offset")).cast("long")
    )
    return ranked.drop("_slot", "_kslot", "_rn", "_offset", *[f"_k{i}" for i in range(len(keys))])


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    point: str,
    start: str,
    end: str,
    width: int,
    how: str = "left",
    open_start: bool = False,
) -> DataFrame:
    """Match points to the intervals that contain them by equality on (keys, bucket).

    Each interval is listed once per bucket of ``width`` that it touches, so a point
    only meets intervals of its own bucket and a hot key is split along the axis.
    """
    def bucket(column):
        return F.floor(F.col(column) / F.lit(width))

    left = points.withColumn("_bucket", bucket(point))
    right = intervals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.col(c) for c in intervals.columns if c not in keys],
        F.explode(F.sequence(bucket(start), bucket(end))).alias("_ibucket"),
    )
    lower = F.col(start) < F.col(point) if open_start else F.col(start) <= F.col(point)
    cond = (F.col("_bucket") == F.col("_ibucket")) & lower & (F.col(point) <= F.col(end))
    for i, key in enumerate(keys):
        cond = cond & (F.col(key) == F.col(f"_k{i}"))
    return left.join(right, cond, how).drop("_bucket", "_ibucket", *[f"_k{i}" for i in range(len(keys))])


def sessionise(
    events: DataFrame, key: str, ts: str, order_id: str, gap_seconds: int, chunk_seconds: int = 86400
) -> DataFrame:
    """Add ``session_start`` per key: a new session begins after a pause longer than ``gap_seconds``.

    A pause of exactly the gap goes on with the session, as in ``session_window``.

    Rows are ordered inside (key, time chunk).  What a chunk has to know about earlier
    ones - their last event and their last session start - is one row per chunk.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.withColumn("_us", micros).withColumn(
        "_chunk", F.floor(F.col("_us") / F.lit(chunk_seconds * 1_000_000))
    )
    in_chunk = Window.partitionBy(key, "_chunk").orderBy("_us", order_id)
    per_chunk = Window.partitionBy("_key").orderBy("_chunk_id")
    earlier = per_chunk.rowsBetween(Window.unboundedPreceding, -1)

    # First event of a chunk: does it follow closely on the chunk before?  Later events
    # only look inside the chunk.
    prev = F.lag("_us").over(in_chunk)
    local = rows.withColumn("_prev", prev).withColumn(
        "_local_start",
        F.when(F.col("_prev").isNotNull() & (F.col("_us") - F.col("_prev") > gap_seconds * 1_000_000), F.col("_us")),
    )
    chunks = rows_summary(rows, key, gap_seconds)
    carried = (
        chunks.withColumn("_before", F.lag("_last").over(per_chunk))
        .withColumn(
            "_opens",
            F.col("_before").isNull() | (F.col("_first") - F.col("_before") > gap_seconds * 1_000_000),
        )
        .withColumn("_final_start", F.coalesce("_inner_start", F.when(F.col("_opens"), F.col("_first"))))
        .withColumn("_open_start", F.last("_final_start", ignorenulls=True).over(earlier))
        .select(
            "_key",
            "_chunk_id",
            F.when(F.col("_opens"), F.col("_first")).otherwise(F.col("_open_start")).alias("_carry"),
        )
    )
    so_far = in_chunk.rowsBetween(Window.unboundedPreceding, 0)
    joined = local.withColumn("_own", F.last("_local_start", ignorenulls=True).over(so_far)).join(
        carried, (F.col(key) == F.col("_key")) & (F.col("_chunk") == F.col("_chunk_id")), "left"
    )
    start = F.timestamp_micros(F.coalesce("_own", "_carry"))
    return joined.withColumn("session_start", start).drop(
        "_us", "_chunk", "_prev", "_local_start", "_own", "_key", "_chunk_id", "_carry"
    )


def rows_summary(rows: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """One row per (key, chunk): first and last event, and the last start inside the chunk."""
    in_chunk = Window.partitionBy(key, "_chunk").orderBy("_us")
    return (
        rows.select(key, "_chunk", "_us")
        .withColumn("_prev", F.lag("_us").over(in_chunk))
        .groupBy(F.col(key).alias("_key"), F.col("_chunk").alias("_chunk_id"))
        .agg(
            F.min("_us").alias("_first"),
            F.max("_us").alias("_last"),
            F.max(F.when(F.col("_us") - F.col("_prev") > gap_seconds * 1_000_000, F.col("_us"))).alias("_inner_start"),
        )
    )
