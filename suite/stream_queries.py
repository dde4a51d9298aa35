"""Queries that run as streams over the driver's tables and return what the sink holds."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import checkpoint_folder
from codeloom.plans import incremental
from codeloom.sources.logstate import ANY, FIRST_KNOWN, LAST, LAST_KNOWN, LogState
from codeloom.streaming import state, watch
from suite.history_queries import _SESSIONS, GAP_SECONDS
from suite.registry import query

IDLE_SECONDS = 3600
STREAM_PARTS = 3


def _stream(t, name: str) -> DataFrame:
    """One table of the folder as a file stream."""
    schema = t.table(name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def _folder(t, name: str) -> str:
    return f"{checkpoint_folder(t.spark)}/streams/{name}-{uuid.uuid4().hex}"


def _run(writer) -> None:
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()


def _run_timed(writer, rows: int) -> None:
    """Run until all rows have come in; streams with timers on the clock don't end by themselves."""
    running = writer.trigger(processingTime="0 seconds").start()
    try:
        while running.isActive and sum(p.numInputRows for p in running.recentProgress) < rows:
            time.sleep(0.2)
        if running.exception() is not None:
            raise running.exception()
    finally:
        running.stop()


def _in_parts(t, rows: DataFrame, part, stream, timed: bool = False) -> str:
    """Run a stream over the rows part after part, started anew from its checkpoint each time; its folder.

    ``stream`` makes the rows that go to the sink of the rows that come in.
    """
    out = _folder(t, "parts")
    rows.withColumn("part", part).write.partitionBy("part").parquet(f"{out}/all")
    for number in range(STREAM_PARTS):
        arriving = t.spark.read.parquet(f"{out}/all").filter(F.col("part") == number).drop("part")
        arriving.write.mode("append").parquet(f"{out}/in")
        found, mode = stream(t.spark.readStream.schema(rows.schema).parquet(f"{out}/in"))
        sink = found.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state")
        if mode == "append":
            sink = sink.format("parquet").option("path", f"{out}/rows")
            _run_timed(sink, arriving.count()) if timed else _run(sink)
        else:
            _run(sink.format("noop"))
    return out


def _period(column: str, first: str, days: int):
    """Number of the period that a time is in; the last one has no end."""
    passed = F.floor(F.datediff(F.col(column).cast("date"), F.to_date(F.lit(first))) / days)
    return F.greatest(F.lit(0), F.least(F.lit(STREAM_PARTS - 1), passed)).cast("int")


@query("file_events", f"WITH {_SESSIONS} SELECT project_id, session_start, n_events FROM sessions")
def debounce_stream(t):
    """All bursts: those a later event has closed, and those still open in the state."""
    first, days = t.file_events.agg(F.min("ts").cast("date").cast("string"), F.ceil((F.datediff(F.max("ts"), F.min("ts")) + 1) / STREAM_PARTS)).first()
    out = _in_parts(t, t.file_events, _period("ts", first, days), lambda rows: (
        state.debounce_timed(watch.python_changes(rows), GAP_SECONDS, IDLE_SECONDS), "append"), timed=True)
    bursts = t.spark.read.parquet(f"{out}/rows").select("project_id", "session_start", "n_events").unionByName(
        state.open_bursts(t.spark, f"{out}/state").drop("last_event"))
    return bursts.select("project_id", F.col("session_start").cast("timestamp_ntz"), "n_events")


@query("decisions", """
    SELECT action_type, context_hash, count(*) AS n_decisions, count(*) FILTER (NOT was_approved) AS n_rejected
    FROM (SELECT * FROM decisions WHERE was_approved IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY action_type, context_hash ORDER BY created_at DESC, id DESC) <= 10)
    GROUP BY action_type, context_hash""")
def rejection_rate_stream(t):
    """Decisions come in three batches that are not in order of time; the state holds the last ten of each context."""
    part = F.pmod(F.xxhash64("id"), F.lit(STREAM_PARTS)).cast("int")
    out = _in_parts(t, t.decisions, part, lambda rows: (state.last_decisions(rows), "update"))
    return state.current_rates(t.spark, f"{out}/state").select("action_type", "context_hash", "n_decisions", "n_rejected")


@query("queue", """
    SELECT id, action_type, target FROM queue QUALIFY row_number() OVER (PARTITION BY action_type, target ORDER BY created_at, id) = 1""")
def open_reviews_stream(t):
    out, queue = _folder(t, "open_reviews"), t.queue_of(_stream(t, "lineitem"))
    taken = state.open_reviews(queue, queue.filter(F.lit(False)).withColumnRenamed("id", "review_id"))
    _run(taken.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state"))
    return t.spark.read.parquet(f"{out}/rows").select("id", "action_type", "target")


@query("queue", """
    WITH RECURSIVE asked AS (
        SELECT id, action_type, CAST(owner AS VARCHAR) AS target, true AS is_review, CAST(created_at AS DATE) AS day FROM queue
        UNION ALL SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey), q.action_type, CAST(l_suppkey AS VARCHAR), false, CAST(l_shipdate AS DATE) + CAST(30 + l_partkey % 60 AS INT)
        FROM lineitem JOIN queue q ON q.id = concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) WHERE l_returnflag <> 'N'
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY action_type, target ORDER BY day, is_review, id) AS n FROM asked
    ), walked AS (
        SELECT action_type, target, n, id, is_review AS taken, CASE WHEN is_review THEN id END AS now FROM numbered WHERE n = 1
        UNION ALL
        SELECT e.action_type, e.target, e.n, e.id, e.is_review AND w.now IS NULL,
            CASE WHEN e.is_review AND w.now IS NULL THEN e.id WHEN NOT e.is_review AND w.now = e.id THEN NULL ELSE w.now END
        FROM walked w JOIN numbered e ON e.action_type = w.action_type AND e.target = w.target AND e.n = w.n + 1
    )
    SELECT id, action_type, target FROM walked WHERE taken""")
def decided_reviews_stream(t):
    """Reviews per owner and decisions on them in three periods; a decision frees its target for the next review."""
    items = t.table("lineitem")
    queue = t.queue_of(items).select("id", "action_type", F.col("owner").cast("string").alias("target"), F.col("created_at").cast("date").alias("created_at"))
    decided = t.queue_of(items.filter("l_returnflag <> 'N'").withColumn("l_shipdate", F.date_add("l_shipdate", (30 + F.col("l_partkey") % 60).cast("int"))))
    decided = decided.select("id", "action_type", F.col("owner").cast("string").alias("target"), "created_at")
    both = queue.withColumn("is_review", F.lit(True)).unionByName(decided.withColumn("is_review", F.lit(False)))
    out = _in_parts(t, both, _period("created_at", "1995-01-01", 850), lambda rows: (state.open_reviews(
        rows.filter("is_review"), rows.filter("not is_review").withColumnRenamed("id", "review_id")), "append"))
    return t.spark.read.parquet(f"{out}/rows").select("id", "action_type", "target")


@query("spare", """
    SELECT path, name, alive IS NULL AS is_dead, coalesce(alive, 'no cross-file usage found') AS reason FROM spare""")
def incremental_liveness_stream(t):
    """Liveness after three bursts of changes; every burst parses and judges only what it touched.

    First every module is there but for a third, some in an older form, and with importers that go later; then
    the repositories of even number change to their last form, then the others.
    """
    k, code = F.regexp_extract("path", r"m([0-9]+)\.py", 1).try_cast("long"), t.code
    older = code.filter(k % 3 != 0).withColumn("content", F.when(
        k % 5 == 1, F.concat(F.lit("def older_"), k.cast("string"), F.lit("():\n    pass\n"))).otherwise(F.col("content")))
    guests = code.filter(k % 40 == 0).select(
        "repo", F.concat("repo", F.lit("/guest"), k.cast("string"), F.lit(".py")).alias("path"),
        F.concat(F.lit("from m"), k.cast("string"), F.lit(" import *\n")).alias("content"))
    bursts = code.select(F.col("repo").alias("project_id")).distinct()
    even = F.substring("project_id", 2, 2).cast("int") % 2 == 0
    waves = F.array(F.lit(0), F.when(even, 1).otherwise(2))
    events = bursts.select("project_id", F.explode(waves).alias("wave"))

    def load(scope, batch_id):
        return older.unionByName(guests) if batch_id == 0 else code

    root = _folder(t, "incremental")
    source = f"{root}/in"
    for wave in range(STREAM_PARTS):
        events.filter(F.col("wave") == wave).select("project_id").coalesce(1).write.mode("append").parquet(source)
        arriving = t.spark.readStream.schema("project_id string").parquet(source)
        _run(incremental.refresh_on_change(arriving, load, f"{root}/store", f"{root}/state"))
    return incremental.liveness(incremental.Store(t.spark, f"{root}/store")).select("path", "name", "is_dead", "reason")


@query("", """
    WITH l AS (SELECT *, (o_orderdate, o_orderkey) AS place FROM orders)
    SELECT o_custkey, arg_max(o_orderpriority, place) AS o_orderpriority,
           arg_max(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, place) AS status,
           min(o_orderdate) AS o_orderdate, bool_or(o_totalprice > 300000) AS large
    FROM l GROUP BY o_custkey""")
def state_in_parts(t):
    """Orders as a log in three interleaved parts, one of them sent twice, with a snapshot in between."""
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    log = t.orders.select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", status.alias("status"), (F.col("o_totalprice") > 300000).alias("large"))
    rules = {"o_orderpriority": LAST, "status": LAST_KNOWN, "o_orderdate": FIRST_KNOWN, "large": ANY}
    store = LogState(t.spark, _folder(t, "state"), log.schema, ["o_custkey"], ["o_orderdate", "o_orderkey"], rules)
    for batch, part in enumerate([2, 0, 1]):
        for _ in range(1 + (batch == 1)):
            store.add(batch, log.filter(F.col("o_orderkey") % STREAM_PARTS == part))
        if batch == 1:
            store.compact()
    return store.current()
