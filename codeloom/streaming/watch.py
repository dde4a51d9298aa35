"""Change events, debounce and re-analysis.

What a batch writes goes through ``foreachBatch`` into folders named by batch id, so a batch
that is run again after a failure overwrites its own output.  State that lives across
batches is in ``codeloom.streaming.state``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from codeloom.functions import vocab
from codeloom.operators import history
from codeloom.operators.skew import sessionise
from codeloom.schemas import FILE_EVENTS
from codeloom.session import checkpoint_folder


# ------------------------------------------------------------------ events
def python_changes(events: DataFrame) -> DataFrame:
    """Created or modified Python files; works on streams and tables."""
    return events.filter(
        F.endswith("path", F.lit(".py")) & ~F.col("is_dir") & F.col("kind").isin("modified", "created")
    )


def read_file_events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Change events dropped as Parquet files into a folder."""
    stream = (
        spark.readStream.schema(FILE_EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )
    return python_changes(stream)


def watched(events: DataFrame, projects: DataFrame) -> DataFrame:
    """Events of projects that are being watched (stream-static semi join)."""
    active = projects.filter(F.col("status") == "watching").select("project_id")
    return events.join(active, "project_id", "left_semi")


# ------------------------------------------------------------------ debounce
def debounce(events: DataFrame, gap: str = vocab.DEBOUNCE, lateness: str = "1 minute") -> DataFrame:
    """One row per project and burst of changes, emitted once the burst is over.

    For streams.  A burst ends after a pause longer than ``gap``; later rows than the watermark
    allows are dropped.
    """
    return (
        events.withWatermark("ts", lateness)
        .groupBy("project_id", F.session_window("ts", gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select("project_id", F.col("session.start").alias("session_start"), F.col("session.end").alias("fires_at"), "n_events")
    )


def debounce_table(events: DataFrame, gap_seconds: int, order_id: str, chunk_seconds: int = 86400) -> DataFrame:
    """The same bursts over a stored table; a busy project is split along time."""
    started = sessionise(events, "project_id", "ts", order_id, gap_seconds, chunk_seconds)
    return started.groupBy("project_id", "session_start").agg(
        F.count(F.lit(1)).alias("n_events"),
        (F.max(F.col("ts").cast("timestamp")) + F.make_dt_interval(secs=F.lit(gap_seconds))).alias("fires_at"),
    )


# ------------------------------------------------------------------ per-batch work
def _batch_folder(root: str, name: str, batch_id: int) -> str:
    return f"{root}/{name}/batch_id={batch_id}"


def on_change(
    sessions: DataFrame, files: DataFrame, analyse: Callable[[DataFrame], DataFrame], output: str, checkpoint: str | None = None
) -> DataStreamWriter:
    """Re-analyse the projects whose bursts have ended.

    ``analyse`` maps the projects' files to review rows.  Reviews and one notification per
    project go to ``output``.
    """
    folder = checkpoint or f"{checkpoint_folder(sessions.sparkSession)}/on_change"

    def run(batch: DataFrame, batch_id: int) -> None:
        fired = batch.groupBy("project_id").agg(F.max("fires_at").alias("fires_at"))
        changed = files.join(fired.select(F.col("project_id").alias("repo")), "repo", "left_semi")
        reviews = analyse(changed)
        reviews.write.mode("overwrite").parquet(_batch_folder(output, "reviews", batch_id))
        stored = batch.sparkSession.read.parquet(_batch_folder(output, "reviews", batch_id))
        session = F.concat_ws("_", F.col("project_id"), F.lit(str(batch_id)))
        runs = fired.select(
            session.alias("session_id"), "project_id", F.col("project_id").alias("project_name"),
            F.lit(None).cast("int").alias("findings_count"), F.lit(None).cast("string").alias("username"),
        )
        waiting = stored.select(F.concat_ws("_", F.col("repo"), F.lit(str(batch_id))).alias("session_id"))
        history.notify(waiting, runs).write.mode("overwrite").parquet(_batch_folder(output, "notifications", batch_id))

    return sessions.writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", folder)


def dedup_bounded(reviews: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Drop repeats of a (type, target) within a time horizon, inside the stream."""
    return reviews.withWatermark("created_at", horizon).dropDuplicatesWithinWatermark(["action_type", "target"])
