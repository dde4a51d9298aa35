"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings the operators are planned for.  Window-free joins on hot keys
# lean on the skew-join rewrite, so it is forced even where it adds a shuffle.
WORK_SETTING = "spark.codeloom.work.dir"
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # One sorted file per bucket is read as sorted, so stored texts aren't sorted again.
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


# The size of a file says little about the rows made of it: a table of names takes a few bytes a row in Parquet
# and a hundred in a driver's hash table.  So the planned threshold is moved to the measured one.
PLANNED_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
MEASURED_BROADCAST = "spark.sql.adaptive.autoBroadcastJoinThreshold"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that already exists.

    Joins broadcast a side only where its shuffled rows were measured to be below the session's threshold.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    planned = spark.conf.get(PLANNED_BROADCAST)
    if not planned.startswith("-"):
        spark.conf.set(MEASURED_BROADCAST, spark.conf.get(MEASURED_BROADCAST, None) or planned)
        spark.conf.set(PLANNED_BROADCAST, "-1")
    return spark


def local_session(cores: int | str = 8, memory: str = "8g", app: str = "codeloom", quiet: bool = True) -> SparkSession:
    """A single-JVM session for tests and benches."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.codeloom.input.partitions", str(cores))
        .config(WORK_SETTING, tempfile.mkdtemp(prefix="codeloom-work-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", str(not quiet).lower())
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, else of ``spark.codeloom.work.dir``.

    The first is fixed when a session starts; the second can be set later.  Without either, one machine
    uses a folder of its warehouse, and a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(WORK_SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set spark.checkpoint.dir or {WORK_SETTING} to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/codeloom-work"


def write_table(df: DataFrame, partition: str | None = None, cluster: tuple[str, ...] = ()) -> DataFrame:
    """Write a table once to a folder of its own in the checkpoint folder and read it back.

    Readers get the written files, so columns, values of ``partition`` and ranges of ``cluster`` are pruned
    by the scan.  Rows are clustered within the tasks that make them: nothing is shuffled, so a name that
    holds a third of the rows stays spread.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark).rstrip('/')}/codeloom-{uuid.uuid4().hex}"
    keys = [partition] * (partition is not None) + list(cluster)
    writer = (df.sortWithinPartitions(*keys) if keys else df).write
    (writer.partitionBy(partition) if partition else writer).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder).select(*[F.col(f"`{c}`") for c in df.columns])


def materialise(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage through a written table, which outlives lost executors."""
    return write_table(df)
