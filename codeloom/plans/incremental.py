"""Liveness kept up to date from changed files only.

The store is a folder of tables, each in folders named by batch: what was parsed, where imports lead, and
what was judged.  ``marks`` says in which batch a path was last parsed, resolved or judged, so older rows of
it no longer count.  A batch reads only batches before its own and overwrites its own folders,
so it can be run again.

A refresh parses files whose checksum is new.  Imports are resolved again for these files and for
those that might lead to an added or removed path.  Judged again are changed files and the
files that a changed or newly resolved import leads to, now or before; nothing else can change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from codeloom.functions import text
from codeloom.operators import graph, scan, symbols
from codeloom.operators.skew import parts_for
from codeloom.schemas import SYMBOLS
from codeloom.session import checkpoint_folder, materialise
from codeloom.sources.files import changed_files

_EDGE = "repo string, importing_file string, source_module string, symbol_name string, is_external boolean, edge_ord int, resolved_file string, star_file string"
STORED = {
    "marks": "path string, step string, gone boolean",
    "files": "repo string, path string, checksum string",
    "changes": "path string, state string",
    "symbols": SYMBOLS,
    "tokens": "path string, name string, how string",
    "edges": _EDGE,
    "verdicts": "repo string, path string, name string, line int, is_dead boolean, reason string",
}


class Store:
    """Tables under ``root``, seen as they were before a batch or as they are now."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def write(self, table: str, batch: int, rows: DataFrame) -> DataFrame:
        path = f"{self.root}/{table}/batch={batch}"
        shape = T.StructType.fromDDL(STORED[table]) if isinstance(STORED[table], str) else STORED[table]
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in shape.fields]).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(shape).parquet(path)

    def rows(self, table: str, before: int | None = None) -> DataFrame:
        shape = T.StructType.fromDDL(STORED[table]) if isinstance(STORED[table], str) else T.StructType(STORED[table].fields[:])
        shape.add("batch", T.IntegerType())
        try:
            found = self.spark.read.schema(shape).parquet(f"{self.root}/{table}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            found = self.spark.createDataFrame([], shape)
        return found if before is None else found.filter(F.col("batch") < before)

    def marked(self, step: str, before: int | None = None) -> DataFrame:
        """path, batch of the last time a path went through a step; paths that are gone are left out."""
        last = self.rows("marks", before).filter(F.col("step") == step).groupBy("path").agg(
            F.max("batch").alias("batch"), F.max_by("gone", "batch").alias("gone"))
        return last.filter(~F.col("gone")).select("path", "batch")

    def valid(self, table: str, step: str, before: int | None = None, path: str = "path") -> DataFrame:
        """Rows that are of the last time their path went through ``step``."""
        marked = self.marked(step, before).withColumnRenamed("path", path)
        return self.rows(table, before).join(marked, [path, "batch"], "left_semi")


def _candidates(edges: DataFrame) -> DataFrame:
    """(importing_file, path): every path an internal import may lead to, star imports by their own folder too."""
    folder = text.parent_dir(F.col("importing_file"))
    tried = F.concat(
        graph.import_candidates(folder, F.col("repo"), F.col("source_module")),
        F.when(F.col("symbol_name") == "*", graph.import_candidates(folder, folder, F.col("source_module"))).otherwise(F.array().cast("array<string>")),
    )
    return edges.filter(~F.col("is_external") | (F.col("symbol_name") == "*")).select("importing_file", F.explode(tried).alias("path")).filter(
        F.col("path").isNotNull())


def _leads_to(edges: DataFrame) -> DataFrame:
    both = F.array("resolved_file", "star_file")
    return edges.select(F.explode(both).alias("path")).filter(F.col("path").isNotNull())


def refresh(store: Store, batch: int, snapshot: DataFrame, scope: DataFrame) -> DataFrame:
    """Bring the store up to date with ``snapshot`` (repo, path, content), all files of the repositories in ``scope`` (repo).

    Returns the changes: path and state (added, changed, removed).
    """
    # Hashes are taken once; only narrow rows meet the scope and what is known.
    hashed = materialise(snapshot.select("repo", "path", F.sha2("content", 256).alias("checksum")))
    now = hashed.join(scope.select("repo").distinct(), "repo", "left_semi")
    known = store.valid("files", "parsed", batch)
    in_scope = known.join(scope.select("repo").distinct(), "repo", "left_semi")
    changes = store.write("changes", batch, changed_files(in_scope, now).filter(F.col("state").isin("added", "changed", "removed")))
    parsed, removed = changes.filter("state <> 'removed'").select("path"), changes.filter("state = 'removed'").select("path")

    # Texts move once, to as many tasks as there are files to parse, and are read from there.
    parts, keys = parts_for(store.spark, parsed.count()), ["path", "repo"]
    fresh_keys = now.join(parsed, "path", "left_semi").select(*keys)
    delta = materialise(snapshot.select("repo", "path", "content").repartition(parts, *keys).join(
        fresh_keys.repartition(parts, *keys), keys, "left_semi"))
    files = store.write("files", batch, now.join(parsed, "path", "left_semi"))
    fresh = store.write("symbols", batch, symbols.extract_symbols(delta))
    store.write("tokens", batch, scan.cross_file_names(delta))
    untouched = known.join(changes, "path", "left_anti").select("repo", "path")
    alive = materialise(untouched.unionByName(files.select("repo", "path")))

    # Imports of unchanged files that may lead to a path that has come or gone.
    older = materialise(store.valid("edges", "resolved", batch, "importing_file"))
    kept_edges = older.join(changes.withColumnRenamed("path", "importing_file"), "importing_file", "left_anti")
    moved = changes.filter("state <> 'changed'").select("path")
    again = materialise(_candidates(kept_edges).join(moved, "path", "left_semi").select("importing_file").distinct())
    plain = ["repo", "importing_file", "source_module", "symbol_name", "is_external", "edge_ord"]
    asked = materialise(symbols.import_edges(fresh).unionByName(kept_edges.join(again, "importing_file", "left_semi").select(*plain)))
    stars = graph.star_targets(asked, alive).withColumnRenamed("path", "star_file").withColumn("symbol_name", F.lit("*"))
    resolved = store.write("edges", batch, graph.resolve_import_edges(asked, alive).join(
        stars, ["importing_file", "source_module", "symbol_name"], "left"))
    importers = parsed.unionByName(again.withColumnRenamed("importing_file", "path"))

    def marks(paths: DataFrame, step: str, gone: bool = False) -> DataFrame:
        return paths.select("path", F.lit(step).alias("step"), F.lit(gone).alias("gone"))

    # What the imports that went led to, and what the new ones lead to.
    went = older.join(changes.select("path").unionByName(importers).withColumnRenamed("path", "importing_file"), "importing_file", "left_semi")
    affected = parsed.unionByName(_leads_to(went)).unionByName(_leads_to(resolved)).distinct().join(alive, "path", "left_semi")
    gone = [marks(removed, step, True) for step in ("parsed", "resolved", "judged")]
    rows = marks(parsed, "parsed").unionByName(marks(importers, "resolved")).unionByName(marks(affected, "judged"))
    for more in gone:
        rows = rows.unionByName(more)
    store.write("marks", batch, rows)
    judge(store, batch)
    return changes


def judge(store: Store, batch: int) -> DataFrame:
    """Liveness of the functions in the paths that the batch marked, from stored rows only."""
    until = batch + 1
    paths = store.rows("marks", until).filter((F.col("batch") == batch) & (F.col("step") == "judged") & ~F.col("gone")).select("path")
    own = store.valid("symbols", "parsed", until).filter(F.col("bucket").isin("function", "class", "assignment"))
    own = materialise(own.join(paths, "path", "left_semi"))
    # Read from two branches; a name's last line is all that exports need of it.
    latest = materialise(symbols.latest_symbols(own).select("path", "bucket", "name", "line_text"))
    edges = store.valid("edges", "resolved", until, "importing_file")
    leading = materialise(edges.join(paths.withColumnRenamed("path", "resolved_file"), "resolved_file", "left_semi"))
    stars = edges.filter(F.col("star_file").isNotNull()).select(F.col("star_file").alias("path")).distinct()
    importers = leading.select(F.col("importing_file").alias("path")).distinct()
    tokens = store.valid("tokens", "parsed", until).join(importers, "path", "left_semi")
    live = graph.function_liveness(
        symbols.locally_unused(own), leading, tokens, symbols.module_exports(own, latest=latest), stars.join(paths, "path", "left_semi"))
    return store.write("verdicts", batch, live)


def liveness(store: Store) -> DataFrame:
    """Verdicts on the functions of all files as they are now."""
    return store.valid("verdicts", "judged").drop("batch")


def refresh_on_change(
    sessions: DataFrame, load: Callable[[DataFrame, int], DataFrame], root: str, checkpoint: str | None = None
) -> DataStreamWriter:
    """Refresh the store for the projects whose bursts have ended; ``load`` gives the files of the projects (repo) of a batch."""
    spark = sessions.sparkSession
    store = Store(spark, root)

    def run(batch: DataFrame, batch_id: int) -> None:
        scope = batch.select(F.col("project_id").alias("repo")).distinct()
        refresh(store, batch_id, load(scope, batch_id), scope)

    return sessions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint or f"{checkpoint_folder(spark)}/refresh_on_change")
