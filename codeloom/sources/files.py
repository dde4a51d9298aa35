"""File corpora: discovery, snapshots, inventory and change detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text, vocab


def path_is_kept(path: Column, excluded: list[str] | None = None, match: str = "substring") -> Column:
    """False for excluded paths.

    ``substring`` drops any path that contains an excluded word anywhere, so
    ``distance.py`` goes with ``dist``; ``segment`` compares whole path parts.
    """
    parts = vocab.EXCLUDED_PATH_PARTS if excluded is None else excluded
    if not parts:
        return F.lit(True)
    if match == "segment":
        return ~F.arrays_overlap(F.split(path, "/", -1), F.array(*[F.lit(p) for p in parts]))
    return ~reduce(lambda a, b: a | b, [F.contains(path, F.lit(p)) for p in parts])


def listed_path() -> Column:
    """The path of a file as known before it is opened; the listing holds it as an encoded address."""
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.regexp_replace(F.url_decode(encoded), r"^file:/*", "/")


def discover_files(
    spark: SparkSession,
    root: str | list[str],
    excluded: list[str] | None = None,
    match: str = "substring",
    projects: DataFrame | None = None,
) -> DataFrame:
    """Raw Python files under one or more folders: repository, path, bytes, modification time.

    The exclusion filter is on the listed path, so it is applied while files are listed and
    dropped ones are never opened.  With ``projects`` (column ``repo_path``) the repository of a
    file is the deepest such folder that holds it, null if none does; otherwise it is ``root``
    (of several: the deepest that holds the file).
    """
    roots = [root] if isinstance(root, str) else list(root)
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.py")
        .load(roots)
        .filter(path_is_kept(listed_path(), excluded, match))
    )
    files = found.select(
        F.regexp_replace(F.col("path"), r"^file:/*", "/").alias("path"),
        F.col("content").alias("raw"),
        F.col("modificationTime").alias("snapshot_ts"),
    )
    if projects is None and len(roots) == 1:
        return files.select(F.lit(roots[0].rstrip("/")).alias("repo"), *files.columns)
    if projects is None:
        projects = spark.createDataFrame([(r,) for r in roots], "repo_path string")
    listing = found.select(F.regexp_replace(F.col("path"), r"^file:/*", "/").alias("path"))
    return with_repository(files, projects, listing).select("repo", *files.columns)


def folder_of(path: Column) -> Column:
    """Everything before the last slash."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """The folder and all folders above it, the shallowest first."""
    parts = F.split(folder, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def repository_of_folders(folders: DataFrame, projects: DataFrame) -> DataFrame:
    """Each distinct ``folder`` with the deepest project root (``repo_path``) that is it or lies above it.

    Folders are taken apart into their ancestors, which meet roots by equality: no prefix
    comparison of all roots with all folders, however deeply roots are nested.  Slashes at the end of a
    root don't count; folders under no root are left out; null and repeated roots change nothing.
    """
    roots = projects.select(F.rtrim(F.col("repo_path"), F.lit("/")).alias("_root")).filter("_root IS NOT NULL").distinct()
    above = folders.select("folder").distinct().select("folder", F.explode(ancestors(F.col("folder"))).alias("_root"))
    return above.join(roots, "_root").groupBy("folder").agg(F.max_by("_root", F.length("_root")).alias("repo"))


def with_repository(files: DataFrame, projects: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """``files`` with ``repo``, the deepest project root above each path; null where there is none.

    Only folder names are taken apart and grouped, never texts.  ``listing`` (paths) stands for
    ``files`` there, so that a scan of file names alone is enough.  The map of folders is joined back
    by folder: Catalyst broadcasts it while its measured size is below the threshold, and otherwise
    shuffles by folder, with hot folders split by the skew-join rule.
    """
    paths = files if listing is None else listing
    owners = repository_of_folders(paths.select(folder_of(F.col("path")).alias("folder")), projects)
    kept = [c for c in files.columns if c != "repo"]
    keyed = files.select(*kept, folder_of(F.col("path")).alias("folder"))
    return keyed.join(owners, "folder", "left").select("repo", *kept)


def load_snapshots(raw_files: DataFrame) -> DataFrame:
    """Decode to text with uniform newlines; unreadable files stay, with ``parse_error``."""
    decoded = F.try_validate_utf8(F.col("raw").cast("string"))
    return raw_files.select(
        "repo",
        "path",
        F.regexp_replace(decoded, "\r\n?", "\n").alias("content"),
        F.sha2("raw", 256).alias("checksum"),
        F.when(decoded.isNull(), "not valid UTF-8").alias("parse_error"),
        "snapshot_ts",
    )


def corpus_inventory(projects: DataFrame, files: DataFrame) -> DataFrame:
    """Files per project, projects without any included and flagged."""
    sizes = files.groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"))
    return projects.join(sizes, "repo", "left").select(
        *projects.columns,
        F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"),
        F.col("n_files").isNotNull().alias("has_files"),
    )


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """added / removed / changed / same per path; ``dirty`` old rows are never reloaded."""
    dirty = F.col("dirty") if "dirty" in old.columns else F.lit(False)
    was = old.select(F.col("path"), F.col("checksum").alias("old_checksum"), dirty.alias("dirty"))
    now = new.select(F.col("path"), F.col("checksum").alias("new_checksum"))
    state = (
        F.when(F.col("old_checksum").isNull(), "added")
        .when(F.col("new_checksum").isNull(), "removed")
        .when(F.col("old_checksum") == F.col("new_checksum"), "same")
        .when(F.col("dirty"), "kept_dirty")
        .otherwise("changed")
    )
    return was.join(now, "path", "full_outer").select("path", state.alias("state"))


def files_to_parse(old: DataFrame, new: DataFrame) -> DataFrame:
    """New snapshot rows whose text was not parsed before, for incremental re-analysis."""
    seen = old.select("path", "checksum")
    return new.join(seen, ["path", "checksum"], "left_anti")


def file_state(files: DataFrame, symbol_counts: DataFrame) -> DataFrame:
    """Per file: size, short checksum, error and symbol counts."""
    dirty = F.col("dirty") if "dirty" in files.columns else F.lit(False)
    return files.select(
        "path",
        text.line_count(F.col("content")).alias("lines"),
        dirty.alias("dirty"),
        F.substring("checksum", 1, vocab.CHECKSUM_CHARS).alias("checksum"),
        "parse_error",
    ).join(symbol_counts, "path", "left")


def files_where(files: DataFrame, dirty: bool | None = None) -> DataFrame:
    """Listing of loaded or dirty files."""
    rows = files if dirty is None else files.filter(F.col("dirty") == dirty)
    return rows.select("path")
