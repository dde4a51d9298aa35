"""Imports, usages and liveness across files, as joins on an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import rules, text, vocab
from codeloom.operators.skew import interval_join


# ------------------------------------------------------------------ resolution
def import_candidates(folder: Column, root: Column, module: Column) -> Column:
    """Paths a module may live at, best first; null entries do not apply."""
    parts = F.split(module, r"\.", -1)
    leaf = F.concat(F.element_at(parts, -1), F.lit(".py"))
    package = F.concat(F.array_join(parts, "/"), F.lit("/__init__.py"))
    nested = F.when(
        F.size(parts) > 1, F.concat(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"), F.lit("/"), leaf)
    )
    return F.array(*[F.concat(base, F.lit("/"), tail) for base in (folder, root) for tail in (leaf, package, nested)])


def _first_existing(requests: DataFrame, files: DataFrame, candidates: Column, keys: list[str]) -> DataFrame:
    """First candidate per request that is a known path."""
    tried = requests.select(*keys, F.posexplode(candidates).alias("pos", "path")).filter(F.col("path").isNotNull())
    return (
        tried.join(files.select("path").distinct(), "path")
        .groupBy(*keys)
        .agg(F.min_by("path", "pos").alias("resolved_file"))
    )


def resolve_import_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Add the file each internal import leads to; external or unknown ones stay null.

    Many files of a folder import the same module, so each (folder, module) is
    resolved once and joined back.
    """
    located = edges.withColumn("folder", text.parent_dir(F.col("importing_file")))
    keys = ["repo", "folder", "source_module"]
    requests = located.filter(~F.col("is_external")).select(*keys).distinct()
    candidates = import_candidates(F.col("folder"), F.col("repo"), F.col("source_module"))
    resolved = _first_existing(requests, files, candidates, keys)
    return located.join(resolved, keys, "left").drop("folder")


def star_targets(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(importing_file, source_module, path) of ``*`` imports, looked up next to the importing file only."""
    keys = ["folder", "source_module"]
    stars = edges.filter(F.col("symbol_name") == "*").select(
        "importing_file", "source_module", text.parent_dir(F.col("importing_file")).alias("folder")
    ).distinct()
    candidates = import_candidates(F.col("folder"), F.col("folder"), F.col("source_module"))
    found = _first_existing(stars.select(*keys).distinct(), files, candidates, keys)
    return stars.join(found, keys).select("importing_file", "source_module", F.col("resolved_file").alias("path"))


def star_import_sources(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Files that are imported with ``*``."""
    return star_targets(edges, files).select("path").distinct()


# ------------------------------------------------------------------ importers
def importers_of_file(resolved: DataFrame) -> DataFrame:
    """Distinct (path, importing_file) pairs."""
    return (
        resolved.filter(F.col("resolved_file").isNotNull())
        .select(F.col("resolved_file").alias("path"), "importing_file")
        .distinct()
    )


def fan_in(resolved: DataFrame) -> DataFrame:
    """How many files import each file; their names are rows of ``importers_of_file``."""
    return importers_of_file(resolved).groupBy("path").agg(F.count(F.lit(1)).alias("n_importers"))


def importers_of_symbol(defs: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, name, importing_file): by name, and ``*`` rows for whole-module imports.

    A star import stands for every name of its file and is kept as one row rather
    than one per name.
    """
    hits = resolved.filter(F.col("resolved_file").isNotNull()).select(
        F.col("resolved_file").alias("path"), F.col("symbol_name").alias("name"), "importing_file"
    ).distinct()
    direct = hits.join(defs.select("path", "name").distinct(), ["path", "name"], "left_semi")
    stars = hits.filter(F.col("name") == "*").join(defs.select("path").distinct(), "path", "left_semi")
    return direct.unionByName(stars)


def importer_reasons(wanted: DataFrame, resolved: DataFrame) -> DataFrame:
    """First importer and their number for each wanted (path, name), star imports included.

    All of them are rows of ``importers_of_symbol``.
    """
    hits = resolved.filter(F.col("resolved_file").isNotNull()).select(
        F.col("resolved_file").alias("path"), F.col("symbol_name").alias("name"), "importing_file"
    )
    per_name = hits.groupBy("path", "name").agg(
        F.min("importing_file").alias("direct_first"), F.count_distinct("importing_file").alias("direct_n")
    )
    stars = per_name.filter(F.col("name") == "*").select(
        "path", F.col("direct_first").alias("star_first"), F.col("direct_n").alias("star_n")
    )
    return (
        wanted.select("path", "name").distinct()
        .join(per_name, ["path", "name"], "left")
        .join(stars, "path", "left")
        .withColumn("first_importer", F.least("direct_first", "star_first"))
        .filter(F.col("first_importer").isNotNull())
        .select(
            "path", "name", "first_importer",
            (F.coalesce("direct_n", F.lit(0)) + F.coalesce("star_n", F.lit(0))).alias("n_importers"),
        )
    )


# ------------------------------------------------------------------ liveness
def _uses_through_imports(wanted: DataFrame, resolved: DataFrame, tokens: DataFrame, rank: Column) -> DataFrame:
    """Per wanted (path, name): the best use of the name in a file that imports the path.

    Each importing file gets the names wanted of its imports; tokens meet these by equality.
    """
    pairs = importers_of_file(resolved).filter(F.col("path") != F.col("importing_file"))
    looked_for = pairs.join(wanted.select("path", "name").distinct(), "path")
    found = tokens.withColumnRenamed("path", "importing_file").join(looked_for, ["importing_file", "name"])
    return found.groupBy("path", "name").agg(
        F.min(F.struct(rank.alias("rank"), F.col("importing_file").alias("file"))).alias("use")
    )


def function_liveness(
    functions: DataFrame,
    resolved: DataFrame,
    tokens: DataFrame,
    exports: DataFrame,
    star_sources: DataFrame,
) -> DataFrame:
    """(is_dead, reason) for functions their own file does not call.

    ``functions`` comes from ``locally_unused``, ``tokens`` from ``cross_file_names``.
    """
    wanted = functions.filter(
        ~F.col("name").isin(vocab.ALWAYS_ALIVE_FUNCTIONS) & ~rules.is_special(F.col("name"))
    ).select("path", "name").distinct()
    uses = _uses_through_imports(wanted, resolved, tokens, F.when(F.col("how") == "called", 0).otherwise(1))
    importers = importer_reasons(wanted, resolved)
    exported = exports.select("path", "name", F.lit(True).alias("_exported"))
    stars = star_sources.select("path", F.lit(True).alias("_star"))
    rows = (
        functions.join(uses, ["path", "name"], "left")
        .join(importers, ["path", "name"], "left")
        .join(exported, ["path", "name"], "left")
        .join(stars, "path", "left")
    )
    used_in = text.file_name(F.col("use.file"))
    alive = (
        F.when(F.col("_star") & F.col("_exported"), F.lit("star-export"))
        .when(F.col("name").isin(vocab.ALWAYS_ALIVE_FUNCTIONS), F.lit("always-alive name"))
        .when(rules.is_special(F.col("name")), F.lit("dunder method"))
        .when(F.col("use.rank") == 0, F.concat(F.lit("called in "), used_in))
        .when(F.col("use.rank") == 1, F.concat(F.lit("imported by "), used_in))
        .when(F.col("first_importer").isNotNull(),
              F.concat(F.lit("directly imported by "), text.file_name(F.col("first_importer"))))
        .when(F.col("_exported"), F.lit("listed in __all__ or public API"))
    )
    return rows.select(
        *functions.columns, alive.isNull().alias("is_dead"),
        F.coalesce(alive, F.lit("no cross-file usage found")).alias("reason"), "first_importer", "n_importers",
    )


def dead_functions(functions: DataFrame, resolved: DataFrame, tokens: DataFrame, exports: DataFrame, star_sources: DataFrame) -> DataFrame:
    return function_liveness(functions, resolved, tokens, exports, star_sources).filter("is_dead").drop("is_dead", "first_importer", "n_importers")


def reexported(defs: DataFrame, inits: DataFrame, segment: bool = False) -> DataFrame:
    """(path, name, init_path) where a package init of the same repository exports the name above the file.

    The init's folder has to be a prefix of the path, so prefixes of the path are listed and
    meet the folder by equality.  As plain text ``/a/pkg`` is also a prefix of ``/a/pkg2``;
    ``segment`` asks for whole path parts.
    """
    homes = inits.select("repo", "name", "init_path", text.parent_dir(F.col("init_path")).alias("_folder"))
    asked = defs.select("repo", "path", "name").distinct().join(homes.select("repo", "name").distinct(), ["repo", "name"], "left_semi")
    parts = F.split(F.col("path"), "/", -1)
    if segment:
        above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
        above = F.when(F.size(parts) > 1, above)
    else:
        above = F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.substring(F.col("path"), F.lit(1), i))
    placed = asked.select("repo", "path", "name", F.explode(above).alias("_folder"))
    return placed.join(homes, ["repo", "name", "_folder"]).select("path", "name", "init_path")


def symbol_liveness(
    defs: DataFrame, resolved: DataFrame, usages: DataFrame, inits: DataFrame, segment: bool = False
) -> DataFrame:
    """(is_unused, reason) per defined (path, name), by the index rule.

    ``usages`` comes from ``identifier_usages``: any token counts, but only in files
    that import the defining file.
    """
    wanted = defs.groupBy("repo", "path", "name").agg(F.bool_or("in_all").alias("in_all"))
    alive_name = F.col("name").isin(vocab.ALWAYS_ALIVE_SYMBOLS)
    open_names = wanted.filter(~alive_name & ~rules.is_special(F.col("name")))
    importers = importer_reasons(open_names, resolved)
    uses = _uses_through_imports(open_names, resolved, usages.select("path", "name"), F.lit(0))
    inits_hit = (
        reexported(open_names, inits, segment).groupBy("path", "name").agg(F.min("init_path").alias("_init"))
    )
    rows = (
        wanted.join(importers, ["path", "name"], "left")
        .join(uses, ["path", "name"], "left")
        .join(inits_hit, ["path", "name"], "left")
    )
    alive = (
        F.when(alive_name, F.lit("always-alive pattern"))
        .when(rules.is_special(F.col("name")), F.lit("dunder method/attribute"))
        .when(F.col("first_importer").isNotNull(), F.concat(F.lit("imported by: "), text.file_name(F.col("first_importer"))))
        .when(F.col("use").isNotNull(), F.concat(F.lit("used in: "), text.file_name(F.col("use.file"))))
        .when(F.col("in_all"), F.lit("exported in __all__"))
        .when(F.col("_init").isNotNull(), F.concat(F.lit("re-exported via "), text.file_name(F.col("_init"))))
    )
    return rows.select(
        "path", "name", alive.isNull().alias("is_unused"),
        F.coalesce(alive, F.lit("no cross-file usage found")).alias("reason"), "first_importer", "n_importers",
    )


def unused_symbols(defs: DataFrame, resolved: DataFrame, usages: DataFrame, inits: DataFrame, segment: bool = False) -> DataFrame:
    return symbol_liveness(defs, resolved, usages, inits, segment).filter("is_unused").drop("is_unused", "first_importer", "n_importers")


# ------------------------------------------------------------------ positions
def parent_class(points: DataFrame, latest: DataFrame, line: str = "line", width: int = 256) -> DataFrame:
    """Outermost class whose body holds the line: start < line <= end."""
    classes = latest.filter(F.col("bucket") == "class").select(
        "path", F.col("name").alias("_class"), F.col("start_line").alias("_from"), F.col("end_line").alias("_to"),
        F.col("first_ord").alias("_ord"), F.col("has_docstring").alias("_doc"),
    )
    keyed = points.select("path", line).distinct()
    inside = interval_join(keyed, classes, ["path"], line, "_from", "_to", width, "inner", open_start=True)
    owner = inside.groupBy("path", line).agg(F.min_by(F.struct("_class", "_doc"), "_ord").alias("_o"))
    return points.join(owner, ["path", line], "left").select(
        *points.columns, F.col("_o._class").alias("parent_class"),
        F.coalesce("_o._doc", F.lit(False)).alias("parent_has_docstring"),
    )


def statement_at(points: DataFrame, symbols: DataFrame, line: str = "line", width: int = 256) -> DataFrame:
    """First module-level block that holds the line."""
    blocks = symbols.filter(F.col("bucket") == "statement").select(
        "path", F.col("name").alias("_block"), F.col("start_line").alias("_from"), F.col("end_line").alias("_to"),
        F.col("walk_ord").alias("_ord"),
    )
    keyed = points.select("path", line).distinct()
    inside = interval_join(keyed, blocks, ["path"], line, "_from", "_to", width, "inner")
    first = inside.groupBy("path", line).agg(F.min_by("_block", "_ord").alias("statement"))
    return points.join(first, ["path", line], "left")


def symbols_by_line(latest: DataFrame) -> DataFrame:
    """Name of the function, class, import and assignment that start on a line."""
    def starting(bucket: str) -> Column:
        order = F.when(F.col("bucket") == bucket, F.col("first_ord"))
        return F.min_by("name", order).alias(f"line_{bucket}")

    return latest.groupBy("path", F.col("start_line").alias("line_number")).agg(
        *[starting(b) for b in ("function", "class", "import", "assignment")]
    )


# ------------------------------------------------------------------ lookups
def used_in_file(usages: DataFrame, name: str, path: str) -> DataFrame:
    return usages.filter((F.col("name") == name) & (F.col("path") == path))


def definitions_of(defs: DataFrame, name: str) -> DataFrame:
    return defs.filter(F.col("name") == name)
