"""The symbol table of a corpus and the per-file views on it."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.functions import rules, text, vocab
from codeloom.functions.pyast import raw_counts, symbol_rows
from codeloom.operators.totals import side_by_side
from codeloom.schemas import RAW_METRICS, SYMBOLS

BUCKETS = ["function", "class", "import", "assignment", "statement"]
_COLUMNS = [f.name for f in SYMBOLS.fields]
_FILES_PER_CHUNK = 64
_NODES_PER_COLLECTION = 200_000


def _per_file(schema: T.StructType, rows_of: Callable[[str | None], list[dict]]):
    """An Arrow step that gives the rows of each file, a few files at a time, built column by column."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(schema)
        # Syntax trees hold no cycles; looking for some after every few hundred nodes took a quarter of the time.
        gc.set_threshold(_NODES_PER_COLLECTION)
        for batch in batches:
            for start in range(0, batch.num_rows, _FILES_PER_CHUNK):
                files = batch.slice(start, _FILES_PER_CHUNK).to_pydict()
                found = [rows_of(content) for content in files["content"]]
                rows = [row for of_file in found for row in of_file]
                own = {
                    key: [value for value, of_file in zip(files[key], found) for _ in of_file] for key in ("repo", "path")
                }
                columns = [own[f.name] if f.name in own else [row.get(f.name) for row in rows] for f in shape]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

    return step


parse_batches = _per_file(SYMBOLS, symbol_rows)


def extract_symbols(files: DataFrame) -> DataFrame:
    """Functions, classes, imports, module assignments and blocks of every file.

    The only Python step: one pass over (repo, path, content) in the scan's own
    partitions.  Text goes no further, so it is never shuffled.
    """
    return files.select("repo", "path", "content").mapInArrow(parse_batches, SYMBOLS)


def raw_metrics(files: DataFrame) -> DataFrame:
    """Line counts of every file by its tokens: see ``pyast.raw_counts``.

    One pass in the scan's own partitions.  A file that cannot be read has ``loc`` and ``error`` only;
    a null text counts as empty.  ``scan.file_metrics`` gives the counts that need no tokens, without Python.
    """
    counted = _per_file(RAW_METRICS, lambda content: [raw_counts(content)])
    return files.select("repo", "path", "content").mapInArrow(counted, RAW_METRICS)


def _bucket(symbols: DataFrame, *names: str) -> DataFrame:
    return symbols.filter(F.col("bucket").isin(*names))


def parse_errors(symbols: DataFrame) -> DataFrame:
    return _bucket(symbols, "error").select("repo", "path", F.col("error").alias("parse_error"))


def latest_symbols(symbols: DataFrame) -> DataFrame:
    """One row per (file, bucket, name): the last definition, and when the name first came."""
    payload = [c for c in _COLUMNS if c not in ("repo", "path", "bucket", "name")]
    picked = (
        _bucket(symbols, *BUCKETS)
        .groupBy("repo", "path", "bucket", "name")
        .agg(F.max_by(F.struct(*payload), "walk_ord").alias("s"), F.min("walk_ord").alias("first_ord"))
    )
    return picked.select("repo", "path", "bucket", "name", "s.*", "first_ord")


def all_names(symbols: DataFrame) -> DataFrame:
    return _bucket(symbols, "all_member").select("path", "name").distinct()


def definitions(symbols: DataFrame) -> DataFrame:
    """All definition sites; module assignments but no augmented or starred ones."""
    listed = all_names(symbols).withColumn("in_all", F.lit(True))
    sites = _bucket(symbols, "function", "class", "assignment").filter(~F.col("kind").isin("augmented", "starred"))
    return sites.join(listed, ["path", "name"], "left").select(
        "repo", "path", "name", "start_line", "end_line",
        F.col("bucket").alias("kind"),
        rules.is_public(F.col("name")).alias("is_public"),
        F.coalesce("in_all", F.lit(False)).alias("in_all"),
        "walk_ord",
    )


def import_edges(symbols: DataFrame) -> DataFrame:
    """One row per imported name; purely relative imports have no module and no edge."""
    plain = F.col("kind") == "import"
    return _bucket(symbols, "import").filter(plain | (F.col("module") != "")).select(
        "repo",
        F.col("path").alias("importing_file"),
        F.col("module").alias("source_module"),
        F.when(plain, F.col("name")).otherwise(F.col("imported")).alias("symbol_name"),
        rules.is_external(F.col("module")).alias("is_external"),
        F.col("walk_ord").alias("edge_ord"),
    )


def init_exports(symbols: DataFrame) -> DataFrame:
    """Names imported in package init files."""
    return (
        _bucket(symbols, "import")
        .filter(F.endswith("path", F.lit("/__init__.py")))
        .select("repo", F.col("path").alias("init_path"), "name")
        .distinct()
    )


def module_exports(symbols: DataFrame, fallback: bool = True, latest: DataFrame | None = None) -> DataFrame:
    """Names a module offers: its one-line ``__all__`` list, or else every public name.

    ``latest`` is the table of ``latest_symbols`` where it is stored already.
    """
    latest = latest_symbols(symbols) if latest is None else latest
    one_line = F.nullif(F.regexp_extract("line_text", vocab.ONE_LINE_LIST, 1), F.lit(""))
    listed = (
        latest.filter((F.col("bucket") == "assignment") & (F.col("name") == "__all__"))
        .select("path", one_line.alias("members"))
        .filter(F.col("members").isNotNull())
    )
    member = F.regexp_replace(text.strip(F.col("member")), r"""^['"]+|['"]+$""", "")
    explicit = (
        listed.select("path", F.explode(F.split("members", ",", -1)).alias("member"))
        .select("path", member.alias("name"))
        .filter(F.col("name") != "")
        .distinct()
    )
    if not fallback:
        return explicit
    public = latest.filter(
        F.col("bucket").isin("function", "class", "assignment") & rules.is_public(F.col("name"))
    ).select("path", "name")
    return explicit.unionByName(public.join(listed.select("path"), "path", "left_anti").distinct())


def docstring_issues(symbols: DataFrame, include_async: bool = False) -> DataFrame:
    """Missing and short docstrings of modules, functions and classes."""
    rows = _bucket(symbols, "module", "function", "class")
    if not include_async:
        rows = rows.filter(~F.coalesce("is_async", F.lit(False)))
    module, kind = F.col("bucket") == "module", F.initcap("bucket")
    missing = F.coalesce("doc_len", F.lit(0)) == 0
    issue = (
        F.when(missing, F.concat(F.lit("missing_"), F.col("bucket"), F.lit("_docstring")))
        .when(~module & (F.col("doc_len") < vocab.SHORT_DOCSTRING), F.lit("short_docstring"))
    )
    message = (
        F.when(missing & module, F.lit("Module is missing a docstring"))
        .when(missing, F.concat(kind, F.lit(' "'), F.col("name"), F.lit('" is missing a docstring')))
        .otherwise(
            F.concat(F.lit('Docstring for "'), F.col("name"), F.lit('" is very short ('), F.col("doc_len"), F.lit(" chars)"))
        )
    )
    seen = module | ~rules.is_private(F.col("name"))
    return (
        rows.filter(seen)
        .select(
            "repo", "path", issue.alias("issue"), "name", "bucket", F.col("start_line").alias("line"),
            message.alias("message"), "walk_ord",
        )
        .filter(F.col("issue").isNotNull())
    )


def function_rows(symbols: DataFrame, include_async: bool = False) -> DataFrame:
    """Functions with visibility flags and the call count of their own file."""
    rows = _bucket(symbols, "function")
    if not include_async:
        rows = rows.filter(~F.col("is_async"))
    return rows.select(
        "repo", "path", "name", F.col("start_line").alias("line"), "end_line",
        rules.is_private(F.col("name")).alias("is_private"),
        rules.is_special(F.col("name")).alias("is_special"),
        rules.is_public(F.col("name")).alias("is_public"),
        "args_count", "has_docstring", "doc_len", F.col("mentions").alias("call_sites"), "walk_ord",
    )


def locally_unused(symbols: DataFrame, include_async: bool = False) -> DataFrame:
    """Functions that their own file calls nowhere; the definition itself is one site."""
    return function_rows(symbols, include_async).filter(~F.col("is_special") & (F.col("call_sites") <= 1))


def functions_without_docstring(symbols: DataFrame) -> DataFrame:
    return function_rows(symbols).filter(F.col("doc_len").isNull() & ~F.col("is_private"))


def function_complexity(symbols: DataFrame, gate: int | None = vocab.COMPLEXITY_GATE) -> DataFrame:
    """Cyclomatic complexity of top-level functions and methods above the gate.

    1 + decision points of the body; functions inside functions count towards their outer one.
    """
    rows = _bucket(symbols, "function").filter(~F.col("nested"))
    if gate is not None:
        rows = rows.filter(F.col("complexity") > gate)
    return rows.select(
        "repo", "path", "name", "complexity", F.col("start_line").alias("line"),
        rules.complexity_grade(F.col("complexity")).alias("grade"),
        F.when(F.col("owner_class").isNotNull(), "method").otherwise("function").alias("kind"),
        F.col("owner_class").alias("parent_class"),
        "walk_ord",
    )


def unused_imports(symbols: DataFrame) -> DataFrame:
    """Imports whose bound name occurs at most once in the file's text.

    A plain substring count: comments and longer words count as use.  Of several
    imports that bind one name the last in walk order stands.
    """
    eligible = _bucket(symbols, "import").filter((F.col("kind") == "import") | (F.col("module") != ""))
    picked = eligible.groupBy("repo", "path", "name").agg(
        F.max_by(F.struct("module", "start_line", "kind", "mentions"), "walk_ord").alias("s"),
        F.min("walk_ord").alias("walk_ord"),
    )
    return picked.filter(F.col("s.mentions") <= 1).select(
        "repo", "path", "name", "s.module", F.col("s.start_line").alias("line"),
        F.when(F.col("s.kind") == "import", "import").otherwise("from_import").alias("type"), "walk_ord",
    )


def symbol_lookup(latest: DataFrame, wanted: DataFrame) -> DataFrame:
    """Resolve (path, name, kind?) requests.

    With a known kind only that bucket answers; otherwise function, class, import,
    assignment and statement are tried in this order.
    """
    bucket = F.when(F.col("kind") == "import_from", "import").otherwise(F.col("kind"))
    rank = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("bucket"))
    asked = wanted.select("path", "name", F.when(bucket.isin(BUCKETS[:4]), bucket).alias("asked_bucket")).distinct()
    hits = latest.select("path", "name", "bucket", "start_line", "end_line").join(asked, ["path", "name"])
    hits = hits.filter(F.col("asked_bucket").isNull() | (F.col("asked_bucket") == F.col("bucket")))
    return (
        hits.groupBy("path", "name", "asked_bucket")
        .agg(F.min_by(F.struct("bucket", "start_line", "end_line"), rank).alias("s"))
        .select("path", "name", "asked_bucket", "s.*")
    )


def symbol_summary(latest: DataFrame) -> DataFrame:
    """Symbols per bucket and file."""
    def of(bucket: str) -> Column:
        return F.count_if(F.col("bucket") == bucket)

    return latest.groupBy("path").agg(
        of("function").alias("functions"), of("class").alias("classes"), of("import").alias("imports"),
        of("assignment").alias("assignments"), of("statement").alias("statements"),
    )


def has_import(latest: DataFrame, name: str) -> DataFrame:
    """Files that bind ``name`` by an import."""
    return latest.filter((F.col("bucket") == "import") & (F.col("name") == name)).select("path")


def index_summary(defs: DataFrame, usages: DataFrame, edges: DataFrame, inits: DataFrame, approx: bool = False) -> DataFrame:
    """Corpus totals: defined names, used names, import edges, init exports."""
    distinct = F.approx_count_distinct if approx else F.count_distinct
    return side_by_side(
        defs.agg(distinct("name").alias("defined_symbols")),
        usages.agg(distinct("name").alias("symbols_with_usage")),
        edges.agg(F.count(F.lit(1)).alias("import_edges")),
        inits.agg(F.count(F.lit(1)).alias("init_exports")),
    )


def delete_span(latest: DataFrame) -> DataFrame:
    """Lines to remove with a function: its span and one blank line before it."""
    return latest.filter(F.col("bucket") == "function").select(
        "path", "name", (F.col("start_line") - F.col("blank_before").cast("int")).alias("start_line"), "end_line"
    )
