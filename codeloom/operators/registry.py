"""Analyses by name, and the parser as a table function for SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

from codeloom.operators import scan, symbols
from codeloom.schemas import SYMBOLS
from codeloom.sources.files import path_is_kept


def _imports(files: DataFrame) -> DataFrame:
    return symbols.unused_imports(symbols.extract_symbols(files))


def _functions(files: DataFrame) -> DataFrame:
    return symbols.function_rows(symbols.extract_symbols(files))


def _documentation(files: DataFrame) -> DataFrame:
    return symbols.docstring_issues(symbols.extract_symbols(files))


def _metrics(files: DataFrame) -> DataFrame:
    return symbols.raw_metrics(files)


def _python_files(files: DataFrame) -> DataFrame:
    return files.filter(F.endswith("path", F.lit(".py")) & path_is_kept(F.col("path"))).select("repo", "path")


TOOLS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "analyze_imports": _imports,
    "analyze_functions": _functions,
    "analyze_security": scan.security_scan,
    "analyze_documentation": _documentation,
    "get_file_metrics": _metrics,
    "get_python_files": _python_files,
}


def run_tool(name: str, files: DataFrame) -> DataFrame:
    """Run an analysis by name; an unknown name gives one error row.

    A file that cannot be parsed never fails the job: see ``symbols.parse_errors``.
    """
    if name not in TOOLS:
        return files.sparkSession.range(1).select(F.lit(f"Unknown tool: {name}").alias("error"))
    return TOOLS[name](files)


class SymbolTable:
    """``SELECT path, name FROM code_symbols(TABLE(SELECT repo, path, content FROM files))``

    Takes and gives whole Arrow batches in the partitions of its input: nothing is shuffled and no
    row passes through Python by itself.
    """

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield from symbols.parse_batches([batch])


def register(spark: SparkSession) -> None:
    spark.udtf.register("code_symbols", arrow_udtf(SymbolTable, returnType=SYMBOLS))
