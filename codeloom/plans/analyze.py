"""The whole analysis: files to findings, actions, and routed reviews."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text, vocab
from codeloom.operators import coordinate, findings, graph, queue, routing, scan, symbols
from codeloom.session import materialise, write_table


@dataclass
class Index:
    """Tables that several agents read."""

    files: DataFrame
    symbols: DataFrame
    latest: DataFrame
    definitions: DataFrame
    edges: DataFrame
    stored: bool = False


def build_index(files: DataFrame, keep: bool = False) -> Index:
    """Symbols, their latest definitions and resolved import edges of a corpus.

    ``keep`` stores them in the checkpoint folder, which pays when a plan reads them from many
    branches: the symbols and the latest ones by bucket and clustered by name, so a reader of
    functions opens no imports.  The files are stored with them, once they are parsed where they are
    spread: later scans and edits would make every text anew in each of their branches.
    """
    table = symbols.extract_symbols(files)
    if keep:
        table = write_table(table, "bucket", ("name",))
        files = write_table(files)
    latest = symbols.latest_symbols(table)
    if keep:
        latest = write_table(latest, "bucket", ("name",))
    edges = graph.resolve_import_edges(symbols.import_edges(table), files)
    if keep:
        edges = write_table(edges, cluster=("resolved_file", "symbol_name"))
    return Index(files, table, latest, symbols.definitions(table), edges, keep)


def liveness(index: Index, exports_fallback: bool = True) -> DataFrame:
    return graph.function_liveness(
        symbols.locally_unused(index.symbols),
        index.edges,
        scan.cross_file_names(index.files),
        symbols.module_exports(index.symbols, exports_fallback, index.latest),
        graph.star_import_sources(symbols.import_edges(index.symbols), index.files),
    )


def dead_functions(index: Index, exports_fallback: bool = True) -> DataFrame:
    return liveness(index, exports_fallback).filter("is_dead").drop("is_dead", "first_importer", "n_importers")


def collect_findings(
    index: Index,
    agents: list[str] | None = None,
    large_file: int = vocab.LARGE_FILE_LINES,
    exports_fallback: bool = True,
    mask: bool = True,
) -> DataFrame:
    """Findings of the chosen agents.

    Files that do not parse give security and size findings only.
    """
    dead = dead_functions(index, exports_fallback)
    if index.stored:
        dead = materialise(dead)
    parts = {
        "dead_code": [
            findings.from_unused_imports(symbols.unused_imports(index.symbols)),
            findings.from_dead_functions(dead),
            findings.from_complexity(symbols.function_complexity(index.symbols)),
        ],
        "security": [findings.from_security(scan.security_scan(index.files, mask))],
        "documentation": [
            findings.from_documentation(symbols.docstring_issues(index.symbols), dead, index.latest)
        ],
        "structure": [
            findings.from_large_files(
                scan.large_files(index.files, large_file), graph.fan_in(index.edges), large_file
            )
        ],
    }
    return findings.all_findings(parts, agents)


def coordinate_actions(found: DataFrame, index: Index) -> DataFrame:
    """One action per entity, numbered per file for safe execution."""
    with_entity = coordinate.extract_entity(found, index.latest, index.symbols)
    actions = coordinate.merge_to_action(coordinate.group_entities(with_entity))
    placed = coordinate.with_current_line(actions, index.latest)
    # Numbering reads its input twice: to count slots and to number rows.
    return coordinate.execution_order(materialise(placed) if index.stored else placed)


def to_reviews(routed: DataFrame, owner: str | None = None) -> DataFrame:
    """Review rows of the actions that wait for a person."""
    return routing.review_actions(routed).select(
        text.natural_id("review", F.col("action_type"), F.col("target")).alias("id"),
        "repo", "action_type", "target", "description", "risk_level", "confidence",
        F.lit("pending").alias("status"), F.col("reason").alias("review_notes"),
        F.lit(owner).cast("string").alias("owner"), F.current_timestamp().alias("created_at"),
    )


def analyze(
    files: DataFrame,
    rates: DataFrame | None = None,
    agents: list[str] | None = None,
    auto_approve: bool = False,
    threshold: float = vocab.CONFIDENCE_THRESHOLD,
    mode: str = "pipeline",
    owner: str | None = None,
    keep: bool = True,
) -> dict[str, DataFrame]:
    """Named tables of one analysis; nothing is executed and no file is changed."""
    index = build_index(files, keep)
    found = collect_findings(index, agents)
    if keep:
        found = materialise(found)
    actions = coordinate_actions(found, index)
    routed = routing.route(actions, rates, threshold, auto_approve, mode)
    if keep:
        routed = materialise(routed)
    return {
        "symbols": index.symbols,
        "edges": index.edges,
        "importers_of_file": graph.importers_of_file(index.edges),
        "importers_of_symbol": graph.importers_of_symbol(index.definitions, index.edges),
        "findings": found,
        "actions": actions if not keep else routed.select(*actions.columns),
        "routed": routed,
        "auto": routing.auto_actions(routed),
        "reviews": queue.unique_pending(to_reviews(routed, owner)),
        "stats": coordinate.merge_stats(found, actions),
    }
