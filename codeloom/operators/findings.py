"""Findings of the four analysis agents, one shape for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text, vocab
from codeloom.operators import graph
from codeloom.schemas import IMPACT

# Position of a finding within its file: the kind first, then the order inside the kind.
_KIND_SPAN = 1 << 40
_KINDS = ["unused_import", "dead_function", "complexity", "security", "documentation", "large_file"]


def _impact(**values) -> Column:
    fields = []
    for field in IMPACT.fields:
        value = values.get(field.name)
        column = value if isinstance(value, Column) else F.lit(value)
        fields.append(column.cast(field.dataType).alias(field.name))
    return F.struct(*fields)


def _join(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _finding(
    rows: DataFrame, kind: str, agent: str, action: str, *, title: Column, description: Column, line: Column,
    severity, confidence, reasoning, impact: Column, fix, snippet, order: Column,
) -> DataFrame:
    def column(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    shaped = rows.select(
        "repo",
        F.col("path").alias("file_path"),
        F.lit(agent).alias("agent_type"),
        F.lit(action).alias("action_type"),
        title.alias("title"),
        description.alias("description"),
        line.cast("int").alias("line_number"),
        column(severity).alias("severity"),
        column(confidence).cast("double").alias("confidence"),
        column(reasoning).alias("reasoning"),
        impact.alias("impact"),
        column(fix).cast("string").alias("suggested_fix"),
        column(snippet).cast("string").alias("code_snippet"),
        F.lit(vocab.AGENTS.index(agent)).alias("agent_ord"),
        (F.lit(_KINDS.index(kind) * _KIND_SPAN) + order.cast("long")).alias("finding_ord"),
    )
    key = [F.col(c) for c in ("file_path", "action_type", "title", "line_number", "finding_ord")]
    return shaped.withColumn("id", text.natural_id("finding", *key))


def from_unused_imports(imports: DataFrame) -> DataFrame:
    name = F.col("name")
    return _finding(
        imports, "unused_import", "dead_code", "delete_import",
        title=_join("Unused import: ", name),
        description=_join("Import '", name, "' from '", F.col("module"), "' is not used in this file"),
        line=F.col("line"), severity="low", confidence=0.85,
        reasoning="Import found but symbol never referenced after import line",
        impact=_impact(breaking_changes=False, files_affected=1, test_impact="none"),
        fix=_join("Remove: import ", name), snippet=_join("import ", name), order=F.col("walk_ord"),
    )


def from_dead_functions(dead: DataFrame) -> DataFrame:
    name = F.col("name")
    return _finding(
        dead, "dead_function", "dead_code", "delete_function",
        title=_join("Unused function (repo-wide): ", name),
        description=_join(
            "Function '", name, "' is not called in this file or imported/used by any other file in the repository"
        ),
        line=F.col("line"), severity="medium",
        confidence=F.when(F.col("is_private"), 0.60).otherwise(0.75),
        reasoning=_join("Local: zero call sites. Repo: ", F.col("reason")),
        impact=_impact(breaking_changes=True, files_affected=1, test_impact="high", cross_file_check="passed"),
        fix="Verify public-API usage before removing", snippet=_join("def ", name), order=F.col("walk_ord"),
    )


def from_complexity(complex_functions: DataFrame) -> DataFrame:
    name, owner, score = F.col("name"), F.col("parent_class"), F.col("complexity")
    tail = _join(" has cyclomatic complexity ", score, " (grade ", F.col("grade"), ")")
    method = F.col("kind") == "method"
    return _finding(
        complex_functions, "complexity", "dead_code", "refactor_code",
        title=F.when(method, _join("High complexity method: ", name, " (in ", owner, ")")).otherwise(
            _join("High complexity: ", name)
        ),
        description=F.when(method, _join("Method '", name, "' in class '", owner, "'", tail)).otherwise(
            _join("Function '", name, "'", tail)
        ),
        line=F.col("line"),
        severity=F.when(score < vocab.COMPLEXITY_HIGH, "medium").otherwise("high"),
        confidence=1.0, reasoning="High cyclomatic complexity increases maintenance cost",
        impact=_impact(
            breaking_changes=False, files_affected=1, test_impact="medium", complexity=score,
            entity_type=F.col("kind"), parent_class=owner,
        ),
        fix="Refactor into smaller single-purpose functions",
        snippet=_join("def ", name, "  # complexity=", score), order=F.col("walk_ord"),
    )


def from_security(hits: DataFrame) -> DataFrame:
    return _finding(
        hits, "security", "security", "fix_security",
        title=F.col("message"), description=_join("Security issue: ", F.col("message")),
        line=F.col("line"), severity=F.col("severity"),
        confidence=F.when(F.col("finding_type") == "hardcoded_secret", 0.95).otherwise(0.80),
        reasoning=_join("Detected ", F.col("finding_type"), " pattern in source code"),
        impact=_impact(
            breaking_changes=False, files_affected=1, test_impact="low",
            security_risk=F.upper("severity"), credential_line=F.col("code"),
        ),
        fix="Extract to .env.example and replace with os.getenv().", snippet=F.col("code"),
        order=F.col("rule_ord") * F.lit(1 << 32) + F.col("match_ord"),
    )


def from_documentation(issues: DataFrame, dead: DataFrame, latest: DataFrame) -> DataFrame:
    """Docstring findings without modules, doomed functions and documented initialisers."""
    doomed = dead.select("path", "name").distinct()
    open_issues = issues.filter(F.col("bucket") != "module").join(doomed, ["path", "name"], "left_anti")
    initialiser = F.col("name") == "__init__"
    covered = (
        graph.parent_class(open_issues.filter(initialiser).select("path", "line"), latest)
        .filter("parent_has_docstring")
        .select("path", "line", F.lit("__init__").alias("name"))
        .distinct()
    )
    kept = open_issues.join(covered, ["path", "line", "name"], "left_anti")
    # A short docstring is reported as a function's; the true kind is kept in the impact.
    shown = F.when(F.contains("issue", F.lit("class")), "class").otherwise("function")
    name = F.col("name")
    return _finding(
        kept, "documentation", "documentation", "add_docstring",
        title=F.col("message"), description=_join(F.initcap(shown), " '", name, "' is missing a docstring"),
        line=F.col("line"), severity="low", confidence=0.90,
        reasoning="Public API should be documented for maintainability",
        impact=_impact(breaking_changes=False, files_affected=1, test_impact="none", entity_type=shown),
        fix=_join("Add Google-style docstring to ", shown, " '", name, "'"), snippet=name, order=F.col("walk_ord"),
    )


def from_large_files(large: DataFrame, importers: DataFrame, limit: int = vocab.LARGE_FILE_LINES) -> DataFrame:
    """``importers`` comes from ``graph.fan_in``; names are rows of ``graph.importers_of_file``."""
    rows = large.join(importers, "path", "left").withColumn("n", F.coalesce("n_importers", F.lit(0)))
    listed = F.when(F.col("n") == 0, F.lit("none")).otherwise(_join(F.col("n"), " files"))
    loc = F.col("loc")
    return _finding(
        rows, "large_file", "structure", "restructure",
        title=_join("Large file: ", loc, " LOC"), description=_join("File has ", loc, " lines of code"),
        line=F.lit(1), severity="medium", confidence=0.70,
        reasoning=f"Files >{limit} LOC are harder to navigate and maintain",
        impact=_impact(
            breaking_changes=True, files_affected=F.col("n") + 1, test_impact="high", loc=loc,
            n_importers=F.col("n"),
        ),
        fix=_join("Consider splitting into logical sub-modules. Imported by: ", listed),
        snippet=None, order=F.lit(0),
    )


def all_findings(parts: dict[str, list[DataFrame]], agents: list[str] | None = None) -> DataFrame:
    """Findings of the chosen agents appended; their order is in the ordinal columns."""
    chosen = [df for agent in (agents or vocab.AGENTS) for df in parts.get(agent, [])]
    result = chosen[0]
    for df in chosen[1:]:
        result = result.unionByName(df)
    return result
