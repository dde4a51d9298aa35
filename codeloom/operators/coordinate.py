"""Findings merged into one ordered, risk-rated action per code entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import rules, text, vocab
from codeloom.operators import graph
from codeloom.operators.skew import rank_within
from codeloom.operators.totals import side_by_side


def extract_entity(findings: DataFrame, latest: DataFrame, symbols: DataFrame) -> DataFrame:
    """Add (entity_type, entity_name): text patterns first, then the symbol on the line."""
    by_line = graph.symbols_by_line(latest).withColumnRenamed("path", "file_path")
    restructures = (
        findings.filter((F.col("action_type") == "restructure") & F.col("line_number").isNotNull())
        .select(F.col("file_path").alias("path"), F.col("line_number").alias("line"))
        .distinct()
    )
    blocks = graph.statement_at(restructures, symbols).select(
        F.col("path").alias("file_path"), F.col("line").alias("line_number"), F.lit("restructure").alias("action_type"),
        "statement",
    )
    rows = findings.join(by_line, ["file_path", "line_number"], "left").join(
        blocks, ["file_path", "line_number", "action_type"], "left"
    )
    return rows.withColumn("_e", entity_of(F.col("statement"))).select(
        *findings.columns, F.col("_e.entity_type").alias("entity_type"), F.col("_e.entity_name").alias("entity_name")
    )


def entity_of(statement: Column) -> Column:
    """struct<entity_type, entity_name> from a finding's text and its line's symbols."""
    action, texts = F.col("action_type"), [F.col("description"), F.col("title")]
    hint, line = F.col("impact.entity_type"), F.col("line_number").cast("string")

    def entity(kind: str, name: Column) -> Column:
        return F.when(name.isNotNull(), F.struct(F.lit(kind).alias("entity_type"), name.alias("entity_name")))

    def named(kind: str, patterns: list[str]) -> Column:
        return entity(kind, text.first_group(texts, patterns))

    def any_text(word: str) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(F.lower(t), F.lit(word)) for t in texts])

    # An unknown line is shown as the word None.
    shown_line = F.coalesce(line, F.lit("None"))
    on_line = lambda kind, bucket: entity(kind, F.col(f"line_{bucket}"))
    method = (hint == "method") & (action == "refactor_code")
    class_like = (hint == "class") | F.startswith(F.lower(F.col("description")), F.lit("class "))
    function = F.coalesce(
        F.when(method, F.coalesce(on_line("function", "function"), named("function", vocab.METHOD_NAME))),
        F.when(class_like, F.coalesce(named("class", vocab.CLASS_NAME), on_line("class", "class"))),
        named("function", vocab.FUNCTION_NAME),
        on_line("function", "function"),
        on_line("class", "class"),
        entity("function", F.concat(F.lit("line_"), shown_line)),
    )
    imported = F.coalesce(
        named("import", vocab.IMPORT_NAME), on_line("import", "import"),
        entity("import", F.concat(F.lit("line_"), shown_line)),
    )
    security = F.coalesce(on_line("variable", "assignment"), entity("line", shown_line))
    restructure = F.coalesce(
        entity("statement", statement), named("structure", vocab.STRUCTURE_NAME),
        entity("structure", text.file_stem(F.col("file_path"))),
    )
    other = F.coalesce(
        F.when(any_text("class"), named("class", vocab.LOOSE_CLASS_NAME)), entity("line", shown_line)
    )
    return (
        F.when(action.isin("delete_function", "add_docstring", "refactor_code"), function)
        .when(action == "delete_import", imported)
        .when(action == "fix_security", security)
        .when(action.isin("delete_file", "move_file"), entity("file", text.file_name(F.col("file_path"))))
        .when(action == "restructure", restructure)
        .otherwise(other)
    )


def group_entities(findings: DataFrame) -> DataFrame:
    """Per (file, entity): the primary finding, all action types and the best confidence.

    Two steps: first per action type, which is combined before the shuffle and leaves at
    most nine rows per entity, then per entity.
    """
    keys = ["file_path", "entity_type", "entity_name"]
    order = F.struct("finding_ord", "id")
    payload = F.struct(*[c for c in findings.columns if c not in (*keys, "action_type", "confidence", "agent_ord")])
    per_type = findings.groupBy(*keys, "action_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("confidence").alias("best"),
        F.min(order).alias("first"),
        F.min_by(payload, order).alias("finding"),
    )
    member = F.struct("first", "action_type")
    priority = F.struct(rules.action_priority(F.col("action_type")).alias("rank"), F.col("first"))
    grouped = per_type.groupBy(*keys).agg(
        F.sum("n").alias("n_findings"),
        F.max("best").alias("confidence"),
        F.min("first").alias("first"),
        F.sort_array(F.collect_list(member)).alias("members"),
        F.min_by(F.struct("action_type", "finding"), priority).alias("primary"),
    )
    return grouped.select(
        *keys, "n_findings", "confidence", "first",
        F.transform("members", lambda m: m["action_type"]).alias("action_types"),
        F.col("primary.action_type").alias("action_type"),
        F.col("primary.finding").alias("finding"),
    )


def sub_actions(primary: Column, action_types: Column) -> Column:
    """Primary and its compatible secondary in execution order; empty when there is only one."""
    secondary = F.element_at(
        F.create_map(*[F.lit(x) for pair in vocab.COMPATIBLE.items() for x in pair]), primary
    )
    both = F.coalesce(F.array_contains(action_types, secondary), F.lit(False))
    return F.when(both, F.array(primary, secondary)).otherwise(F.array().cast("array<string>"))


def merge_to_action(groups: DataFrame, confidence: str = "max") -> DataFrame:
    """One action per entity group.

    ``confidence='max'`` lets a complex dead function inherit full confidence for its
    deletion; ``'primary'`` keeps the confidence of the finding that gives the type.
    """
    entity = F.concat_ws(":", "entity_type", "entity_name")
    subs = sub_actions(F.col("action_type"), F.col("action_types"))
    rows = groups.withColumn("sub_actions", subs)
    many, n = F.col("n_findings") > 1, F.col("n_findings").cast("string")
    merged = F.concat(F.lit("merged "), n, F.lit(" findings"))
    base = F.col("finding.description")
    sequence = F.concat(
        F.lit("Execute "), F.size("sub_actions").cast("string"), F.lit(" actions on "), F.col("entity_type"),
        F.lit(" '"), F.col("entity_name"), F.lit("': "), F.array_join("sub_actions", " → "),
    )
    description = (
        F.when(F.size("sub_actions") > 1, sequence)
        .when(many, F.concat(base, F.lit(" ["), merged, F.lit("]")))
        .otherwise(base)
    )
    reasoning = F.when(many, F.concat("finding.reasoning", F.lit(" ("), merged, F.lit(")"))).otherwise(
        F.col("finding.reasoning")
    )
    snippet = F.when(F.col("action_type") == "fix_security", F.col("finding.code_snippet"))
    impact = F.col("finding.impact").withField(
        "credential_line", F.coalesce(snippet, F.col("finding.impact.credential_line"))
    )
    target = text.encode_target(F.col("file_path"), F.col("entity_type"), F.col("entity_name"))
    chosen = F.col("confidence") if confidence == "max" else F.col("primary_confidence")
    return rows.select(
        text.natural_id("action", F.col("action_type"), target).alias("id"),
        F.concat(F.lit("merged_"), F.col("finding.id")).alias("finding_id"),
        F.col("finding.repo").alias("repo"),
        "file_path", "entity_type", "entity_name", "action_type",
        description.alias("description"), target.alias("target"),
        chosen.alias("confidence"), rules.risk_of(F.col("action_type")).alias("risk_level"),
        reasoning.alias("reasoning"), impact.alias("impact"), entity.alias("entity"),
        F.col("action_types").alias("merged_actions"), "sub_actions",
        F.col("finding.suggested_fix").alias("suggested_changes"),
        "n_findings", F.col("first.finding_ord").alias("first_ord"),
    )


def with_primary_confidence(findings: DataFrame, groups: DataFrame) -> DataFrame:
    """Confidence of the primary finding itself, for ``merge_to_action(confidence='primary')``."""
    own = findings.select(F.col("id").alias("_id"), F.col("confidence").alias("primary_confidence"))
    return groups.join(own, F.col("finding.id") == F.col("_id")).drop("_id")


def with_current_line(actions: DataFrame, latest: DataFrame) -> DataFrame:
    """Current line of the entity a delete action names, 0 when it cannot be found."""
    spots = latest.filter(F.col("bucket").isin("function", "import", "class")).select(
        F.col("path").alias("file_path"), F.col("bucket").alias("entity_type"), F.col("name").alias("entity_name"),
        F.col("start_line").alias("_line"),
    )
    return actions.join(spots, ["file_path", "entity_type", "entity_name"], "left").withColumn(
        "current_line", F.coalesce("_line", F.lit(0))
    ).drop("_line")


def execution_order(actions: DataFrame, lines_per_slot: int = 4096) -> DataFrame:
    """Number the actions of each file: deletes bottom to top, then the rest by priority."""
    delete = F.col("action_type").isin(vocab.DELETE_TYPES)
    last = (~delete).cast("int")
    weight = F.when(delete, -F.col("current_line")).otherwise(rules.action_priority(F.col("action_type")))
    coarse = F.when(delete, F.floor(weight / F.lit(lines_per_slot))).otherwise(weight)
    slot = F.struct(last.alias("a"), coarse.cast("long").alias("b"), F.floor(F.when(delete, 0).otherwise(
        F.col("first_ord") / F.lit(lines_per_slot))).cast("long").alias("c"))
    return rank_within(actions, ["file_path"], [last, weight, F.col("first_ord"), F.col("id")], slot, "exec_order")


def merge_stats(findings: DataFrame, actions: DataFrame) -> DataFrame:
    """How many findings became how many actions."""
    both = side_by_side(
        findings.agg(F.count(F.lit(1)).alias("findings")), actions.agg(F.count(F.lit(1)).alias("actions"))
    )
    return both.withColumn("merged", F.col("findings") - F.col("actions"))
