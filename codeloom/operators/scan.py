"""Scans over file text: lines, metrics, identifiers, secrets and credentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text, vocab

# ------------------------------------------------------------------ lines
def explode_lines(files: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Numbered lines of every file, or of a line range; sliced before they are exploded."""
    lines = text.lines_of(F.col("content"))
    first = start or 1
    if start is not None or end is not None:
        size = F.lit(end - first + 1) if end is not None else F.greatest(F.size(lines) - first + 1, F.lit(0))
        lines = F.slice(lines, F.lit(first), size)
    return files.select("repo", "path", F.posexplode(lines).alias("pos", "text")).select(
        "repo", "path", (F.col("pos") + first).alias("line"), "text"
    )


def file_metrics(files: DataFrame) -> DataFrame:
    """Physical, blank, comment and source lines per file."""
    lines = text.lines_of(F.col("content"))
    counted = files.select("repo", "path", text.line_count(F.col("content")).alias("loc"), lines.alias("_lines"))
    blank = F.size(F.filter("_lines", text.is_blank)).cast("long")
    comment = F.size(F.filter("_lines", lambda x: F.regexp_like(x, F.lit(r"^\s*#")))).cast("long")
    return counted.select(
        "repo", "path", "loc", blank.alias("blank"), comment.alias("comments"),
        (F.col("loc") - blank - comment).alias("sloc"),
    )


def loc_per_file(files: DataFrame) -> DataFrame:
    return files.select("repo", "path", text.line_count(F.col("content")).alias("loc"))


def large_files(files: DataFrame, limit: int = vocab.LARGE_FILE_LINES) -> DataFrame:
    return loc_per_file(files).filter(F.col("loc") > limit)


def lines_at(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The text of requested (path, line) pairs, null when out of range."""
    return wanted.join(files.select("path", "content"), "path").select(
        *wanted.columns, text.line_at(F.col("content"), F.col("line")).alias("text")
    )


def find_line_by_content(files: DataFrame, hints: DataFrame, skip_blank: bool = True) -> DataFrame:
    """First line from ``search_from`` on that contains the hint or lies within it."""
    start = F.col("search_from") if "search_from" in hints.columns else F.lit(1)
    found = text.first_line_matching(F.col("content"), F.col("hint"), start, skip_blank)
    return hints.join(files.select("path", "content"), "path").select(*hints.columns, found.alias("line"))


def whole_line_present(files: DataFrame, entry: str) -> DataFrame:
    """Files in which the entry stands as a line of its own."""
    present = F.exists(text.lines_of(F.col("content")), lambda x: text.rstrip(x) == entry)
    return files.filter(present).select("path")


# ------------------------------------------------------------------ identifiers
def identifier_usages(files: DataFrame) -> DataFrame:
    """Distinct (path, name) pairs; distinct within the row, so nothing is shuffled."""
    return files.select("repo", "path", F.explode(text.words(F.col("content"))).alias("name"))


def files_per_identifier(files: DataFrame) -> DataFrame:
    """In how many files each identifier occurs; counted before the shuffle."""
    return identifier_usages(files).groupBy("name").agg(F.count(F.lit(1)).alias("n_files"))


def single_file_identifiers(files: DataFrame) -> DataFrame:
    """Identifiers of a repository that exactly one of its files uses."""
    return (
        identifier_usages(files)
        .groupBy("repo", "name")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("path"))
        .filter(F.col("_n") == 1)
        .drop("_n")
    )


def call_tokens(files: DataFrame, dotted: bool = True) -> DataFrame:
    """Called names per file with their counts, in one pass over the text."""
    return (
        files.select("repo", "path", F.explode(text.call_names(F.col("content"), dotted)).alias("name"))
        .groupBy("repo", "path", "name")
        .agg(F.count(F.lit(1)).alias("n_calls"))
    )


def call_site_count(files: DataFrame, functions: DataFrame) -> DataFrame:
    """Call sites of given functions in their own file, zero included."""
    calls = call_tokens(files, dotted=False).select("path", "name", "n_calls")
    return functions.join(calls, ["path", "name"], "left").withColumn("n_calls", F.coalesce("n_calls", F.lit(0)))


def cross_file_names(files: DataFrame) -> DataFrame:
    """(path, name, how) of names a file calls, dots into, or mentions on an import line."""
    called = F.transform(
        F.array_distinct(text.call_names(F.col("content"), dotted=True)),
        lambda n: F.struct(n.alias("name"), F.lit("called").alias("how")),
    )
    mentioned = F.transform(
        text.import_line_names(F.col("content")),
        lambda n: F.struct(n.alias("name"), F.lit("imported").alias("how")),
    )
    return files.select("path", F.explode(F.concat(called, mentioned)).alias("t")).select("path", "t.*")


# ------------------------------------------------------------------ pattern rules
def _tagger(position: int, rule: tuple):
    """Function that adds the rule's columns to a match."""
    rule_id, _, label, finding_type, severity = rule

    def tag(match: Column) -> Column:
        return F.struct(
            F.lit(rule_id).alias("rule_id"), F.lit(label).alias("label"), F.lit(finding_type).alias("finding_type"),
            F.lit(severity).alias("severity"), F.lit(position).alias("rule_ord"),
            match["k"].alias("match_ord"), match["line"].alias("line"),
        )

    return tag


_NO_MATCHES = "array<struct<k:int,match:string,line:int>>"
_HIT = ["rule_id", "label", "finding_type", "severity", "rule_ord", "match_ord", "line"]


def rule_hits(files: DataFrame, rules: list[tuple], mask: bool = True, with_code: bool = True) -> DataFrame:
    """Every match of every rule with its line; rules may overlap and are not merged.

    All rules run in one pass over the text.  ``mask`` hides quoted values in the code.
    """
    none = F.array().cast(_NO_MATCHES)
    per_rule = [
        F.transform(F.coalesce(text.matches_with_lines(F.col("content"), rule[1]), none), _tagger(position, rule))
        for position, rule in enumerate(rules)
    ]
    return _hit_rows(files, F.flatten(F.array(*per_rule)), mask, with_code)


def table_rule_hits(files: DataFrame, rules: DataFrame, mask: bool = True, with_code: bool = True) -> DataFrame:
    """As ``rule_hits``, for rules that stay a table (rule_id, regex, label, finding_type, severity).

    The table becomes one array value of the plan, numbered by ``rule_id``, so a plan of thousands of
    rules is as short as that of one; it is configuration and does not grow with the files.  A pattern
    runs only over texts with the literal that it needs: the one of ``text.required_literal``, found once
    in the table of rules, and that of a column ``literal`` where the caller gives one.  Rows
    without id or pattern and repeated rows don't count; of one id with two patterns both do.
    """
    given = F.col("literal") if "literal" in rules.columns else F.lit(None).cast("string")
    rows = rules.filter("rule_id IS NOT NULL AND regex IS NOT NULL").select(F.struct(
        "rule_id", "regex", "label", "finding_type", "severity",
        F.array_compact(F.array(text.required_literal(F.col("regex")), given)).alias("literals"),
    ).alias("rule"))
    every = rows.agg(F.sort_array(F.collect_set("rule")).alias("rules")).scalar()
    numbered = F.transform("_rules", lambda rule, i: F.struct(rule.alias("rule"), i.alias("rule_ord")))
    content = F.col("content")

    def may_match(entry: Column) -> Column:
        return F.forall(entry["rule"]["literals"], lambda literal: F.contains(content, literal))

    def hits_of(entry: Column) -> Column:
        rule = entry["rule"]
        found = F.transform(text.matches_with_lines(content, rule["regex"]), lambda match: F.struct(
            rule["rule_id"].alias("rule_id"), rule["label"].alias("label"), rule["finding_type"].alias("finding_type"),
            rule["severity"].alias("severity"), entry["rule_ord"].alias("rule_ord"), match["k"].alias("match_ord"), match["line"].alias("line"),
        ))
        return F.coalesce(found, F.array())

    found = F.flatten(F.transform(F.filter(numbered, may_match), hits_of))
    return _hit_rows(files.select("repo", "path", "content", every.alias("_rules")), found, mask, with_code)


def _hit_rows(files: DataFrame, found: Column, mask: bool, with_code: bool) -> DataFrame:
    """One row per hit, with the source line where ``with_code``."""
    content = F.col("content")
    columns = ["repo", "path", *_HIT]
    if not with_code:
        return files.select("repo", "path", F.explode(found).alias("hit")).select("repo", "path", "hit.*").select(*columns)

    def with_text(hit, lines):
        code = F.coalesce(F.get(lines, hit["line"] - 1), F.lit(""))
        return hit.withField("code", text.mask_quoted(code) if mask else code)

    # Texts without a match are not split.
    coded = text.let(found, lambda hits: F.when(F.size(hits) > 0, text.let(
        text.lines_of(content), lambda lines: F.transform(hits, lambda hit: with_text(hit, lines))
    )))
    return (
        files.select("repo", "path", F.explode(coded).alias("hit"))
        .select("repo", "path", "hit.*")
        .select(*columns, "code")
    )


def _with_messages(hits: DataFrame) -> DataFrame:
    secret = F.col("finding_type") == "hardcoded_secret"
    message = F.when(secret, F.concat(F.lit(vocab.SECRET_MESSAGE_PREFIX), F.col("label"))).otherwise(F.col("label"))
    return hits.withColumn("message", message)


def secret_scan(files: DataFrame, mask: bool = True, with_code: bool = True) -> DataFrame:
    return _with_messages(rule_hits(files, vocab.SECRET_RULES, mask, with_code))


def insecure_scan(files: DataFrame, mask: bool = True, with_code: bool = True) -> DataFrame:
    return _with_messages(rule_hits(files, vocab.INSECURE_RULES, mask, with_code))


def security_scan(files: DataFrame, mask: bool = True) -> DataFrame:
    return _with_messages(rule_hits(files, vocab.SECRET_RULES + vocab.INSECURE_RULES, mask))


def security_summary(files: DataFrame) -> DataFrame:
    """Issues per file by severity, files without any included.

    Only counts are needed, so the text is counted in place: no line numbers, no
    explode, no shuffle.
    """
    def total(rules: list[tuple]) -> Column:
        counts = [F.regexp_count(F.col("content"), F.lit(r[1])) for r in rules]
        return sum(counts[1:], counts[0]).cast("long")

    high, medium = total(vocab.SECRET_RULES), total(vocab.INSECURE_RULES)
    return files.select("repo", "path", high.alias("high_severity"), medium.alias("medium_severity")).withColumn(
        "total_issues", F.col("high_severity") + F.col("medium_severity")
    )


# ------------------------------------------------------------------ credentials
def credential_lines(lines: DataFrame) -> DataFrame:
    """Lines that assign a hard-coded credential; the value itself leaves only as a hash."""
    found = text.parse_credential(F.col("text"))
    return (
        lines.withColumn("_c", found)
        .filter(F.col("_c").isNotNull())
        .select(
            *lines.columns,
            F.col("_c.name").alias("variable"),
            text.env_var_name(F.col("_c.name")).alias("env_var"),
            text.placeholder(F.col("_c.name")).alias("placeholder"),
            F.sha2(F.col("_c.value"), 256).alias("value_sha256"),
        )
        .drop("text")
    )


def credential_edits(flagged: DataFrame) -> DataFrame:
    """Replacement edits for flagged (path, line, text) rows; done lines give no edit."""
    return (
        flagged.withColumn("_fix", text.rewritten_line(F.col("text")))
        .filter(F.col("_fix.action") != "fix_security_skipped")
        .select(
            "path", F.col("line").alias("start"), F.col("line").alias("end"),
            F.col("_fix.new_lines").alias("new_lines"), F.col("_fix.action").alias("action"),
            F.col("_fix.env_var").alias("env_var"),
        )
    )


# ------------------------------------------------------------------ messages
def extract_code_blocks(messages: DataFrame, key: list[str], column: str = "text") -> DataFrame:
    """All fenced blocks of a message in order."""
    return messages.select(*key, F.posexplode(text.code_blocks(F.col(column))).alias("block", "code"))
