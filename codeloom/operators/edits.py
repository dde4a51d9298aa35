"""Line edits on file text, as new tables; input files are never changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text, vocab
from codeloom.operators import scan


def collapse_blank_runs(files: DataFrame) -> DataFrame:
    """Keep one of consecutive blank lines, inside the row."""
    return files.withColumn("content", text.join_lines(text.collapse_blanks(text.lines_of(F.col("content")))))


def apply_line_edits(files: DataFrame, edits: DataFrame, collapse: bool = False) -> DataFrame:
    """Apply all edits of a file at once; line numbers mean lines of the input text.

    An edit (path, start, end, new_lines) replaces lines start..end; no new lines is a
    deletion, ``end = start - 1`` inserts before ``start``.  Out-of-range edits are left
    out (see ``rejected_edits``).  Edits are cut from the line array as slices, so the
    cost grows with lines plus edits.  Overlapping deletions merge.
    """
    order = F.struct("start", "end", "new_lines")
    grouped = edits.filter(F.col("start") >= 1).groupBy("path").agg(F.sort_array(F.collect_list(order)).alias("_all"))
    lines = text.lines_of(F.col("content"))
    prepared = files.join(grouped, "path", "left").withColumn("_lines", lines)
    valid = F.filter("_all", lambda e: (e["end"] <= F.size("_lines")) & (e["start"] <= e["end"] + 1))
    prepared = prepared.withColumn("_edits", F.coalesce(valid, F.array())).withColumn(
        "_ends", F.transform("_edits", lambda e: e["end"])
    )
    # The last input line that the edits before each one have consumed.
    prepared = prepared.withColumn("_reached", text.running_max(F.col("_ends")))

    def untouched(start, stop):
        return F.slice("_lines", start, F.greatest(stop - start + 1, F.lit(0)))

    pieces = F.transform(
        "_edits", lambda e, i: F.concat(untouched(F.get("_reached", i) + 1, e["start"] - 1), e["new_lines"])
    )
    count = F.size("_edits")
    edited = F.concat(F.flatten(pieces), untouched(F.coalesce(F.array_max("_ends"), F.lit(0)) + 1, F.size("_lines")))
    if collapse:
        edited = text.collapse_blanks(edited)
    content = F.when(count == 0, F.col("content")).otherwise(text.join_lines(edited))
    return prepared.withColumn("content", content).select(*files.columns)


def rejected_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits whose lines do not exist in the file, or whose file does not exist."""
    size = text.line_count(F.col("content"))
    bad = (
        ~F.coalesce("_known", F.lit(False)) | (F.col("start") < 1) | (F.col("end") > F.col("_size")) | (F.col("start") > F.col("end") + 1)
    )
    sizes = files.select("path", F.col("content").isNotNull().alias("_known"), size.alias("_size"))
    return edits.join(sizes, "path", "left").filter(bad).select(*edits.columns)


def import_removals(imports: DataFrame, latest: DataFrame) -> DataFrame:
    """Edits that take names out of their import lines.

    Several names on one line are removed together.  ``imports`` has (path, name).
    """
    lines = latest.filter(F.col("bucket") == "import").select("path", "name", "start_line", "line_text")
    per_line = (
        imports.select("path", "name").join(lines, ["path", "name"])
        .groupBy("path", F.col("start_line").alias("line"))
        .agg(F.sort_array(F.collect_set("name")).alias("names"), F.first("line_text").alias("text"))
    )
    start = F.struct(text.rstrip(F.col("text")).alias("new_line"), F.lit(False).alias("whole_line"))
    result = F.aggregate(
        "names", start, lambda acc, n: F.when(acc["whole_line"], acc).otherwise(text.without_import(acc["new_line"], n))
    )
    return per_line.withColumn("_r", result).select(
        "path", F.col("line").alias("start"), F.col("line").alias("end"),
        F.when(F.col("_r.whole_line"), F.array().cast("array<string>"))
        .otherwise(F.array("_r.new_line")).alias("new_lines"),
    )


def plan_edits(
    actions: DataFrame, latest: DataFrame, files: DataFrame, align: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Dry run: what each action would do to the current text, or why it cannot.

    ``actions`` needs (id, action_type, target).  The symbol is resolved by name in the
    current table, so line shifts since the finding do not matter.  For files of a stored
    ``TextTable``, ``align`` is its ``aligned``: the wanted lines go to the texts.
    """
    target = text.decode_target(F.col("target"))
    asked = actions.select(
        "id", "action_type", target["file"].alias("path"), target["entity_type"].alias("entity_type"),
        target["entity_name"].alias("entity_name"),
    )
    span = F.struct("start_line", "end_line", "has_docstring", "complexity", "line_text", "blank_before")
    spans = latest.groupBy("path", F.col("name").alias("entity_name")).agg(
        *[F.max(F.when(F.col("bucket") == b, span)).alias(b) for b in ("function", "class", "import", "assignment")]
    )
    kind = F.col("action_type")
    number = F.expr("try_cast(entity_name AS INT)")
    by_line = (kind == "fix_security") & (F.col("entity_type") != "variable")
    wanted = asked.filter(by_line & number.isNotNull()).select("path", number.alias("line"))
    texts = scan.lines_at(files, (align(wanted) if align else wanted).distinct()).select("path", F.col("line").cast("string").alias("entity_name"), F.col("text").alias("at_line"))
    rows = (
        asked.join(spans, ["path", "entity_name"], "left")
        .join(texts, ["path", "entity_name"], "left")
        .join(files.select("path", F.lit(True).alias("known")), "path", "left")
    )
    doc = F.coalesce("function", "class")
    symbol = (
        F.when(kind == "delete_import", F.col("import"))
        .when(kind.isin("delete_function", "refactor_code"), F.col("function"))
        .when(kind == "add_docstring", doc)
        .when((kind == "fix_security") & ~by_line, F.col("assignment"))
    )
    line = F.when(by_line, number).otherwise(symbol["start_line"])
    whole = kind.isin("delete_function", "refactor_code", "add_docstring")
    rows = rows.withColumn("line", line).withColumn("end_line", F.when(whole, symbol["end_line"]).otherwise(line))
    rows = rows.withColumn("text", F.when(by_line, F.col("at_line")).otherwise(symbol["line_text"]))
    name = F.col("entity_name")
    quoted = F.concat(F.lit("'"), name, F.lit("'"))
    # Costly parts become columns of their own; they are used several times below.
    rows = rows.withColumn("_cut", text.let(text.without_import(F.col("text"), name), lambda c: c))
    rows = rows.withColumn("_c", text.parse_credential(F.col("text")))
    rows = rows.withColumn("_fix", text.rewritten_line(F.col("text")))
    cut = F.col("_cut")
    shown = text.strip(F.col("text"))
    first = F.col("line") - F.col("function.blank_before").cast("int")
    credential = F.col("_c")
    error = (
        F.when(F.col("known").isNull(), F.concat(F.lit("Cannot load "), F.col("path")))
        .when((kind == "delete_import") & F.col("line").isNull(), F.concat(F.lit("Import "), quoted, F.lit(" not found (already removed?)")))
        .when((kind == "delete_function") & F.col("line").isNull(), F.concat(F.lit("Function "), quoted, F.lit(" not found (already removed?)")))
        .when((kind == "add_docstring") & F.col("line").isNull(),
              F.concat(quoted, F.lit(" not found as function or class in "), text.file_name(F.col("path"))))
        .when((kind == "refactor_code") & F.col("line").isNull(), F.concat(quoted, F.lit(" not found in "), text.file_name(F.col("path"))))
        .when((kind == "fix_security") & (F.col("entity_type") == "variable") & F.col("line").isNull(),
              F.concat(F.lit("Variable "), quoted, F.lit(" not found in assignments table")))
        .when((kind == "fix_security") & number.isNull() & (F.col("entity_type") != "variable"),
              F.concat(F.lit("Invalid line reference: "), name))
        .when((kind == "fix_security") & F.col("text").isNull(), F.concat(F.lit("Line "), F.col("line"), F.lit(" not found")))
        .when(~kind.isin(vocab.ACTION_TYPES) | (kind == "delete_file"), F.concat(F.lit("No handler: "), kind))
    )
    message = (
        F.when((kind == "delete_import") & cut["whole_line"],
               F.concat(F.lit("Would delete entire line "), F.col("line"), F.lit(": "), shown))
        .when(kind == "delete_import",
              F.concat(F.lit("Would rewrite line "), F.col("line"), F.lit(": '"), shown, F.lit("' → '"),
                       text.strip(cut["new_line"]), F.lit("'")))
        .when(kind == "delete_function",
              F.concat(F.lit("Would delete "), quoted, F.lit(" lines "), first, F.lit("–"), F.col("end_line")))
        .when((kind == "add_docstring") & doc["has_docstring"], F.concat(quoted, F.lit(" already has a docstring")))
        .when(kind == "add_docstring",
              F.concat(F.lit("Would add AI docstring to "),
                       F.when(F.col("function").isNotNull(), "function").otherwise("class"),
                       F.lit(" "), quoted, F.lit(" at line "), F.col("line")))
        .when(kind == "refactor_code",
              F.concat(F.lit("Would refactor "), quoted, F.lit(" (complexity="), F.col("function.complexity"),
                       F.lit(", lines "), F.col("line"), F.lit("–"), F.col("end_line"), F.lit(")")))
        .when((kind == "fix_security") & text.uses_environment(F.col("text")),
              F.concat(quoted, F.lit(" already uses os.getenv/os.environ — already fixed")))
        .when((kind == "fix_security") & credential.isNotNull(),
              F.concat(F.lit("Would extract '"), credential["name"],
                       F.lit("' to .env.example and replace with os.getenv()")))
        .when(kind == "fix_security", F.concat(F.lit("Would comment out security issue at line "), F.col("line")))
        .otherwise(F.concat(F.lit("Would analyse "), F.col("path")))
    )
    no_lines = F.array().cast("array<string>")
    new_lines = (
        F.when((kind == "delete_import") & cut["whole_line"], no_lines)
        .when(kind == "delete_import", F.array(cut["new_line"]))
        .when(kind == "delete_function", no_lines)
        .when((kind == "fix_security") & ~text.uses_environment(F.col("text")), F.col("_fix.new_lines"))
    )
    ok = error.isNull()
    return rows.select(
        "id", "action_type", "path", "entity_type", "entity_name",
        F.when(ok & new_lines.isNotNull(), F.when(kind == "delete_function", first).otherwise(F.col("line"))).alias("start"),
        F.when(ok & new_lines.isNotNull(), F.col("end_line")).alias("end"),
        F.when(ok, new_lines).alias("new_lines"),
        F.when(ok, message).alias("message"),
        error.alias("error"),
    )
