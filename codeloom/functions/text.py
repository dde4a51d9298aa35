"""Column expressions over file text, lines, targets and identifiers.

Everything here stays in the JVM and works within one row, so no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions import vocab


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it many times in ``body``.

    A column used n times is otherwise copied n times into the plan; nested uses outgrow
    the size limit of generated code.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


# ------------------------------------------------------------------ lines
def lines_of(content: Column) -> Column:
    """Lines split at newlines only; a trailing newline does not add an empty line."""
    parts = F.split(content, "\n", -1)
    return F.when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(content: Column) -> Column:
    """Number of lines without building the line array."""
    open_last = (F.length(content) > 0) & ~F.endswith(content, F.lit("\n"))
    return (newline_count(content) + open_last.cast("int")).cast("long")


def line_at(content: Column, line: Column) -> Column:
    """The text of one line, null when out of range."""
    return F.get(lines_of(content), line - 1)


def is_blank(line: Column) -> Column:
    return F.regexp_like(line, F.lit(r"^\s*$"))


def strip(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def rstrip(line: Column) -> Column:
    return F.regexp_replace(line, r"\s+$", "")


def lstrip(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+", "")


def indent_width(line: Column) -> Column:
    return F.length(line) - F.length(lstrip(line))


def clip(text: Column, size: int = vocab.LISTING_CHARS) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, size)


def preview(text: Column, size: int = vocab.PREVIEW_CHARS) -> Column:
    """First ``size`` characters and an ellipsis when something was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def join_lines(lines: Column) -> Column:
    """Text of a line array, each line ended by a newline."""
    return F.when(F.size(lines) == 0, F.lit("")).otherwise(
        F.concat(F.array_join(lines, "\n"), F.lit("\n"))
    )


def reindent(block: Column, width: int) -> Column:
    """Shift a block so that its first non-blank line starts at column ``width``."""
    lines = F.split(F.regexp_replace(block, r"\n$", ""), "\n", -1)
    first = F.get(F.filter(lines, lambda x: ~is_blank(x)), F.lit(0))
    delta = F.lit(width) - indent_width(first)

    def shift(line):
        return F.when(is_blank(line), F.lit("")).otherwise(
            F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), indent_width(line) + delta)), lstrip(line))
        )

    return F.when(is_blank(block), F.array().cast("array<string>")).otherwise(F.transform(lines, shift))


def collapse_blanks(lines: Column) -> Column:
    """Keep the first line of every run of blank lines."""
    return let(lines, lambda rows: F.filter(
        rows, lambda x, i: ~(is_blank(x) & (i > 0) & is_blank(F.coalesce(F.get(rows, i - 1), F.lit("x"))))
    ))


def running_max(numbers: Column, block: int = 128) -> Column:
    """For each place the largest of the numbers before it, 0 if none.

    Whole blocks before a place are looked up; only its own block is searched.
    """
    def largest(values, start, size):
        return F.coalesce(F.array_max(F.slice(values, start, size)), F.lit(0))

    def over(values):
        n_blocks = F.ceil(F.size(values) / block).cast("int")
        tops = F.transform(F.sequence(F.lit(0), n_blocks), lambda j: largest(values, j * block + 1, F.lit(block)))
        before = let(tops, lambda t: F.transform(t, lambda x, j: largest(t, F.lit(1), j)))
        return let(before, lambda b: F.transform(values, lambda x, i: F.greatest(
            F.get(b, F.floor(i / block).cast("int")), largest(values, i - i % block + 1, i % block)
        )))

    return let(numbers, over)


def first_line_matching(content: Column, hint: Column, start: Column, skip_blank: bool = True) -> Column:
    """First line number >= ``start`` where the hint is inside the line or the reverse."""
    def search(lines, wanted):
        def hit(i):
            return let(strip(F.get(lines, i - 1)), lambda text: (
                (F.contains(text, wanted) | F.contains(wanted, text)) & ((F.length(text) > 0) if skip_blank else F.lit(True))
            ))

        span = F.when(start <= F.size(lines), F.sequence(start, F.size(lines)))
        return F.when(F.length(wanted) > 0, F.get(F.filter(span, hit), F.lit(0)))

    return let(lines_of(content), lambda lines: let(strip(hint), lambda wanted: search(lines, wanted)))


# ------------------------------------------------------------------ patterns
def matches_with_lines(content: Column, pattern: str | Column) -> Column:
    """array<struct<k, match, line>> of every match over the whole text; null without one.

    A match may span lines; its line is the one where it starts.  One more character is
    put before each match, so a line has grown by the number of matches that start in it.
    """
    pattern = F.lit(pattern)
    found = F.regexp_extract_all(content, pattern, F.lit(0))
    marked = F.split(F.regexp_replace(content, pattern, F.lit("|$0")), "\n", -1)
    grown = F.zip_with(marked, F.split(content, "\n", -1), lambda long, short: F.length(long) - F.length(short))
    starts = F.flatten(F.transform(grown, lambda n, i: F.array_repeat(i + 1, n)))
    rows = let(starts, lambda at: F.transform(
        found, lambda m, k: F.struct(k.alias("k"), m.alias("match"), F.get(at, k).alias("line"))
    ))
    # Lines are only split where something matched at all.
    return F.when(F.regexp_like(content, pattern), rows)


def required_literal(pattern: Column) -> Column:
    """A text that every match of a plain pattern contains, the longest; null where none is certain.

    Plain means: single characters, escaped signs and bracketed classes with or without a count.
    Anything else (groups, alternatives, anchors, counts of a character, escaped brackets or letters) gives null.
    """
    gap = "\u0000"
    classes = F.regexp_replace(pattern, r"\[[^\[\]\\&]+\](\{[0-9,]+\}|[*+?])?", gap)
    bare = F.regexp_replace(classes, r"\\[^A-Za-z0-9]", "")
    signs = F.regexp_like(bare, F.lit(r"[\\^$.|?*+()\[\]{}]")) | F.regexp_like(pattern, F.lit(r"\\[\[\]\x00]|\x00"))
    pieces = F.split(F.regexp_replace(classes, r"\\([^A-Za-z0-9])", "$1"), gap, -1)
    longest = F.array_max(F.transform(pieces, lambda x: F.struct(F.length(x).alias("n"), x.alias("piece"))))["piece"]
    return F.when(~signs & (longest != ""), longest)


def first_group(texts: list[Column], patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches; texts outer, patterns inner."""
    tries = [
        F.nullif(F.regexp_extract(text, "(?U)" + pattern, 1), F.lit(""))
        for text in texts
        for pattern in patterns
    ]
    return F.coalesce(*tries)


def words(content: Column) -> Column:
    """Distinct identifiers of two or more characters, comments and strings included."""
    runs = F.array_distinct(F.regexp_extract_all(content, F.lit(f"{vocab.WORD}+"), F.lit(0)))
    return F.filter(runs, lambda w: (F.length(w) >= 2) & F.regexp_like(w, F.lit("^[A-Za-z_]")))


def call_names(content: Column, dotted: bool = False) -> Column:
    """Names directly followed by ``(`` (or also by ``.``), one entry per occurrence."""
    tail = r"[(.]" if dotted else r"\("
    # Whole words only, without backtracking into them: one pass over the text.
    whole = rf"(?<!{vocab.WORD})({vocab.WORD}++)\s*+{tail}"
    return F.regexp_extract_all(content, F.lit(whole), F.lit(1))


def import_line_names(content: Column) -> Column:
    """Distinct names on the rest of a line after the word ``import``."""
    tails = F.regexp_extract_all(
        content, F.lit(rf"(?<!{vocab.WORD})import(?!{vocab.WORD})([^#\n]*)"), F.lit(1)
    )
    per_tail = F.transform(tails, lambda t: F.regexp_extract_all(t, F.lit(f"{vocab.WORD}+"), F.lit(0)))
    return F.array_distinct(F.flatten(per_tail))


def occurrences(content: Column, name: Column) -> Column:
    """Non-overlapping substring count."""
    return (
        (F.length(content) - F.length(F.replace(content, name, F.lit("")))) / F.length(name)
    ).cast("long")


def code_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(vocab.CODE_FENCE), F.lit(1))


def mask_quoted(text: Column) -> Column:
    """Hide quoted values and long key-like runs so that findings carry no secret."""
    hidden = F.regexp_replace(text, r"""(["'])[^"']*(["'])""", "$1***$2")
    return F.regexp_replace(hidden, r"sk-[a-zA-Z0-9]{32,}", "sk-***")


# ------------------------------------------------------------------ targets
def encode_target(path: Column, entity_type: Column, entity_name: Column) -> Column:
    return F.concat(path, F.lit("@"), entity_type, F.lit(":"), entity_name)


def target_file(target: Column) -> Column:
    return F.when(F.contains(target, F.lit("@")), F.substring_index(target, "@", 1)).otherwise(
        F.substring_index(target, ":", 1)
    )


def target_entity(target: Column) -> Column:
    """Text after the last colon, empty without one."""
    return F.when(F.contains(target, F.lit(":")), F.substring_index(target, ":", -1)).otherwise("")


def _after(value: Column, mark: str) -> Column:
    """Text after the first ``mark``."""
    return F.substr(value, F.instr(value, mark) + 1)


def decode_target(target: Column) -> Column:
    """struct<file, entity_type, entity_name>; legacy ``path:line`` targets become type line."""
    modern = F.contains(target, F.lit("@"))
    rest = _after(target, "@")
    name = F.when(F.contains(rest, F.lit(":")), _after(rest, ":")).otherwise("")
    line = F.coalesce(F.get(F.split(target, ":", -1), F.lit(1)), F.lit(""))
    return F.struct(
        target_file(target).alias("file"),
        F.when(modern, F.substring_index(rest, ":", 1)).otherwise("line").alias("entity_type"),
        F.when(modern, name).otherwise(line).alias("entity_name"),
    )


def context_hash(action_type: Column, risk_level: Column) -> Column:
    return F.md5(F.concat(action_type, F.lit("_"), risk_level))


def natural_id(prefix: str, *parts: Column) -> Column:
    """Deterministic id of a natural key, the same on every retry."""
    shown = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(f"{prefix}_"), F.sha2(F.concat_ws("\x1f", *shown), 256))


# ------------------------------------------------------------------ paths
def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


# ------------------------------------------------------------------ credentials
def env_var_name(name: Column) -> Column:
    return F.regexp_replace(F.upper(name), r"[^A-Z0-9_]", "_")


def placeholder(name: Column) -> Column:
    lowered = F.lower(name)
    default = F.concat(F.lit("your_"), lowered, F.lit("_here"))

    def wrap(rest, case):
        keys, text = case
        hit = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(k)) for k in keys])
        return F.when(hit, text).otherwise(rest)

    return reduce(wrap, reversed(vocab.PLACEHOLDERS), default)


def parse_credential(line: Column) -> Column:
    """struct<name, value, quote> of a hard-coded credential assignment, else null.

    The variable name decides first; a name without a credential word needs a long
    and varied value that is not a plain word, a version or an environment name.
    """
    def group(number: int) -> Column:
        return F.regexp_extract(strip(line), vocab.CREDENTIAL_LINE, number)

    parts = F.struct(group(1).alias("name"), group(3).alias("value"), group(2).alias("quote"))
    return let(parts, lambda c: F.when((c["name"] != "") & _looks_secret(c["name"], c["value"]), c))


def _looks_secret(name: Column, value: Column) -> Column:
    def has(pattern: str) -> Column:
        return F.regexp_like(value, F.lit(pattern))

    named = F.regexp_like(F.lower(name), F.lit("|".join(vocab.CREDENTIAL_KEYWORDS)))
    upper, lower, digit = has(r"\p{Lu}"), has(r"\p{Ll}"), has(r"\p{Nd}")
    size = F.length(value)
    varied = (
        (upper & lower & digit) | (has(vocab.CREDENTIAL_SPECIALS) & (size > 16)) | (upper & digit & (size > 20))
    )
    harmless = has(vocab.SIMPLE_WORD) | has(vocab.VERSION_TEXT) | has(vocab.ENVIRONMENT_NAME)
    return named | ((size >= vocab.CREDENTIAL_MIN_LENGTH) & varied & ~harmless)


def uses_environment(line: Column) -> Column:
    return F.contains(line, F.lit("os.getenv")) | F.contains(line, F.lit("os.environ"))


def rewritten_line(line: Column) -> Column:
    """struct<action, new_lines, env_var> that replaces one flagged line."""
    pad = F.repeat(F.lit(" "), indent_width(line))
    reason = F.lit(vocab.REMEDIATION_DEFAULT)
    for pattern, text in reversed(vocab.REMEDIATION_RULES):
        reason = F.when(F.regexp_like(line, F.lit(pattern)), F.lit(text)).otherwise(reason)
    commented = F.array(
        F.concat(pad, F.lit("# SECURITY WARNING: "), reason), F.concat(pad, F.lit("# "), lstrip(line))
    )

    def result(action: str, lines: Column, var: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), lines.alias("new_lines"), var.alias("env_var"))

    def choose(found: Column) -> Column:
        env, none = env_var_name(found["name"]), F.lit(None).cast("string")
        fixed = F.concat(pad, found["name"], F.lit(' = os.getenv("'), env, F.lit('")'))
        return (
            F.when(found.isNotNull(), result("fix_security", F.array(fixed), env))
            .when(uses_environment(line), result("fix_security_skipped", F.array(line), none))
            .otherwise(result("fix_security_comment", commented, none))
        )

    return let(parse_credential(line), choose)


# ------------------------------------------------------------------ import lines
def bound_name(part: Column) -> Column:
    """The name an import part binds: its alias, or else its own name."""
    tries = [F.regexp_extract(part, r"(?U)^(\w+)(?:\s+as\s+(\w+))?", group) for group in (2, 1)]
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in tries], part)


def without_import(line: Column, name: Column) -> Column:
    """struct<new_line, whole_line> after dropping one name from an import line."""
    text = rstrip(line)
    plain = F.regexp_like(text, F.lit(vocab.PLAIN_IMPORT)) & ~F.contains(text, F.lit("from "))
    from_form = F.regexp_like(text, F.lit(vocab.FROM_IMPORT))

    def trimmed(pattern):
        parts = F.transform(F.split(F.regexp_extract(text, pattern, 2), ",", -1), strip)
        kept = F.filter(parts, lambda p: bound_name(p) != name)
        return F.when(
            F.size(kept) > 0,
            F.struct(
                F.concat(F.regexp_extract(text, pattern, 1), F.array_join(kept, ", ")).alias("new_line"),
                F.lit(False).alias("whole_line"),
            ),
        )

    whole = F.struct(text.alias("new_line"), F.lit(True).alias("whole_line"))
    return F.coalesce(
        F.when(plain, trimmed(vocab.PLAIN_IMPORT)).when(from_form, trimmed(vocab.FROM_IMPORT)), whole
    )
