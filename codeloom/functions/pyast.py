"""Per-file parser helper: Python text to flat symbol rows.

A small stdlib-``ast`` walk that Spark calls on executors, one file at a time.
Everything after it is DataFrame work.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections import Counter, deque

from codeloom.functions import vocab

# From a word's start and without going back: a word that no bracket follows is looked at once.
_CALL = re.compile(r"\b(\w++)\s*+\(")
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_DEFINITIONS = {*_FUNCTIONS, ast.ClassDef}
_IMPORTS = {ast.Import, ast.ImportFrom}
_BLOCKS = {
    ast.If: "if", ast.Try: "try", ast.TryStar: "try", ast.With: "with", ast.AsyncWith: "with",
    ast.For: "for", ast.AsyncFor: "for", ast.While: "while", ast.Expr: "expr",
}


# Nodes and fields that never lead to a branch, a definition or an import.
_PLAIN_FIELDS = {"ctx", "op", "ops", "id", "attr", "arg", "asname", "names", "type_comment", "type_ignores"}
_LEAF_KINDS = {type(None), str, ast.Name, ast.Constant, ast.Global, ast.Nonlocal, ast.Pass, ast.Break, ast.Continue}
# Fields of statements, handlers and cases that hold statements, handlers and cases; no other field leads to one.
_BLOCK_FIELDS = {"body", "orelse", "finalbody", "handlers", "cases"}
_child_fields: dict[type, tuple[str, ...]] = {}
_split_fields: dict[type, tuple[tuple[str, ...], tuple[str, ...]]] = {}


def _fields_of(kind: type) -> tuple[str, ...]:
    """The fields of a kind of node that may hold nodes worth a visit."""
    fields = _child_fields.get(kind)
    if fields is None:
        fields = _child_fields[kind] = tuple(f for f in getattr(kind, "_fields", ()) if f not in _PLAIN_FIELDS)
    return fields


def _blocks_and_parts(kind: type) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The fields of a kind of statement, handler or case: those that hold statements, and the others."""
    fields = _split_fields.get(kind)
    if fields is None:
        known = _fields_of(kind)
        fields = _split_fields[kind] = (
            tuple(f for f in known if f in _BLOCK_FIELDS), tuple(f for f in known if f not in _BLOCK_FIELDS))
    return fields


_POINTS = {
    **dict.fromkeys((ast.If, ast.IfExp, ast.With, ast.AsyncWith, ast.Assert), lambda part: 1),
    **dict.fromkeys((ast.For, ast.AsyncFor, ast.While), lambda part: 1 + bool(part.orelse)),
    **dict.fromkeys((ast.Try, ast.TryStar), lambda part: len(part.handlers) + bool(part.orelse)),
    ast.BoolOp: lambda part: len(part.values) - 1,
    ast.comprehension: lambda part: 1 + len(part.ifs),
    ast.Match: lambda part: len(part.cases),
}


def _points_below(node: ast.AST, fields: tuple[str, ...]) -> int:
    """Decision points of the expressions in these fields of a node; expressions hold no statements."""
    found, waiting = 0, []
    while True:
        for field in fields:
            value = getattr(node, field, None)
            if type(value) is list:
                waiting.extend([part for part in value if type(part) not in _LEAF_KINDS])
            elif type(value) not in _LEAF_KINDS:
                waiting.append(value)
        if not waiting:
            return found
        node = waiting.pop()
        kind = type(node)
        if kind in _POINTS:
            found += _POINTS[kind](node)
        fields = _fields_of(kind)


def _bound_names(target: ast.expr, kind: str = "assign"):
    """(name, kind) of an assignment target; starred parts are marked as such."""
    if isinstance(target, ast.Name):
        yield target.id, kind
    elif isinstance(target, ast.Starred):
        yield from _bound_names(target.value, "starred")
    elif isinstance(target, (ast.Tuple, ast.List)):
        for part in target.elts:
            yield from _bound_names(part, kind)


def _short(node: ast.AST) -> str | None:
    """A preview of an expression; null where it is nested too deeply to be written out."""
    try:
        shown = ast.unparse(node)
    except (RecursionError, MemoryError):
        return None
    return shown[: vocab.PREVIEW_CHARS] + ("…" if len(shown) > vocab.PREVIEW_CHARS else "")


def _doc_length(node: ast.AST) -> int | None:
    doc = ast.get_docstring(node)
    return None if doc is None else len(doc)


def _starts_with_text(node: ast.AST) -> bool:
    first = node.body[0] if node.body else None
    return isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)


def _definition(node: ast.AST, parent: ast.AST | None, calls: Counter) -> dict:
    row = dict(
        name=node.name, start_line=node.lineno, end_line=node.end_lineno, col_offset=node.col_offset,
        has_docstring=_starts_with_text(node), doc_len=_doc_length(node),
    )
    if isinstance(node, ast.ClassDef):
        return row | dict(bucket="class", kind="class")
    return row | dict(
        bucket="function", kind="function", complexity=1,
        is_async=isinstance(node, ast.AsyncFunctionDef), nested=isinstance(parent, _FUNCTIONS),
        owner_class=parent.name if isinstance(parent, ast.ClassDef) else None,
        args_count=len(node.args.args), mentions=calls[node.name],
    )


def _imports(node: ast.AST, content: str):
    plain = isinstance(node, ast.Import)
    for alias in node.names:
        bound = alias.asname or alias.name
        yield dict(
            bucket="import", kind="import" if plain else "import_from", name=bound,
            start_line=node.lineno, end_line=node.lineno, alias=alias.asname, imported=alias.name,
            module=alias.name if plain else (node.module or ""), mentions=content.count(bound),
        )


def _module_statement(node: ast.stmt):
    """Assignments, blocks and ``__all__`` members of the module's top level."""
    span = dict(start_line=node.lineno, end_line=node.end_lineno)
    if isinstance(node, ast.Assign):
        for target in node.targets:
            for name, kind in _bound_names(target):
                yield dict(bucket="assignment", kind=kind, name=name, value_repr=_short(node.value), **span)
            listed = isinstance(node.value, (ast.List, ast.Tuple))
            if isinstance(target, ast.Name) and target.id == "__all__" and listed:
                for part in node.value.elts:
                    if isinstance(part, ast.Constant) and isinstance(part.value, str):
                        yield dict(bucket="all_member", kind="all_member", name=part.value, **span)
    elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
        yield dict(
            bucket="assignment", kind="annotated", name=node.target.id, annotation=ast.unparse(node.annotation),
            value_repr=_short(node.value) if node.value else None, **span,
        )
    elif isinstance(node, ast.AugAssign) and isinstance(node.target, ast.Name):
        yield dict(bucket="assignment", kind="augmented", name=node.target.id, value_repr="augmented", **span)
    elif type(node) in _BLOCKS:
        kind = _BLOCKS[type(node)]
        yield dict(bucket="statement", kind="statement", name=f"{kind}_block_L{node.lineno}", stmt_kind=kind, **span)


def symbol_rows(content: str | None) -> list[dict]:
    """Flat rows of one file in walk order; a file that cannot be read gives one error row."""
    try:
        return _rows_of((content or "").replace("\r\n", "\n").replace("\r", "\n"))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
        return [dict(bucket="error", kind="error", walk_ord=0, error=str(problem))]


def _rows_of(text: str) -> list[dict]:
    tree = ast.parse(text)
    calls = Counter(_CALL.findall(text))
    rows = [dict(bucket="module", kind="module", start_line=1, doc_len=_doc_length(tree))]
    # One walk over statements, breadth first: (node, definition it stands in, number of the function it stands in).
    # Decision points (branches, loops, handlers, assertions, comprehension parts and boolean operators) are
    # added up per function, and of inner functions to their outer ones at the end.  Expressions are
    # looked into for them only, so not at all outside functions.
    waiting: deque = deque([(tree, None, -1)])
    functions: list[dict] = []
    outer_of: list[int] = []
    while waiting:
        node, holder, within = waiting.popleft()
        kind = type(node)
        if kind in _DEFINITIONS:
            row = _definition(node, holder, calls)
            rows.append(row)
            holder = node
            if kind is not ast.ClassDef:
                functions.append(row)
                outer_of.append(within)
                within = len(functions) - 1
        elif kind in _IMPORTS:
            rows.extend(_imports(node, text))
        elif within >= 0 and kind in _POINTS:
            functions[within]["complexity"] += _POINTS[kind](node)
        blocks, parts = _blocks_and_parts(kind)
        for field in blocks:
            waiting.extend([(part, holder, within) for part in getattr(node, field) if type(part) not in _LEAF_KINDS])
        if within >= 0:
            functions[within]["complexity"] += _points_below(node, parts)
    for row, outer in zip(reversed(functions), reversed(outer_of)):
        if outer >= 0:
            functions[outer]["complexity"] += row["complexity"] - 1
    for node in tree.body:
        rows.extend(_module_statement(node))
    lines = text.split("\n")
    for position, row in enumerate(rows):
        at = row["start_line"]
        row["walk_ord"] = position
        row["line_text"] = lines[at - 1]
        row["blank_before"] = at > 1 and not lines[at - 2].strip()
    return rows


_LAYOUT = {
    tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING,
}


def raw_counts(content: str | None) -> dict:
    """Line counts of one file by its tokens; only ``loc`` and ``error`` where it cannot be read.

    ``blank`` + ``sloc`` + ``single_comments`` + ``multi`` is ``loc``:

    * blank: nothing but white space, also inside a string;
    * single_comments: a comment alone, or a string statement within one line;
    * multi: lines of a string statement over several lines;
    * sloc: all others.

    ``comments`` counts all comments, those behind code included, and no ``#`` inside a string.
    ``lloc`` counts logical lines, however many physical lines one takes, and each further
    statement that begins on the same one.
    """
    text = (content or "").replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    if not lines[-1]:
        lines.pop()
    try:
        return {"loc": len(lines), **_token_counts(text, lines)}
    except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
        return {"loc": len(lines), "error": str(problem)}


def _token_counts(text: str, lines: list[str]) -> dict:
    tree = ast.parse(text)
    kind = ["blank" if not line.strip() else "sloc" for line in lines]
    logical_of: dict[int, int] = {}
    comments, logical, tokens = 0, 0, []
    for token in tokenize.generate_tokens(io.StringIO(text).readline):
        if token.type == tokenize.COMMENT:
            comments += 1
            if not token.line[: token.start[1]].strip():
                kind[token.start[0] - 1] = "single_comments"
        elif token.type not in _LAYOUT:
            tokens.append(token)
        elif token.type == tokenize.NEWLINE and tokens:
            first, last = tokens[0].start[0], tokens[-1].end[0]
            logical_of.update((number, logical) for number in range(first, last + 1))
            logical += 1
            if all(t.type == tokenize.STRING for t in tokens):
                for number in range(first, last + 1):
                    if kind[number - 1] != "blank":
                        kind[number - 1] = "single_comments" if first == last else "multi"
            tokens = []
    begun = Counter(logical_of[n.lineno] for n in ast.walk(tree) if isinstance(n, ast.stmt) and n.lineno in logical_of)
    further = sum(n - 1 for n in begun.values())
    counted = Counter(kind)
    return {
        "lloc": logical + further, "comments": comments,
        **{name: counted[name] for name in ("sloc", "single_comments", "multi", "blank")},
    }
