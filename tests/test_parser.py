"""Files that break a parser give one row and harm nothing else."""

import ast
import time

import pytest

from codeloom.functions import pyast
from codeloom.functions.pyast import symbol_rows

HARD = {
    "carriage_return": "a = 1\rb = 2\r\ndef f():\r    pass\r",
    "long_sum": "x = " + " + ".join(["1"] * 3000),
    "long_chain": "x = a" + ".b" * 3000,
    "unary_signs": "x = " + "-" * 20000 + "1",
    "null_byte": "x = 1\0",
    "surrogate": "x = '\ud800'",
}


@pytest.mark.parametrize("name", HARD)
def test_hard_files_give_rows(name):
    rows = symbol_rows(HARD[name])
    assert rows and all(r["walk_ord"] == i for i, r in enumerate(rows))
    assert rows[0]["bucket"] in ("module", "error")


def test_line_ends_are_read_alike():
    assert symbol_rows("a = 1\rdef f():\r    pass\r") == symbol_rows("a = 1\ndef f():\n    pass\n")


def test_a_long_word_is_looked_at_once():
    """Before, the search for calls went back through a word from each of its letters: a minute for these."""
    text = "def f():\n    pass\n# " + "a" * 50_000 + "\nf ()\n"
    begin = time.process_time()
    rows = symbol_rows(text)
    assert time.process_time() - begin < 2
    assert [r["mentions"] for r in rows if r["bucket"] == "function"] == [2]


def test_calls_are_those_of_any_word_before_a_bracket():
    assert pyast._CALL.findall("f(g (1), é\n(2)) a.b() _x1 y3(") == ["f", "g", "é", "b", "y3"]


def test_expressions_outside_functions_are_not_visited(monkeypatch):
    """They lead to no definition, import or decision point of a function."""
    seen = []
    whole = pyast._fields_of
    monkeypatch.setattr(pyast, "_fields_of", lambda kind: seen.append(kind) or whole(kind))
    pyast._split_fields.clear()
    symbol_rows("x = [a and b, c.d(e or f)]\nclass A(g and h):\n    y = i if j else k\n")
    assert not [kind for kind in seen if issubclass(kind, ast.expr)]


def test_decision_points_of_every_place_of_a_function():
    text = (
        "@deco(a and b)\nasync def f(x=1 if c else 2, *, y: (d or e) = 3) -> (g and h):\n"
        "    async with i as j, k:\n        try:\n            pass\n        except (X if l else Y):\n"
        "            def inner():\n                assert m and n\n        else:\n            pass\n"
        "    match o:\n        case 1 if p or q:\n            class C(r and s):\n                z = [t for t in u if t]\n"
    )
    found = {r["name"]: r["complexity"] for r in symbol_rows(text) if r["bucket"] == "function"}
    # 4 of the header, with, handler and its expression, else; the case and its guard; the bases; comprehension 2; inner 2.
    assert found == {"f": 1 + 4 + 1 + 1 + 1 + 1 + 1 + 1 + 1 + 2 + 2, "inner": 3}
