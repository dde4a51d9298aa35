"""Rule tables: credentials, import lines, targets, routing, edits."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import rules, text
from codeloom.operators import edits, history, queue, routing, scan
from codeloom.operators.skew import interval_join, rank_within


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("r")).first().r


@pytest.mark.parametrize("line, name", [
    ('API_KEY = "dummy-abc"', "API_KEY"),
    ('smtp_password = "Pass@1"', "smtp_password"),
    ('DATABASE_URL = "postgres://..."', "DATABASE_URL"),
    ('jwt_secret = "abcXYZ123"', "jwt_secret"),
    ('value: str = "Ab1Ab1Ab1Ab1"  # note', "value"),
    ("long_thing = 'a/b/c/d/e/f/g/h/i/j'", "long_thing"),
    ('VERSION = "1.0.0"', None),
    ('STATUS = "active"', None),
    ('ENV = "development"', None),
    ("CHUNK_SIZE = 8192", None),
    ('WORDS = "averyveryverylongword"', None),
    ('api_key = os.getenv("API_KEY")', None),
    ('mixed = "quotes\'', None),
])
def test_credential_gates(spark, line, name):
    found = one(spark, text.parse_credential(F.col("line")), line=line)
    assert (found.name if found else None) == name


@pytest.mark.parametrize("line, expected", [
    ('    api_key = "dummy-abc"', ['    api_key = os.getenv("API_KEY")']),
    ("  exec(x)", ["  # SECURITY WARNING: exec() allows arbitrary code execution — validate or replace with safe alternative", "  # exec(x)"]),
    ("f(password=y)", ["# SECURITY WARNING: Hardcoded secret detected — move to environment variable", "# f(password=y)"]),
    ('k = os.environ["K"]', ['k = os.environ["K"]']),
])
def test_rewritten_lines(spark, line, expected):
    assert one(spark, text.rewritten_line(F.col("line")), line=line).new_lines == expected


@pytest.mark.parametrize("line, name, new, whole", [
    ("import os, sys, json", "json", "import os, sys", False),
    ("from typing import List, Dict, Any", "Any", "from typing import List, Dict", False),
    ("import numpy as np, pandas as pd", "np", "import pandas as pd", False),
    ("from os import path as p, getcwd", "p", "from os import getcwd", False),
    ("  import os", "os", "  import os", True),
    ("from . import x", "x", "from . import x", True),
])
def test_import_lines(spark, line, name, new, whole):
    got = one(spark, text.without_import(F.col("line"), F.col("name")), line=line, name=name)
    assert (got.new_line, got.whole_line) == (new, whole)


@pytest.mark.parametrize("target, expected", [
    ("/a/b.py@function:f", ("/a/b.py", "function", "f")),
    ("/a/b.py@line:42", ("/a/b.py", "line", "42")),
    ("/a/b.py:42", ("/a/b.py", "line", "42")),
    ("/a/b.py", ("/a/b.py", "line", "")),
])
def test_targets(spark, target, expected):
    assert tuple(one(spark, text.decode_target(F.col("t")), t=target)) == expected


@pytest.mark.parametrize("action, confidence, subs, rate, decision, reason", [
    ("restructure", 0.99, [], None, "review", "Critical risk: restructure"),
    ("delete_import", 0.69, [], None, "review", "Low confidence: 0.69 < 0.7"),
    ("delete_function", 0.75, [], None, "review", "HIGH risk requires ≥0.85 confidence — got 0.75"),
    ("fix_security", 0.95, [], None, "review", "Security fixes always require manager approval"),
    ("refactor_code", 1.0, ["refactor_code", "add_docstring"], None, "review", "Code refactoring always requires manager approval"),
    ("add_docstring", 0.9, [], 0.6, "review", "Historical rejection rate 60% > 50% — escalating"),
    ("add_docstring", 0.9, [], 0.5, "auto", "Auto-approved: low risk, confidence=0.90"),
    ("delete_function", 1.0, [], None, "auto", "Auto-approved: high risk, confidence=1.00"),
])
def test_routing_ladder(spark, action, confidence, subs, rate, decision, reason):
    rows = spark.createDataFrame([(action, confidence, subs)], "action_type string, confidence double, sub_actions array<string>")
    rows = rows.withColumn("risk_level", rules.risk_of(F.col("action_type")))
    rates = spark.createDataFrame([(action, rate)], "action_type string, rejection_rate double").withColumn(
        "context_hash", text.context_hash(F.col("action_type"), rules.risk_of(F.col("action_type"))))
    got = routing.route(rows, rates if rate is not None else None).first()
    assert (got.decision, got.reason) == (decision, reason)


def test_override_and_task_mode(spark):
    rows = spark.createDataFrame([("restructure", 1.0, "critical", []), ("delete_import", 0.85, "low", [])],
                                 "action_type string, confidence double, risk_level string, sub_actions array<string>")
    assert {r.decision for r in routing.route(rows, auto_approve=True).collect()} == {"auto"}
    assert {r.decision for r in routing.route(rows, mode="task").collect()} == {"review"}
    task = {r.action_type: r.decision for r in routing.route(rows, mode="task", auto_approve=True).collect()}
    assert task == {"restructure": "review", "delete_import": "auto"}


_LINE = st.text(alphabet="ab #", max_size=5)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(lines=st.lists(_LINE, min_size=1, max_size=12), data=st.data())
def test_edits_equal_a_plain_list_edit(spark, lines, data):
    starts = data.draw(st.lists(st.integers(1, len(lines)), unique=True, max_size=3))
    chosen = [(s, s, [f"new{s}"] if s % 2 else []) for s in starts]
    files = spark.createDataFrame([("r", "p", "\n".join(lines) + "\n")], "repo string, path string, content string")
    rows = spark.createDataFrame([("p", *e) for e in chosen], "path string, start int, end int, new_lines array<string>")
    expected = []
    for number, line in enumerate(lines, 1):
        hit = next((e for e in chosen if e[0] == number), None)
        expected += [line] if hit is None else hit[2]
    got = edits.apply_line_edits(files, rows).first().content
    assert got == "".join(x + "\n" for x in expected)


def test_overlapping_and_impossible_edits(spark):
    files = spark.createDataFrame([("r", "p", "1\n2\n3\n4\n\n\n7\n")], "repo string, path string, content string")
    rows = spark.createDataFrame(
        [("p", 2, 4, []), ("p", 3, 3, []), ("p", 9, 9, ["x"]), ("p", 1, 0, ["top"]), ("q", 1, 1, [])],
        "path string, start int, end int, new_lines array<string>")
    assert edits.apply_line_edits(files, rows, collapse=True).first().content == "top\n1\n\n7\n"
    assert {(r.path, r.start) for r in edits.rejected_edits(files, rows).collect()} == {("p", 9), ("q", 1)}


def test_identity_without_edits(spark):
    files = spark.createDataFrame([("r", "p", "no newline at end")], "repo string, path string, content string")
    rows = spark.createDataFrame([], "path string, start int, end int, new_lines array<string>")
    assert edits.apply_line_edits(files, rows).first().content == "no newline at end"


def test_hint_search_skips_blank_lines_unless_asked(spark):
    files = spark.createDataFrame([("r", "p", "a = 1\n\n  secret = 2\n")], "repo string, path string, content string")
    hints = spark.createDataFrame([("p", "secret")], "path string, hint string")
    assert scan.find_line_by_content(files, hints).first().line == 3
    assert scan.find_line_by_content(files, hints, skip_blank=False).first().line == 2


def test_rank_and_interval_helpers_equal_brute_force_on_one_hot_key(spark):
    hot = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        (F.col("id") * 7919 % 1009).alias("v"), "id")
    ranked = rank_within(hot, ["key"], [F.col("v"), F.col("id")], F.floor(F.col("v") / 50))
    seen = {}
    for r in sorted(ranked.collect(), key=lambda r: (r.key, r.v, r.id)):
        seen[r.key] = seen.get(r.key, 0) + 1
        assert r.position == seen[r.key]
    spans = spark.createDataFrame([("hot", 10, 120), ("hot", 500, 500), ("k1", 0, 2000)], "key string, a int, b int")
    got = interval_join(hot, spans, ["key"], "v", "a", "b", 64, "inner").count()
    rows, wanted = hot.collect(), spans.collect()
    assert got == sum(1 for r in rows for s in wanted if r.key == s.key and s.a <= r.v <= s.b)


def test_queue_properties_with_one_file_holding_most_rows(spark):
    rows = spark.range(2000).select(
        F.col("id").cast("string").alias("id"),
        F.get(F.array(*[F.lit(a) for a in ("delete_import", "add_docstring", "move_file", "delete_file")]), (F.col("id") % 4).cast("int")).alias("action_type"),
        F.concat(F.when(F.col("id") % 3 < 2, F.lit("/hot.py")).otherwise(F.concat(F.lit("/f"), F.col("id") % 40)), F.lit("@function:f"), F.col("id") % 97).alias("target"),
        (F.col("id") % 5).alias("owner"), F.timestamp_seconds(F.col("id")).alias("created_at"))
    blocked = queue.is_blocked(rows).collect()
    low = {}
    for r in blocked:
        low[r.file] = min(low.get(r.file, 99), r.action_order)
    assert all(r.is_blocked == (low[r.file] < r.action_order) for r in blocked)
    once = queue.unique_pending(rows)
    assert once.count() == queue.unique_pending(once).count() == rows.select("action_type", "target").distinct().count()
    total = queue.group_counts(rows).filter("file is null").first()
    assert total.total == 2000 and total.blocked == sum(r.is_blocked for r in blocked)
    mine = queue.block_reason(rows, owner=3).collect()
    assert len(mine) == 400
    # the reason only knows visible rows, blocking knows all
    both = rows.filter("id in ('0', '6')").withColumn("owner", F.col("id").cast("int")).withColumn("target", F.lit("/hot.py@function:f"))
    alone = queue.block_reason(both, owner=6).first()
    assert alone.is_blocked and alone.block_reason == ""


def test_notes_and_status_of_jobs(spark):
    reviews = spark.createDataFrame([("a", "approved", "n"), ("b", "approved", None), ("c", "approved", "n")], "id string, status string, review_notes string")
    jobs = spark.createDataFrame(
        [("j1", "a", "partial", False, [(True,), (False,)]), ("j2", "b", "done", True, []), ("j3", "c", "running", False, [])],
        "job_id string, review_id string, status string, success boolean, steps array<struct<success:boolean>>")
    got = {r.id: (r.status, r.review_notes) for r in queue.execution_outcome(reviews, jobs).collect()}
    assert got == {"a": ("partially_approved", "n | execution: 1/2 steps succeeded | job:j1"), "b": ("approved", " | execution: success | job:j2")}


def test_empty_history_gives_zeros(spark):
    none = spark.createDataFrame([], "action_type string, was_approved boolean, confidence double")
    row = history.action_stats(none, by=None).first()
    assert (row.total, row.approved, row.avg_confidence, row.approval_rate) == (0, 0, 0.0, 0.0)
