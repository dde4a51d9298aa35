"""Stored texts, literals of patterns, null keys of the queue and the stored index."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import edits, queue, scan
from codeloom.plans import analyze
from codeloom.sources.texts import store_texts
from suite.views import Tables

FOLDER = "/root/testdata/sf0.001"


def moved(df):
    """Attributes that the exchanges of a plan take in."""
    shown = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = re.findall(r"^\(\d+\) (\w*Exchange)\nInput \[\d+\]: \[(.*)\]$", shown, re.M)
    assert "Exchange" not in shown or nodes
    return [{name.split("#")[0] for name in names.split(", ")} for _, names in nodes]


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def stored(spark, tmp_path):
    made = store_texts(Tables(spark, FOLDER).files, f"texts_{uuid.uuid4().hex}", 5, str(tmp_path / "texts"))
    yield made
    spark.sql(f"DROP TABLE {made.name}")


def some_edits(files):
    planned = F.array(*[
        F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.array(F.lit(x)).alias("new_lines")) for a, b, x in ((1, 0, "top"), (2, 3, "new"))
    ])
    return files.filter(F.hash("path") % 3 == 0).select("path", F.explode(planned).alias("e")).select("path", "e.*")


def test_edits_meet_stored_texts_without_moving_them(spark, stored, no_broadcast):
    plain = Tables(spark, FOLDER).files
    rows = some_edits(plain)
    done = edits.apply_line_edits(stored.files, stored.aligned(rows))
    assert moved(done) and not any("content" in names for names in moved(done))
    # Texts come sorted from their buckets: the only sort is that of the edits.
    assert done._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    want = edits.apply_line_edits(plain, rows)
    assert any("content" in names for names in moved(want))
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, want.collect()))


def test_lines_and_hints_go_to_stored_texts(spark, stored, no_broadcast):
    plain = Tables(spark, FOLDER).files
    wanted = plain.select("path", F.explode(F.array(F.lit(1), F.lit(3), F.lit(10**6))).alias("line"))
    hints = plain.select("path", F.substring("content", 3, 9).alias("hint"))
    for operator, rows in ((scan.lines_at, wanted), (scan.find_line_by_content, hints), (edits.rejected_edits, some_edits(plain))):
        got = operator(stored.files, stored.aligned(rows))
        assert not any("content" in names for names in moved(got))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, operator(plain, rows).collect()))


def test_planned_edits_leave_stored_texts(spark, tmp_path, no_broadcast):
    code = Tables(spark, FOLDER).code
    made = store_texts(code, f"texts_{uuid.uuid4().hex}", 5, str(tmp_path / "code"))
    index = analyze.build_index(code, keep=True)
    actions = analyze.coordinate_actions(analyze.collect_findings(index), index)
    got = edits.plan_edits(actions.select("id", "action_type", "target"), index.latest, made.files, made.aligned)
    assert not any("content" in names for names in moved(got.filter("path IS NOT NULL")))
    want = edits.plan_edits(actions.select("id", "action_type", "target"), index.latest, code)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    spark.sql(f"DROP TABLE {made.name}")


def test_empty_null_and_repeated_texts_are_stored(spark, tmp_path, no_broadcast):
    shape = "repo string, path string, content string, path_note string"
    rows = [("r", "a", "x\ny\n", "n"), ("r", "b", None, None), ("r", None, "z\n", "n"), ("r", "c", "", "n"), ("r", "d", "l\n" * 50_000, "n")]
    for name, files in (("full", spark.createDataFrame(rows, shape)), ("none", spark.createDataFrame([], shape))):
        made = store_texts(files, f"texts_{name}_{uuid.uuid4().hex}", 3, str(tmp_path / name))
        cuts = spark.createDataFrame([("a", 1, 1, []), ("d", 1, 49_999, ["one"]), ("b", 1, 1, [])], "path string, start int, end int, new_lines array<string>")
        got = {tuple(r) for r in edits.apply_line_edits(made.files, made.aligned(cuts)).collect()}
        want = {("r", "a", "y\n", "n"), ("r", "b", None, None), ("r", None, "z\n", "n"), ("r", "c", "", "n"), ("r", "d", "one\nl\n", "n")}
        assert got == (want if name == "full" else set())
        spark.sql(f"DROP TABLE {made.name}")


def test_required_literals(spark):
    cases = {
        "no such text 7": "no such text 7", r"[a-z]{2,}\. A": ". A", r"x = [0-9]": "x = ", r"a\\d": "a\\d", "ab[cd]*efg[h]+": "efg",
        r"ab?": None, r"a|b": None, r"(?i)key": None, r"\d+": None, r"^x": None, r"x{2}": None, r"[a-c]": None, "": None,
        r"x\[abc]+y": None, r"[^\]]+": None, "[]a]b": None, r"[a]+?bc": None, r"\.?x": None, "a.b": None, "q\x00r": None, None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "regex string").select("regex", text.required_literal(F.col("regex")).alias("got"))
    assert {r.regex: r.got for r in rows.collect()} == cases


def test_null_keys_of_the_queue_lose_no_review(spark):
    shape = "id string, action_type string, target string, risk_level string, owner string, created_at int"
    rows = [
        ("1", "delete_import", None, "low", None, 1), ("2", "delete_import", None, "low", "x", 2), ("3", "delete_function", "f@a:b", "high", None, 1),
        ("4", "delete_import", "f@a:c", "low", None, 2), ("5", None, "f@a:c", "low", "x", 3),
    ]
    reviews = spark.createDataFrame(rows, shape)
    assert {r.id: (r.review_id, r.is_duplicate) for r in queue.dedup_pending(reviews).collect()} == {
        "1": ("1", False), "2": ("1", True), "3": ("3", False), "4": ("4", False), "5": ("5", False)}
    for df in (queue.is_blocked(reviews), queue.block_reason(reviews), queue.block_reason(reviews, by_owner=True)):
        assert sorted(r.id for r in df.collect()) == ["1", "2", "3", "4", "5"]
    assert {r.id for r in queue.block_reason(reviews, owner="x").collect()} == {"2", "5"}


def test_stored_index_is_pruned_by_bucket(spark):
    index = analyze.build_index(Tables(spark, FOLDER).code, keep=True)
    for df in (index.symbols, index.latest):
        shown = df.filter("bucket = 'function' AND name = 'load_3'").select("path")._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = function", shown) and "EqualTo(name,load_3)" in shown
        assert "ReadSchema: struct<path:string,name:string>" in shown or "ReadSchema: struct<name:string,path:string>" in shown
