"""Steps that many queries share keep to what they promise on large inputs."""

import ast
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from codeloom.functions.pyast import symbol_rows
from codeloom.operators import skew, symbols
from codeloom.session import tune
from codeloom.streaming import state

FOLDER = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_narrow_rows_are_spread_without_a_setting(spark):
    before = spark.conf.get(skew.SPREAD_SETTING)
    spark.conf.unset(skew.SPREAD_SETTING)
    try:
        one = spark.range(100).coalesce(1)
        assert skew.spread(one, "id").rdd.getNumPartitions() == 1
        spread = skew.spread(one, "id", always=True)
        assert spread.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
        assert sorted(r.id for r in spread.collect()) == list(range(100))
        code = entry.queries()["function_complexity"](spark, FOLDER)
        assert code.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set(skew.SPREAD_SETTING, before)


def test_narrow_rows_are_spread_by_their_number(spark, monkeypatch):
    before = spark.conf.get(skew.SPREAD_SETTING)
    spark.conf.unset(skew.SPREAD_SETTING)
    monkeypatch.setattr(skew, "ROWS_A_TASK", 50, raising=False)
    try:
        spread = skew.spread(spark.range(5001).coalesce(1), "id", always=True)
        assert spread.rdd.getNumPartitions() == 101
        assert skew.spread(spark.range(0), "id", always=True).rdd.getNumPartitions() >= 1
        assert sorted(r.id for r in spread.collect()) == list(range(5001))
    finally:
        spark.conf.set(skew.SPREAD_SETTING, before)


def test_no_side_is_broadcast_by_the_size_of_its_files(spark, tmp_path):
    tune(spark)
    spark.range(50).select("id", F.concat(F.lit("r/m"), F.col("id").cast("string")).alias("path")).write.parquet(str(tmp_path / "t"))
    small = spark.read.parquet(str(tmp_path / "t"))
    other = spark.range(50).select("id")
    assert "BroadcastHashJoin" not in plan(other.join(small, "id"))
    assert other.join(small, "id").count() == 50
    assert not spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold").startswith("-")


@pytest.mark.parametrize("name", [
    "file_state", "definitions", "module_exports", "index_summary", "package_definitions", "package_offers", "parent_class", "star_import_sources",
])
def test_texts_are_parsed_once_where_symbols_are_read_often(spark, name):
    assert "MapInArrow" not in plan(entry.queries()[name](spark, FOLDER))


SOURCE = '''
@outer(lambda q: q if q else 0)
def f(a=[x for x in y if x if z]):
    class Inner:
        def g(self):
            async def h():
                async for i in j:
                    assert i and j or k
            while True:
                pass
            else:
                pass
    match a:
        case {"k": 1, **rest}:
            import os, json as js
        case [1, *_]:
            pass
    try:
        with a as b, c:
            pass
    except E:
        pass
    except (F, G):
        from m import *
    else:
        return {**a, 1: lambda: a if a else b}
'''


def test_one_walk_counts_inner_functions_for_outer_ones():
    def points(node):
        total = 0
        for part in ast.walk(node):
            total += {
                ast.If: 1, ast.IfExp: 1, ast.With: 1, ast.AsyncWith: 1, ast.Assert: 1,
            }.get(type(part), 0)
            if isinstance(part, (ast.For, ast.AsyncFor, ast.While)):
                total += 1 + bool(part.orelse)
            elif isinstance(part, ast.Try):
                total += len(part.handlers) + bool(part.orelse)
            elif isinstance(part, ast.BoolOp):
                total += len(part.values) - 1
            elif isinstance(part, ast.comprehension):
                total += 1 + len(part.ifs)
            elif isinstance(part, ast.Match):
                total += len(part.cases)
        return total

    tree = ast.parse(SOURCE)
    expected = {n.name: 1 + points(n) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
    rows = symbol_rows(SOURCE)
    assert {r["name"]: r["complexity"] for r in rows if r["bucket"] == "function"} == expected
    assert [(r["name"], r["nested"], r["owner_class"]) for r in rows if r["bucket"] == "function"] == [
        ("f", False, None), ("g", False, "Inner"), ("h", True, None)]
    assert [r["name"] for r in rows if r["bucket"] == "import"] == ["os", "js", "*"]


def test_columns_hold_the_rows_of_every_file():
    texts = [None, "", "x = 1\n", "def broken(:\n", SOURCE] * 40
    batch = pa.RecordBatch.from_pydict({"repo": ["r"] * 200, "path": [f"p{i}" for i in range(200)], "content": texts})
    got = [row for out in symbols.parse_batches(iter([batch])) for row in out.to_pylist()]
    wanted = [{"repo": "r", "path": f"p{i}", **row} for i, text in enumerate(texts) for row in symbol_rows(text)]
    assert [{k: v for k, v in row.items() if v is not None} for row in got] == [
        {k: v for k, v in row.items() if v is not None} for row in wanted]


def test_targets_of_a_bucket_are_taken_in_one_call_and_stay_apart(spark, tmp_path):
    """All targets in two buckets, over three batches, against a walk row by row; keys and times may be null."""
    schema = "id string, review_id string, action_type string, target string, created_at timestamp"
    source, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    now, expected = {}, []
    for batch in range(3):
        rows = []
        for i in range(120):
            place = batch * 120 + i
            new, n = place % 3 != 2, place if place % 3 != 2 else place - 2 - place % 7
            action, target = (None if place % 11 == 5 else f"a{place % 2}"), (None if place % 13 == 7 else f"t{place % 17}")
            rows.append((f"{n:04}" if new else None, None if new else f"{n:04}", action, target, None if place % 29 == 3 else START + timedelta(seconds=place)))
        held = list(now.items())
        rows += [(None, id_, action, target, START + timedelta(days=1)) for (action, target), id_ in held[::2]]
        for id_, review_id, action, target, at in sorted(rows, key=lambda r: (r[4] is None, r[4] or START, r[0] is not None, r[0] or r[1])):
            key = (action, target)
            if id_ is not None and key not in now:
                now[key] = id_
                expected.append((id_, action, target, at))
            elif id_ is None and now.get(key) == review_id:
                del now[key]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        taken = state.open_reviews(stream.filter("id is not null"), stream.filter("review_id is not null"), buckets=2)
        query = taken.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        query.awaitTermination(120)
    def order(rows):
        return sorted(map(tuple, rows), key=str)

    assert order(spark.read.parquet(out).collect()) == order(expected)
    kept = spark.read.format("statestore").load(cp).select("value.groupState.*").collect()
    assert len(kept) <= 2
    assert sorted(i for r in kept for i in [r.id, *r.ids]) == sorted(now.values())
