"""Streams give what the batch operators give."""

import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators import routing
from codeloom.schemas import FILE_EVENTS
from codeloom.sources import tables as stored
from codeloom.streaming import state, watch

START = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame(
        [(p, f, "modified", False, START + timedelta(seconds=s)) for p, f, s in rows], FILE_EVENTS)


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_debounce_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("p", "a.py", s) for s in (0, 10, 35, 65, 200, 230)] + [("q", "b.py", 5), ("q", "c.txt", 6)]
    events(spark, rows).coalesce(1).write.parquet(source)
    events(spark, [("end", "z.py", 10_000)]).coalesce(1).write.mode("append").parquet(source)
    events(spark, [("end", "z.py", 20_000)]).coalesce(1).write.mode("append").parquet(source)
    stream = watch.debounce(watch.read_file_events(spark, source, files_per_batch=1))
    out = str(tmp_path / "out")
    run(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append"))
    got = {(r.project_id, r.session_start, r.fires_at, r.n_events) for r in spark.read.parquet(out).collect() if r.project_id != "end"}
    batch = watch.debounce_table(watch.python_changes(events(spark, rows)), 30, "path", chunk_seconds=20)
    assert got == {(r.project_id, r.session_start, r.fires_at, r.n_events) for r in batch.collect()}
    # a pause of exactly the gap goes on with the burst: 35 -> 65 and 200 -> 230
    assert sorted(r[3] for r in got if r[0] == "p") == [2, 4]


@pytest.mark.parametrize("chunk", [7, 60, 3600])
def test_chunks_do_not_change_sessions(spark, chunk):
    rows = [("hot", "a.py", (i * i * 13) % 5000) for i in range(400)] + [("cold", "a.py", 50)]
    table = events(spark, rows).withColumn("n", F.monotonically_increasing_id())
    expected = sorted({(p, s) for p, _, s in rows})
    starts, last = set(), {}
    for p, s in expected:
        if p not in last or s - last[p] > 30:
            starts.add((p, s))
        last[p] = s
    got = watch.debounce_table(table, 30, "n", chunk).collect()
    assert {(r.project_id, int((r.session_start - START).total_seconds())) for r in got} == starts
    assert sum(r.n_events for r in got) == len(rows)


def test_only_watched_projects(spark):
    projects = spark.createDataFrame([("p", "watching"), ("q", "stopped")], "project_id string, status string")
    assert {r.project_id for r in watch.watched(events(spark, [("p", "a.py", 1), ("q", "a.py", 1)]), projects).collect()} == {"p"}


def test_change_triggers_analysis_and_one_notification(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("p", START, START + timedelta(seconds=30), 3), ("p", START + timedelta(60), START + timedelta(90), 1)],
                          "project_id string, session_start timestamp, fires_at timestamp, n_events long").coalesce(1).write.parquet(source)
    bursts = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    files = spark.createDataFrame([("p", "p/a.py", "eval(x)"), ("q", "q/a.py", "eval(x)")], "repo string, path string, content string")
    out = str(tmp_path / "out")
    run(watch.on_change(bursts, files, lambda f: f.select("repo", "path"), out, str(tmp_path / "cp")))
    assert [r.path for r in spark.read.parquet(f"{out}/reviews").collect()] == ["p/a.py"]
    note = spark.read.parquet(f"{out}/notifications").collect()
    assert [(n.pending_count, n.message) for n in note] == [(1, "1 action(s) need your review in 'p'")]


def test_open_reviews_stay_unique_until_decided(spark, tmp_path):
    schema = "id string, review_id string, action_type string, target string, created_at timestamp"
    source, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    clock = iter(range(1000))

    def arrive(*rows):
        data = [(i if new else None, None if new else i, "fix_security", t, START + timedelta(seconds=next(clock))) for new, i, t in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        taken = state.open_reviews(stream.filter("id is not null"), stream.filter("review_id is not null"))
        run(taken.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append"))

    def open_now():
        return sorted(r[0] for r in spark.read.format("statestore").load(cp).select("value.groupState.id").collect())

    arrive((True, "1", "x"), (True, "2", "x"), (True, "3", "y"))
    assert open_now() == ["1", "3"]
    arrive((True, "4", "x"), (False, "2", "x"), (True, "6", "x"))
    arrive((False, "1", "x"))
    assert open_now() == ["3"]
    arrive((True, "5", "x"), (False, "5", "x"), (True, "7", "x"), (False, "3", "y"), (False, "7", "x"))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["1", "3", "5", "7"]
    assert open_now() == []


def test_running_rates_equal_batch_rates(spark, tmp_path):
    schema = "id long, action_type string, context_hash string, was_approved boolean, created_at timestamp"
    source, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    rows = [(i, "fix_security", "h" if i % 3 else "g", i % 4 != 0, START + timedelta(seconds=(i * 37) % 100)) for i in range(90)]
    for part in range(3):
        spark.createDataFrame(rows[part * 30:(part + 1) * 30], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        run(state.last_decisions(stream, 10, parts=2).writeStream.format("noop").outputMode("update").option("checkpointLocation", cp))
        seen = spark.createDataFrame(rows[:(part + 1) * 30], schema)
        assert sorted(map(tuple, state.current_rates(spark, cp, 10).collect())) == sorted(map(tuple, routing.rejection_rate(seen, 10).collect()))
    assert state.kept_decisions(spark, cp).count() <= 2 * 2 * 10


def test_a_timer_closes_the_last_burst(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("p", "a.py", s) for s in (0, 10, 35, 65, 200, 230)] + [("q", "b.py", 5)]
    events(spark, rows).coalesce(1).write.parquet(source)
    stream = state.debounce_timed(watch.read_file_events(spark, source), 30, idle_seconds=2)
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append")
    query = writer.trigger(processingTime="1 second").start()
    try:
        end = time.monotonic() + 60
        while time.monotonic() < end and not (query.lastProgress and query.lastProgress.stateOperators[0].numRowsRemoved):
            time.sleep(0.5)
    finally:
        query.stop()
    got = {(r.project_id, r.session_start, r.fires_at, r.n_events) for r in spark.read.parquet(out).collect()}
    batch = watch.debounce_table(watch.python_changes(events(spark, rows)), 30, "path", chunk_seconds=20)
    assert got == {(r.project_id, r.session_start, r.fires_at, r.n_events) for r in batch.collect()}


def test_bursts_join_in_any_order():
    times = [0, 10, 35, 65, 200, 230, 500]
    whole = state.bursts_of(np.array(times), 30)
    for cut in range(1, len(times)):
        parts = [*state.bursts_of(np.array(times[cut:]), 30), *state.bursts_of(np.array(times[:cut]), 30)]
        assert state.joined_bursts(parts, 30) == whole == [(0, 65, 4), (200, 230, 2), (500, 500, 1)]


def test_bounded_dedup_stream(spark, tmp_path):
    schema = "id string, action_type string, target string, created_at timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(str(i), "a", f"t{i % 3}", START + timedelta(seconds=i)) for i in range(9)], schema).coalesce(1).write.parquet(source)
    stream = watch.dedup_bounded(spark.readStream.schema(schema).parquet(source))
    run(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append"))
    assert spark.read.parquet(out).select("target").distinct().count() == spark.read.parquet(out).count() == 3


def test_logs_append_and_queue_restores(spark, tmp_path):
    folder = str(tmp_path)
    good = '{"action_type":"a","target":"f@line:1"}'
    rows = [("2", good, "pending", START), ("1", good, "pending", START - timedelta(1)), ("3", "oops", "pending", START), ("4", good, "completed", START)]
    stored.append_log(spark.createDataFrame(rows, "id string, action_data string, status string, created_at timestamp"), folder, "reviews")
    pending, corrupt = stored.read_queue(stored.read_table(spark, folder, "reviews"))
    assert [(r.id, r.action.target, r.username) for r in pending.collect()] == [("1", "f@line:1", None), ("2", "f@line:1", None)]
    assert [r.id for r in corrupt.collect()] == ["3"]
