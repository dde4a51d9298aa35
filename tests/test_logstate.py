"""State folded in parts against one pass over the whole log."""

import random

import pytest

from codeloom.sources.logstate import ANY, FIRST_KNOWN, LAST, LAST_KNOWN, LogState

SHAPE = "id string, ts int, n int, status string, note string, read boolean"
COLUMNS = {"status": LAST, "note": LAST_KNOWN, "ts": FIRST_KNOWN, "read": ANY}


def one_pass(rows):
    state = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1], r[2])):
        s = state.setdefault(r[0], [None, None, r[1], None])
        s[0] = r[3]
        s[1] = r[4] if r[4] is not None else s[1]
        s[3] = s[3] if r[5] is None else bool(s[3]) or r[5]
    return {k: tuple(v) for k, v in state.items()}


def state_of(store):
    return {r.id: tuple(r)[1:] for r in store.current().collect()}


def test_parts_equal_one_pass(spark, tmp_path):
    draw = random.Random(4)
    rows = [
        (draw.choice(["a", "b", "c", "d", None]), draw.randrange(5), n, draw.choice(["x", "y", None]),
         draw.choice(["p", None, None]), draw.choice([True, False, None]))
        for n in range(60)
    ]
    log = spark.createDataFrame(rows, SHAPE)
    store = LogState(spark, str(tmp_path / "state"), log.schema, ["id"], ["ts", "n"], COLUMNS)
    assert state_of(store) == {} and store.compact() == -1
    parts = [rows[40:], rows[:25], rows[20:40], []]  # out of order, five rows twice, one empty
    seen = []
    for batch, part in enumerate(parts):
        for _ in range(2):  # each part comes twice
            store.add(batch, spark.createDataFrame(part, SHAPE))
        seen += part
        assert state_of(store) == one_pass(seen)
        if batch == 1:
            assert store.compact() == 1 and store.compact() == 1
            assert state_of(store) == one_pass(seen)
    assert state_of(store) == one_pass(rows)
    # Another session finds the same; a batch that comes after its snapshot is an error, not a loss.
    again = LogState(spark, str(tmp_path / "state"), log.schema, ["id"], ["ts", "n"], COLUMNS)
    assert state_of(again) == one_pass(rows) and again.compact() == 3
    again.add(0, log)
    again.add(5, log)
    assert again.compact() == 5 and state_of(again) == one_pass(rows)
    with pytest.raises(ValueError, match="compacted"):
        again.add(4, log)


def test_work_follows_the_part(spark, tmp_path):
    root = str(tmp_path / "state")
    log = spark.createDataFrame([(str(i), i, i, "x", None, None) for i in range(200)], SHAPE)
    store = LogState(spark, root, log.schema, ["id"], ["ts", "n"], COLUMNS)
    store.add(0, log)
    store.compact()
    store.add(1, log.limit(3))
    assert spark.read.parquet(f"{root}/parts/batch=1").count() == 3
    shown = store.current()._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(batch" in shown and "(batch#" in shown
    with pytest.raises(ValueError, match="unknown rules"):
        LogState(spark, root, log.schema, ["id"], ["ts"], {"status": "newest"})
