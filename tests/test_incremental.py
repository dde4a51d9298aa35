"""Refreshing changed files gives what a whole analysis gives, and parses nothing else."""

import pytest
from pyspark.sql import functions as F

from codeloom.plans import analyze, incremental
from tests.corpus import FILES, frame

CHANGES = [
    {},
    # a call of a private name comes, a star import goes
    {"/a/calls.py": "import dead\n\ndead._tangled(1)\n", "/a/app.py": "import os\nprint(os.sep)\n"},
    # an import that led nowhere finds its file; another loses it
    {"/a/nowhere.py": "def thing():\n    pass\n\ndef _idle():\n    pass\n", "/a/pkg/core.py": None, "/a/app.py": FILES["/a/app.py"]},
    # the same texts again
    {},
    {"/a/dead.py": None, "/b/solo.py": None, "/a/pkg/core.py": FILES["/a/pkg/core.py"]},
]
PARSED = [len(FILES), 2, 2, 0, 1]


def rows(df):
    return sorted(map(str, df.select("path", "name", "is_dead", "reason").collect()))


def test_refresh_equals_whole_analysis(spark, tmp_path):
    store, files = incremental.Store(spark, str(tmp_path / "store")), dict(FILES)
    for batch, (change, parsed) in enumerate(zip(CHANGES, PARSED)):
        files = {p: c for p, c in {**files, **change}.items() if c is not None}
        snapshot = frame(spark, files)
        scope = spark.createDataFrame([("/a",), ("/b",)], "repo string")
        for _ in range(2 if batch == 2 else 1):  # a batch may be run again
            incremental.refresh(store, batch, snapshot, scope)
        assert store.rows("files").filter(F.col("batch") == batch).count() == parsed
        whole = analyze.liveness(analyze.build_index(snapshot))
        assert rows(incremental.liveness(store)) == rows(whole), batch
    judged = store.rows("marks").filter("step = 'judged' and not gone and batch = 3")
    assert judged.count() == 0


def test_other_repositories_stay(spark, tmp_path):
    store = incremental.Store(spark, str(tmp_path / "store"))
    both = spark.createDataFrame([("/a",), ("/b",)], "repo string")
    incremental.refresh(store, 0, frame(spark), both)
    before = rows(incremental.liveness(store).filter("repo = '/b'"))
    one = {p: c for p, c in FILES.items() if p in ("/a/dead.py", "/a/app.py")}
    changes = incremental.refresh(store, 1, frame(spark, one), both.limit(1))
    assert {r.state for r in changes.collect()} == {"removed"}
    assert rows(incremental.liveness(store).filter("repo = '/b'")) == before


def test_texts_are_made_twice_a_refresh(spark, tmp_path):
    """Once to be hashed and once to be stored; steps after that read what is stored."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(content):
        made.add(1)
        return content

    store = incremental.Store(spark, str(tmp_path / "store"))
    snapshot = frame(spark).withColumn("content", counted("content"))
    incremental.refresh(store, 0, snapshot, frame(spark).select("repo").distinct())
    assert store.rows("files").count() == len(FILES)
    assert 0 < made.value <= 2 * len(FILES)
