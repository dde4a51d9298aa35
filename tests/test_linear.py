"""Text columns whose cost grows with the text, and their values at block and match borders."""

from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import edits, scan

RULE = ("r", r"eval\(", "Eval", "insecure", "high")


def files(spark, content):
    return spark.createDataFrame([("/r", "/r/a.py", content)], "repo string, path string, content string")


CASES = {
    "matches": lambda spark, n: scan.rule_hits(files(spark, "x = eval(y)\n" * n), [RULE]),
    "blanks": lambda spark, n: edits.collapse_blank_runs(files(spark, "a\n\n\n" * (n // 3))),
    "hint": lambda spark, n: scan.find_line_by_content(
        files(spark, "a = 1\n" * n + "last = 2\n"), spark.createDataFrame([("/r/a.py", "last = 2")], "path string, hint string")
    ),
    "edits": lambda spark, n: edits.apply_line_edits(
        files(spark, "a = 1\n" * n),
        spark.createDataFrame([("/r/a.py", i, i, [f"b{i}"]) for i in range(1, n + 1)], "path string, start int, end int, new_lines array<string>"),
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_twice_the_lines_take_about_twice_the_time(spark, name):
    def seconds(n):
        df = CASES[name](spark, n)
        best = []
        for _ in range(3):
            begin = time.time()
            df.write.format("noop").mode("overwrite").save()
            best.append(time.time() - begin)
        return min(best)

    seconds(8_000)
    assert seconds(16_000) <= 2.5 * seconds(8_000) + 0.3


def test_running_max_over_blocks(spark):
    for n in (0, 1, 127, 128, 129, 300):
        numbers = [(i * 7919) % 1009 for i in range(n)]
        df = spark.createDataFrame([(numbers,)], "v array<int>")
        want = [max(numbers[:i], default=0) for i in range(n)]
        assert df.select(text.running_max(F.col("v")).alias("m")).first().m == want


@pytest.mark.parametrize("content", ["", "a\n", "|a|\n||\na", "b\nba\n\nxaab", "a\n\na\n\n|", "no"])
@pytest.mark.parametrize("pattern", ["a", r"\n+", r"a\n\s*", r"(a)|(\|)"])
def test_match_lines(spark, content, pattern):
    df = files(spark, content).select(text.matches_with_lines(F.col("content"), pattern).alias("m"))
    want = [(k, m.group(0), content.count("\n", 0, m.start()) + 1) for k, m in enumerate(re.finditer(pattern, content))]
    assert [tuple(x) for x in df.first().m or []] == want
