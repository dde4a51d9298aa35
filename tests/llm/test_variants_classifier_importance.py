"""Spelling variants and importance resampling against brute force, the classifier by held-out rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import classifier, importance, variants
from codeloom.llm.common import id_remainder

RNG = np.random.default_rng(11)
LETTERS = list("abcé÷")
WORDS = ["".join(RNG.choice(LETTERS, RNG.integers(5, 9))) for _ in range(300)] + ["Common", "commn", "comon", "commoon", "CÉmmon"]
SCHEMA = "doc_id long, text string"


def texts():
    out = [(i, " ".join(RNG.choice(WORDS, int(n)))) for i, n in enumerate(RNG.integers(0, 200, 60))]
    # A chain of forms: comonlyy, comonly or commonlyy, commonly.
    out += [(100 + i, "commonly Commonly " * 60 + "comonly " * 10 + "commonlyy " * 8 + "comonlyy " * 2) for i in range(4)]
    # Null ids and texts, repeated rows, marks between words, and one long text.
    out += [(None, " ".join(WORDS)), (3, None), (3, ""), (7, "x" * 9), (7, "x" * 9), (8, "Àbcdef-ghijkl_mnopqr9stuvwx"), (9, " ".join(RNG.choice(WORDS, 70_000)))]
    return out


DATA = texts()


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def vocabulary():
    counts = Counter()
    for i, text in DATA:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


@pytest.mark.parametrize("slice_words", [variants.SLICE_WORDS, 20])
def test_variants(spark, monkeypatch, slice_words):
    monkeypatch.setattr(variants, "SLICE_WORDS", slice_words)
    words = vocabulary()
    want = {}
    for w, n in words.items():
        close = sorted(((-words[v], v) for v in words if near(w, v)))
        form = close[0][1] if close and -close[0][0] >= 5 * n else None
        want[w] = [form, n, len(close), words[form] if form else None]
    found = {r.word: r for r in variants.variants(spark.createDataFrame(DATA, SCHEMA)).collect()}
    assert {w: [r.form, r.n, r.n_near, r.form_n] for w, r in found.items()} == want
    assert sum(r.form is not None for r in found.values()) > 2
    for w, r in found.items():
        root = w
        while want[root][0]:
            root = want[root][0]
        assert r.root == root
    assert variants.variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_importance(spark):
    bench = [(1, "common COMMON words of the target"), (2, None), (3, "")]

    def runs(text):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text).encode())
        return len(w), [zlib.crc32(b" ".join(w[i:i + k])) % 10000 for i in range(len(w)) for k in (1, 2, 3) if i + k <= len(w)]

    corpus, target = Counter(), Counter()
    for _, text in DATA:
        corpus.update(runs(text)[1])
    for _, text in bench:
        target.update(runs(text)[1])
    s_all, t_all = sum(corpus.values()) + 10000, sum(target.values()) + 10000
    rows = []
    for i, text in DATA:
        n, found = runs(text)
        weight = sum(math.floor(1000 * math.log((target[b] + 1) * s_all / ((corpus[b] + 1) * t_all))) for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for place, r in enumerate(able[:5 * len(able) // 100], 1):
        r[5] = place
    docs, wanted = spark.createDataFrame(DATA, SCHEMA), spark.createDataFrame(bench, "item_id long, text string")
    got = importance.importance(docs.repartition(5), wanted)
    assert sorted(map(str, (list(r) for r in got.collect()))) == sorted(map(str, rows))
    assert importance.importance(docs.limit(0), wanted).count() == 0
    assert importance.importance(docs, wanted.limit(0)).filter("rank is not null").count() == len(able) * 5 // 100
    half = importance.importance(docs, wanted, percent=50, least_words=1)
    places = sorted(r.rank for r in half.filter("rank is not null").collect())
    assert places == list(range(1, half.filter("n_words > 0").count() // 2 + 1))


def test_classifier_on_held_out_rows(spark):
    data, labels = [], []
    for i in range(1200):
        words = list(RNG.choice(WORDS, int(RNG.integers(5, 80))))
        good = i % 3 > 0
        if not good:
            words = [f"{w}{RNG.choice(['###', '!!'])}" for w in words] if i % 2 else [words[0]] * len(words)
        data.append((i, " ".join(words)))
        labels.append((i, int(good)))
    labels += [(5, 1 - labels[5][1]), (None, 1), (9, None), (99_999, 1)]
    data += [(None, "a b"), (2000, None), (2001, ""), (2002, " \n"), (2003, "common " * 60_000), (2003, "common words")]
    docs, marked = spark.createDataFrame(data, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    model = classifier.fit(docs, marked, id_remainder("doc_id", 5) != 0)
    rows = classifier.classified(docs, model).collect()
    assert len(rows) == len(data) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    found = {r.doc_id: r.score for r in rows}
    held = [(found[i], y) for i, y in labels[:1200] if zlib.crc32(str(i).encode()) % 5 == 0 and i != 5]
    right = [(s >= 0.3) == (y == 1) for s, y in held]
    assert len(held) > 150 and sum(right) / len(right) >= 0.97
    assert found[2000] == found[2001] == found[2002]
    again = classifier.fit(docs.repartition(3), marked, id_remainder("doc_id", 5) != 0)
    assert np.allclose(again, model)
    few = classifier.sample(marked, F.lit(True), "quality", 300).count()
    assert 200 < few < 400
    none = classifier.fit(docs, marked.limit(0), F.lit(True))
    assert {r.score for r in classifier.classified(docs, none).collect()} == {0.5}
    assert classifier.classified(docs.limit(0), none).count() == 0
