"""Baum-Welch over whole texts and all of them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codeloom.llm import hidden_markov as hm
from codeloom.llm import recursion
from codeloom.llm.common import Words

RNG = np.random.default_rng(3)


def parameters(symbols):
    k = hm.STATES
    p = hm.Parameters(*(x / x.sum(axis=-1, keepdims=True) for x in (RNG.random(k), RNG.random(k), RNG.random((k, k)))), RNG.random((symbols, k)))
    p.emit /= p.emit.sum(axis=0)
    return p


def test_expected_counts_of_long_texts_are_those_of_the_whole_text():
    p = parameters(9)
    sizes = [300, 1, 129, 700]
    flat, starts = RNG.integers(0, 9, sum(sizes)).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])
    first, moves, emitted = np.zeros(hm.STATES), np.zeros((hm.STATES, hm.STATES)), np.zeros((9, hm.STATES))
    for a, b in zip(starts, starts[1:]):
        x = flat[a:b]
        alpha, beta = np.zeros((len(x), hm.STATES)), np.ones((len(x), hm.STATES))
        for t in range(len(x)):
            alpha[t] = (p.start if t == 0 else alpha[t - 1] @ p.moves) * p.emit[x[t]]
            alpha[t] /= alpha[t].sum()
        for t in range(len(x) - 2, -1, -1):
            beta[t] = p.moves @ (p.emit[x[t + 1]] * beta[t + 1])
            beta[t] /= beta[t].sum()
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        first += gamma[0]
        np.add.at(emitted, x, gamma)
        for t in range(len(x) - 1):
            pair = alpha[t][:, None] * p.moves * (p.emit[x[t + 1]] * beta[t + 1])
            moves += pair / pair.sum()
    for size in (64, 256, 1000):
        for got, want in zip(hm.expected(flat, starts, p, size), (first, moves, emitted)):
            assert np.allclose(got, want, rtol=1e-6)


def test_likelihood_of_long_texts_is_that_of_the_whole_text(monkeypatch):
    p = parameters(9)
    sizes = [300, 1, 2, 129, 700, 256, 512]
    flat, starts = RNG.integers(0, 9, sum(sizes)).astype(np.int16), np.concatenate([[0], np.cumsum(sizes)])
    want = []
    for a, b in zip(starts, starts[1:]):
        alpha, log = p.start, 0.0
        for t, x in enumerate(flat[a:b]):
            alpha = (alpha if t == 0 else alpha @ p.moves) * p.emit[x]
            log += np.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        want.append(log)
    monkeypatch.setattr(recursion, "GROUP", 3)
    for size in (1, 5, 64, 256, 1000):
        assert np.allclose(hm.log_likelihood(flat, starts, p, size), want, rtol=1e-9)


def test_every_round_reads_all_texts(spark):
    texts = [" ".join(RNG.choice(["aa", "bb", "cc", "dd"], 150)) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = docs.select("text").mapInArrow(hm.word_counts, "word long, class int, n long").groupBy("word", "class").agg({"n": "sum"})
    table, unigram = hm.make_table(words.withColumnRenamed("sum(n)", "n").cache(), len(texts))
    rows = hm.symbol_rows(docs.withColumn("held_out", F.lit(False)), table)
    found, want = hm.trained(rows, unigram), hm.beginning(unigram)
    own = Words(pa.array(texts))
    flat, starts = hm.sequences(own, hm.word_symbols(own, table)[0])
    for _ in range(8):
        first, moves, emitted = hm.expected(flat, starts, want)
        first, moves, usual, emit = first + 1, moves + 1, emitted.sum(axis=0) + 1, emitted + 20 * unigram[:, None]
        want = hm.Parameters(*(x.astype(np.float32) for x in (
            first / first.sum(), usual / usual.sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)
        )))
    assert np.allclose(found.moves, want.moves, rtol=0.01) and np.allclose(found.emit, want.emit, rtol=0.01)
