"""The training-data operators against brute force, on small tables with the awkward cases."""

import base64
import datetime
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from codeloom.llm import decontamination, hidden_markov, mixing, ngram_join, passages, pseudonyms, quality, token_counts, token_files, toxicity
from codeloom.llm.common import id_remainder

SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()), StructField("size", StringType()),
])
RNG = np.random.default_rng(5)
VOCABULARY = ["".join(RNG.choice(list("abcdeorst"), RNG.integers(2, 7))) for _ in range(400)]
PASSAGE = " ".join(RNG.choice(VOCABULARY, 60))


def prose(n):
    return " ".join(RNG.choice(VOCABULARY, n))


def rows():
    base = prose(80)
    words = base.split()
    near = [" ".join(words[:i] + [f"x{i}"] + words[i + 1:]) for i in (0, 40, 79)]
    texts = [base, base, *near, None, "", " \n\t", "one", "One", "two words", "three of four words", prose(5), prose(3000),
             prose(30) + " " + PASSAGE + " " + prose(30), PASSAGE + "\n" + prose(100), "a b a b a b a b " * 20, "line\nline\nline\n" * 30]
    texts += [prose(int(n)) for n in RNG.integers(1, 120, 40)]
    out = [(i, t, "en", f"src{i % 4}" if i % 9 else None, len(t or ""), "clash") for i, t in enumerate(texts)]
    return out


DATA = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DATA, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def groups(data):
    sets = [(i, shingles(t)) for i, t, *_ in data]
    root = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 75 * len(a | b) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return {i: (len(s), root[i]) for i, s in sets}


def test_jaccard_components(docs, empty):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(docs).collect()}
    assert found == groups(DATA)
    assert ngram_join.linked_components(empty).count() == 0


def test_near_copies_keep_one(docs):
    want = {i for i, (_, root) in groups(DATA).items() if i == root}
    kept = ngram_join.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == want
    twice = ngram_join.without_near_copies(docs.unionByName(docs))
    assert sorted(r.doc_id for r in twice.filter("n_chars > 5").collect()) == sorted(i for i in want if len(DATA[i][1] or "") > 5)


def test_mixing(docs, empty):
    found = mixing.mixed_documents(docs, block_words=16).collect()
    assert len(found) == len(DATA) and all(0 <= r.taken <= 2 * r.size for r in found)
    sizes, target, taken = Counter(), {}, Counter()
    for r in found:
        sizes[r.source] += r.size
        target[r.source] = r.target
        taken[r.source] += r.taken
    assert math.isclose(sum(target.values()), 1.5 * sum(sizes.values()))
    order = sorted(sizes, key=lambda s: (s is None, s))
    rates = {s: target[s] / (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    free = [rates[s] for s in order if target[s] < 2 * sizes[s]]
    assert max(free) - min(free) < 1e-6
    assert all(rates[s] <= max(free) + 1e-6 for s in order)
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    again = mixing.mixed_documents(docs.repartition(5), block_words=16).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in found)
    texts = {r.doc_id: r.text for r in mixing.mixed_texts(docs, block_words=16).collect()}
    assert {i: len(words(t)) for i, t in texts.items()} == {r.doc_id: r.taken for r in found if r.taken}
    assert mixing.mixed_documents(empty).count() == 0


def test_token_files_round_trip(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encode = Tokenizer.from_file(path)
    at = 0
    found = token_files.token_index(docs, path).orderBy("doc_id").collect()
    for r, (i, text, *_) in zip(found, DATA, strict=True):
        ids = [*encode.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert token_files.token_index(empty, path).count() == 0


def test_words_encode_like_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encode, encoder = Tokenizer.from_file(path), token_files.WordEncoder.of(path)
    for text in ("Éa, ß don't I'LL x_y <|endoftext|> <|ENDOFTEXT|>", "a b c é ́x ΣΑΣ İ 12½", "...!? a!b " + "z" * 300, "日本語 текст"):
        assert np.frombuffer(encoder.ids(text.encode()), "<u4").tolist() == encode.encode(text, add_special_tokens=False).ids


def test_a_word_of_a_batch_is_looked_up_once():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encode, met = Tokenizer.from_file(path), []

    class Watched(token_files.WordEncoder):
        def __getitem__(self, word):
            met.append(word)
            return super().__getitem__(word)

    texts = ["Éa don't \x0b a!  ", None, "", " \n", "a! b " * 1000, "b \x1c a!", "ÉA <|endoftext|> " + "z" * 300 + " 1999."]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array([t], pa.string())}) for t in texts]
    encoder = Watched(path)
    found = [encoder.ids_of(t["text"].cast(pa.large_string()).combine_chunks()) for t in token_files.gathered(batches)]
    assert [np.frombuffer(ids, "<u4").tolist() for some in found for ids in some] == [
        encode.encode(t or "", add_special_tokens=False).ids for t in texts
    ]
    assert len(met) == len(set(met))
    assert [len(t) for t in token_files.gathered(batches, least=2_000)] == [5, 2]


def test_an_encoder_remembers_little():
    import tracemalloc

    encoder = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = (a + b + c + d + e for a in letters for b in letters for c in letters for d in letters for e in "aei")
    some = [w for w, _ in zip(words, range(400_000))]
    tracemalloc.start()
    try:
        for i in range(0, len(some), 50_000):
            encoder.ids(" ".join(some[i:i + 50_000]).encode())
        held, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert held < 70e6




def test_wavelet_matrix():
    ids = RNG.integers(0, 60000, 3000).astype(np.uint16)
    ids[::5] = 9
    matrix = token_files.WaveletMatrix([(b.tobytes(), o.tobytes(), z) for b, o, z in token_files.build_planes(ids)], len(ids))
    where = np.flatnonzero(ids == 9)
    assert (matrix.decode() == ids).all()
    assert all(matrix.access(i) == ids[i] for i in range(0, 3000, 61))
    assert all(matrix.rank(9, i) == (where < i).sum() for i in (0, 1, 511, 512, 513, 2999, 3000))
    assert [matrix.select(9, n) for n in range(len(where))] == where.tolist()
    assert matrix.select(9, len(where)) is None and matrix.select(60001, 0) is None


def test_length_histogram(docs, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = [len(encode.encode_ordinary(t or "")) for _, t, *_ in DATA]
    found = token_counts.length_histogram(docs, path).collect()
    assert sorted(r.n_tokens for r in found) == sorted(set(sizes))
    for r in found:
        assert r.n_docs == sizes.count(r.n_tokens)
        assert r.truncated_total == sum(min(s, r.n_tokens) for s in sizes)
        assert (r.docs_within, r.tokens_within) == (sum(s <= r.n_tokens for s in sizes), sum(s for s in sizes if s <= r.n_tokens))
        assert (r.docs_at_least, r.tokens_at_least) == (sum(s >= r.n_tokens for s in sizes), sum(s for s in sizes if s >= r.n_tokens))
    assert token_counts.length_histogram(empty, path).count() == 0


def test_decontamination(spark, docs, empty):
    item = "the quick brown fox jumps over the lazy dog while seven wizards mix potent brews in the dark of night"
    edited = item.replace("quick", "quack").replace("dark", "park").upper()
    extra = [(900, f"{prose(20)}. {item}! {prose(9)}", "en", "s", 1, "c"), (901, f"{prose(5)} {edited} {prose(5)}", "en", "s", 1, "c"),
             (902, item[:40] + prose(20), "en", "s", 1, "c"), (None, item, "en", "s", 1, "c")]
    both = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "zq")], "item_id long, text string")
    found = {r.doc_id: r for r in decontamination.contamination(both, bench).collect()}
    assert {i for i, r in found.items() if r.contaminated} == {900, 901, None}
    assert [(found[i].n_items, found[i].least_distance) for i in (900, 901, None)] == [(1, 0), (1, 2), (1, 0)]
    kept = decontamination.decontaminated(both, bench)
    assert kept.columns == docs.columns and kept.count() == len(DATA) + 1
    assert decontamination.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.contamination(empty, bench).count() == 0


def test_edit_matches_equal_brute_force():
    def distance(a, text):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    item = "".join(RNG.choice(list("abcd "), 90)).strip()
    block = ((1, item),)
    for n in range(0, 14):
        chars = list(item)
        for _ in range(n):
            chars[RNG.integers(len(chars))] = "z"
        text = "q" * 30 + "".join(chars) + "q" * 30
        best = distance(item, text)
        found = decontamination.matches(text, block)
        assert bool(found) == (best <= decontamination.budget(len(item)))
        assert not found or found[0]["distance"] == best


def test_toxicity(spark, docs, empty):
    bad = ["grobnik", "zlurpy"]
    data, labels = [], []
    for i in range(1000, 1400):
        toxic = i % 4 == 0
        data.append((i, prose(30) + (f" {bad[i // 4 % 2]}{VOCABULARY[i % 7]} " if toxic else " ") + prose(10), "en", "s", 1, "c"))
        labels.append((i, 1, int(toxic)))
    labels += [(5, 1, None), (99999, 1, 1), (None, 0, 1)]
    train = docs.unionByName(spark.createDataFrame(data, SCHEMA))
    model = toxicity.fit(train, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r.doc_id: r for r in toxicity.toxicity(train, model).collect()}
    assert all(found[i].predicted == int(i % 4 == 0) for i in range(1000, 1400))
    assert all(0 <= r.score <= 1 for r in found.values()) and found[5].predicted == found[6].predicted == 0
    disguised = spark.createDataFrame([(1, "you GR0BNIKab there", "en", "s", 1, "c"), (2, "a grоbnikcd", "en", "s", 1, "c")], SCHEMA)
    assert all(r.predicted == 1 for r in toxicity.toxicity(disguised, model).collect())
    kept = toxicity.without_toxic(train, model)
    assert kept.columns == train.columns and kept.count() == len(DATA) + 300
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.toxicity(docs, none).filter("predicted = 1").count() == 0
    assert toxicity.toxicity(empty, none).count() == 0


def test_hidden_markov_scores(docs, empty):
    found = {r.doc_id: r for r in hidden_markov.model_scores(docs, id_remainder("doc_id", 10) == 0).collect()}
    counts = Counter()
    for i, t, *_ in DATA:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*words(t), "end"])
    total, types = sum(counts.values()), len(counts)
    for i, t, *_ in DATA:
        own = [*words(t), "end"]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (types + 1))) for w in own)
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert hidden_markov.model_scores(empty, F.lit(False)).count() == 0
    assert hidden_markov.model_scores(docs, F.lit(True)).count() == len(DATA)


def test_forward_recursion_is_the_sum_over_paths():
    from itertools import product

    k, n = hidden_markov.STATES, 4
    p = hidden_markov.Parameters(*(x / x.sum(axis=-1, keepdims=True) for x in (RNG.random(k), RNG.random(k), RNG.random((k, k)))), RNG.random((6, k)))
    p.emit /= p.emit.sum(axis=0)
    flat = np.array([3, 1, 5, 0], dtype=np.int32)
    total = sum(
        p.start[s[0]] * math.prod(p.emit[flat[t], s[t]] for t in range(n)) * math.prod(p.moves[s[t - 1], s[t]] for t in range(1, n))
        for s in product(range(k), repeat=n)
    )
    assert math.isclose(hidden_markov.log_likelihood(flat, np.array([0, n]), p)[0], math.log10(total), rel_tol=1e-9)


def test_repeated_passages(docs, empty):
    where = {}
    for i, t, *_ in DATA:
        w = words(t)
        for a in range(len(w) - 49):
            where.setdefault(tuple(w[a:a + 50]), set()).add(i)
    found = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
    for i, t, *_ in DATA:
        w, want = words(t), set()
        for a in range(len(w) - 49):
            if len(where[tuple(w[a:a + 50])]) > 1:
                want.update(range(a, a + 50))
        assert {x for s in found[i].spans for x in range(s.start, s.end)} == want
        assert found[i].repeated_words == len(want)
    assert passages.repeated_passages(empty).count() == 0


def test_pseudonyms(spark, empty):
    card, other = "4963780161091446", "4963-7801-6109-1446"
    text = f"Card {card}, again {card} and {other}; not 4963780161091447. Call +1 (555) 123-4567, host 10.20.30.40 not 300.1.1.1, born 1984-02-29 or 29.02.1984, mail Ab.09@x.example.com."
    data = [(1, text, "en", "s", 1, "c"), (2, f"x {card} y 1984-02-29", "en", "s", 1, "c"), (3, None, "en", "s", 1, "c"), (4, "", "en", "s", 1, "c")]
    rows = {r.doc_id: r for r in pseudonyms.pseudonymise(spark.createDataFrame(data, SCHEMA), "key").collect()}
    out = rows[1].text
    cards = re.findall(r"\d{16}|\d{4}-\d{4}-\d{4}-\d{4}", out)
    assert cards[0] == cards[1] == cards[2].replace("-", "") != card and cards[3] == "4963780161091447"

    def luhn(number):
        ds = [int(c) for c in reversed(number)]
        return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(ds)) % 10

    assert luhn(cards[0]) == 0
    assert "300.1.1.1" in out and "10.20.30.40" not in out and "(555) 123-4567" not in out and "Ab.09@" not in out
    iso, dotted = re.search(r"born (\S+) or (\S+),", out).groups()
    assert datetime.date.fromisoformat(iso) == datetime.datetime.strptime(dotted, "%d.%m.%Y").date()
    assert rows[2].text == f"x {cards[0]} y {iso}"
    assert (rows[1].pii_card, rows[1].pii_phone, rows[1].pii_address, rows[1].pii_date, rows[1].pii_mail) == (3, 1, 1, 2, 1)
    assert rows[3].text is None and rows[4].text == ""
    assert pseudonyms.pseudonymise(empty, "key").count() == 0


def test_feistel_is_a_permutation(spark):
    octets = spark.range(1000).select(pseudonyms.phone_pseudonym(F.lpad(F.col("id").cast("string"), 3, "0"), "key").alias("p"))
    assert octets.distinct().count() == 1000
    order = spark.range(777).select(mixing.shuffled(F.col("id"), F.lit(777).cast("long"), F.lit(3), 1).alias("p"))
    assert sorted(r.p for r in order.collect()) == list(range(777))


def test_quality(docs, empty):
    found = {r.doc_id: r for r in quality.quality(docs).collect()}
    for i, t, *_ in DATA:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(zip(w, w[1:], w[2:]))
        inside = {a + k for a in range(len(w) - 2) if grams[tuple(w[a:a + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(inside))
        assert (r.n_dup_lines, r.n_symbols) == (len(lines) - len(set(lines)), sum((t or "").count(c) for c in quality.SYMBOLS))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.quality(empty).count() == 0
