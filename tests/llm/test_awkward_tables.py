"""Columns with clashing, dotted and case-differing names, and rows that share an id."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codeloom.llm import (
    classifier, decontamination, importance, mixing, ngram_join, passages, pseudonyms, quality, token_counts, token_files, toxicity, variants,
)

CLASHES = [
    "a.b", "Text", "DOC_ID", "tox_score", "mix_id", "dup_id", "dup_class", "pii_note", "pii_card", "pii_result", "component_id", "label",
    "key", "size", "n_words", "score", "rank", "place", "other0",
]


def words(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


DATA = [(1, words("a"), "s"), (1, words("b"), "s"), (2, words("c"), None), (None, words("d"), "t"), (3, None, "t"), (4, "", "s"), (2, words("c"), None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, *(f"{c} {i}" for c in CLASHES)) for i, r in enumerate(DATA)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"`{c}` string" for c in CLASHES)]))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "nothing of the kind is in any of these texts")], "item_id long, text string")


def own(df, columns):
    return sorted(map(str, df.toPandas().iloc[:, :columns].values.tolist()))


def test_filters_keep_foreign_columns(spark, docs, bench):
    model = toxicity.Model((), (), (-30.0, 0.0, 0.0))
    n = len(docs.columns)
    for out in (toxicity.without_toxic(docs, model), decontamination.decontaminated(docs, bench)):
        assert out.columns == docs.columns and own(out, n) == own(docs, n)
    kept = ngram_join.without_near_copies(docs)
    assert kept.columns == docs.columns
    found = kept.toPandas().iloc[:, :2].values.tolist()
    assert sorted(str(t) for i, t in found if i == 1) == [words("a"), words("b")]
    assert [t for i, t in found if i == 2] == [words("c")] and kept.count() == len(DATA) - 1


def test_mixed_texts_keep_foreign_columns(docs):
    out = mixing.mixed_texts(docs, block_words=16)
    assert out.columns == docs.columns and 0 < out.count() <= len(DATA)


def test_pseudonyms_keep_foreign_columns(docs):
    out = pseudonyms.pseudonymise(docs, "key")
    assert out.columns == [*docs.columns, *(f"pii_{k}" for k in pseudonyms.KINDS)]
    assert own(out, len(docs.columns)) == own(docs, len(docs.columns))


@pytest.mark.parametrize("operator", [
    lambda d, b: mixing.mixed_documents(d, block_words=16), lambda d, b: ngram_join.linked_components(d),
    lambda d, b: token_files.token_index(d, public_tokenizers.path("word_bpe_49k.json")), lambda d, b: quality.quality(d),
    lambda d, b: importance.importance(d, b),
    lambda d, b: classifier.classified(d, classifier.fit(d, d.sparkSession.createDataFrame([], "doc_id long, quality int"), F.lit(True))),
], ids=["mixing", "near_copies", "token_files", "quality", "importance", "classifier"])
def test_a_row_for_each_document(docs, bench, operator):
    assert operator(docs, bench).count() == len(DATA)


def test_tables_of_other_rows(docs, bench):
    assert decontamination.contamination(docs, bench).count() == passages.repeated_passages(docs).count() == 5
    assert token_counts.length_histogram(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).agg(F.sum("n_docs")).first()[0] == len(DATA)
    assert variants.variants(docs).count() == 0


def test_an_id_that_names_two_components(spark):
    near = words("x") + " more"
    rows = [(1, words("x")), (1, words("y")), (5, near), (6, words("y") + " more"), (5, words("z"))]
    kept = ngram_join.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([rows[0], rows[1], rows[4]])


def test_planes_for_a_large_vocabulary():
    import numpy as np

    ids = np.array([70_000, 3, 65_536, 70_000, 1], dtype=np.uint32)
    planes = token_files.build_planes(ids, 17)
    matrix = token_files.WaveletMatrix([(b.tobytes(), o.tobytes(), z) for b, o, z in planes], len(ids))
    assert matrix.decode().tolist() == ids.tolist() and matrix.rank(70_000, 4) == 2 and matrix.select(70_000, 1) == 3 and matrix.access(2) == 65_536
    with pytest.raises(ValueError):
        token_files.build_planes(ids)
