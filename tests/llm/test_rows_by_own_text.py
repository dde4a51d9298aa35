"""Filters that judge each row by its own text, also where rows share an id or have none."""

import pytest

from codeloom.llm import decontamination, ngram_join

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards mix potent brews in the dark of night"


def text(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.mark.parametrize("block_chars", [None, 50])
def test_only_rows_with_an_item_go(spark, monkeypatch, block_chars):
    if block_chars:
        monkeypatch.setattr(decontamination.blocks, "__defaults__", (block_chars,))
    data = [(None, f"x {ITEM} y"), (None, text("a")), (None, None), (7, ITEM.upper()), (7, text("b")), (8, text("c")), (9, text("z", 20))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, text("z", 20))], "item_id long, text string")
    kept = decontamination.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [data[1], data[2], data[4], data[5]]))


def test_near_copies_go_by_their_own_text(spark):
    near = lambda name: text(name) + " more"
    data = [
        (1, text("a")), (7, near("a")), (7, text("b")), (9, near("b")), (7, ""), (8, text("c")), (8, near("c")),
        (5, text("d")), (5, text("d")), (5, text("e")), (None, text("f")), (3, near("e")), (6, None), (6, None),
    ]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in ngram_join.without_near_copies(docs).collect()]
    either = [x for x in kept if x[0] == 8]
    assert len(either) == 1 and either[0] in data
    want = [data[0], data[2], data[4], data[7], data[10], data[11], data[12], data[13]]
    assert sorted(map(str, (x for x in kept if x[0] != 8))) == sorted(map(str, want))
