"""Labelled rows that the toxicity fit keeps."""

from collections import Counter

from codeloom.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def test_only_rows_equal_in_text_and_label_are_folded(spark):
    """All texts share all but one word with another, and so their lowest word hashes."""
    base = " ".join(f"w{i}" for i in range(200))
    data = [(i, f"{base} own{i} " + f"more{i} " * 50) for i in range(60)] + [(i, base) for i in range(60, 70)] + [(70, None), (71, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in data] + [(999, 1, 1)], LABELS)
    found = toxicity.labelled(docs, labels, held_out=-1).collect()
    want = {(t or "", i % 2) for i, t in data}
    assert Counter((r.text, r.toxic) for r in found) == Counter(want)
    # The bound counts rows that differ, not labels that are copies or have no document.
    assert toxicity.labelled(docs, labels, held_out=-1, rows=50).count() == 50


def test_all_candidates_reach_the_lexicon(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_ROWS", 3)
    data = [(i, f"{'grobnik' if i % 2 else 'plain'} {'zlurpy' if i % 2 else 'fair'} n{i}") for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in data], LABELS)
    entries = [e for e, _ in toxicity.fit(docs, labels, rows=1000).entries]
    assert any(e.startswith(" gro") for e in entries) and any(e.startswith(" ziu") for e in entries)
