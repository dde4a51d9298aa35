"""Slots of the whole mix."""

from collections import Counter

from codeloom.llm import mixing


def test_slots_hold_every_word_of_the_mix(spark):
    data = [(i, " ".join(f"w{i}x{k}" for k in range(7 + i % 40)) + "\n", f"s{i % 5}") for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    sources, slots, takings = mixing.mix(docs, block_words=16)
    target = {r.turn: round(r.target) for r in sources.collect()}
    size = {r.turn: r.source_size for r in sources.collect()}
    assert any(target[t] >= 2 * size[t] for t in target) and any(target[t] % size[t] for t in target)
    rows = slots.collect()
    words, passes, seen = Counter(), {}, Counter()
    for r in rows:
        words[r.turn] += r.words
        passes.setdefault((r.turn, r["pass"]), []).append((r.slot, r.block))
        seen[r.turn, r.slot] += 1
    assert dict(words) == target and max(seen.values()) == 1
    for (turn, nth), pairs in passes.items():
        blocks = -(-size[turn] // 16)
        assert all(nth * blocks <= slot < (nth + 1) * blocks for slot, _ in pairs)
        assert len({b for _, b in pairs}) == len(pairs)
        if target[turn] >= (nth + 1) * size[turn]:
            assert len(pairs) == blocks
    whole = [t for t in target if target[t] >= 2 * size[t]]
    order = lambda turn, nth: [b for _, b in sorted(passes[turn, nth])]
    assert any(order(t, 0) != order(t, 1) for t in whole)
    # Parts of all documents are the words of all slots, and each text is what its parts say.
    by_slot = Counter()
    taken = {}
    for r in takings.collect():
        taken[r.doc_id] = r.parts
        for p in r.parts:
            by_slot[r.turn, p.slot] += p["count"]
    assert by_slot == Counter({(r.turn, r.slot): r.words for r in rows})
    texts = {r.doc_id: r.text for r in mixing.mixed_texts(docs, block_words=16).collect()}
    for i, text, _ in data:
        own = text.split()
        want = [w for p in taken[i] for w in own[p["from"]:p["from"] + p["count"]]]
        assert (texts.get(i) or "").split() == want
