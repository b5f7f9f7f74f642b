"""Benchmark items of mostly ordinary words, longer than a passage or shorter than three terms."""

import random

from tidewell.llm import decontaminate

from .test_operators import frame


def brute(texts, items):
    """Where a text holds 65 % of an item's words in order, and half of its answer's, in a stretch of about its length."""
    out = set()
    for d, t in enumerate(texts):
        words = decontaminate.words(t.encode())
        for k, item in enumerate(items):
            w, answer = decontaminate.words(item.encode()), decontaminate.answer_of(item)
            for a in range(0, len(words), max(1, len(w) // 8)):
                part = words[a : a + len(w) + len(w) // 4]
                if decontaminate.common_subsequence(*decontaminate.masks_of(w), part) >= 0.65 * len(w) and decontaminate.common_subsequence(*decontaminate.masks_of(answer), part) >= 0.5 * len(answer):
                    out.add((d, k))
                    break
    return out


def test_long_and_short_items(spark):
    rng = random.Random(36)
    ordinary = [a + b + c for a in "bcdfgklm" for b in "aeiou" for c in "nrstlmkp"]
    text = lambda n: [rng.choice(ordinary) for _ in range(n)]
    items = []
    for k in range(40):
        w = text(rng.choice([100, 150, 200, 300, 400]))
        for j in range(10):  # ten own words, evenly over the item
            w[(2 * j + 1) * len(w) // 20] = f"own{k}x{j}"
        items.append(" ".join(w))
    items += ["zyzzyva", "quixotry gazpacho"]
    texts = [text(120) for _ in range(160)]
    for k, item in enumerate(items[:40]):
        w = item.split()
        if k % 2:  # a paraphrase that keeps 75 % of the words in place
            gone = set(rng.sample(range(len(w)), len(w) // 4))
            w = [rng.choice(ordinary) if i in gone else x for i, x in enumerate(w)]
        texts[k][60:60] = w
    texts[50][30:30] = ["Zyzzyva"]
    texts[51][30:30] = ["quixotry", "gazpacho."]
    texts = [" ".join(t) for t in texts]
    want = brute(texts, items)
    assert {(k, k) for k in range(40)} | {(50, 40), (51, 41)} <= want
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, texts), bench, max_df=0.002).collect()}
    assert got == want
    kept = {r.doc_id for r in decontaminate.drop_leaks(frame(spark, texts), bench, max_df=0.002).collect()}
    assert kept == set(range(160)) - {d for d, _ in want}


def test_items_counted_in_parts(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(37)
    names = [b"t%d" % i for i in range(30)]
    items = [decontaminate.Item(k, [names[i] for i in rng.integers(0, 30, rng.integers(1, 9))], [names[0]]) for k in range(25)]
    model = decontaminate.Model(items, {w: i for i, w in enumerate(names)}, np.zeros((30, 1)), np.zeros((25, 1)), 0.3, 0.65, 0.5)
    text = np.sort(rng.integers(0, 40, 300))
    terms = rng.integers(0, 30, 300)
    sets = [{names[t] for t in terms[text == d]} for d in range(40)]
    want = [(d, k) for d in range(40) for k in range(25) if len(sets[d] & {*items[k].words}) >= min(3, len({*items[k].words}))]
    for most in (1, 50, 10**6):
        monkeypatch.setattr(decontaminate, "COUNTED", most)
        assert list(decontaminate.held_items(model, terms, text)) == want
