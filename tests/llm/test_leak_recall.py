"""Recall of decontamination against comparing every document with every item, at three strengths of paraphrase."""

import os
import random

import pyarrow.parquet as pq
import pytest

from tidewell.llm import decontaminate

from .test_operators import frame

FOLDER = "/root/testdata/sf0.01"


def exhaustive(texts, items):
    """Pairs by longest common subsequences of items and all stretches of about their lengths."""
    out = set()
    matchers = [(decontaminate.masks_of(w), decontaminate.masks_of(decontaminate.answer_of(t)), w, decontaminate.answer_of(t)) for t in items for w in [decontaminate.words(t.encode())]]
    for d, t in enumerate(texts):
        words = decontaminate.words(t.encode())
        names = {*words}
        for k, (whole, answer, w, a) in enumerate(matchers):
            if sum(x in names for x in w) < 0.65 * len(w):
                continue  # not even out of order
            for at in range(0, len(words), max(1, len(w) // 8)):
                part = words[at : at + len(w) + len(w) // 4]
                if decontaminate.common_subsequence(*whole, part) >= 0.65 * len(w) and decontaminate.common_subsequence(*answer, part) >= 0.5 * len(a):
                    out.add((d, k))
                    break
    return out


def paraphrase(rng, words, strength, others):
    """Substitutes, drops, inserts and swaps words, a share of ``strength`` of them touched."""
    out = []
    for w in words:
        if rng.random() >= strength:
            out.append(w)
            continue
        way = rng.randrange(4)
        if way == 0:
            out.append(rng.choice(others))
        elif way == 1:
            out += [w, rng.choice(others)]
        elif way == 2 and out:
            out.insert(len(out) - 1, w)
    return out


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("strength", [0.1, 0.2, 0.3])
def test_recall(spark, strength):
    rng = random.Random(50)
    texts = [t or "" for t in pq.read_table(f"{FOLDER}/documents.parquet", columns=["text"])["text"].to_pylist()][:700]
    items = pq.read_table(f"{FOLDER}/benchmark.parquet", columns=["text"])["text"].to_pylist()
    others = [w for t in texts[:50] for w in t.split()]
    for k in range(300):
        w = texts[k].split()
        at = rng.randrange(len(w) + 1)
        texts[k] = " ".join(w[:at] + paraphrase(rng, items[k % len(items)].split(), strength, others) + w[at:])
    want = exhaustive(texts, items)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, texts), bench).collect()}
    print(f"strength {strength}: {len(want)} pairs, recall {len(got & want) / len(want):.4f}, more {len(got - want)}")
    assert len(want) > 150 and len(got & want) >= 0.95 * len(want)


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    rng = random.Random(51)
    unique = lambda n: " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))
    items, texts = [unique(25) for _ in range(30)], [unique(120) for _ in range(60)]
    for k in range(30):
        texts[k] += " " + items[k] + " " + unique(20)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    find = lambda: {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, texts), bench, max_df=0.01).collect()}
    assert find() == {(k, k) for k in range(30)}
    for items_most, terms_most in ((12, 100_000), (50_000, 300)):
        monkeypatch.setattr(decontaminate, "MAX_ITEMS", items_most)
        monkeypatch.setattr(decontaminate, "MAX_TERMS", terms_most)
        assert len(list(decontaminate.read_items(bench))) > 2 and find() == {(k, k) for k in range(30)}
        assert decontaminate.drop_leaks(frame(spark, texts), bench, max_df=0.01).count() == 30


def test_sums_in_a_tree(spark, monkeypatch):
    import numpy as np

    rng = random.Random(52)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40))) for _ in range(100)]
    index = {c.encode(): i for i, c in enumerate("abcdefgh")}
    once = decontaminate.distributed_gram(frame(spark, texts).repartition(1), index)
    monkeypatch.setattr(decontaminate, "FAN", 2)
    assert np.array_equal(once, decontaminate.distributed_gram(frame(spark, texts).repartition(9), index))
