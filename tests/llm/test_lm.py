"""The network of op7, what it is trained on, and its scores against plain loops."""

import collections
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import lm, tokens

from .conftest import WORDS
from .test_operators import frame


def double(w):
    return lm.Weights([p.astype(np.float64) for p in w.parts])


def some_classes(rng):
    of = np.concatenate([rng.integers(0, lm.STARTS, 25_000), rng.integers(lm.STARTS, lm.CLASSES, lm.VOCABULARY - 25_000)])
    of[lm.END] = 0
    of = of.astype(np.uint8)
    share = np.bincount(of, minlength=lm.CLASSES)
    return lm.Classes(of, -np.log(share[of]).astype(np.float32), np.log(np.maximum(share, 0.5) / len(of)))


def check_gradients(w, x, y, rng):
    _, grads = lm.gradients(w, x, y)
    for p, g in zip(w.parts, grads, strict=True):
        for _ in range(4):
            i = tuple(rng.integers(0, s) for s in p.shape)
            p[i] += 1e-4
            a, _ = lm.gradients(w, x, y)
            p[i] -= 2e-4
            b, _ = lm.gradients(w, x, y)
            p[i] += 1e-4
            assert abs((a - b) / 2e-4 - g[i]) < 1e-5


def test_gradients():
    rng = np.random.default_rng(13)
    w = double(lm.Weights.initial(np.full(lm.CLASSES, -math.log(lm.CLASSES))))
    for m in (lm.BLOCK, 2 * lm.BLOCK):
        check_gradients(w, rng.integers(0, lm.CLASSES + 1, (3, 2 * lm.BLOCK)), rng.integers(0, lm.CLASSES, (3, m)), rng)


def test_padded_targets_count_for_nothing():
    rng = np.random.default_rng(34)
    w = double(lm.Weights.initial(np.full(lm.CLASSES, -math.log(lm.CLASSES))))
    x, y = rng.integers(0, lm.CLASSES + 1, (3, 2 * lm.BLOCK)), rng.integers(0, lm.CLASSES, (3, lm.BLOCK))
    y[0, 5:] = y[2, 1:] = lm.CLASSES
    loss, grads = lm.gradients(w, x, y)
    one = lambda i, k: lm.gradients(w, x[[i]], np.where(np.arange(lm.BLOCK) == k, y[[i]], lm.CLASSES))
    alone = [one(i, k) for i in range(3) for k in range(lm.BLOCK) if y[i, k] != lm.CLASSES]
    assert len(alone) == 22 and abs(loss - np.mean([x[0] for x in alone])) < 1e-9
    for at, g in enumerate(grads):
        assert np.allclose(g, np.mean([x[1][at] for x in alone], axis=0), atol=1e-6)
    check_gradients(w, x, y, rng)


def plain_log_probs(w, classes, ids):
    """ln P(class), ln P(id) and ln P(a word begins) at each place of one text, place by place."""
    embed, qkv, bias, out = (p.astype(np.float64) for p in w.parts)
    kinds = classes.of[np.asarray(ids)]
    seen = [lm.CLASSES] * (lm.BLOCK + 1) + kinds.tolist()
    rows = []
    for t, kind in enumerate(kinds):
        block = t // lm.BLOCK * lm.BLOCK
        e = embed[seen[block : t + lm.BLOCK + 1]]
        p = e @ qkv
        s = p[:, lm.WIDTH : 2 * lm.WIDTH] @ p[-1, : lm.WIDTH] / math.sqrt(lm.WIDTH) + bias[np.arange(len(e) - 1, -1, -1)]
        a = np.exp(s - s.max())
        logits = np.concatenate([e[-1], (a / a.sum()) @ p[:, 2 * lm.WIDTH :], [1]]) @ out
        begins = 1 / (1 + math.exp(-logits[-1]))
        kinds_of = [np.exp(part) / np.exp(part).sum() for part in (logits[: lm.STARTS], logits[lm.STARTS : -1])]
        chances = np.concatenate([begins * kinds_of[0], (1 - begins) * kinds_of[1]])
        assert abs(chances.sum() - 1) < 1e-9
        rows.append((math.log(chances[kind]), math.log(chances[kind]) + float(classes.within[ids[t]]), math.log(begins)))
    return np.array(rows)


def test_windows_score_each_id_once():
    rng = np.random.default_rng(14)
    w, classes = lm.Weights.initial(np.full(lm.CLASSES, -math.log(lm.CLASSES))), some_classes(rng)
    texts = [np.append(rng.integers(0, 50_000, n), lm.END).astype(np.uint16) for n in (0, 1, 14, 15, 16, 100, 5)]
    got = lm.id_log_probs(w, classes, np.concatenate(texts), np.array([len(t) for t in texts]), at_once=3)
    want = np.concatenate([plain_log_probs(w, classes, t) for t in texts])
    assert np.allclose(got[0], want[:, 1], atol=2e-3) and np.allclose(got[1], want[:, 2], atol=2e-3)


def test_word_probabilities_sum_to_one():
    """Over the words of one or two ids after a context, and what is left to longer ones."""
    rng = np.random.default_rng(41)
    w, classes = lm.Weights.initial(rng.normal(size=lm.CLASSES) - 7), some_classes(rng)
    before = rng.integers(0, 50_000, 5)
    total = 0.0
    at = plain_log_probs(w, classes, np.append(before, 0))[5]
    chance = lambda ids: plain_log_probs(w, classes, np.concatenate([before, ids]).astype(int))[5:]
    for start in range(lm.STARTS):
        some = int(np.flatnonzero(classes.of == start)[0])
        rows = chance([some, 0])
        first = rows[0][0] - at[2]  # of the class, given that a word begins
        total += math.exp(first) * (math.exp(rows[1][2]) + (1 - math.exp(rows[1][2])))
    assert abs(total - 1) < 1e-6


def test_words():
    known = lm.Words(tokens.default_vocabulary())
    for words in ([], [b"the", b"thanningly"], ["é漢".encode(), b"!?", "\x85x".encode(), b"<|endoftext|>", "a　".encode()], [b"y" * 3000], ["\xa0".encode(), b"the"]):
        numbers = known.number([[*words, None], [None]])
        ids, at = known.stream(numbers)
        got = [known.encode(" " + w.decode()).tolist() for w in words]
        ends = [*at[1:].tolist(), len(ids)]
        assert [ids[a:b].tolist() for a, b in zip(at, ends, strict=True)] == [*got, [lm.END], [lm.END]]
        assert known.keys[numbers].tolist() == [*lm.hashes_of(words).tolist(), *np.array([lm.END_WORD] * 2, np.uint64).view(np.int64).tolist()]
    known.reset()
    assert known.number([[b"new", None]]).tolist() == [1, 0] and len(known.keys) == 2


def test_blocks():
    rng = np.random.default_rng(42)
    sizes = np.array([1, 15, 16, 17, 40])
    classes = rng.integers(0, lm.CLASSES, sizes.sum())
    x, y, first, place = lm.blocks_of(classes, sizes)
    assert first.tolist() == [True, True, True, True, False, True, False, False] and np.array_equal(y.ravel()[place], classes)
    at = 0
    for n, b in zip(sizes, np.flatnonzero(first), strict=True):
        text = classes[at : at + n]
        assert x.ravel()[b * lm.BLOCK : b * lm.BLOCK + n].tolist() == [lm.CLASSES, *text[:-1]]
        at += n
    streams = [(rng.integers(0, 50_000, sizes.sum()).astype(np.uint16), sizes) for _ in range(3)]
    of = some_classes(rng).of
    parts = [w for turn in range(3) for w in lm.windows(iter(streams), of, turn, 3)]
    assert all(x.shape == y.shape and x.shape[1] == 2 * lm.BLOCK and np.array_equal(x[:, 1:][y[:, 1:] != lm.CLASSES], y[:, :-1][y[:, 1:] != lm.CLASSES]) for x, y in parts)
    targets = np.concatenate([y.ravel() for _, y in parts])
    assert sorted(targets[targets != lm.CLASSES].tolist()) == sorted(of[np.concatenate([s for s, _ in streams])].tolist())


def test_weights_are_averaged_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 3)
    rng = np.random.default_rng(43)
    sets = [lm.Weights.initial(rng.normal(size=lm.CLASSES) - 7) for _ in range(20)]
    rows = [(i, float(i + 1), sets[i].to_bytes(i + 1)) for i in range(20)]
    got = lm.average(spark.createDataFrame(rows, "part long, weight double, flat binary"), 20)
    for k, p in enumerate(got.parts):
        assert np.allclose(p, sum((i + 1) * s.parts[k].astype(float) for i, s in enumerate(sets)) / 210, atol=1e-5)


def dialects(rng, n):
    spoken = [rng.sample(WORDS, 30) for _ in range(2)]
    dialect = lambda k: " ".join(rng.choice(["the", "of", "and"] if k else ["der", "und", "die"]) if i % 2 else rng.choice(spoken[k]) for i in range(150))
    return [dialect(i % 2) for i in range(n)]


def test_words_that_are_forgotten_count_the_same(spark, monkeypatch):
    rng = random.Random(54)
    docs = frame(spark, [" ".join(f"w{rng.randrange(300)}" for _ in range(100)) for _ in range(100)])
    counts = lambda: {r.key: (r.c, r.i) for r in lm.gather(docs, tokens.default_vocabulary()).filter("n > 0").groupBy("key").agg(F.sum("n").alias("c"), F.max("id").alias("i")).collect()}
    whole = counts()
    monkeypatch.setattr(lm, "REMEMBERED", 50)
    assert counts() == whole and len(whole) == 301


def test_scores_equal_plain_loops(spark, monkeypatch):
    rng, seen = random.Random(15), {}
    fit = lm.fit

    def caught(streams, classes, **options):
        seen["classes"], seen["weights"] = classes, fit(streams, classes, **options)
        return seen["weights"]

    monkeypatch.setattr(lm, "fit", caught)
    texts = [*dialects(rng, 80), "", None, "only-here and there"]
    rows = lm.score_documents(frame(spark, texts), frequent=30).collect()
    counts = collections.Counter()
    words_of = lambda t: [*(t or "").lower().split(), None]
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(words_of(t))
    total, v = sum(counts.values()), len(counts)
    base = lambda x: (counts[x] + 0.5) / (total + 0.5 * (v + 1))
    known, classes = lm.Words(tokens.default_vocabulary()), seen["classes"]
    first = lambda x: lm.END if x is None else known.split([x.encode()])[0][0]
    mass = collections.Counter({k: 0.5 for k in range(lm.STARTS)})
    for x, n in counts.items():
        mass[classes.of[first(x)]] += n + 0.5
    for r in rows:
        words = words_of(texts[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and (r.n_tokens, r.train_tokens) == (len(words), total)
        assert r.n_known == sum(counts[x] > 0 for x in words)
        assert abs(r.base_score - sum(math.log10(base(x)) for x in words)) < 1e-6
        if r.doc_id % 8 == 0 or r.doc_id >= 78:
            ids, at = known.stream(known.number([[w and w.encode() for w in words]]))
            plain = plain_log_probs(seen["weights"], classes, ids)
            want = 0.0
            for k, (x, a) in enumerate(zip(words, at, strict=True)):
                b = len(ids) if x is None else at[k + 1]
                whole = plain[a:b, 1].sum() - plain[a, 2] + (0 if x is None else plain[b, 2])
                share = mass[classes.of[ids[a]]] / sum(mass.values())
                want += math.log10(lm.TRUST * math.exp(whole) + (1 - lm.TRUST) * math.exp(plain[a, 0] - plain[a, 2]) / share * base(x))
            assert abs(r.score - want) < 2e-3 * len(words)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_short_texts_are_trained_on(spark):
    rng = random.Random(35)
    texts = [f"the {rng.choice('abcd')} of {rng.choice('efgh')}" for _ in range(400)]
    held = [r for r in lm.score_documents(frame(spark, texts)).collect() if r.held_out]
    assert sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held) > 0.2


def test_every_id_of_training_texts_is_a_target(spark):
    rng = random.Random(38)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 3, 15, 16, 200]))) for _ in range(40)]
    known = lm.Words(tokens.default_vocabulary())
    streams_of = [known.stream(known.number([lm.words_of(t.encode())]))[0].tolist() for t in texts]
    want = collections.Counter(i for ids in streams_of for i in ids)
    streams = lm.gather(frame(spark, texts).repartition(3), tokens.default_vocabulary()).filter(F.col("ids").isNotNull()).select("ids", "sizes")
    counts = lm.id_counts(streams)
    assert {i: int(counts[i]) for i in np.flatnonzero(counts)} == want
    near = lm.followed(streams, np.array([lm.END, *want])[:20])
    assert near.sum() == sum(n for i, n in collections.Counter(a for ids in streams_of for a in ids[:-1]).items() if i in {lm.END, *list(want)[:19]})
