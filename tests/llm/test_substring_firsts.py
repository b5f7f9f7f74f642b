"""Every chunk of text stays in the first document that holds it."""

import random

import numpy as np

from tidewell.llm import substrings

from .conftest import prose
from .test_operators import frame


def test_first_holders_keep_their_text(spark):
    rng = random.Random(33)
    shared, body = prose(rng, 80), [prose(rng, 150), prose(rng, 150)]
    texts = [prose(rng, 200) for _ in range(12)]
    texts[5] += " " + shared
    texts[7] = texts[9] = texts[11] = f"{body[0]} {shared} {body[1]}"
    spans = substrings.repeated_spans(frame(spark, texts)).collect()
    assert all(s.duplicate == (s.first_doc_id != s.doc_id) for s in spans)
    assert {s.first_doc_id for s in spans if s.doc_id == 7} == {5, 7} and {s.doc_id for s in spans if not s.duplicate} == {5, 7}
    kept = {r.doc_id: r.text for r in substrings.drop_repeats(frame(spark, texts)).collect()}
    first = {}
    for i, t in enumerate(texts):
        data, at = t.encode(), 0
        for e in substrings.chunk_ends(np.frombuffer(data, "u1")).tolist():
            first.setdefault(data[at:e], i)
            at = e
    assert all(c.decode() in kept[i] for c, i in first.items())
    assert all(len(kept[i]) < 0.2 * len(texts[i]) for i in (9, 11)) and len(kept[7]) < len(texts[7]) - 0.5 * len(shared)


def plain_ends(data):
    """Chunk ends by a rolling hash, byte by byte."""
    h, hashes = 0, []
    for c in data:
        h = (2 * h + int(substrings.GEAR[c])) % 2**32
        hashes.append(h)
    r, ends = substrings.REACH, []
    for i in range(r, len(data) - r):
        if hashes[i] > max(hashes[i - r : i]) and hashes[i] >= max(hashes[i + 1 : i + r + 1]):
            ends.append(i + 1)
    out, at = [], 0
    for e in [*ends, len(data)]:
        while e - at > substrings.LONGEST:
            at += substrings.LONGEST
            out.append(at)
        out.append(e)
        at = e
    return out


def brute(texts, min_words):
    """The rows of repeated_spans, and the texts that drop_repeats leaves, by plain loops."""
    chunks = {}
    for i, t in texts.items():
        data, at, chunks[i] = (t or "").encode(), 0, []
        for e in plain_ends(data) if data else []:
            starts = sum(data[k : k + 1].strip() != b"" and (k == 0 or data[k - 1 : k].strip() == b"") for k in range(at, e))
            chunks[i].append((data[at:e], len(data[:at].decode(errors="ignore")), len(data[:e].decode(errors="ignore")), starts))
            at = e
    holders = {}
    for i in sorted(chunks):
        for c, *_ in chunks[i]:
            holders.setdefault(c, []).append(i)
    rows, left = [], {}
    for i, found in chunks.items():
        run, runs = [], []
        for k, (c, *_) in enumerate(found):
            if len(holders[c]) > 1:
                run.append(k)
            if run and (len(holders[c]) == 1 or k == len(found) - 1):
                runs.append(run)
                run = []
        cut = []
        for run in runs:
            if sum(found[k][3] for k in run) < min_words:
                continue
            seen = [c for c, *_ in found]
            label = lambda k: (holders[found[k][0]][0], holders[found[k][0]][0] != i or seen.index(found[k][0]) != k)  # noqa: E731, B023
            part = [run[0]]
            for k in [*run[1:], None]:
                if k is not None and label(k) == label(part[0]):
                    part.append(k)
                    continue
                first, later = label(part[0])
                rows.append((i, found[part[0]][1], found[part[-1]][2], sum(found[x][3] for x in part), len(part), first, max(len(holders[found[x][0]]) for x in part), later))
                if later:
                    cut.append((found[part[0]][1], found[part[-1]][2]))
                part = [k]
        t = texts[i] or ""
        left[i] = "".join(c for k, c in enumerate(t) if not any(a <= k < b for a, b in cut))
    return sorted(rows), left


def test_spans_equal_brute_force(spark):
    rng = random.Random(45)
    passages = [prose(rng, rng.randrange(10, 70)) for _ in range(8)]
    texts = {i: " ".join(rng.choice([prose(rng, 30), rng.choice(passages)]) for _ in range(rng.randrange(1, 7))) for i in range(40)}
    texts |= {50: passages[0], 51: f"{passages[0]} {passages[1]}", 52: f"{passages[0]} {passages[1]}", 53: "é漢😀 " * 60, 54: " ".join([passages[2]] * 4), 55: "", 56: None, 57: "a" * 700}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows, left = brute(texts, substrings.MIN_WORDS)
    assert sorted(tuple(r) for r in substrings.repeated_spans(docs).collect()) == rows
    assert {r.doc_id: r.text or "" for r in substrings.drop_repeats(docs).collect()} == left
    # P in one document and "P Q" in two others: Q stays in the first of these, and so does everything somewhere.
    assert left[50] == passages[0] or left[51] != "" and passages[1][100:200] in left[min(i for i in left if passages[1][100:200] in (texts[i] or ""))]


def test_rows_that_repeat_a_doc_id(spark):
    rng = random.Random(46)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(1, a), (2, f"{b} {a}"), (2, c), (2, c), (None, a), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted((r.doc_id or 0, r.text or "") for r in substrings.drop_repeats(docs).collect())
    assert (1, a) in left and left.count((2, c)) == 2 and (0, a) in left and (0, "") in left
    short = next(t for i, t in left if i == 2 and t != c)
    assert short.startswith(b[:300]) and len(short) < len(b) + 150
