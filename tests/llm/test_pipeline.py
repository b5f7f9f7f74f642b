"""The corpus pipeline against a brute-force version on a small corpus with known cases."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import decontaminate, tokens
from tidewell.llm.oracles import ORACLE_SQL
from tidewell.llm.queries import QUERIES

from .conftest import KIND, prose
from .test_operators import brute_groups, brute_spans, check_packing


def corpus(rng):
    """Texts by id, and the benchmark."""
    unique = lambda n: " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))
    items = [unique(25).capitalize() + "." for _ in range(6)]
    texts = {i: unique(rng.randrange(30, 120)) for i in range(160)}
    texts |= {200: "too short", 201: "a b c d e f g h " * 12, 202: unique(40).replace(" ", " ### "), 203: None, 204: ""}
    for i in range(6):
        texts[300 + i] = texts[i]  # copies
        w = texts[10 + i].split()
        w[0] = "changed"
        texts[310 + i] = " ".join(w)
        texts[320 + i] = unique(40) + " " + items[i] + " " + unique(10)
        texts[330 + i] = unique(30) + " api_key = '" + "".join(rng.choice("0123456789abcdef") for _ in range(32)) + "'"
    return texts, items


def brute(texts, items):
    """What the first four stages keep: text by id."""

    def fails(t):
        w = (t or "").split()
        places = {}
        for i in range(len(w) - 7):
            places.setdefault(tuple(w[i : i + 8]), []).append(i)
        covered = {k for p in places.values() if len(p) > 1 for i in p for k in range(i, i + 8)}
        symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
        return len(w) < 20 or 100 * len(covered) > 30 * len(w) or symbols > 0.1 * len("".join(w))

    kept = {k: t for k, t in texts.items() if not fails(t)}
    groups = brute_groups(kept, width=5)
    kept = {k: t for k, t in kept.items() if groups[k][1] == k}

    def leak(t):
        words = decontaminate.words(t.encode())
        for item in items:
            w = decontaminate.words(item.encode())
            masks = decontaminate.masks_of(w)
            if any(decontaminate.common_subsequence(*masks, words[a : a + 2 * len(w)]) >= 0.65 * len(w) for a in range(0, len(words), 5)):
                return True
        return False

    kept = {k: t for k, t in kept.items() if not leak(t)}
    out = {}
    for k, t in kept.items():
        at, parts = 0, []
        for a, _, b in brute_spans(t)[1]:
            if a >= at:
                parts += [t[at:a], "[SECRET]"]
            at = max(at, b)
        out[k] = "".join(parts) + t[at:]
    return out


def test_pipeline(spark, tmp_path):
    texts, items = corpus(random.Random(21))
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(texts, items)
    assert 150 < len(want) < 180 and any("[SECRET]" in t for t in want.values())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(want)
    check_packing(got, want)
    encode = tokens.encoder(tokens.default_vocabulary())
    some = next(k for k, t in want.items() if "[SECRET]" in t)
    ids = np.array([*encode(want[some]), 0], "<u4")
    first = next(r for r in got if r.doc_id == some and r.start == 0)
    assert first.ids_crc32 == zlib.crc32(ids[: first.length].tobytes())


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(random.Random(i), 40), "en", "s", 1) for i in range(30)], KIND)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 30
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "secret scans", "packing"]
    assert {re.match(r"op(\d+)_", k)[1] for k in QUERIES} == {str(i) for i in range(1, 11)} and set(ORACLE_SQL) <= set(QUERIES)
    assert F is not None
