"""The compiled graphs of op7 against its numpy functions."""

import math
import random

import numpy as np
import pytest

from tidewell.llm import compiled, lm, tokens

from .test_lm import dialects
from .test_operators import frame

pytestmark = pytest.mark.skipif(not compiled.available(), reason="onnxruntime is not installed")


def some_weights(seed):
    rng = np.random.default_rng(seed)
    w = lm.Weights.initial(rng.normal(size=lm.CLASSES) - 7)
    w.parts[2][:] = rng.normal(size=2 * lm.BLOCK)
    return w


def inputs(rng, n, block):
    x, y = (rng.integers(0, lm.CLASSES + k, (n, block)).astype(np.uint8) for k in (1, 0))
    y[0, 5:] = lm.CLASSES
    kinds = y.copy(), np.minimum(y, lm.STARTS - 1), np.maximum(y, lm.STARTS), np.full_like(y, lm.CLASSES)
    return x, kinds  # targets of both kinds, of either, and none


def test_gradients_equal_those_of_numpy():
    w, run = some_weights(51), lm.gradient_graph()
    x, kinds = inputs(np.random.default_rng(52), 9, 2 * lm.BLOCK)
    for y in kinds:
        for want, got in zip(lm.gradients(w, x, y)[1], lm.compiled_gradients(run, w.parts, x, y), strict=True):
            assert got.shape == want.shape and got.dtype == np.float32
            assert np.allclose(got, want, rtol=1e-3, atol=1e-5)


def test_scores_equal_those_of_numpy():
    w = some_weights(53)
    score = lm.scorer(w)
    x, kinds = inputs(np.random.default_rng(54), 20, lm.BLOCK)
    first = np.arange(20) % 7 == 0
    for y in kinds:
        for want, got in zip(lm.block_log_probs(w, x, y, first), score(x, y, first), strict=True):
            assert got.shape == want.shape and np.allclose(got, want, atol=1e-4)


def test_documents_score_the_same_without_the_library(spark, monkeypatch):
    docs = frame(spark, [*dialects(random.Random(55), 60), "", None])
    run = lambda: {r.doc_id: r for r in lm.score_documents(docs).collect()}
    with_it = run()
    monkeypatch.setattr(lm, "available", lambda: False)
    without = run()
    assert with_it.keys() == without.keys() and len(without) == 62
    for key, r in with_it.items():
        assert r[:-1] == without[key][:-1] and math.isclose(r.score, without[key].score, abs_tol=2e-2 * r.n_tokens)


def test_vocabulary_is_that_of_the_library():
    from tokenizers import Tokenizer

    path = tokens.default_vocabulary()
    assert tokens.vocabulary_of(path) == Tokenizer.from_file(path).get_vocab()
