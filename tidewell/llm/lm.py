"""Language-model scoring: a causal self-attention model on subword ids, trained and run in numpy, or by compiled graphs
with the same results where ``onnxruntime`` is installed.

A text is its words (A-Z lower-cased), then an end. Each word is all the byte-level BPE ids of a space and the word,
so a text is one stream of ids, of which some begin a word. The network gives P(id | ids before) as
P(class | ids before) * P(id | class): ids fall into classes of ids that begin a word and of ids that go on
with one (the most frequent have a class each, the others are clustered by the ids that they follow), and the second
factor is the id's smoothed share of its class over all training documents.

The probability of a word is a mixture of two. The first is that of all its ids, given that a word begins, and that
the next one begins after them. The second, of weight 1 - ``trust``, is P(class of its first id | ids before) times the
word's smoothed share of all words whose first id is of that class. The score is the sum of logs over words and end.

The model has one attention layer: a query at each place, keys and values of the places before it in its own
block of BLOCK places and in the block before, with a learned bias for each distance. Windows of two blocks
overlap by one, so each id is scored once, with at least BLOCK places of context, in batched masked products.

1. One pass over the training documents gathers word counts and the streams of ids (2 bytes an id).
2. Training: the streams are cut into windows of two blocks, all of whose ids are targets; in each round every partition runs Adam from the shared
   weights over its share of the windows, and the weights are averaged by their targets, in a tree. A partition of
   few windows goes over them up to EPOCHS times. The padding after a text's end is no target.
3. One pass scores all documents. Counts of the ``frequent`` most common words go to the workers (a bounded
   table); the other words are joined with the table of all counts, with their probabilities by the network.

Defined results: a null or empty text has the end only; a null doc_id is a training document; repeated rows are
scored alike and counted each; without training documents counts are 0; further columns are ignored.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compiled import Graph, available
from .shared import materialize
from .tokens import default_vocabulary, encoder, vocabulary_of

BLOCK, WIDTH = 16, 16
#: Classes of ids that begin words, of which so many are of one id, and of those that go on with one.
STARTS, OWN_STARTS, CONTS, OWN_CONTS = 56, 40, 72, 48
CLASSES = STARTS + CONTS
#: Weight of the probability of a word by its ids; the rest goes by its share among the words of its class.
TRUST = 0.2
#: Most times that training goes over the windows of a partition in a round, and windows that are shuffled together.
EPOCHS, SHUFFLED = 40, 32_768
#: Sets of weights that one task sums up.
FAN = 64
#: Ids of the vocabulary, and the id of a text's end, which no text has.
VOCABULARY = 50_258
END = VOCABULARY - 1
#: The base's end token: no word has a separator in it.
END_WORD = xxhash.xxh3_64_intdigest(b"\n")
#: Texts of a row of the streams, each of which belongs to one round of training.
TEXTS = 32
#: Distinct words that a worker remembers (some 60 MB), and passes on the counts of, before it starts anew.
REMEMBERED = 250_000


def remainder(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, mod 5; a null doc_id has 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def hashes_of(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


# ---------------------------------------------------------------- subwords


def begins_word(path: str, vocabulary: dict[str, int] | None = None) -> np.ndarray:
    """For each id whether its first byte is a space; the end begins a word of its own."""
    out = np.zeros(VOCABULARY, bool)
    out[[i for token, i in (vocabulary or vocabulary_of(path)).items() if token.startswith("Ġ")]] = True
    out[END] = True
    return out


class Words(dict):
    """Numbers of the distinct words that a worker has met, and their ids: all ids of a space and the word.

    Word 0, the key None, is the end of a text. ``keys`` has the words' hashes.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        vocabulary = vocabulary_of(path)
        self.encode, self.begins = encoder(path, arrays=True, vocabulary=vocabulary), begins_word(path, vocabulary)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self[None] = 0
        self.fresh: list[bytes] = []
        self.ids, self.ends = np.array([END], np.uint16), np.array([0, 1])
        self.keys = np.array([END_WORD], np.uint64).view(np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def split(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words, one after another, and where each begins."""
        ids = self.encode((b" " + b" ".join(words)).decode(errors="replace")).astype(np.uint16)
        at = np.flatnonzero(self.begins[ids])
        if len(at) != len(words):  # rare: separators of other alphabets, which the vocabulary joins with the space
            each = [self.encode(" " + w.decode(errors="replace")).astype(np.uint16) for w in words]
            ids, at = np.concatenate(each), np.cumsum([0, *map(len, each)])[:-1]
        return ids, at

    def number(self, lists: list[list[bytes | None]]) -> np.ndarray:
        """The numbers of the words of some texts, one after another."""
        out = np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), np.int64, sum(map(len, lists)))
        if self.fresh:
            ids, at = self.split(self.fresh)
            self.ends = np.concatenate([self.ends, len(self.ids) + np.append(at[1:], len(ids))])
            self.ids, self.keys = np.concatenate([self.ids, ids]), np.concatenate([self.keys, hashes_of(self.fresh)])
            self.fresh = []
        return out

    def stream(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, and where each word begins in them."""
        first = self.ends[numbers]
        sizes = self.ends[numbers + 1] - first
        begins = np.cumsum(sizes) - sizes
        return self.ids[np.arange(sizes.sum()) + np.repeat(first - begins, sizes)], begins


def words_of(text: bytes | None) -> list[bytes | None]:
    """The words of a text, and None for its end."""
    return [*(text or b"").lower().split(), None]


# ---------------------------------------------------------------- the model


def keep_memory() -> None:
    """Tells the C library to keep freed memory for the next batch: giving it back costs as much as the arithmetic."""
    library = ctypes.CDLL(None)
    if hasattr(library, "mallopt"):
        library.mallopt(-3, 1 << 30)  # M_MMAP_THRESHOLD: bytes from which a piece is mapped by itself
        library.mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD: free bytes that are kept


@dataclass
class Weights:
    """embed (CLASSES + 1, WIDTH), qkv (WIDTH, 3 WIDTH), bias (2 BLOCK) by distance, out (2 WIDTH + 1, CLASSES + 1).

    The output is a tree of two levels: its last column decides whether a word begins, the others are the classes of
    ids that begin words, or of those that do not. Its last row is added to every place.
    """

    parts: list[np.ndarray]

    @staticmethod
    def shapes() -> list[tuple[int, ...]]:
        return [(CLASSES + 1, WIDTH), (WIDTH, 3 * WIDTH), (2 * BLOCK,), (2 * WIDTH + 1, CLASSES + 1)]

    @classmethod
    def initial(cls, log_share: np.ndarray) -> Weights:
        rng = np.random.default_rng(20240504)
        parts = [rng.normal(0, 0.3, s).astype(np.float32) for s in cls.shapes()]
        parts[2][:] = 0
        starts = np.exp(log_share[:STARTS]).sum() + 1e-9
        parts[3][-1] = np.append(log_share, np.log(starts / max(1 - starts, 1e-9)))
        return cls(parts)

    def to_bytes(self, scale: float = 1.0) -> bytes:
        return np.concatenate([p.ravel() for p in self.parts]).astype(np.float64).__mul__(scale).tobytes()

    @classmethod
    def from_array(cls, flat: np.ndarray) -> Weights:
        parts, at = [], 0
        for s in cls.shapes():
            n = int(np.prod(s))
            parts.append(flat[at : at + n].reshape(s).astype(np.float32))
            at += n
        return cls(parts)


#: Distance of each key from each query of a window, whose first block has queries in training only.
_FAR = np.arange(2 * BLOCK)[:, None] - np.arange(2 * BLOCK)[None, :]
_SEEN = _FAR >= 0


def attention_bias(bias: np.ndarray, queries: int = BLOCK) -> np.ndarray:
    """The bias by distance for the last places of a window; keys after a query are masked."""
    return np.where(_SEEN, bias[np.maximum(_FAR, 0)], np.float32(-1e9)).astype(np.float32)[-queries:]


def blocks_of(classes: np.ndarray, sizes: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs x and targets y (n, block), which blocks are a text's first, and the place of each id in y.

    The input of a place is the class before it in the text; CLASSES stands before a text and for padding.
    """
    blocks = -(-sizes // block)
    begin = np.cumsum(blocks) - blocks
    ends = np.cumsum(sizes)
    total = int(blocks.sum())
    place = np.arange(len(classes)) + np.repeat(begin * block - (ends - sizes), sizes)
    x, y = np.full(total * block, CLASSES, np.uint8), np.full(total * block, CLASSES, np.uint8)
    y[place] = classes
    x[1:] = y[:-1]
    x[begin * block] = CLASSES
    x[y == CLASSES] = CLASSES
    first = np.zeros(total, bool)
    first[begin] = True
    return x.reshape(-1, block), y.reshape(-1, block), first, place


def groups(y: np.ndarray) -> list[tuple[np.ndarray, slice]]:
    """The places of the targets that begin words and of those that go on with one, and the classes of each kind."""
    flat = y.ravel()
    return [(np.flatnonzero(flat < STARTS), slice(0, STARTS)), (np.flatnonzero((flat >= STARTS) & (flat < CLASSES)), slice(STARTS, CLASSES))]


def gradients(w: Weights, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss and gradients for windows x (n, 2 BLOCK) of classes and the targets y of their last places.

    Targets of CLASSES are padding and count for nothing.
    """
    embed, qkv, bias, out = w.parts
    n, m, scale, kind = len(x), y.shape[1], embed.dtype.type(1 / np.sqrt(WIDTH)), embed.dtype
    e = embed[x]
    p = (e.reshape(-1, WIDTH) @ qkv).reshape(n, 2 * BLOCK, 3 * WIDTH)
    q, k, v = p[:, -m:, :WIDTH] * scale, p[:, :, WIDTH : 2 * WIDTH], p[:, :, 2 * WIDTH :]
    a = q @ k.transpose(0, 2, 1)
    a += attention_bias(bias, m)
    np.exp(np.minimum(a, 60, out=a), out=a)
    a /= a.sum(axis=2, keepdims=True)

    # The places of targets, those of ids that begin words first.
    flat, kinds = y.ravel(), groups(y)
    order = np.concatenate([rows for rows, _ in kinds])
    h = np.empty((len(order), 2 * WIDTH + 1), kind)
    h[:, :WIDTH], h[:, WIDTH:-1], h[:, -1] = e[:, -m:].reshape(-1, WIDTH)[order], (a @ v).reshape(-1, WIDTH)[order], 1
    targets, starts = max(1, len(order)), len(kinds[0][0])
    begins = 1 / (1 + np.exp(-np.clip(h @ out[:, -1], -60, 60)))
    error = begins.copy()
    error[:starts] -= 1
    error /= targets
    d_out, dh, loss = np.zeros_like(out), error[:, None].astype(kind) * out[:, -1], 0.0
    d_out[:, -1] = h.T @ error
    for (rows, cut), chance, here in zip(kinds, (begins[:starts], 1 - begins[starts:]), (slice(0, starts), slice(starts, None)), strict=True):
        own = h[here]
        g = own @ out[:, cut]
        if len(g) and g.max() > 60:
            np.minimum(g, 60, out=g)
        target = np.arange(len(rows)), flat[rows].astype(np.int64) - cut.start
        chosen = g[target]
        np.exp(g, out=g)
        total = g.sum(axis=1)
        loss += float((np.log(total) - chosen - np.log(chance)).sum()) / targets
        g *= (1 / (total * targets))[:, None].astype(kind)
        g[target] -= kind.type(1 / targets)
        d_out[:, cut] = own.T @ g
        dh[here] += g @ out[:, cut].T

    back = np.zeros((n * m, 2 * WIDTH), kind)
    back[order] = dh[:, :-1]
    back = back.reshape(n, m, 2 * WIDTH)
    do = back[:, :, WIDTH:]
    ds = do @ v.transpose(0, 2, 1)
    ds -= np.einsum("nqk,nqk->nq", ds, a)[:, :, None]
    ds *= a
    dp = np.zeros_like(p)
    dp[:, -m:, :WIDTH] = ds @ k * scale
    dp[:, :, WIDTH : 2 * WIDTH] = ds.transpose(0, 2, 1) @ q
    dp[:, :, 2 * WIDTH :] = a.transpose(0, 2, 1) @ do
    d_bias = np.bincount(np.maximum(_FAR[-m:], 0).ravel(), weights=(ds.sum(axis=0) * _SEEN[-m:]).ravel(), minlength=2 * BLOCK)
    flat_p = dp.reshape(-1, 3 * WIDTH)
    de = (flat_p @ qkv.T).reshape(n, 2 * BLOCK, WIDTH)
    de[:, -m:] += back[:, :, :WIDTH]
    by_class = np.argsort(x.ravel(), kind="stable")
    ranked = x.ravel()[by_class]
    at = np.flatnonzero(np.diff(ranked.astype(np.int64), prepend=-1))
    d_embed = np.zeros_like(embed)
    d_embed[ranked[at]] = np.add.reduceat(de.reshape(-1, WIDTH)[by_class], at, axis=0)
    return loss, [d_embed, e.reshape(-1, WIDTH).T @ flat_p, d_bias.astype(kind), d_out]


def gradient_graph():
    """``gradients`` of windows of two blocks, all of whose places have targets or padding, as a compiled graph.

    Its results are sums over the targets: by ``embed``, by ``qkv``, by query and key, and by ``out``.
    """
    g, scale = Graph(), 1 / WIDTH**0.5
    embed, qkv, bias, out = (g.input(name, "float32", 2) for name in ("embed", "qkv", "bias", "out"))
    x, begun = g.input("x", "int64", 2), g.input("begun", "float32", 2)
    order, back_to, split = (g.input(name, "int64", 1) for name in ("order", "back_to", "split"))
    targets, less = [g.input(f"target{i}", "int64", 2) for i in range(2)], [g.input(f"less{i}", "float32", 2) for i in range(2)]

    e = g("Gather", embed, x)
    q, k, v = (g("Gather", t, x) for t in g("Split", g("MatMul", embed, qkv), g.shape(WIDTH, WIDTH, WIDTH), outputs=3, axis=1))
    a = g("Softmax", g("Add", g.product(q, k, 0, 1, scale), bias), axis=-1)
    o = g.product(a, v)
    h = g("Gather", g("Reshape", g("Concat", e, o, axis=-1), g.shape(-1, 2 * WIDTH)), order)
    tree = g.shape(STARTS, CONTS, 1)
    weights, added = (g("Split", part, tree, outputs=3, axis=1) for part in g("Split", out, g.shape(2 * WIDTH, 1), outputs=2, axis=0))

    error = g("Sub", g("Sigmoid", g("Gemm", h, weights[2], added[2])), begun)
    errors, own = [], g("Split", h, split, outputs=2, axis=0)
    for part, w, b, t, n in zip(own, weights[:2], added[:2], targets, less, strict=True):
        errors.append(g("ScatterElements", g("Softmax", g("Gemm", part, w, b), axis=-1), t, n, axis=1, reduction="add"))
    d_weights = g("Concat", *(g.product(part, d, 1, 0) for part, d in zip([*own, h], [*errors, error], strict=True)), axis=1)
    d_added = g("Concat", *(g("ReduceSum", d, g.shape(0), keepdims=1) for d in [*errors, error]), axis=1)
    d_out = g("Concat", d_weights, d_added, axis=0)
    dh = g("Concat", *(g.product(d, w, 0, 1) for d, w in zip(errors, weights[:2], strict=True)), axis=0)
    dh = g("Add", dh, g("Mul", error, g("Transpose", weights[2], perm=[1, 0])))

    back = g("Gather", g("Concat", dh, g.constant(np.zeros((1, 2 * WIDTH), np.float32)), axis=0), back_to)
    de, do = g("Split", back, g.shape(WIDTH, WIDTH), outputs=2, axis=1)
    do = g("Reshape", do, g.shape(-1, 2 * BLOCK, WIDTH))
    ds = g("Mul", a, g("Sub", g.product(do, v, 0, 1), g("ReduceSum", g("Mul", do, o), g.shape(2), keepdims=1)))
    dp = g("Concat", g.product(ds, k, 0, 0, scale), g.product(ds, q, 1, 0, scale), g.product(a, do, 1, 0), axis=2)
    dp = g("Reshape", dp, g.shape(-1, 3 * WIDTH))
    zero = g.constant(np.zeros((CLASSES + 1, WIDTH), np.float32))
    d_embed = g("ScatterND", zero, g("Reshape", x, g.shape(-1, 1)), g("Add", g.product(dp, qkv, 0, 1), de), reduction="add")
    g.output(d_embed, g.product(g("Reshape", e, g.shape(-1, WIDTH)), dp, 1, 0))
    g.output(g("ReduceSum", ds, g.shape(0), keepdims=0), d_out)
    return g.session()


def compiled_gradients(run: Callable, parts: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The gradients that ``gradients`` gives, by ``run`` of ``gradient_graph``."""
    embed, qkv, bias, out = parts
    flat, kinds = y.ravel(), groups(y)
    order = np.concatenate([rows for rows, _ in kinds])
    back_to = np.full(len(flat), len(order))
    back_to[order] = np.arange(len(order))
    begun = np.zeros((len(order), 1), np.float32)
    begun[: len(kinds[0][0])] = 1
    ins = {"split": np.array([len(rows) for rows, _ in kinds]), "order": order, "back_to": back_to, "begun": begun}
    for i, (rows, cut) in enumerate(kinds):
        ins |= {f"target{i}": flat[rows, None].astype(np.int64) - cut.start, f"less{i}": np.full((len(rows), 1), -1, np.float32)}
    d_embed, d_qkv, ds, d_out = run(embed=embed, qkv=qkv, bias=attention_bias(bias, 2 * BLOCK), out=out, x=x.astype(np.int64), **ins)
    d_bias = np.bincount(np.maximum(_FAR, 0).ravel(), weights=(ds * _SEEN).ravel(), minlength=2 * BLOCK)
    return [d * np.float32(1 / max(1, len(order))) for d in (d_embed, d_qkv, d_bias.astype(np.float32), d_out)]


class Adam:
    """Weights that are trained batch by batch; the rate falls to a tenth over ``steps``."""

    def __init__(self, w: Weights, steps: int, rate: float) -> None:
        self.run = gradient_graph() if available() else None
        self.flat = np.concatenate([p.ravel() for p in w.parts])
        ends = np.cumsum([p.size for p in w.parts])
        self.parts = [part.reshape(p.shape) for part, p in zip(np.split(self.flat, ends[:-1]), w.parts, strict=True)]
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.t, self.steps, self.rate = 0, max(1, steps), rate

    def step(self, x: np.ndarray, y: np.ndarray) -> None:
        self.t += 1
        grads = compiled_gradients(self.run, self.parts, x, y) if self.run else gradients(Weights(self.parts), x, y)[1]
        now = self.rate * (1 - 0.9 * min(1, self.t / self.steps))
        g, a, b = np.concatenate([part.ravel() for part in grads]), self.m, self.v
        a += np.float32(0.1) * (g - a)
        b += np.float32(0.01) * (g * g - b)
        self.flat -= np.float32(now / (1 - 0.9**self.t)) * a / (np.sqrt(b / np.float32(1 - 0.99**self.t)) + np.float32(1e-8))


def block_log_probs(w: Weights, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For blocks x (n, BLOCK) in the order of the texts: ln P(class y | context), and ln P(a word begins | context).

    ``first`` marks a text's first block; where y is CLASSES, for padding, the former is 0.
    """
    embed, qkv, bias, out = w.parts
    n, scale = len(x), np.float32(1 / np.sqrt(WIDTH))
    e = embed[x].reshape(-1, WIDTH)
    p = (e @ qkv).reshape(n, BLOCK, 3 * WIDTH)
    pad = (embed[CLASSES] @ qkv)[WIDTH:]
    both = np.empty((n, 2 * BLOCK, 2 * WIDTH), np.float32)
    both[:, BLOCK:] = p[:, :, WIDTH:]
    both[1:, :BLOCK] = p[:-1, :, WIDTH:]
    both[first, :BLOCK] = pad
    s = (p[:, :, :WIDTH] * scale) @ both[:, :, :WIDTH].transpose(0, 2, 1)
    s += attention_bias(bias)
    np.exp(np.minimum(s, 60, out=s), out=s)
    o = s @ both[:, :, WIDTH:]
    o /= s.sum(axis=2, keepdims=True) + np.float32(1e-30)
    h = np.empty((n * BLOCK, 2 * WIDTH + 1), np.float32)
    h[:, :WIDTH], h[:, WIDTH:-1], h[:, -1] = e, o.reshape(-1, WIDTH), 1
    begins = np.clip(h @ out[:, -1], -60, 60)
    starts = -np.log1p(np.exp(-begins))
    chosen, flat = np.zeros(len(h), np.float32), y.ravel()
    for (rows, cut), chance in zip(groups(y), (starts, starts - begins), strict=True):
        logits = h[rows] @ out[:, cut]
        np.minimum(logits, 60, out=logits)
        target = logits[np.arange(len(rows)), flat[rows].astype(np.int64) - cut.start]
        np.exp(logits, out=logits)
        chosen[rows] = target - np.log(logits.sum(axis=1) + np.float32(1e-37)) + chance[rows]
    return chosen.reshape(n, BLOCK), starts.reshape(n, BLOCK)


def score_graph(w: Weights):
    """ln P(class | context) of targets that begin words, of the others, and the logits that a word begins, compiled.

    Inputs are blocks, those with the blocks before them, and rows and classes of the targets of each kind.
    """
    embed, qkv, bias, out = w.parts
    g, table = Graph(), embed @ qkv
    x, both = g.input("x", "int32", 2), g.input("both", "int32", 2)
    scaled = table[:, :WIDTH] * np.float32(1 / np.sqrt(WIDTH))
    q, k, v = (g("Gather", g.constant(t), at) for t, at in ((scaled, x), (table[:, WIDTH : 2 * WIDTH], both), (table[:, 2 * WIDTH :], both)))
    a = g("Softmax", g("Add", g.product(q, k, 0, 1), g.constant(attention_bias(bias))), axis=-1)
    h = g("Reshape", g("Concat", g("Gather", g.constant(embed), x), g.product(a, v), axis=-1), g.shape(-1, 2 * WIDTH))
    for i, cut in enumerate((slice(0, STARTS), slice(STARTS, CLASSES))):
        own = g("Gather", h, g.input(f"rows{i}", "int64", 1))
        logits = g("Gemm", own, g.constant(out[:-1, cut]), g.constant(out[-1, cut]))
        g.output(g("GatherElements", g("LogSoftmax", logits, axis=-1), g.input(f"target{i}", "int64", 2), axis=1))
    g.output(g("Gemm", h, g.constant(out[:-1, -1:]), g.constant(out[-1, -1:])))
    return g.session()


def scorer(w: Weights) -> Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """``block_log_probs`` of the weights, compiled if the library is there."""
    if not available():
        return lambda x, y, first: block_log_probs(w, x, y, first)
    run = score_graph(w)

    def score(x: np.ndarray, y: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = np.empty((len(x), 2 * BLOCK), np.int32)
        both[:, BLOCK:] = x
        both[1:, :BLOCK] = x[:-1]
        both[first, :BLOCK] = CLASSES
        flat, kinds, ins = y.ravel(), groups(y), {}
        for i, (rows, cut) in enumerate(kinds):
            ins |= {f"rows{i}": rows, f"target{i}": flat[rows, None].astype(np.int64) - cut.start}
        *found, begins = run(x=x.astype(np.int32), both=both, **ins)
        begins = np.clip(begins[:, 0], -60, 60)
        starts = -np.log1p(np.exp(-begins))
        chosen = np.zeros(len(flat), np.float32)
        for (rows, _), part, chance in zip(kinds, found, (starts, starts - begins), strict=True):
            chosen[rows] = part[:, 0] + chance[rows]
        return chosen.reshape(x.shape), starts.reshape(x.shape)

    return score


@dataclass
class Classes:
    """Class of each id, ln of an id's share of its class, and ln of a class's share of all ids."""

    of: np.ndarray
    within: np.ndarray
    share: np.ndarray


def id_log_probs(w: Weights, classes: Classes, flat: np.ndarray, sizes: np.ndarray, at_once: int = 512, score: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For the ids of some texts (``sizes`` each): ln P(id | context), and ln P(a word begins | context) at each place.

    ``score`` is the scorer of the weights, for callers with many texts.
    """
    score = score or scorer(w)
    kinds = classes.of[flat]
    x, y, first, place = blocks_of(kinds, sizes)
    chosen, starts = np.empty(x.shape, np.float32), np.empty(x.shape, np.float32)
    for a in range(0, len(x), at_once):
        lo = max(0, a - 1)  # the block before is context; a text's first block needs none
        begins = first[lo : a + at_once] | (np.arange(lo, min(len(x), a + at_once)) == lo)
        part = score(x[lo : a + at_once], y[lo : a + at_once], begins)
        chosen[a : a + at_once], starts[a : a + at_once] = part[0][a - lo :], part[1][a - lo :]
    return chosen.ravel()[place] + classes.within[flat], starts.ravel()[place]


def word_log_probs(w: Weights, classes: Classes, flat: np.ndarray, sizes: np.ndarray, begins: np.ndarray, score: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each word and end of some texts, whose ids begin at ``begins`` in flat: ln P(its ids) and ln P(class of its first id).

    Both are given what stands before and that a word begins at their place; after the ids a word must begin, unless
    the text is over.
    """
    log_probs, starts = id_log_probs(w, classes, flat, sizes, score=score)
    after = np.append(starts[begins[1:]], 0)
    after[np.searchsorted(begins, np.cumsum(sizes)) - 1] = 0
    whole = np.add.reduceat(log_probs.astype(np.float64), begins) - starts[begins] + after
    return np.minimum(whole, 0), np.minimum(log_probs[begins] - classes.within[flat[begins]] - starts[begins], 0)


# ---------------------------------------------------------------- gathering and training


def gather(docs: DataFrame, path: str) -> DataFrame:
    """Rows with a word's hash, first id and count, and rows with the streams of ids of some texts and their sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        words = Words(path)
        counts = np.zeros(0, np.int64)

        def rows(keys: np.ndarray, n: np.ndarray, id_: np.ndarray, ids: bytes | None = None, sizes: bytes | None = None) -> pa.RecordBatch:
            columns = [pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(id_.astype(np.int32)), *[pa.array([x] * len(keys), pa.binary()) for x in (ids, sizes)]]
            return pa.RecordBatch.from_arrays(columns, names=["key", "n", "id", "ids", "sizes"])

        for whole in batches:
            for batch in (whole.slice(at, TEXTS) for at in range(0, whole.num_rows, TEXTS)):
                lists = [words_of(t.as_py()) for t in batch.column(0)]
                numbers = words.number(lists)
                found = np.bincount(numbers, minlength=len(words))
                found[: len(counts)] += counts
                counts = found
                ids, begins = words.stream(numbers)
                texts = np.cumsum([0, *map(len, lists)])
                yield rows(np.zeros(1), np.zeros(1), np.zeros(1), ids.tobytes(), np.diff(np.append(begins, len(ids))[texts]).astype(np.int64).tobytes())
                if len(words) > REMEMBERED:
                    yield rows(words.keys, counts, words.ids[words.ends[:-1]])
                    words.reset()
                    counts = np.zeros(0, np.int64)
        if len(counts):
            yield rows(words.keys, counts, words.ids[words.ends[:-1]])

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "key long, n long, id int, ids binary, sizes binary")


def read_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and sizes of the texts of each row."""
    for batch in batches:
        for ids, sizes in zip(batch.column(0), batch.column(1), strict=True):
            yield np.frombuffer(ids.as_py(), np.uint16), np.frombuffer(sizes.as_py(), np.int64)


def id_counts(streams: DataFrame) -> np.ndarray:
    """How often each id occurs in all streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for ids, _ in read_streams(batches):
            total += np.bincount(ids, minlength=VOCABULARY)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    out = np.zeros(VOCABULARY, np.int64)
    for i, n in streams.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect():  # a row for each id
        out[i] = n
    return out


def followed(streams: DataFrame, own: np.ndarray) -> np.ndarray:
    """How often each id stands right after each of the ids ``own``, in its text: (VOCABULARY, len(own))."""
    size = len(own)
    place = np.full(VOCABULARY, size, np.int64)
    place[own] = np.arange(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY * (size + 1), np.int64)
        waiting: list[np.ndarray] = []

        def add() -> None:
            np.add(total, np.bincount(np.concatenate(waiting), minlength=len(total)), out=total)
            waiting.clear()

        for ids, sizes in read_streams(batches):
            pairs = ids[1:].astype(np.int64) * (size + 1) + place[ids[:-1]]
            inside = np.ones(len(pairs), bool)
            inside[np.cumsum(sizes)[:-1] - 1] = False
            waiting.append(pairs[inside])
            if sum(map(len, waiting)) > 2_000_000:
                add()
        if waiting:
            add()
        seen = np.flatnonzero(total)
        i, j = np.divmod(seen, size + 1)
        keep = j < size
        yield pa.RecordBatch.from_arrays([pa.array(i[keep]), pa.array(j[keep]), pa.array(total[seen[keep]])], names=["id", "j", "n"])

    out = np.zeros((VOCABULARY, size))
    summed = streams.mapInArrow(run, "id long, j long, n long").groupBy("id", "j").agg(F.sum("n").alias("n"))
    found = summed.toPandas().to_numpy(np.int64)  # a row for each id and each of own at most
    out[found[:, 0], found[:, 1]] = found[:, 2]
    return out


def clusters(near: np.ndarray, weight: np.ndarray, k: int, steps: int = 15) -> np.ndarray:
    """Weighted k-means of the square roots of the shares in each row of near, from the heaviest rows."""
    x = np.sqrt(near / np.maximum(near.sum(axis=1, keepdims=True), 1))
    centre = x[np.argsort(-weight, kind="stable")[np.linspace(0, min(len(x), 4 * k) - 1, k).astype(np.int64)]]
    group = np.zeros(len(x), np.int64)
    for _ in range(steps):
        group = np.argmax(x @ centre.T - 0.5 * (centre**2).sum(axis=1), axis=1)
        sums = np.stack([np.bincount(group, weights=weight * x[:, c], minlength=k) for c in range(x.shape[1])], axis=1)
        total = np.bincount(group, weights=weight, minlength=k)
        centre = np.where(total[:, None] > 0, sums / np.maximum(total, 1)[:, None], centre)
    return group


def own_ids(counts: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids with a class of their own: the most frequent that begin words (and the end), and that go on with one."""
    ranked = np.argsort(-counts, kind="stable")
    starts = [END, *[i for i in ranked[begins[ranked]].tolist() if i != END][: OWN_STARTS - 1]]
    return np.array(starts), ranked[~begins[ranked]][:OWN_CONTS]


def classes_of(counts: np.ndarray, near: np.ndarray, begins: np.ndarray) -> Classes:
    """Classes of starts come first, those of own ids before the clusters; ids that never occur are clustered too."""
    of, at = np.zeros(VOCABULARY, np.uint8), 0
    for own, kind, k in zip(own_ids(counts, begins), (begins, ~begins), (STARTS - OWN_STARTS, CONTS - OWN_CONTS), strict=True):
        rest = np.setdiff1d(np.flatnonzero(kind), own)
        of[own] = at + np.arange(len(own))
        of[rest] = at + len(own) + clusters(near[rest], counts[rest] + 0.5, k)
        at += len(own) + k
    mass = counts + 0.5
    share = np.bincount(of, weights=mass, minlength=CLASSES)
    return Classes(of, np.log(mass / share[of]).astype(np.float32), np.log(np.maximum(share, 0.5) / share.sum()))


def windows(streams: Iterator[tuple[np.ndarray, np.ndarray]], of: np.ndarray, turn: int, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The windows of the round's rows of the streams: x and y of two blocks, some SHUFFLED at a time."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def mixed() -> tuple[np.ndarray, np.ndarray]:
        x, y = (np.concatenate([p[k] for p in parts]) for k in range(2))
        order = np.random.default_rng(turn).permutation(len(x))
        parts.clear()
        return x[order], y[order]

    for number, (ids, sizes) in enumerate(streams):
        if number % rounds != turn:
            continue
        parts.append(blocks_of(of[ids], sizes, 2 * BLOCK)[:2])
        if sum(len(x) for x, _ in parts) >= SHUFFLED:
            yield mixed()
    if parts:
        yield mixed()


def train(start: Weights, streams: Iterator[tuple[np.ndarray, np.ndarray]], of: np.ndarray, turn: int, rounds: int, batch: int, least_steps: int, rate: float) -> tuple[Weights, int]:
    """Adam over the round's windows of a partition, and the number of targets; few windows are gone over again."""
    adam, targets = None, 0
    for x, y in windows(streams, of, turn, rounds):
        once = -(-len(x) // batch)
        adam = adam or Adam(start, max(min(least_steps, EPOCHS * once), once), rate)
        targets += int((y != CLASSES).sum())
        for t in range(once):
            adam.step(x[t * batch : (t + 1) * batch], y[t * batch : (t + 1) * batch])
    while adam and adam.t < adam.steps:  # all windows of a partition so small came in one part
        rows = np.arange(adam.t * batch, (adam.t + 1) * batch) % len(x)
        adam.step(x[rows], y[rows])
    return Weights(adam.parts) if adam else start, targets


def average(local: DataFrame, partitions: int) -> Weights | None:
    """The mean of (part, weight, flat) by weight, summed up FAN at a time, so that no task gets more than that."""

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(np.frombuffer(group["flat"].iloc[0])))
        for _, x in sorted(zip(group["part"], group["flat"], strict=True), key=lambda r: r[0]):
            total += np.frombuffer(x)
        return pd.DataFrame({"part": [int(group["part"].min())], "weight": [float(group["weight"].sum())], "flat": [total.tobytes()]})

    while partitions > FAN:
        local = local.withColumn("part", (F.col("part") / FAN).cast("long")).groupBy("part").applyInPandas(summed, local.schema)
        partitions = -(-partitions // FAN)
    rows = sorted(local.collect(), key=lambda r: r["part"])  # at most FAN sets of weights
    if not rows:
        return None
    return Weights.from_array(sum(np.frombuffer(r["flat"]) for r in rows) / sum(r["weight"] for r in rows))


def fit(streams: DataFrame, classes: Classes, rounds: int = 3, batch: int = 64, least_steps: int = 120, rate: float = 0.01) -> Weights:
    """Local Adam on every partition of the streams and weighted averages, round by round."""
    of, w = classes.of, Weights.initial(classes.share)
    partitions = streams.rdd.getNumPartitions()
    for turn in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, start: Weights = w) -> Iterator[pa.RecordBatch]:
            keep_memory()
            done, targets = train(start, read_streams(batches), of, turn, rounds, batch, least_steps, rate)
            if targets:
                columns = [pa.array([TaskContext.get().partitionId()]), pa.array([float(targets)]), pa.array([done.to_bytes(targets)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "weight", "flat"])

        w = average(streams.mapInArrow(run, "part long, weight double, flat binary"), partitions) or w
    return w


# ---------------------------------------------------------------- scoring


def score_documents(docs: DataFrame, vocabulary: str | None = None, frequent: int = 200_000, trust: float = TRUST, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs."""
    path = vocabulary or default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    gathered = materialize(gather(docs.filter(remainder(F.col("doc_id")) != 1), path), "gathered")
    counts = materialize(gathered.filter("n > 0").groupBy("key").agg(F.sum("n").alias("c"), F.max("id").alias("id")), "counts")
    n_all, n_distinct = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).first())
    streams, begins = gathered.filter("ids IS NOT NULL").select("ids", "sizes"), begins_word(path)
    often = id_counts(streams)
    classes = classes_of(often, followed(streams, np.concatenate(own_ids(often, begins))), begins)
    weights = fit(streams, classes, **options)

    denominator = n_all + 0.5 * (n_distinct + 1)
    mass = np.full(STARTS, 0.5)
    for i, c, n in counts.groupBy("id").agg(F.sum("c"), F.count("*")).collect():  # a row for each id
        mass[min(classes.of[i], STARTS - 1)] += c + 0.5 * n
    word_share = np.log(mass / mass.sum())  # of the words of each class
    # The least count with which at most ``frequent`` words go to the workers.
    steps = [(r["b"], r["n"]) for r in counts.groupBy(F.floor(F.log2("c") * 4).alias("b")).agg(F.count("*").alias("n")).collect()]
    least, total = 1 << 62, 0
    for b, n in sorted(steps, reverse=True):
        if (total := total + n) > frequent:
            break
        least = b
    common = counts.filter(F.floor(F.log2("c") * 4) >= least).toPandas().sort_values("key")
    # Classes of this package go to the workers with the function, by value.
    table = common["key"].to_numpy(np.int64).copy(), common["c"].to_numpy(np.float64) + 0.5, weights, classes, word_share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        keys, known, w, kinds, shares = table
        score = scorer(w)
        words, row = Words(path), TaskContext.get().partitionId() << 33
        place, hits = np.zeros(0, np.int64), np.zeros(0, bool)  # of the words' counts in the table, by their numbers
        for whole in batches:
            for batch in (whole.slice(at, 64) for at in range(0, whole.num_rows, 64)):
                if len(words) > REMEMBERED:
                    words.reset()
                    place, hits = place[:0], hits[:0]
                lists = [words_of(t.as_py()) for t in batch.column(1)]
                numbers = words.number(lists)
                fresh = words.keys[len(place) :]
                at = np.minimum(np.searchsorted(keys, fresh), max(0, len(keys) - 1))
                place, hits = np.append(place, at), np.append(hits, keys[at] == fresh if len(keys) else np.zeros(len(fresh), bool))
                every, begins = words.stream(numbers)
                sizes = np.array([len(x) for x in lists])
                texts = np.append(0, np.cumsum(sizes))
                net, gain = word_log_probs(w, kinds, every, np.diff(np.append(begins, len(every))[texts]), begins, score)
                net, gain = net + np.log(trust), gain - shares[np.minimum(kinds.of[every[begins]], STARTS - 1)]
                hit, text = hits[numbers], np.repeat(np.arange(len(lists)), sizes)
                count = known[place[numbers[hit]]]
                mixed = np.log(np.exp(net[hit]) + np.exp(gain[hit]) * count * ((1 - trust) / denominator)) / np.log(10)
                sums = [np.bincount(text[hit], weights=x, minlength=len(lists)).astype(np.float64) for x in (None, np.log10(count), mixed)]
                ends = np.append(0, np.cumsum(np.bincount(text[~hit], minlength=len(lists)))).astype(np.int32)
                rare = pa.StructArray.from_arrays([pa.array(words.keys[numbers[~hit]]), *[pa.array(x[~hit].astype(np.float32)) for x in (net, gain)]], names=["key", "net", "gain"])
                columns = [pa.array(row + np.arange(len(lists))), batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.ListArray.from_arrays(pa.array(ends), rare)]
                row += len(lists)
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_tokens", "n_hit", "base", "mixed", "rare"])

    kind = "row long, doc_id long, n_tokens long, n_hit long, base double, mixed double, rare array<struct<key:long,net:float,gain:float>>"
    scored = materialize(docs.mapInArrow(run, kind), "scored")
    rare = scored.select("row", F.inline("rare")).join(counts.drop("id"), "key", "left").withColumn("k", F.coalesce("c", F.lit(0)) + 0.5)
    mixture = F.log10(F.exp(F.col("net").cast("double")) + F.exp(F.col("gain").cast("double")) * F.col("k") * ((1 - trust) / denominator))
    summed = rare.groupBy("row").agg(F.sum(F.log10("k")).alias("more"), F.sum(mixture).alias("more_mixed"), F.count("c").alias("n_more"))
    zero = F.lit(0.0)
    return (
        scored.drop("rare")
        .join(summed, "row", "left")
        .select(
            "doc_id",
            (remainder(F.col("doc_id")) == 1).alias("held_out"),
            "n_tokens",
            (F.col("n_hit") + F.coalesce("n_more", F.lit(0))).alias("n_known"),
            F.lit(n_all).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more", zero) - F.col("n_tokens") * float(np.log10(denominator))).alias("base_score"),
            (F.col("mixed") + F.coalesce("more_mixed", zero)).alias("score"),
        )
    )


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
