"""Benchmark decontamination by latent semantic retrieval.

1. Terms are the words of the benchmark (lower-cased, punctuation dropped). One pass over all documents
   counts the passages (windows of two blocks of BLOCK words) that hold each; terms of more than ``max_df``
   of all passages are left out, but every item keeps its KEEP rarest, a long one an eighth of its length.
2. A second pass keeps, for each document, the places of these terms: a compact table.
3. Randomised SVD of the TF-IDF passages, distributed: with random signs S, every partition sums T'TS over
   its passages (T: term counts; whole numbers, so the sum is the same in any order). The driver adds the
   benchmark's own passages, scales by idf and takes the Nystroem approximation of the Gram matrix; its
   eigenvectors are the latent space. Only matrices of benchmark terms by RANK meet there.
4. A last pass projects all passages of all documents and compares them, in blocks, with all items. Pairs of
   cosine at least ``cosine`` are candidates, confirmed by the longest common subsequence of words, for the
   item and for its answer (its last sentence). A passage is shorter than many items, so items of which a
   document holds enough terms are also compared with regions of their own length, laid where the terms'
   places in document and item agree.

The benchmark is a fixed evaluation set, taken in blocks of at most MAX_ITEMS items and MAX_TERMS terms, so what goes
to the workers at a time is bounded. Nothing else depends on the number of documents.

Defined results: null and empty texts match nothing, and so do items without words; null ids are kept;
repeated rows are judged alike; empty tables give no match; further columns are ignored by
``find_leaks`` and passed through by ``drop_leaks``.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

BLOCK, RANK, KEEP = 16, 128, 10
#: Places of terms that a passage needs to be compared, and different terms of an item that a passage or a region
#: needs to be its candidate; an item has KEEP terms or more, unless it is shorter, and one of fewer than EVIDENCE
#: needs all of them.
EVIDENCE = 3
#: Rows of documents' terms by items that are counted at once.
COUNTED = 2_000_000
MAX_ITEMS, MAX_TERMS = 50_000, 100_000
#: Partitions whose sums one task adds up.
FAN = 64
BENCHMARK_WEIGHT = 20
PUNCTUATION = b".,;:!?\"'()[]{}*_`"


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(None, PUNCTUATION).split()


def answer_of(text: str) -> list[bytes]:
    """The words of the last sentence, or the last half of the words where that is shorter than 4 or all there is."""
    whole = words(text.encode())
    last = words(re.split(r"(?<=[.!?])\s+", text.strip())[-1].encode())
    return last if 4 <= len(last) < len(whole) else whole[len(whole) // 2 :]


@dataclass
class Item:
    item_id: int | None
    words: list[bytes]
    answer: list[bytes]


def read_items(benchmark: DataFrame) -> Iterator[list[Item]]:
    """The items with words, in blocks of about MAX_ITEMS items, or fewer if these have more than MAX_TERMS terms."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    blocks = -(-rows.count() // MAX_ITEMS)
    for n in range(blocks):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).collect()
        items = [Item(r[0], words(r[1].encode()), answer_of(r[1])) for r in sorted(own, key=lambda r: (r[0] is None, r[0], r[1]))]
        waiting = [[x for x in items if x.words]]
        while waiting:
            block = waiting.pop()
            if len(block) > 1 and len({w for x in block for w in x.words}) > MAX_TERMS:
                waiting += [block[len(block) // 2 :], block[: len(block) // 2]]
            elif block:
                yield block


def _texts(batches: Iterator[pa.RecordBatch], column: int, rows: int = 300) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            yield batch, [words(t.as_py() or b"") for t in batch.column(column)]


def _binary(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("binary").alias("text"))


def passage_counts(docs: DataFrame, index: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """For each term the number of blocks that hold it, and the number of blocks, over all documents."""
    held, size = docs.sparkSession.sparkContext.broadcast(index), len(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, counts, blocks = held.value.get, np.zeros(size, np.int64), 0
        for _, texts in _texts(batches, 0):
            sizes = np.array([len(w) for w in texts], np.int64)
            ids = np.fromiter(map(get, chain.from_iterable(texts), repeat(-1)), np.int32, sizes.sum())
            block = block_numbers(sizes)
            blocks += int((-(-sizes // BLOCK)).sum())
            known = ids >= 0
            pairs = np.unique(block[known] * size + ids[known])
            counts += np.bincount(pairs % size, minlength=size) if size else counts
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(counts[seen], blocks))], names=["term", "n"])

    rows = _binary(docs).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term
    counts = np.zeros(size, np.int64)
    total = 0
    for term, n in rows:
        if term < 0:
            total = n
        else:
            counts[term] = n
    return counts, total


def block_numbers(sizes: np.ndarray) -> np.ndarray:
    """The block of each word; a block is left out after each text, so that passages don't reach over."""
    per_text = -(-sizes // BLOCK) + 1
    first = np.cumsum(per_text) - per_text
    start = np.cumsum(sizes) - sizes
    return np.repeat(first, sizes) + (np.arange(sizes.sum()) - np.repeat(start, sizes)) // BLOCK


def passage_sums(values: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sums of the passages (blocks s and s + 1) that hold any of the rows; block is sorted."""
    own, at = np.unique(block, return_index=True)
    sums = np.add.reduceat(values, at, axis=0)
    starts = np.unique(np.concatenate([own - 1, own]))
    out = np.zeros((len(starts), values.shape[1]), values.dtype)
    for shift in (0, 1):
        where = np.searchsorted(starts, own - shift)
        out[where] += sums
    return starts, out


def parts_of(block: np.ndarray, places: int = 2000) -> list[int]:
    """Bounds of parts of about so many places, cut only where a block is missing, as one is after each text."""
    cuts = np.flatnonzero(np.diff(block) > 1) + 1
    wanted = np.searchsorted(cuts, np.arange(places, len(block), places))
    return np.unique([0, *cuts[wanted[wanted < len(cuts)]], len(block)]).tolist()


def signs(terms: int, rank: int = RANK) -> np.ndarray:
    return np.random.default_rng(20240503).integers(0, 2, (terms, rank)).astype(np.float32) * 2 - 1


def gram_product(ids: np.ndarray, block: np.ndarray, s: np.ndarray, into: np.ndarray) -> None:
    """Adds T'TS of some passages to into; sums of these few passages are whole numbers that float32 holds exactly."""
    starts, z = passage_sums(s[ids], block)
    both = z[np.searchsorted(starts, block - 1)] + z[np.searchsorted(starts, block)]
    order = np.argsort(ids, kind="stable")
    ranked = ids[order]
    at = np.flatnonzero(np.diff(ranked, prepend=-1))
    into[ranked[at]] += np.add.reduceat(both[order], at, axis=0)


def distributed_gram(docs: DataFrame, index: dict[bytes, int]) -> np.ndarray:
    """T'TS over the passages of all documents, by way of a compact table of the terms' places."""
    size, held = len(index), docs.sparkSession.sparkContext.broadcast(index)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = held.value.get
        for _, texts in _texts(batches, 0):
            sizes = np.array([len(w) for w in texts], np.int64)
            ids = np.fromiter(map(get, chain.from_iterable(texts), repeat(-1)), np.int32, sizes.sum())
            block = block_numbers(sizes)[ids >= 0].astype(np.int32)
            kept = ids[ids >= 0]
            yield pa.RecordBatch.from_arrays([pa.array([kept.tobytes()]), pa.array([block.tobytes()])], names=["ids", "blocks"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, total = signs(size), np.zeros((size, RANK))
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                ids, block = np.frombuffer(a.as_py(), np.int32), np.frombuffer(b.as_py(), np.int32).astype(np.int64)
                bounds = parts_of(block)
                for lo, hi in zip(bounds, bounds[1:], strict=False):
                    gram_product(ids[lo:hi], block[lo:hi], s, total)
        seen = np.flatnonzero(total.any(axis=1))
        for at in range(0, len(seen), 64):
            part = seen[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([total[i].astype("<i8").tobytes() for i in part], pa.binary())], names=["term", "row"])

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        by: dict[int, np.ndarray] = {}
        for term, row in zip(group["term"], group["row"], strict=True):
            value = np.frombuffer(row, "<i8")
            by[term] = by[term] + value if term in by else value
        return pd.DataFrame({"term": list(by), "part": int(group["part"].iloc[0]), "row": [v.tobytes() for v in by.values()]})

    compact = materialize(_binary(docs).mapInArrow(places, "ids binary, blocks binary"), "places")
    parts = compact.mapInArrow(partial, "term long, row binary").withColumn("part", F.spark_partition_id())
    block, left = (F.col("term") / 16).cast("long").alias("block"), compact.rdd.getNumPartitions()
    while left > 1:  # a tree: no task gets more than FAN sums of a block of terms
        left = -(-left // FAN)
        parts = parts.withColumn("part", (F.col("part") / FAN).cast("int")).groupBy(block, "part").applyInPandas(summed, "term long, part int, row binary")
    out = np.zeros((size, RANK))
    for term, row in parts.select("term", "row").toLocalIterator():  # a row for each benchmark term
        out[term] = np.frombuffer(row, "<i8")
    return out


def latent_space(gram: np.ndarray, s: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Terms by RANK: the leading right singular vectors of the TF-IDF passages, from T'TS."""
    y = gram * idf[:, None]
    core = s.T.astype(np.float64) @ gram
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > max(value.max(), 0) * 1e-9
    if not good.any():
        return np.zeros((len(idf), 1), np.float32)
    u, _, _ = np.linalg.svd(y @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    return u.astype(np.float32)


def common_subsequence(masks: dict[bytes, int], ones: int, region: list[bytes]) -> int:
    """Length of the longest common subsequence of an item (its words' bit masks) and a region."""
    v, get = ones, masks.get
    for w in region:
        if m := get(w):
            u = v & m
            v = ((v + u) | (v - u)) & ones
    return ones.bit_count() - v.bit_count()


def masks_of(item: list[bytes]) -> tuple[dict[bytes, int], int]:
    masks: dict[bytes, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks, (1 << len(item)) - 1


class Matcher:
    """An item ready to be compared with regions of texts."""

    def __init__(self, item: Item, subsequence: float) -> None:
        self.item, self.whole, self.answer = item, masks_of(item.words), masks_of(item.answer)
        self.names, self.least = {*item.words}, subsequence * len(item.words)
        self.often = {w: n for w, n in Counter(item.words).items() if n > 1}

    def possible(self, held: set[bytes]) -> bool:
        """Whether a text or region of these words may hold enough of the item: a bound for the subsequence."""
        shared = self.names & held
        return len(shared) + sum(n - 1 for w, n in self.often.items() if w in held) >= self.least

    def shares(self, region: list[bytes]) -> tuple[float, float]:
        """Shares of the item's words and of its answer's that a region holds in order; (0, 0) where too few are there at all."""
        if not self.possible({*region}):
            return 0.0, 0.0
        share = common_subsequence(*self.whole, region)
        if share < self.least:
            return 0.0, 0.0
        return share / len(self.item.words), common_subsequence(*self.answer, region) / max(1, len(self.item.answer))


@dataclass
class Model:
    """What workers need to find leaks: bounded by the benchmark."""

    items: list[Item]
    index: dict[bytes, int]
    terms: np.ndarray
    vectors: np.ndarray
    cosine: float
    subsequence: float
    answer: float

    def matcher(self, k: int) -> Matcher:
        if k not in self.matchers:
            self.matchers[k] = Matcher(self.items[k], self.subsequence)
        return self.matchers[k]

    def __post_init__(self) -> None:
        """The places of the terms of each item, the terms it needs, and the items of each term (``holders`` from ``ends``)."""
        self.matchers: dict[int, Matcher] = {}
        self.places: list[dict[int, list[int]]] = []
        for x in self.items:
            at: dict[int, list[int]] = {}
            for i, w in enumerate(x.words):
                if (t := self.index.get(w)) is not None:
                    at.setdefault(t, []).append(i)
            self.places.append(at)
        self.terms_of = [{*at} for at in self.places]
        self.need = np.array([max(1, min(EVIDENCE, len(at))) for at in self.places], np.int64)
        terms = np.array([t for at in self.places for t in at], np.int64)
        self.holders = np.repeat(np.arange(len(self.items)), np.array([len(at) for at in self.places], np.int64))[np.argsort(terms, kind="stable")]
        self.ends = np.append(0, np.cumsum(np.bincount(terms, minlength=len(self.index))))


def fit(docs: DataFrame, items: list[Item], max_df: float = 0.0005, cosine: float = 0.3, subsequence: float = 0.65, answer: float = 0.5) -> Model:
    vocabulary = sorted({w for x in items for w in x.words})
    counts, total = passage_counts(docs, {w: i for i, w in enumerate(vocabulary)})
    of = dict(zip(vocabulary, counts.tolist(), strict=True))
    kept = {w for w, n in of.items() if n <= max_df * total + 1}
    for x in items:
        kept.update(sorted(set(x.words), key=lambda w: (of[w], w))[: max(KEEP, len(x.words) // 8)])
    index = {w: i for i, w in enumerate(sorted(kept))}
    n = np.array([of[w] for w in sorted(kept)], np.float64)
    idf = np.log((total + 1) / (n + 1)) + 1
    s = signs(len(index))
    gram = distributed_gram(docs, index)
    own = [np.array([index[w] for w in x.words if w in index], np.int64) for x in items]
    extra = np.zeros_like(gram)
    for ids in own:
        gram_product(ids, np.ones(len(ids), np.int64), s, extra)
    space = latent_space(gram + BENCHMARK_WEIGHT * extra, s, idf)
    terms = (space * idf[:, None]).astype(np.float32)
    vectors = np.array([terms[ids].sum(axis=0) for ids in own], np.float32).reshape(len(items), -1)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return Model(items, index, terms, vectors, cosine, subsequence, answer)


def leaks(model: Model, texts: list[list[bytes]]) -> list[list[tuple]]:
    """For each text its matches: (item_id, cosine, share of the item's words, of its answer's, first word, last word)."""
    out: list[list[tuple]] = [[] for _ in texts]
    sizes = np.array([len(w) for w in texts], np.int64)
    ids = np.fromiter(map(model.index.get, chain.from_iterable(texts), repeat(-1)), np.int32, sizes.sum())
    known = np.flatnonzero(ids >= 0)
    if not len(known) or not model.items:
        return out
    block = block_numbers(sizes)[known]
    first = np.cumsum(-(-sizes // BLOCK) + 1) - (-(-sizes // BLOCK) + 1)
    best: dict[tuple[int, int], tuple] = {}
    bounds, need = parts_of(block), model.need.tolist()
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        starts, sums = passage_sums(model.terms[ids[known[lo:hi]]], block[lo:hi])
        _, held = passage_sums(np.ones((hi - lo, 1), np.float32), block[lo:hi])
        enough = held[:, 0] >= EVIDENCE
        starts, sums = starts[enough], sums[enough]
        terms = ids[known[lo:hi]].tolist()
        begins, ends = np.searchsorted(block[lo:hi], starts).tolist(), np.searchsorted(block[lo:hi], starts + 1, side="right").tolist()
        text_of = (np.searchsorted(first, starts + 1, side="right") - 1).tolist()
        names: dict[int, set[int]] = {}  # the terms of a passage that is near some item
        sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        for at in range(0, len(model.items), 4096):
            near = sums @ model.vectors[at : at + 4096].T
            for p, k in zip(*(x.tolist() for x in np.nonzero(near >= model.cosine)), strict=True):
                k_all, d = k + at, text_of[p]
                if (found := best.get((d, k_all))) and found[2] >= 1:
                    continue
                if p not in names:
                    names[p] = {*terms[begins[p] : ends[p]]}
                if len(names[p]) < need[k_all] or len(names[p] & model.terms_of[k_all]) < need[k_all]:
                    continue
                begin, length = (int(starts[p]) - int(first[d])) * BLOCK, len(model.items[k_all].words)
                a, b = max(0, begin - length // 2 - BLOCK), min(len(texts[d]), begin + 2 * BLOCK + length // 2 + BLOCK)
                share, answer = model.matcher(k_all).shares(texts[d][a:b])
                if share and answer >= model.answer and (not found or share > found[2]):
                    best[d, k_all] = (model.items[k_all].item_id, float(near[p, k]), share, answer, a, b)
    for key, match in long_matches(model, texts, ids, known, np.repeat(np.arange(len(texts)), sizes)[known], best):
        best[key] = match
    for (d, _), match in sorted(best.items()):
        out[d].append(match)
    return out


def held_items(model: Model, terms: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int]]:
    """Text and item wherever a text holds as many different terms of an item as it needs, by way of the items of each term."""
    pairs = np.unique(text * len(model.index) + terms)
    d, t = pairs // len(model.index), pairs % len(model.index)
    sizes = model.ends[t + 1] - model.ends[t]
    cuts = np.flatnonzero(np.diff(d)) + 1  # between texts
    total = np.append(0, np.cumsum(sizes))
    lo = 0
    while lo < len(d):
        fit_in = cuts[(cuts > lo) & (total[cuts] - total[lo] <= COUNTED)]
        after = cuts[cuts > lo]
        hi = len(d) if total[-1] - total[lo] <= COUNTED or not len(after) else int(fit_in[-1] if len(fit_in) else after[0])
        n = sizes[lo:hi]
        k = model.holders[np.repeat(model.ends[t[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        keys, count = np.unique(np.repeat(d[lo:hi], n) * len(model.items) + k, return_counts=True)
        for key in keys[count >= model.need[keys % len(model.items)]].tolist():
            yield divmod(key, len(model.items))
        lo = hi


def long_matches(model: Model, texts: list[list[bytes]], ids: np.ndarray, known: np.ndarray, text: np.ndarray, found: dict) -> Iterator[tuple[tuple[int, int], tuple]]:
    """Matches in regions of the items' own lengths, for texts and items that have none in found."""
    begin = np.cumsum([0, *map(len, texts)])
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    names, of, terms_of = set(), -1, -1
    for d, k in held_items(model, ids[known].astype(np.int64), text):
        if d != of:
            names, of = {*texts[d]}, d
        matcher = model.matcher(k)
        if (d, k) in found or not matcher.possible(names):
            continue
        if d != terms_of:
            terms = ids[known[bounds[d] : bounds[d + 1]]]
            at = known[bounds[d] : bounds[d + 1]] - begin[d]
            listed, terms_of = list(zip(at.tolist(), terms.tolist(), strict=True)), d
        own, length, need = model.places[k], len(model.items[k].words), int(model.need[k])
        held = [x for x in listed if x[1] in own]
        places = [p for p, _ in held]
        slack, best = length // 4 + BLOCK, None
        for start in sorted({(p - o) // BLOCK * BLOCK for p, t in held for o in own[t]}):
            a, b = max(0, start - slack), min(len(texts[d]), start + BLOCK + length + slack)
            lo, hi = bisect.bisect_left(places, a), bisect.bisect_left(places, b)
            if hi - lo < need or len({t for _, t in held[lo:hi]}) < need:
                continue
            lo, hi = np.searchsorted(at, [start, start + BLOCK + length])
            vector = model.terms[terms[lo:hi]].sum(axis=0)
            near = float(vector @ model.vectors[k]) / max(float(np.linalg.norm(vector)), 1e-9)
            if near < model.cosine:
                continue
            share, answer = matcher.shares(texts[d][a:b])
            if share and answer >= model.answer and (not best or share > best[2]):
                best = (model.items[k].item_id, near, share, answer, a, b)
        if best:
            yield (d, k), best


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, cosine, subsequence, answer, first_word, last_word."""
    kind = "doc_id long, item_id long, cosine double, subsequence double, answer double, first_word long, last_word long"
    out = docs.sparkSession.createDataFrame([], kind)
    for n, items in enumerate(read_items(benchmark)):
        model = fit(docs, items, **options)  # goes to the workers with the function, by value

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            for batch, texts in _texts(batches, 1):
                rows = [(i, *m) for i, found in zip(batch.column(0).to_pylist(), leaks(model, texts), strict=True) for m in found]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
                names = ["doc_id", "item_id", "cosine", "subsequence", "answer", "first_word", "last_word"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

        found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, kind)
        out = found if n == 0 else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no item of the benchmark."""
    at, out = docs.columns.index("text"), docs
    for items in read_items(benchmark):
        model = fit(docs.select("text"), items, **options)

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 300):
                    batch = whole.slice(start, 300)
                    texts = [words((t.as_py() or "").encode()) for t in batch.column(at)]
                    yield batch.filter(pa.array([not m for m in leaks(model, texts)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
