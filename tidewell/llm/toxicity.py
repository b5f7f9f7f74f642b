"""Counterfactual-regularised toxicity classifier.

A logistic regression over a text's words and word beginnings (how often each occurs, on a log scale) is fitted in numpy on a bounded sample of labelled
rows: the ``max_rows`` training rows of smallest hash. For every sample row that names a group, ``copies`` copies
are made in which each identity term is swapped for another of its set, and the squared change of the score between
the row and each copy is added to the loss, so a group's name can't carry weight of its own.

Features are hashed into 2 ** BITS weights, so no feature is left out and the model can go to every worker. Each is
scaled by how far apart the shares of toxic and other sample rows that hold it are (a z-score), so that the many
rare ones of long texts count little. Scoring is one pass over all whole texts without a shuffle. Inputs of a score are the words of the text and nothing else.

Defined results: a null or empty text has the score of no words; a null doc_id counts as held out; labels
that are null are ignored and of repeated ones the largest counts; without training rows of both labels
every score is the share of label 1 (0 without rows); further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Terms that name a group, in sets whose members may be swapped (English, French, German, Spanish).
IDENTITY = (
    "men women boys girls males females",
    "man woman boy girl male female",
    "he she they",
    "christians muslims jews hindus buddhists atheists catholics protestants sikhs",
    "christian muslim jewish hindu buddhist atheist catholic protestant sikh",
    "black white asian latino hispanic arab african european american mexican chinese indian",
    "blacks whites asians latinos hispanics arabs africans europeans americans mexicans chinese indians",
    "gay straight lesbian bisexual transgender queer heterosexual homosexual",
    "immigrants refugees foreigners migrants natives citizens",
    "immigrant refugee foreigner migrant native citizen",
    "old young elderly disabled deaf blind",
    "hommes femmes garçons filles",
    "chrétiens musulmans juifs athées",
    "männer frauen jungen mädchen",
    "christen muslime juden atheisten",
    "hombres mujeres chicos chicas",
    "cristianos musulmanes judíos ateos",
)
#: Shortest and longest beginning of a word that is a feature.
BEGIN = (4, 8)
#: Weights are kept for so many bits of a feature's hash.
BITS = 20
#: A z-score that leaves a feature as it is, and the largest that counts.
USUAL_Z, MOST_Z = 5.0, 10.0
#: ASCII characters that separate words.
_MARKS = b".,;:!?\"()[]{}<>*|/\\#%&=+~`^_$@-"
_SEPARATE = bytes.maketrans(_MARKS, b" " * len(_MARKS))
#: Distinct words whose features a worker remembers.
REMEMBERED = 200_000


def swaps() -> dict[str, list[str]]:
    """The terms that may stand in for each term, in the order of their set from the next one on."""
    sets = [s.split() for s in IDENTITY]
    return {w: s[i + 1 :] + s[:i] for s in sets for i, w in enumerate(s)}


def words_of(text: str) -> list[str]:
    """The words of a text: A-Z and other letters lower-cased, without the separating marks."""
    return text.lower().encode().translate(_SEPARATE).decode(errors="replace").split()


class WordFeatures(dict):
    """Numbers of a word's features: of the word and of its beginnings, which ``^`` marks."""

    def __missing__(self, w: str) -> list[int]:
        if len(self) >= REMEMBERED:
            self.clear()
        names = [w, *["^" + w[:k] for k in range(BEGIN[0], min(BEGIN[1], len(w)) + 1)]]
        self[w] = value = [xxhash.xxh3_64_intdigest(x) & ((1 << BITS) - 1) for x in names]
        return value


@dataclass
class Rows:
    """Sparse rows: those of row i are features[ends[i] : ends[i + 1]], with their values."""

    features: np.ndarray
    values: np.ndarray
    ends: np.ndarray

    def part(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.ends)[rows]
        ends = np.append(0, np.cumsum(sizes))
        at = np.arange(ends[-1]) + np.repeat(self.ends[:-1][rows] - ends[:-1], sizes)
        return Rows(self.features[at], self.values[at], ends)

    def times(self, w: np.ndarray) -> np.ndarray:
        """The products of the rows with w."""
        return np.bincount(np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends)), weights=w[self.features] * self.values, minlength=len(self.ends) - 1)

    def add(self, into: np.ndarray, error: np.ndarray) -> None:
        """Adds the rows, each times its error, to into."""
        into += np.bincount(self.features, weights=self.values * np.repeat(error, np.diff(self.ends)), minlength=len(into))


def rows_of(lists: list[list[str]], known: WordFeatures) -> Rows:
    """log2(1 + count) of the features of some lists of words."""
    parts, times, sizes = [], [], []
    for words in lists:
        counts = Counter(words)
        found = [known[w] for w in counts]
        parts += [i for x in found for i in x]
        times += [n for x, n in zip(found, counts.values(), strict=True) for _ in x]
        sizes.append(sum(map(len, found)))
    row = np.repeat(np.arange(len(lists)), sizes)
    keys, at = np.unique((row << BITS) + np.array(parts, np.int64), return_inverse=True)
    counts = np.bincount(at, weights=np.array(times, np.float64), minlength=len(keys))
    return Rows((keys & ((1 << BITS) - 1)).astype(np.int32), np.log2(1 + counts).astype(np.float32), np.searchsorted(keys, np.arange(len(lists) + 1) << BITS))


def changes_of(words: list[str], others: list[list[str]], known: WordFeatures) -> Rows:
    """The features of other lists of words less those of the words: few, where few words differ."""
    every = rows_of([words, *others], known)
    own = dict(zip(every.features[: every.ends[1]].tolist(), every.values[: every.ends[1]].tolist(), strict=True))
    features, values, ends = [], [], [0]
    for a, b in zip(every.ends[1:-1], every.ends[2:], strict=True):
        copy = dict(zip(every.features[a:b].tolist(), every.values[a:b].tolist(), strict=True))
        moved = sorted(i for i in own.keys() | copy.keys() if own.get(i) != copy.get(i))
        features += moved
        values += [copy.get(i, 0.0) - own.get(i, 0.0) for i in moved]
        ends.append(len(features))
    return Rows(np.array(features, np.int32), np.array(values, np.float32), np.array(ends, np.int64))


def counterfactuals(words: list[str], other: dict[str, list[str]], copies: int, salt: int) -> list[list[str]]:
    """Copies of a text that names groups: in the k-th, each term is swapped for the one that is salt + k further in its set."""
    if not any(w in other for w in words):
        return []
    return [[other[w][(salt + k) % len(other[w])] if w in other else w for w in words] for k in range(copies)]


def remainder(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, mod 5; a null doc_id has 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str], known: WordFeatures) -> np.ndarray:
        return sigmoid(rows_of([words_of(t) for t in texts], known).times(self.weights) + self.bias)


@dataclass
class Sample:
    """Rows of a bounded sample with their labels, what changes in their copies with swapped terms, and the row of each copy."""

    rows: Rows
    labels: np.ndarray
    changes: Rows
    origin: np.ndarray


def joined(parts: list[Rows]) -> Rows:
    sizes = np.concatenate([np.empty(0, np.int64), *[np.diff(r.ends) for r in parts]])
    flat = lambda name, kind: np.concatenate([np.empty(0, kind), *[getattr(r, name) for r in parts]])
    return Rows(flat("features", np.int32), flat("values", np.float32), np.append(0, np.cumsum(sizes)).astype(np.int64))


def sample_of(texts: list[str], labels: list[int], copies: int, salt: int = 0) -> Sample:
    known, other = WordFeatures(), swaps()
    lists = [words_of(t) for t in texts]
    made = [counterfactuals(w, other, copies, salt + i) for i, w in enumerate(lists)]
    changes = joined([changes_of(w, c, known) for w, c in zip(lists, made, strict=True) if c])
    return Sample(rows_of(lists, known), np.array(labels, np.float64), changes, np.repeat(np.arange(len(made)), [len(c) for c in made]))


def loss_gradient(w: np.ndarray, rows: Rows, labels: np.ndarray, weight: np.ndarray, changes: Rows, origin: np.ndarray, strength: float) -> np.ndarray:
    """Gradient of the mean weighted log loss + strength * mean over rows of the squared changes of the score; the last of w is the bias.

    A copy is its row and the changes, so its part of the gradient is put on the row's features and on the changes.
    """
    n, out = max(1, len(labels)), np.zeros_like(w)
    z = rows.times(w) + w[-1]
    score = sigmoid(z)
    error = weight * (score - labels) / n
    if len(origin) and strength:
        swapped = sigmoid(z[origin] + changes.times(w))
        change = 2 * strength * (score[origin] - swapped) / n
        back = change * swapped * (1 - swapped)
        error = error + np.bincount(origin, weights=change * score[origin] * (1 - score[origin]) - back, minlength=len(labels))
        changes.add(out, -back)
    rows.add(out, error)
    out[-1] += error.sum()
    return out


def scales(rows: Rows, labels: np.ndarray, size: int) -> np.ndarray:
    """For each feature the z-score of the difference between the shares of rows of label 1 and of label 0 that hold it, over USUAL_Z."""
    ones, n = labels.sum(), len(labels)
    held = np.bincount(rows.features, minlength=size)
    toxic = np.bincount(rows.features, weights=np.repeat(labels, np.diff(rows.ends)), minlength=size)
    share = held / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / ones + 1 / (n - ones)))
    z = np.abs(toxic / ones - (held - toxic) / (n - ones)) / spread
    return np.where(held > 0, np.minimum(z, MOST_Z), 0) / USUAL_Z


def fit(sample: Sample, balance: float = 0.5, ridge: float = 0.0005, strength: float = 5.0, epochs: int = 24, batch: int = 512, rate: float = 0.05) -> Model:
    """Adam on mean log loss + ridge * |w|^2 + strength * mean squared change of the score under swaps."""
    y, n = sample.labels, len(sample.labels)
    share = float(y.mean()) if n else 0.0
    if not 0 < share < 1:
        return Model(np.zeros(1 << BITS, np.float32), 40.0 if share == 1 else -40.0)
    # Only the features of the sample move; they are numbered anew.
    number = np.zeros(1 << BITS, np.int32)
    for x in (sample.rows, sample.changes):
        number[x.features] = 1
    used = np.flatnonzero(number)
    number[used] = np.arange(len(used))
    scale = scales(Rows(number[sample.rows.features], sample.rows.values, sample.rows.ends), y, len(used)).astype(np.float32)
    rows, changes = (Rows(at := number[x.features], x.values * scale[at], x.ends) for x in (sample.rows, sample.changes))
    weight = np.where(y == 1, ((1 - share) / share) ** balance, 1.0)
    weight /= weight.mean()
    w = np.zeros(len(used) + 1)
    w[-1] = np.log(share / (1 - share))
    m, v, t, steps = np.zeros_like(w), np.zeros_like(w), 0, epochs * -(-n // batch)
    for epoch in range(epochs):
        order = np.random.default_rng(epoch).permutation(n)
        for at in range(0, n, batch):
            part = np.sort(order[at : at + batch])
            # Copies go with their rows.
            held = np.flatnonzero(np.isin(sample.origin, part))
            grad = loss_gradient(w, rows.part(part), y[part], weight[part], changes.part(held), np.searchsorted(part, sample.origin[held]), strength)
            grad[:-1] += 2 * ridge * w[:-1]
            t += 1
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    out = np.zeros(1 << BITS, np.float32)
    out[used] = w[:-1] * scale
    return Model(out, float(w[-1]))


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int, copies: int) -> Sample:
    """At most max_rows labelled rows, those of smallest hash, none of remainder 0; their texts go to the driver as features."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0))
    chosen = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    picked = docs.sparkSession.createDataFrame(chosen.toPandas(), "doc_id long, toxic int")  # bounded by max_rows, so it may be broadcast
    texts = materialize(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id"), "labelled")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, label in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                found = sample_of([text.as_py()], [label], copies, doc_id)
                parts = [x.tobytes() for r in (found.rows, found.changes) for x in (r.features, r.values, r.ends)]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id]), pa.array([label], pa.int32()), *[pa.array([p], pa.binary()) for p in parts]], names=["doc_id", "toxic", *"abcdef"])

    kind = "doc_id long, toxic int, a binary, b binary, c binary, d binary, e binary, f binary"
    found = texts.mapInArrow(features, kind).toPandas().sort_values(["doc_id", "a"], kind="stable")
    kinds = (np.int32, np.float32, np.int64)
    parts = [joined([Rows(*(np.frombuffer(x, kind) for x, kind in zip(r, kinds, strict=True))) for r in zip(*(found[c] for c in names), strict=True)]) for names in ("abc", "def")]
    origin = np.repeat(np.arange(len(found)), [len(x) // 8 - 1 for x in found["f"]])
    return Sample(parts[0], found["toxic"].to_numpy(np.float64), parts[1], origin)


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, copies: int = 3, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    model = fit(training_sample(docs, labels, max_rows, copies), **options)  # goes to the workers with the function, by value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFeatures()
        for whole in batches:
            for batch in (whole.slice(at, 100) for at in range(0, whole.num_rows, 100)):
                scores = model.scores([t.as_py() or "" for t in batch.column(1)], known)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return score_toxicity(read("documents"), read("labels"))
