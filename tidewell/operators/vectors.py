"""Vector search: exact cosine top-k, nearest neighbours of a query set, exact or by inverted lists, fusion and linking."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(vectors: DataFrame, query: list[float], k: int, digits: int = 6) -> DataFrame:
    """vec_id and similarity of the k nearest to one query: one scan, and k rows from each partition."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("vec_id", F.round(cosine(F.col("embedding"), q), digits).alias("similarity"))
    return scored.orderBy(F.col("similarity").desc(), "vec_id").limit(k)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """query_id, vec_id, similarity and rank of the k nearest of each row of a stated query set, not itself.

    The query set goes to every worker in blocks of about MAX_QUERIES; a worker compares a block with its rows and
    passes on k candidates a query; a window over these picks the k best.
    """
    blocks = -(-queries.count() // MAX_QUERIES)
    if blocks > 1:
        number = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
        return reduce(DataFrame.unionByName, [_neighbours(vectors, queries.filter(number == n), k, digits) for n in range(blocks)])
    return _neighbours(vectors, queries, k, digits)


def _neighbours(vectors: DataFrame, queries: DataFrame, k: int, digits: int) -> DataFrame:
    rows = queries.select("vec_id", "embedding").toPandas()
    ids = rows["vec_id"].to_numpy(np.int64)
    q = np.array(rows["embedding"].tolist(), np.float64).reshape(len(rows), -1)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    def run(batches):
        for batch in batches:
            v = np.array(batch["embedding"].tolist(), np.float64).reshape(len(batch), -1)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            own = batch["vec_id"].to_numpy(np.int64)
            s = np.round(q @ v.T, digits)
            s[ids[:, None] == own[None, :]] = -2
            out = []
            for i in range(len(ids)):
                best = np.lexsort((own, -s[i]))[:k]
                out.append(pd.DataFrame({"query_id": ids[i], "vec_id": own[best], "similarity": s[i, best]}))
            if out:
                yield pd.concat(out).query("similarity > -2")

    found = vectors.select("vec_id", "embedding").mapInPandas(run, "query_id long, vec_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


MAX_QUERIES = 10_000


def reciprocal_rank_fusion(*ranked: DataFrame, constant: int = 60, digits: int = 9) -> DataFrame:
    """ranked(id, rank) lists into id and score: the sum of 1 / (constant + rank)."""
    parts = [r.select("id", (1.0 / (constant + F.col("rank"))).alias("part")) for r in ranked]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("id").agg(F.round(F.sum("part"), digits).alias("score"))


def duplicate_links(articles: DataFrame) -> DataFrame:
    """Links from each article to the first with the same normalised content (n - 1 for n copies)."""
    hashed = articles.select("id", content_hash(F.col("content")).alias("h"))
    first = hashed.groupBy("h").agg(F.min("id").alias("target_article_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return hashed.join(first, "h").filter("id <> target_article_id").select(F.col("id").alias("source_article_id"), "target_article_id", F.lit("similar").alias("relationship"), F.lit(1.0).alias("strength"))


def similar_links(found: DataFrame, at_least: float) -> DataFrame:
    """neighbours() rows at or above a similarity as link rows."""
    return found.filter(F.col("similarity") >= at_least).select(F.col("query_id").alias("source_article_id"), F.col("vec_id").alias("target_article_id"), F.lit("related").alias("relationship"), F.col("similarity").alias("strength"))


def keyword_tags(postings: DataFrame, stats: DataFrame, per_article: int = 5, column: str = "content", shortest: int = 4) -> DataFrame:
    """Offline tagger: the terms of highest tf-idf of each article as (article_id, pos, name, confidence)."""
    own = postings.filter((F.col("field") == column) & (F.length("term") >= shortest))
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    n = F.broadcast(stats.filter(F.col("field") == column).select("n_docs"))
    scored = own.join(df, "term").join(n).select("doc_id", "term", (F.col("tf") * F.log(1 + F.col("n_docs") / F.col("df"))).alias("w"))
    order = Window.partitionBy("doc_id").orderBy(F.round("w", 9).desc(), "term")
    best = scored.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= per_article)
    top = F.max("w").over(Window.partitionBy("doc_id"))
    return best.select(F.col("doc_id").alias("article_id"), F.col("pos"), F.col("term").alias("name"), F.round(F.col("w") / top, 6).alias("confidence"))


# ------------------------------------------------------------------ approximate search


#: Rows of the sample that the lists' centres are fitted on, and rounds of that.
IVF_SAMPLE, IVF_STEPS = 20_000, 12


@dataclass
class InvertedLists:
    """Unit vectors by the centre that they are nearest to: ``rows`` has vec_id, embedding and list; centres are few."""

    centres: np.ndarray
    rows: DataFrame

    def write(self, path: str) -> None:
        """Rows lie by list, so that a search reads the lists that it probes."""
        self.rows.repartition("list").write.partitionBy("list").parquet(f"{path}/rows")
        frame = pd.DataFrame({"list": range(len(self.centres)), "centre": [c.tolist() for c in self.centres]})
        self.rows.sparkSession.createDataFrame(frame, "list int, centre array<double>").write.parquet(f"{path}/centres")

    @classmethod
    def read(cls, spark, path: str) -> InvertedLists:
        centres = spark.read.parquet(f"{path}/centres").orderBy("list").toPandas()
        return cls(np.array(centres["centre"].tolist(), np.float64), spark.read.parquet(f"{path}/rows"))


def _units(column) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    v = np.array(column.tolist(), np.float64).reshape(len(column), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def build_lists(vectors: DataFrame, lists: int | None = None, sample: int = IVF_SAMPLE) -> InvertedLists:
    """Every vector in the list of its nearest centre; centres are fitted by k-means on the ``sample`` rows of smallest hash."""
    chosen = _units(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()["embedding"])
    k = min(lists or max(1, int(len(chosen) ** 0.5)), max(1, len(chosen)))
    centres = chosen[np.linspace(0, len(chosen) - 1, k).astype(np.int64)] if len(chosen) else np.zeros((1, 1))
    for _ in range(IVF_STEPS if len(chosen) else 0):
        own = np.argmax(chosen @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, chosen)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)

    def run(frames):
        for frame in frames:
            near = np.argmax(_units(frame["embedding"]) @ centres.T, axis=1) if len(frame) else np.empty(0, int)
            yield frame.assign(list=near.astype(np.int32))

    return InvertedLists(centres, vectors.select("vec_id", "embedding").mapInPandas(run, "vec_id long, embedding array<float>, list int"))


def near_neighbours(index: InvertedLists, queries: DataFrame, k: int, probes: int, digits: int = 6) -> DataFrame:
    """query_id, vec_id, similarity and rank: the k nearest of each query in the ``probes`` lists nearest to it, not itself.

    Queries go to the workers in blocks; a list is compared with the queries that probe it only.
    """
    blocks = max(1, -(-queries.count() // MAX_QUERIES))
    out = []
    for n in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).select("vec_id", "embedding").toPandas()
        ids = block["vec_id"].to_numpy(np.int64)
        q = _units(block["embedding"]) if len(block) else np.zeros((0, index.centres.shape[1]))
        probed = np.argsort(-(q @ index.centres.T), axis=1, kind="stable")[:, :probes]
        asked = {int(c): np.flatnonzero((probed == c).any(axis=1)) for c in np.unique(probed)}

        def run(frames, ids=ids, q=q, asked=asked):
            for frame in frames:
                for c, part in frame.groupby("list"):
                    own, rows = part["vec_id"].to_numpy(np.int64), asked[int(c)]
                    s = np.round(q[rows] @ _units(part["embedding"]).T, digits)
                    s[ids[rows][:, None] == own[None, :]] = -2
                    for i, r in enumerate(rows):
                        best = np.lexsort((own, -s[i]))[:k]
                        yield pd.DataFrame({"query_id": ids[r], "vec_id": own[best], "similarity": s[i, best]}).query("similarity > -2")

        out.append(index.rows.filter(F.col("list").isin(list(asked))).mapInPandas(run, "query_id long, vec_id long, similarity double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id"))
    return reduce(DataFrame.unionByName, out).withColumn("rank", rank).filter(F.col("rank") <= k)
