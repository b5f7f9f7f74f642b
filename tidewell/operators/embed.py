"""Embedding of pending articles with a pluggable embedder, batch by batch in the workers."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EmbeddingError
from ..functions.text import MAX_INPUT_BYTES, prepare_article_text, prepare_input
from .store import mark, pending_embedding

Embedder = Callable[[list[str]], list[list[float]]]
BATCH, RETRIES, FIRST_PAUSE = 10, 3, 0.5


def hashing_embedder(width: int) -> Embedder:
    """A deterministic offline embedder: words hashed into ``width`` signed buckets, unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * width
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % width] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return embed


def http_embedder(base_url: str, model: str, timeout: float = 120.0, pause: Callable[[float], None] = time.sleep) -> Embedder:
    """POSTs to an embeddings endpoint; connection errors, 429 and 5xx are tried again with growing pauses."""

    def embed(texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": model, "input": texts if len(texts) > 1 else texts[0]}).encode()
        request = urllib.request.Request(f"{base_url.rstrip('/')}/v1/embeddings", body, {"Content-Type": "application/json"})
        for attempt in range(RETRIES + 1):
            try:
                with urllib.request.urlopen(request, timeout=timeout) as reply:
                    return [x["embedding"] for x in json.load(reply)["data"]]
            except urllib.error.HTTPError as e:
                if e.code < 500 and e.code != 429 or attempt == RETRIES:
                    raise EmbeddingError(f"HTTP {e.code}") from e
            except (OSError, ValueError, KeyError) as e:
                if isinstance(e, (ValueError, KeyError)) or attempt == RETRIES:
                    raise EmbeddingError(str(e)) from e
            pause(FIRST_PAUSE * 2**attempt)
        raise EmbeddingError("no reply")

    return embed


def _checked(vectors: list[list[float]], width: int) -> list[list[float]]:
    for v in vectors:
        if len(v) != width:
            raise EmbeddingError(f"{len(v)} components instead of {width}")
    return vectors


def embed_text(embedder: Embedder, text: str, width: int) -> list[float]:
    found = embedder([text.encode()[:MAX_INPUT_BYTES].decode(errors="ignore")])
    if not found:
        raise EmbeddingError("an empty reply")
    return _checked(found[:1], width)[0]


def embed_batch(embedder: Embedder, texts: list[str], width: int) -> list[list[float]]:
    """One request; a reply of another length, or an error, is followed by one request for each text."""
    if not texts:
        return []
    if len(texts) > 1:
        try:
            found = embedder([t.encode()[:MAX_INPUT_BYTES].decode(errors="ignore") for t in texts])
        except EmbeddingError:
            found = []
        if len(found) == len(texts):
            return _checked(found, width)
    return [embed_text(embedder, t, width) for t in texts]


def embed_pending(articles: DataFrame, embedder: Embedder, width: int, limit: int = 1000, batch: int = BATCH) -> DataFrame:
    """article_id, embedding and error (one of the two is null) of the pending articles."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                texts, rows = part["text"].tolist(), []
                try:
                    rows = [(v, None) for v in embed_batch(embedder, texts, width)]
                except EmbeddingError:
                    for t in texts:
                        try:
                            rows.append((embed_text(embedder, t, width), None))
                        except EmbeddingError as e:
                            rows.append((None, str(e)))
                yield pd.DataFrame({"article_id": part["id"].to_numpy(), "embedding": [r[0] for r in rows], "error": [r[1] for r in rows]})

    text = prepare_input(prepare_article_text(F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    return pending_embedding(articles, limit).select("id", text.alias("text")).mapInPandas(run, "article_id long, embedding array<float>, error string")


def store_embeddings(articles: DataFrame, embedded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Articles with their flags set, the vectors, and a one-row summary; write the vectors before the articles."""
    good = embedded.filter("error IS NULL").select("article_id", "embedding")
    flagged = mark(articles, good.select(F.col("article_id").alias("id")), "embedding_generated", strict=False)
    return flagged, good, embedded.agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"))
