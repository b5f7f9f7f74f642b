"""Consistent-hash ring with virtual nodes and bounded loads.

A key's hash names one of ``CELLS`` equal cells of the ring, and each shard owns the cells that its
virtual nodes come first after, clockwise. Counts per cell (a bounded number of them) go to the driver,
which deals the cells in a fixed pseudo-random order: where a shard is full, the rest of a cell goes on
clockwise to the next virtual node of a shard with room. Capacities are exact, the total divided by the
shards, or larger by ``slack``, so the law is ``rows``: with no slack, counts differ by one at most.
Rows then learn their shard from their rank inside the cell, which also gives slots without gaps.

Texts are read only for size and checksum; what is shuffled is a few numbers a row.

Defined results: a null doc_id hashes to a fixed cell; rows that repeat a doc_id are dealt one by one;
a null text has size 1 and checksum 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS = 16
CELLS = 1 << CELL_BITS


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, clockwise; a shard keeps its nodes when others come."""
    at = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % CELLS
    return sorted((at(s, v), s) for s in range(shards) for v in range(nodes))


def capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack:
        return [int((1 + slack) * total / shards) + 1] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def deal(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, rank after the last, shard, first slot) for the rows of each cell."""
    room, used = list(room), [0] * len(room)
    places = [c for c, _ in nodes]
    after = list(range(1, len(nodes) + 1))
    after[-1] = 0
    out = []

    def free(v: int) -> int:
        """The first node from v on, clockwise, whose shard has room; full ones are skipped for good."""
        path = []
        while not room[nodes[v][1]]:
            path.append(v)
            v = after[v]
        for p in path:
            after[p] = v
        return v

    order = sorted(counts)
    random.Random(0).shuffle(order)
    for cell in order:
        rank, v = 0, bisect.bisect_left(places, cell) % len(nodes)
        while rank < counts[cell]:
            shard = nodes[v := free(v)][1]
            n = min(counts[cell] - rank, room[shard])
            out.append((cell, rank, rank + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
            rank += n
    return out


def cell_of(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - CELL_BITS).cast("int")


def assign_shards(docs: DataFrame, shards: int = 16, nodes: int = 128, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for each row of docs."""
    spark = docs.sparkSession
    counted = docs.select(cell_of(F.col("doc_id")).alias("cell")).groupBy("cell").count()
    counts = {r["cell"]: r["count"] for r in counted.collect()}  # at most CELLS rows
    dealt = deal(counts, ring(shards, nodes), capacities(sum(counts.values()), shards, slack)) if counts else []
    frame = pd.DataFrame(dealt, columns=["cell", "lo", "hi", "shard", "first"])
    parts = F.broadcast(spark.createDataFrame(frame, "cell int, lo long, hi long, shard int, first long"))  # at most CELLS + shards * nodes rows
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), cell_of(F.col("doc_id")).alias("cell"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("doc_id"), "doc_id", "size", "text_crc32")) - 1)
    placed = ranked.join(parts, "cell").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, **options) -> None:
    """Writes the rows of docs as Parquet folders shard=0, 1, ...; doc_id must be unique."""
    placed = assign_shards(docs, shards, **options).select("doc_id", "shard", "slot")
    docs.join(placed, "doc_id").repartition("shard", (F.col("slot") / 100_000).cast("int")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    placed = assign_shards(docs)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
