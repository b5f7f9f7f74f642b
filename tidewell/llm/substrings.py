"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text (h = 2h + G[byte], 32 bits, so it depends on 32 bytes). A chunk
ends where the hash is the strict maximum of REACH positions on each side, which depends on the content
alone: after an insertion the next ends fall on the same bytes again, and chunk lengths stay between
REACH and a few times that. A stretch without maxima (one that repeats itself, mostly) is cut every LONGEST
bytes after the last end. Chunks are deduplicated by a 128-bit digest; a chunk is repeated when its digest
occurs in another document, or again in its own, and neighbouring repeated chunks form a run. Runs of at least
``min_words`` words are reported, so a chance hit of one chunk does nothing; a run is reported as one span for each
stretch of chunks that the same document holds first and that are all first occurrences or all later ones, for
only what stands earlier may be cut.

One row per chunk is shuffled, twice: pre-aggregated to find repeated digests, and in a join that Spark
splits when one digest is very common. No group of equal chunks is ever collected.

Defined results: null and empty texts have no chunks; a null doc_id is no other document, and nothing is cut from
it; rows that repeat a doc_id are one document, none of which is earlier than another; an empty table gives an empty
result; further columns are ignored by ``repeated_spans`` and passed through by ``drop_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .secrets import redacted
from .shared import materialize

REACH, LONGEST = 20, 96
#: Of a repeated span; passages of over 50 words keep more than this after their ends are lost to chunk borders.
MIN_WORDS = 16
GEAR = np.random.default_rng(20240502).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the stretch that is summed."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
    return h


def chunk_ends(data: np.ndarray, reach: int = REACH, longest: int = LONGEST) -> np.ndarray:
    """Ends (exclusive) of the chunks of a text; the last is its length."""
    n = len(data)
    if n > 2 * reach:
        h = gear_hashes(data)
        most, size = h, 1  # most[i]: the maximum of h[i : i + size]
        while size < reach:
            step = min(size, reach - size)
            most, size = np.maximum(most[: len(most) - step], most[step:]), size + step
        middle = h[reach : n - reach]
        found = np.flatnonzero((middle > most[: n - 2 * reach]) & (middle >= most[reach + 1 : n - reach + 1])) + reach + 1
    else:
        found = np.empty(0, dtype=np.int64)
    ends = np.append(found, n)
    gaps = np.diff(ends, prepend=0)
    if (gaps > longest).any():
        ends = np.concatenate([np.append(np.arange(e - g + longest, e, longest), e) for e, g in zip(ends, gaps, strict=True)])
    return ends


_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def chunk_rows(text: bytes) -> tuple[list[bytes], list[bool], np.ndarray, np.ndarray]:
    """128-bit digests, whether a chunk stood in the text before, ends in code points, and the words that start in each chunk."""
    data = np.frombuffer(text, dtype=np.uint8)
    ends = chunk_ends(data)
    view, at, digests, again, seen = memoryview(text), 0, [], [], set()
    for e in ends.tolist():
        digests.append(d := xxhash.xxh3_128_digest(view[at:e]))
        again.append(d in seen)
        seen.add(d)
        at = e
    points = np.cumsum((data & 0xC0) != 0x80)[ends - 1]
    space = _SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1]
    return digests, again, points.astype(np.int32), np.diff(np.cumsum(starts)[ends - 1], prepend=0).astype(np.int32)


def chunks(docs: DataFrame) -> DataFrame:
    """A number of its own for each row, doc_id and a hash of the text; digests (hi and lo), again, ends and words of its chunks."""
    none = ([], [], np.empty(0, np.int32), np.empty(0, np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in (whole.slice(at, 500) for at in range(0, whole.num_rows, 500)):
                rows = [chunk_rows(t) if (t := x.as_py()) else none for x in batch.column(2)]
                ends = pa.array(np.cumsum([0, *[len(r[0]) for r in rows]]).astype(np.int32))
                halves = np.frombuffer(b"".join(d for r in rows for d in r[0]), dtype=np.int64).reshape(-1, 2)
                lists = [halves[:, 0], halves[:, 1], np.array([x for r in rows for x in r[1]], bool), *[np.concatenate([np.empty(0, np.int32), *[r[k] for r in rows]]) for k in (2, 3)]]
                columns = [pa.array(number + np.arange(batch.num_rows)), batch.column(0), batch.column(1), *[pa.ListArray.from_arrays(ends, pa.array(v)) for v in lists]]
                number += batch.num_rows
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "text_hash", "hi", "lo", "again", "ends", "words"])

    kind = "row long, doc_id long, text_hash long, hi array<long>, lo array<long>, again array<boolean>, ends array<int>, words array<int>"
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text")).mapInArrow(run, kind)


def spans_of(made: DataFrame, min_words: int) -> DataFrame:
    """One row per span of the materialised chunks: row, doc_id, start, end, n_words, n_chunks, first_doc_id, copies, duplicate."""
    each = lambda *more: F.inline(F.transform("hi", lambda h, i: F.struct(h.alias("hi"), F.get("lo", i).alias("lo"), *[f(i) for f in more])))
    again = lambda i: F.get("again", i).alias("again")
    counted = made.select("doc_id", each(again)).groupBy("hi", "lo").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("again").alias("inside"))
    repeated = counted.filter("first < last OR inside").select("hi", "lo", "copies", "first")
    # Places travel as two numbers: start and end, and the chunk's number with its words and whether it stood in the text before.
    start = lambda i: F.coalesce(F.get("ends", i - 1), F.lit(0)).cast("long")
    span = lambda i: (F.shiftleft(start(i), 32) + F.get("ends", i)).alias("span")
    place = lambda i: (F.shiftleft(i.cast("long"), 33) + F.shiftleft(F.get("words", i).cast("long"), 1) + F.get("again", i).cast("long")).alias("place")
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    found = made.select("row", "doc_id", each(span, place)).join(repeated, ["hi", "lo"])
    found = found.withColumns({"i": F.shiftright("place", 33), "words": low(F.shiftright("place", 1)), "start": F.shiftright("span", 32), "end": low(F.col("span"))})
    found = found.withColumn("later", (F.col("place").bitwiseAND(F.lit(1)) == 1) | ~F.col("doc_id").eqNullSafe(F.col("first")))
    w = Window.partitionBy("row").orderBy("i")
    same = Window.partitionBy("row", "first", "later").orderBy("i")
    runs = found.withColumn("run", F.col("i") - F.row_number().over(w)).withColumn("part", F.col("i") - F.row_number().over(same)).groupBy("row", "doc_id", "run", "first", "later", "part")
    spans = runs.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"), F.count("*").alias("n_chunks"), F.max("copies").alias("copies"))
    long = spans.withColumn("whole", F.sum("n_words").over(Window.partitionBy("row", "run"))).filter(F.col("whole") >= min_words)
    return long.select("row", "doc_id", F.col("start").cast("long"), F.col("end").cast("long"), "n_words", "n_chunks", F.col("first").alias("first_doc_id"), "copies", F.col("later").alias("duplicate"))


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per span: doc_id, start and end (code points), n_words, n_chunks, first_doc_id, copies, duplicate.

    ``copies`` is the largest number of occurrences of a chunk in the span; ``duplicate`` is false where the chunks
    stand first (in the smallest doc_id, at their first place in it), which deduplication keeps. All chunks of a span
    have the same first document; ``min_words`` holds for the run of neighbouring spans.
    """
    return spans_of(materialize(chunks(docs.select("doc_id", "text")), "chunks"), min_words).drop("row")


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs, with the spans cut from the texts that stand earlier: in a smaller doc_id or further up in the text."""
    made = materialize(chunks(docs.select("doc_id", "text")), "chunks")
    cut = spans_of(made, min_words).filter("duplicate AND doc_id IS NOT NULL").groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias("_spans"))
    # Equal rows have equal spans, so one of them stands for all.
    cut = made.select("row", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).join(cut, "row").drop("row").dropDuplicates(["_id", "_hash"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    joined = rows.join(cut, ["_id", "_hash"], "left")
    text = F.when(F.col("_spans").isNotNull(), redacted(F.col("row.text"), F.col("_spans"), "")).otherwise(F.col("row.text"))
    return joined.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op3_substrings(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
