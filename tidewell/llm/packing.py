"""Hierarchical multi-length packing of token sequences.

Each input partition packs its own documents as a stream, without a shuffle: a retried task reads the
same rows in the same order and gives the same sequences. A document's whole long windows are cut off
first; its rest goes to the smallest context-size tier that holds it. Tiers are packed from the longest
down: a rest opens a window of its tier, and the gap is filled from shorter tiers, the longest rest
that fits first; where none fits, a rest is cut so that the window ends full. Only the tail of a
partition is padded. Windows are then dealt into step groups of nearly equal attention cost.

Defined results: a null or empty text is a document of one token (the end); a null doc_id is kept;
repeated rows are documents of their own; an empty table gives an empty result; further columns of the
input are ignored.
"""

from __future__ import annotations

import bisect
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_vocabulary, encoder

TIERS = (128, 256, 512, 1024)
#: Documents that wait in a partition before windows are closed, and windows in a step group.
BLOCK_TOKENS, GROUP, GROUPS_AT_ONCE = 2_000_000, 8, 32
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs (document key, ids) of one partition; windows come out of ``add`` and ``finish``."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers, self.longest = tuple(sorted(tiers)), max(tiers)
        self.rests: dict[int, list] = defaultdict(list)  # by length: (document, start)
        self.lengths = 0  # bit n is set where rests[n] has any
        self.waiting = 0

    def _put(self, doc, start: int, length: int) -> None:
        if length:
            self.rests[length].append((doc, start))
            self.lengths |= 1 << length
            self.waiting += length

    def _take(self, most: int):
        """The longest rest of at most that many tokens."""
        n = (self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1
        if n <= 0:
            return None
        doc, start = self.rests[n].pop()
        if not self.rests[n]:
            self.lengths &= ~(1 << n)
        self.waiting -= n
        return doc, start, n

    def _shortest(self):
        n = (self.lengths & -self.lengths).bit_length() - 1
        return self._take(n) if n > 0 else None

    def add(self, doc, tokens: int) -> Iterator[tuple[int, list]]:
        full = tokens - tokens % self.longest
        for start in range(0, full, self.longest):
            yield self.longest, [(doc, start, self.longest)]
        self._put(doc, full, tokens - full)
        if self.waiting > BLOCK_TOKENS:
            yield from self.close(BLOCK_TOKENS // 4)

    def close(self, leave: int = 0) -> Iterator[tuple[int, list]]:
        """Full windows, the longest tiers first, until at most ``leave`` tokens wait."""
        for tier in reversed(self.tiers):
            while self.waiting >= max(tier, leave):
                n = self.lengths.bit_length() - 1
                if 2 * n <= tier and tier != self.tiers[0]:
                    break  # what is left belongs to shorter tiers
                yield tier, self._window(tier)

    def _window(self, tier: int) -> list:
        pieces, gap = [], tier
        while gap:
            found = self._take(gap)
            if found is None:  # every rest is longer than the gap: cut one
                doc, start, n = self._shortest()
                self._put(doc, start + gap, n - gap)
                found = (doc, start, gap)
            pieces.append(found)
            gap -= found[2]
        return pieces

    def finish(self) -> Iterator[tuple[int, list]]:
        yield from self.close()
        last = []
        while (found := self._take(self.longest)) is not None:
            last.append(found)
        if last:
            total = sum(x[2] for x in last)
            yield self.tiers[bisect.bisect_left(self.tiers, total)], last


def balanced(windows: list[tuple[int, list]], group: int = GROUP) -> Iterator[tuple[int, tuple[int, list]]]:
    """(group index, window): windows by falling attention cost go to the group with room that costs least so far.

    Groups differ by one window at most.
    """
    count = -(-len(windows) // group)
    room = [len(windows) // count + (g < len(windows) % count) for g in range(count)] if count else []
    cost = [sum(p[2] ** 2 for p in pieces) for _, pieces in windows]
    heap = [(0, g) for g in range(count)]
    for i in sorted(range(len(windows)), key=lambda i: (-cost[i], i)):
        total, g = heapq.heappop(heap)
        room[g] -= 1
        if room[g]:
            heapq.heappush(heap, (total + cost[i], g))
        yield g, windows[i]


def pack_documents(docs: DataFrame, vocabulary: str | None = None, tiers: tuple[int, ...] = TIERS, with_ids: bool = True) -> DataFrame:
    """One row for each piece: its document, tokens (little-endian uint32), window, offset, tier and step group.

    ``sequence_id`` and ``step_group`` are the partition's number times 2**33 plus a running number.
    """
    path = vocabulary or default_vocabulary()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path), Packer(tiers)
        base = TaskContext.get().partitionId() << 33
        state = {"sequence": base, "group": base}
        buffer: list = []

        def rows(windows: list) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(9)]
            most = 0
            for group, (tier, pieces) in balanced(windows):
                offset, most = 0, max(most, group)
                for (doc_id, ids, total), start, length in pieces:
                    for column, value in zip(out, (doc_id, start, length, ids[4 * start : 4 * (start + length)], total, state["sequence"], offset, tier, state["group"] + group), strict=True):
                        column.append(value)
                    offset += length
                state["sequence"] += 1
            state["group"] += most + 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=list(names))

        def full(more) -> Iterator[pa.RecordBatch]:
            for window in more:
                buffer.append(window)
                if len(buffer) == GROUP * GROUPS_AT_ONCE:
                    yield rows(buffer)
                    buffer.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), 0], dtype="<u4").tobytes()
                tokens = len(ids) // 4
                yield from full(packer.add((doc_id, ids, tokens), tokens))
        yield from full(packer.finish())
        if buffer:
            yield rows(buffer)

    packed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, SCHEMA)
    return packed if with_ids else packed.drop("ids")


def piece_digests(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return piece_digests(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
