"""b-bit MinHash near-duplicate search over word shingles, with exact confirmation.

1. One pass over the texts gives each document its shingle count, a 128-bit digest of the shingle set,
   band keys of its MinHash signature, and the signature itself cut to the low ``BITS`` bits of each
   (scrambled) minimum and packed as bit planes.
2. Documents with equal sets are one class, represented by the smallest doc_id; only representatives go on.
3. Representatives that share a band key are candidates. A bucket of up to ``SMALL`` gives all its pairs; in
   a larger one each member meets two, the smallest and one by hash, so n copies cost 2 n candidates.
4. Candidates are thinned by set size and by the collision-corrected estimate from bit counts (a margin of
   more than five standard deviations below the threshold), then confirmed on full shingle sets: first
   one pair of each document, then those whose documents are still in different components.
5. Larger buckets that still hold several components may hide links between their other members. Their
   members are bucketed again by the band keys of 2, 3, ... such buckets at once, which part documents that
   only share a common passage and keep near copies together, and steps 3 and 4 are done on these. Each row has its
   document's component by now, so only pairs across components are made.
6. Documents of first buckets that hold several components even then go to an exact search: a missed link would
   join two components of such a bucket. Rare-first prefixes of their sets (two sets of similarity s share an
   element of these) are joined across components, with the bound that the place of an element gives for what
   two sets can share. Elements of many documents are joined in blocks of SALTED by SALTED.
7. Links become components by large-star and small-star steps. Later links are between components, and only
   these are put together again.

No bucket is capped and no candidate left out for a group's size: what pivots of a crowded bucket miss, step 6 finds.
Bands of 4 rows: a pair of similarity 0.8 shares none of 32 with probability 5e-8. Sets are equal when a 128-bit digest
of their sorted 64-bit shingles is.

Defined results: a null or empty text, or one without words, has an empty set and is linked with
nothing; with fewer words than a shingle the whole sequence is the one shingle; a null doc_id is linked
with nothing and kept; rows that repeat a doc_id are one node, whatever their texts; an empty table gives an empty result;
further columns are ignored by ``near_duplicates`` and passed through by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import materialize
from .shingles import WordHashes, mix, shingle_hashes

HASHES, BANDS, BITS = 128, 32, 4
SMALL, PIVOTS, DEPTH = 8, 2, 4
MARGIN = 0.2
#: Document ids up to which a set of them goes to every executor (some 40 bytes each there); beyond, rows are shuffled.
BROADCAST_IDS = 1_000_000
#: Rows of an element that meet in one group of a join.
SALTED = 1000
SIGNED = "doc_id long, n long, d1 long, d2 long, bands array<long>, sig array<long>"

_A = np.random.default_rng(20240501).integers(1, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of HASHES hash functions over a set."""
    low, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(out, (_A[:, None] * low[None, at : at + 4096]).min(axis=1), out=out)
    return out


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, and the low bits of the minima as bit planes of 64 minima each."""
    least = mix(minima(shingles).astype(np.uint64) + (np.arange(HASHES, dtype=np.uint64) << np.uint64(32)))
    keys, rows = mix(_BAND.copy()), least.reshape(BANDS, HASHES // BANDS)
    for r in range(rows.shape[1]):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    low = (least.astype(np.uint64)[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    planes = np.packbits(low.astype(np.uint8).T.reshape(BITS, HASHES // 64, 64), axis=2, bitorder="little")
    return keys, np.ascontiguousarray(planes).view("<u8").reshape(-1)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sign(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, digest, band keys and signature of each row; without words n is 0 and the lists are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in _chunks(batches):
            counts, digests, bands, sigs = [], [], [], []
            for text in batch.column(1):
                s = shingle_hashes(text.as_py() or b"", width, known)
                counts.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys, planes = signature(s) if len(s) else (s, s)
                bands.append(keys)
                sigs.append(planes)
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), _lists(bands), _lists(sigs)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "d1", "d2", "bands", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SIGNED)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and the full shingle set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in _chunks(batches, 100):
            sets = [shingle_hashes(text.as_py() or b"", width, known) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, shingles array<long>")


def estimate(x: Column, y: Column) -> Column:
    """Similarity from two packed signatures: equal b-bit values, less those that chance makes equal."""
    halves = HASHES // 64
    differ = F.lit(0)
    for h in range(halves):
        bits = F.lit(0).cast("long")
        for plane in range(BITS):
            at = plane * halves + h
            bits = bits.bitwiseOR(F.get(x, F.lit(at)).bitwiseXOR(F.get(y, F.lit(at))))
        differ = differ + F.bit_count(bits)
    chance = 1 / (1 << BITS)
    return ((HASHES - differ) / HASHES - chance) / (1 - chance)


def bucket_candidates(keys: DataFrame, pivots: int, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a < b) of keys(key, doc_id, ...), and the rows of buckets beyond ``small``.

    With a column ``component``, each document's so far, only pairs across components are made.
    """
    known = "component" in keys.columns
    buckets = keys.groupBy("key").agg(F.count("*").alias("c"), *([F.min("component").alias("lo"), F.max("component").alias("hi")] if known else []))
    members = materialize(keys.join(buckets.filter("c > 1 AND lo <> hi").drop("lo", "hi") if known else buckets.filter("c > 1"), "key"), "members")
    label = "component" if known else "doc_id"
    few = members.filter(F.col("c") <= small).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("doc_id", F.col(label).alias("of")))).alias("ids"))
    after = lambda x, i: F.filter(F.slice("ids", i + 2, F.lit(small)), lambda y: y["of"] != x["of"])
    pair = F.flatten(F.transform("ids", lambda x, i: F.transform(after(x, i), lambda y: F.struct(x["doc_id"].alias("a"), y["doc_id"].alias("b")))))
    all_pairs = few.select(F.explode(pair).alias("p")).select("p.a", "p.b")
    crowded = members.filter(F.col("c") > small).drop("c")
    one = F.struct("doc_id", F.col(label).alias("of"))
    chosen = crowded.groupBy("key").agg(F.min(one).alias("p"), F.min_by(one, F.xxhash64("doc_id", "key")).alias("q"))
    star = crowded.join(chosen, "key").filter(f"{label} <> q.of OR {label} <> p.of")
    pairs = all_pairs
    for pivot in ("p", "q")[2 - pivots :]:
        pairs = pairs.union(star.filter(f"{label} <> {pivot}.of").select(F.least("doc_id", f"{pivot}.doc_id").alias("a"), F.greatest("doc_id", f"{pivot}.doc_id").alias("b")))
    return pairs.distinct(), crowded


def mixed(crowded: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of crowded buckets that hold documents of several components, with each document's component."""
    named = found.withColumnRenamed("node", "doc_id")
    labelled = materialize(crowded.join(named, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "labelled")
    several = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    return labelled.join(several, "key", "left_semi")


def deeper(open_: DataFrame, depth: int) -> DataFrame:
    """Keys made of ``depth`` band keys at once, each document's in the order of the bands (pairs also two apart)."""
    listed = open_.groupBy("doc_id", "component").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "key"))), lambda x: x["key"]).alias("keys")).filter(F.size("keys") >= depth)
    take = lambda i, gap: F.xxhash64(F.lit(gap), *[F.get("keys", i + gap * k) for k in range(depth)])
    made = lambda gap: F.when(F.size("keys") > gap * (depth - 1), F.transform(F.sequence(F.lit(0), F.size("keys") - gap * (depth - 1) - 1), lambda i: take(i, gap))).otherwise(F.array().cast("array<long>"))
    return listed.select("doc_id", "component", F.explode(F.array_distinct(F.concat(*[made(gap) for gap in ((1, 2) if depth == 2 else (1,))]))).alias("key"))


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose documents are in different components so far."""
    side = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return joined.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def put_together(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components of found(node, component) after further links; only the components that these touch are searched."""
    side = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = components(between)
    moved = found.join(over.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return materialize(moved.select("node", F.coalesce("to", "component").alias("component")).union(over), "found")


def thin(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose set sizes and estimated similarity may reach the threshold."""
    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    joined = pairs.join(side("b"), "b").filter("a <> b").join(side("a"), "a")
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return joined.filter(fits & (estimate(F.col("sa"), F.col("sb")) >= percent / 100 - MARGIN)).select("a", "b").distinct()


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s{c}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return joined.filter(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b")


def rows_of(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows of docs with (left_semi) or without (left_anti) the distinct ids(doc_id), their texts unmoved if ids are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """Materialised shingle sets of the documents in ids(doc_id)."""
    wanted = materialize(ids.select("doc_id").distinct(), "wanted")
    return materialize(shingle_sets(rows_of(docs.select(F.col("doc_id").cast("long"), "text"), wanted, "left_semi"), width), "sets")


def prefix_candidates(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of labels(doc_id, component) across components that share an element of their rare-first prefixes.

    ``rest`` is how much of a set is left at an element's place, so at the first that two sets share it bounds
    what they share; no pair of the threshold is missed.
    """
    items = sets.join(labels, "doc_id", "left_semi").select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    frequency = items.groupBy("s").agg(F.count("*").alias("f")).filter("f > 1")
    # An element of one document only can't be shared, but it counts in the order: such elements come first.
    ordered = items.join(frequency, "s").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("o"))
    keep = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("o"))
    placed = F.transform(F.slice("o", F.lit(1), keep.cast("int")), lambda x, i: F.struct(x["s"].alias("s"), (F.size("o") - i).alias("rest")))
    prefix = ordered.filter(keep > 0).select("doc_id", "n", F.explode(placed).alias("p")).select("doc_id", "n", "p.s", "p.rest")
    labelled = materialize(prefix.join(labels, "doc_id"), "prefix")

    enough = lambda rest, both: F.col(rest) * (100 + percent) >= both * percent
    several = labelled.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least"), F.max("rest").alias("most"), F.count("*").alias("c")).filter("lo <> hi")
    # A row that not even the shortest set and the largest rest of its element could match goes no further.
    fits = enough("rest", F.col("n") + F.col("least")) & enough("most", F.col("n") + F.col("least"))
    open_ = labelled.join(several.drop("lo", "hi"), "s").filter(fits).select("s", "doc_id", "n", "rest", "component", F.ceil(F.col("c") / SALTED).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(F.col("own"), x).alias("i"), F.greatest(F.col("own"), x).alias("j")))
    salted = open_.withColumn("own", own).withColumn("m", F.explode(met)).select("s", "m.i", "m.j", "own", "doc_id", "n", "rest", "component")
    side = lambda c: salted.select("s", "i", "j", *[F.col(x).alias(f"{x}{c}") for x in ("own", "doc_id", "n", "rest", "component")])
    # Both of one block meet in that block's own group only.
    once = (F.col("doc_ida") < F.col("doc_idb")) & (F.col("componenta") != F.col("componentb")) & ((F.col("owna") != F.col("ownb")) | (F.col("i") == F.col("j")))
    both = F.col("na") + F.col("nb")
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return side("a").join(side("b"), ["s", "i", "j"]).filter(once & sizes & enough("resta", both) & enough("restb", both)).select(F.col("doc_ida").alias("a"), F.col("doc_idb").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    docs = docs.select("doc_id", "text")
    signed = materialize(sign(docs, width), "signed")
    known = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = known.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "d1", "d2"])
    reps = materialize(reps.select("doc_id", "n", "bands", "sig"), "reps")

    pairs, crowded = bucket_candidates(reps.select("doc_id", F.posexplode("bands").alias("band", "key")), PIVOTS)
    pairs = tested = materialize(pairs, "candidates")
    pairs, crowded = materialize(thin(pairs, reps, percent), "pairs"), materialize(crowded, "crowded")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).union(crowded.select("doc_id"))
    sets = sets_of(docs, ids, width)
    # A member of a group is paired with others in each of its buckets; after one pair most of these say nothing new.
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = components(materialize(confirm(first, sets, percent), "confirmed"))
    more = materialize(apart(pairs, found).join(first, ["a", "b"], "left_anti"), "candidates")
    new = materialize(confirm(more, sets, percent), "confirmed")
    if not new.isEmpty():
        found = put_together(found, new)
    changed = True
    for depth in range(2, DEPTH + 1):
        if changed:
            crowded = materialize(mixed(crowded.drop("component"), found), "mixed")
        if crowded.isEmpty():
            break
        more, _ = bucket_candidates(deeper(crowded, depth), 1)
        more = materialize(more.join(tested, ["a", "b"], "left_anti"), "candidates")
        tested = tested.union(more)
        new = materialize(confirm(thin(more, reps, percent), sets, percent), "confirmed")
        changed = not new.isEmpty()
        if changed:
            found = put_together(found, new)
    crowded = mixed(crowded.drop("component"), found) if changed else crowded
    rest = materialize(crowded.select("doc_id", "component").distinct(), "rest")
    if not rest.isEmpty():
        more = materialize(prefix_candidates(sets, rest, percent).join(tested, ["a", "b"], "left_anti"), "candidates")
        new = materialize(confirm(thin(more, reps, percent), sets, percent), "confirmed")
        if not new.isEmpty():
            found = put_together(found, new)

    final = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n", "d1", "d2").join(final, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose document represents its group; rows without doc_id stay.

    Of rows that repeat a doc_id the one whose text has the smallest hash stays (any, if the texts are equal).
    """
    found = materialize(near_duplicates(docs, width, percent).filter("doc_id IS NOT NULL").select("doc_id", "kept"), "verdicts")
    gone = materialize(found.filter("NOT kept").select("doc_id").distinct(), "gone")
    again = materialize(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    left = rows_of(docs, gone, "left_anti").select(*docs.columns)
    if again.isEmpty():
        return left
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    several = rows_of(left, again, "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text").withColumn("_n", F.row_number().over(one))
    return rows_of(left, again, "left_anti").select(*docs.columns).unionByName(several.filter("_n = 1").select("row.*"))


def op4_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=80)
