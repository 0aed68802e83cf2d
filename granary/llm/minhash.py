"""Near-duplicate documents by min-max hashing.

Each of `PERMUTATIONS` hash functions gives two signature values, the least and the greatest hash of a document's shingles,
so half as many functions are evaluated as by keeping minima alone. Bands of four values make candidates; a pair at the
threshold shares none of 32 bands with probability (1 - 0.8**4)**32 < 1e-7.

Documents with equal shingle sets are one class from the start. Among classes no bucket is expanded into its pairs:

1. Every class of a bucket is compared with the bucket's smallest and largest id, on full shingle sets. Members of one
   component of these links need no further link.
2. Where a bucket of more than three still holds several components, its classes outside the one with most members there are compared with
   that component, block by block against an index of the block's sets, with the blocks alone that have a member in a
   bucket of theirs; only one link for each comes out.
3. Classes outside of it are compared with those that share a bucket, again by blocks, where steps 1 and 2 left them in
   different components. A task gives out links that join components it has not joined yet, so never all pairs.

In a bucket of three or fewer, step 1 has compared every pair, so steps 2 and 3 leave it out. They work on components: links
that they add join those of the step before, whose members need not be gone through again.

Pairs whose sets differ too much in size are never compared. Components of all confirmed links, with equal sets joined, are
the result: a link that was not looked at lies within a component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, merged, ship, table, tasks
from .textkit import Words, mix, thrifty, words

PERMUTATIONS, BANDS = 64, 32
#: Members that meet a hub's set in one task; members of a component in a block.
MEMBERS, BLOCK = 512, 1024
#: Tasks that look up the number of a large component's blocks.
SPLIT = 16

_RNG = np.random.default_rng(71)
_A = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_X = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each row's distinct k-word shingles, by row and hash; a row of fewer words is one shingle."""
    h, at = w.grams(k)
    row = w.row[at]
    num = np.diff(w.first)
    short = np.flatnonzero((num > 0) & (num < k))
    if len(short):
        h = np.concatenate([h, w.sequence()[short]])
        row = np.concatenate([row, short])
    o = np.lexsort((h, row))
    h, row = h[o], row[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands): one row per row of docs; no bands without shingles."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in words(b.column(1), lower=True):
                n = j - i
                h, row = shingles(w, k)
                size = np.bincount(row, minlength=n)
                some = np.flatnonzero(size)
                edge = (np.cumsum(size) - size)[some]
                sig = np.zeros((len(some), 2 * PERMUTATIONS), np.uint64)
                sets = np.zeros((2, n), np.uint64)
                if len(some):
                    with np.errstate(over="ignore"):
                        for p in range(PERMUTATIONS):
                            v = (h ^ _X[p]) * _A[p]
                            sig[:, 2 * p] = np.minimum.reduceat(v, edge)
                            sig[:, 2 * p + 1] = np.maximum.reduceat(v, edge)
                        sets[0, some] = np.add.reduceat(mix(h), edge)
                        sets[1, some] = np.add.reduceat(mix(h ^ _X[0]), edge)
                        sig = mix(sig)
                        key = np.zeros((len(some), BANDS), np.uint64)
                        for c in range(2 * PERMUTATIONS // BANDS):
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, c :: 2 * PERMUTATIONS // BANDS])
                        key = mix(key + np.arange(BANDS, dtype=np.uint64))
                else:
                    key = np.zeros((0, BANDS), np.uint64)
                offsets = np.zeros(n + 1, np.int32)
                offsets[1:] = np.cumsum((size > 0) * BANDS)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(size.astype(np.int64)), pa.array(sets[0].view(np.int64)), pa.array(sets[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.ravel().view(np.int64)))], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def confirm(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full shingle sets have 100 * intersection >= percent * union.

    Texts go to b, the hub, whose set is made once for `MEMBERS` members; a hub with more of them is met in several tasks.
    """
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    hubs = pairs.groupBy("b").agg(F.count("*").alias("n"))
    dealt = pairs.join(hubs, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / F.lit(MEMBERS))).alias("part"))
    members = dealt.join(texts, F.col("a") == F.col("id")).select("b", "part", "a", "text")
    heads = dealt.select("b", "part").distinct().join(texts, F.col("b") == F.col("id")).select("b", "part", F.lit(None).cast("long").alias("a"), "text")

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
            head = np.asarray(a.is_null())
            a = a.fill_null(0).to_numpy(zero_copy_only=False)
            out_a, out_b = [], []
            for i, j, w in words(batch.column(2), lower=True):
                h, row = shingles(w, k)
                edge = np.searchsorted(row, np.arange(j - i + 1))
                for r in range(i, j):
                    s = h[edge[r - i] : edge[r - i + 1]]
                    if head[r]:
                        hub, own = b[r], s
                    elif hub == b[r] and len(s):
                        at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                        both = int((own[at] == s).sum()) if len(own) else 0
                        if 100 * both >= percent * (len(s) + len(own) - both):
                            out_a.append(a[r])
                            out_b.append(b[r])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    met = members.unionByName(heads).select("b", "a", "part", "text").repartition(tasks(docs.sparkSession), "b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return met.select("b", "a", "text").mapInArrow(run, "a long, b long")


def confirm_blocks(docs: DataFrame, queries: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links of queries (g, id, c, band) with members (g, id, c, band) of the same group g and another component c.

    Members are dealt into blocks by hash and a query goes to the blocks of its group that hold a member in a band of its
    own. A task joins the components of the links it finds and keeps silent about further links inside them.
    """
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    size = members.select("g", "id").distinct().groupBy("g").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    # a group's rows go to several tasks, by their bands
    size = size.select("g", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))).alias("split"))
    placed = members.withColumn("split", F.pmod(F.xxhash64("band"), F.lit(SPLIT)).cast("int")).join(size, ["g", "split"]).select("g", "band", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("role"), "id", "c")
    asked = queries.join(placed.select("g", "band", "block").distinct(), ["g", "band"]).select("g", "block", F.lit(1).alias("role"), "id", "c")
    rows = placed.drop("band").unionByName(asked).distinct().join(texts, "id").select("g", "block", "role", "id", "c", "text")

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, ids, index, own = None, [], [], None, []
        merged: dict[int, int] = {}

        def label(c: int) -> int:
            while c in merged:
                c = merged[c]
            return c

        for batch in batches:
            g, block, role, id, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            out_a, out_b = [], []
            for i, j, w in words(batch.column(5), lower=True):
                h, row = shingles(w, k)
                edge = np.searchsorted(row, np.arange(j - i + 1))
                for r in range(i, j):
                    s = h[edge[r - i] : edge[r - i + 1]]
                    if now != (g[r], block[r]):
                        now, sets, ids, index, own, merged = (g[r], block[r]), [], [], None, [], {}
                    if role[r] == 0:
                        sets.append(s)
                        ids.append(id[r])
                        own.append(c[r])
                        continue
                    if not sets or not len(s):
                        continue
                    if index is None:
                        sizes, flat = np.array(list(map(len, sets))), np.concatenate(sets)
                        o = np.argsort(flat)
                        index = flat[o], np.repeat(np.arange(len(sets)), sizes)[o], sizes
                        own = np.array(own)
                    keys, owner, sizes = index
                    low, high = np.searchsorted(keys, s), np.searchsorted(keys, s, "right")
                    num = high - low
                    at = np.repeat(low - np.cumsum(num) + num, num) + np.arange(int(num.sum()))
                    both = np.bincount(owner[at], minlength=len(sets))
                    hit = np.flatnonzero(100 * both >= percent * (len(s) + sizes - both))
                    mine = label(int(c[r]))
                    while len(hit := hit[own[hit] != mine]):
                        out_a.append(id[r])
                        out_b.append(ids[hit[0]])
                        other = int(own[hit[0]])
                        own[own == other] = mine
                        merged[other] = mine
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    met = rows.repartition(tasks(docs.sparkSession), "g", "block").sortWithinPartitions("g", "block", "role", "id")
    return met.mapInArrow(run, "a long, b long")


def beyond_hubs(docs: DataFrame, spots: DataFrame, first: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, component): first with the links that it lacks among ids that share a band of spots (id, band)."""
    # buckets in which more than one component is left, and the component with most members there
    mixed = spots.join(first, "id", "left").select("id", "band", F.coalesce("component", "id").alias("c"))
    split = mixed.groupBy("band", "c").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("c", F.struct("n", "c")).alias("g"), F.count("*").alias("cs")).where("cs > 1").drop("cs")
    mixed = cut(mixed.join(split, "band"))
    outside = mixed.where("c <> g")
    if outside.count() == 0:
        return first
    second = cut(merged(first, cut(confirm_blocks(docs, outside, mixed.where("c = g"), k, percent))))
    # classes outside of it among themselves
    left = outside.select("id", "band").join(second, "id", "left").select(F.col("band").alias("g"), "id", F.coalesce("component", "id").alias("c"), "band")
    several = left.groupBy("g").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("g")
    left = cut(left.join(several, "g"))
    return second if left.count() == 0 else merged(second, cut(confirm_blocks(docs, left, left, k, percent)))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of docs.

    Words are lower-cased in A-Z. Null, empty and blank texts have no shingles and are linked with nothing. A row without
    doc_id is kept, with a null component. Rows of one doc_id count as one document; all of them are kept if it is.
    """
    signed = cut(signatures(docs, k))
    sets = signed.where("n_shingles > 0 and doc_id is not null")
    # equal sets are one class; its smallest id stands for it
    classes = cut(sets.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("x")).select(F.col("x.doc_id").alias("id"), F.col("x.n_shingles").alias("size"), F.col("x.bands").alias("bands")))
    rows = classes.select("id", "size", F.explode("bands").alias("band"))
    hubs = rows.groupBy("band").agg(F.min(F.struct("id", "size")).alias("low"), F.max(F.struct("id", "size")).alias("high"), F.count("*").alias("n")).where("low.id < high.id")
    placed = cut(rows.join(hubs, "band"))
    tried = placed.select("id", "size", F.explode(F.array("low", "high")).alias("hub")).where(F.col("id") != F.col("hub.id"))
    fits = 100 * F.least("size", "hub.size") >= percent * F.greatest("size", "hub.size")
    tried = cut(tried.where(fits).select(F.greatest("id", "hub.id").alias("a"), F.least("id", "hub.id").alias("b")).distinct())
    first = cut(components(confirm(docs, tried, k, percent)))
    final = beyond_hubs(docs, placed.where("n > 3").select("id", "band"), first, k, percent)
    member = sets.select("doc_id", "set_a", "set_b").join(sets.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("of")), ["set_a", "set_b"]).select("doc_id", "of")
    named = member.join(final, F.col("of") == F.col("id"), "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "of")).alias("component"))
    out = signed.select("doc_id", "n_shingles").join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate documents by two-word shingles, as near_duplicates."""
    ship(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)
