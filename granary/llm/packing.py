"""Packing into optimal length buckets.

The global histogram of lengths goes to the driver whole: d distinct lengths need d * d / 2 tokens, so a corpus of 10**13 has
some millions at most. Dynamic programming over it chooses the bucket bounds that pad least. Batches are then formed inside
each bucket under a budget of padded tokens. A bucket is dealt into shards by hash, of about SHARD rows each, which number
their rows by themselves; so no bucket meets in one task, at the price of one batch a shard that may not be full.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, ship, table

#: Buckets; padded tokens in a batch; rows of a shard.
BUCKETS, BUDGET, SHARD = 16, 32768, 20_000


def word_count(text: str = "text"):
    """Words between white space; the length unit unless a column of token counts is given."""
    return F.coalesce(F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "w")) - F.when(F.regexp_like(text, F.lit(r"\A[\x20\x09-\x0D]")), F.length(F.regexp_extract(text, r"\A[\x20\x09-\x0D]*+", 0))).otherwise(0), F.lit(0))


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most `buckets` buckets over ascending distinct lengths with the least total padding.

    cost(i, j) = lengths[j-1] * sum(counts[i:j]) - sum(lengths * counts)[i:j] meets the quadrangle inequality, so the best
    split moves monotonically with j. Each layer is solved by divide and conquer, all halves of a level at once, in
    O(buckets * n * log n) steps and O(buckets * log n) numpy calls.
    """
    n = len(lengths)
    if not n:
        return []
    k = min(buckets, n)
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    num = np.concatenate([[0], np.cumsum(counts)])
    mass = np.concatenate([[0], np.cumsum(lengths * counts)])
    never = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, never)
    best[0] = 0
    choice = np.zeros((k + 1, n + 1), np.int32)
    for layer in range(1, k + 1):
        now, own = np.full(n + 1, never), choice[layer]
        lo, hi, a, b = (np.array([x]) for x in (1, n, 0, n - 1))
        while len(lo):
            mid = (lo + hi) // 2
            size = np.minimum(mid - 1, b) - a + 1
            first = np.cumsum(size) - size
            of = np.repeat(np.arange(len(mid)), size)
            i = np.arange(int(size.sum())) - first[of] + a[of]
            m = mid[of]
            cost = best[i] + lengths[m - 1] * (num[m] - num[i]) - (mass[m] - mass[i])
            low = np.minimum.reduceat(cost, first)
            hit = np.flatnonzero(cost == low[of])
            at = i[hit[np.searchsorted(hit, first)]]  # the first of the least
            now[mid], own[mid] = low, at
            lo, hi, a, b = np.concatenate([lo, mid + 1]), np.concatenate([mid - 1, hi]), np.concatenate([a, at]), np.concatenate([at, b])
            on = lo <= hi
            lo, hi, a, b = lo[on], hi[on], a[on], b[on]
        best = np.minimum(now, never)
    bounds, j = [], n
    for layer in range(k, 0, -1):
        bounds.append(int(lengths[j - 1]))
        j = int(choice[layer, j])
        if j == 0:
            break
    return bounds[::-1]


def pack(docs: DataFrame, key: str = "doc_id", tokens=None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(key, n_tokens, bucket, bucket_len, batch, slot): where each row of docs goes; a manifest that leaves texts in place.

    A batch holds rows of one bucket, floor(budget / bucket_len) at most; a row longer than the budget is a batch of its own.
    Null and empty texts have length 0 and go to the first bucket. Repeated rows and rows without key each have
    their own slot. The order inside a shard is by hash of the key, which also shuffles the batches' content; rows of one key
    and length that would fill a shard, as many without key may, are dealt out by their place in the table instead.
    """
    rows = cut(docs.select(docs[key].alias("key"), (word_count() if tokens is None else F.coalesce(tokens, F.lit(0))).cast("long").alias("n_tokens")))
    hist = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).toPandas().sort_values("n_tokens")  # distinct lengths
    lengths, counts = hist["n_tokens"].to_numpy(np.int64), hist["n"].to_numpy(np.int64)
    bounds = optimal_bounds(lengths, counts, buckets)
    place = np.searchsorted(np.array(bounds, np.int64), lengths) if len(bounds) else np.zeros(0, int)
    size = np.bincount(place, counts, minlength=max(len(bounds), 1)).astype(int)
    bucket = F.lit(0)
    for i in range(len(bounds) - 1, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[i], F.lit(i)).otherwise(bucket)
    of = lambda xs: F.element_at(F.array(*(F.lit(int(x)) for x in xs)), F.col("bucket") + 1)
    bounds = bounds or [0]
    fit = [max(1, budget // max(1, b)) for b in bounds]
    shards = [max(1, round(s / SHARD)) for s in size]
    alike = rows.groupBy("key", "n_tokens").agg(F.count("*").alias("n")).where(F.col("n") > SHARD // 4).select(F.col("key").alias("_k"), F.col("n_tokens").alias("_t"))
    spread = rows.withColumn("at", F.monotonically_increasing_id()).join(alike, F.col("key").eqNullSafe(F.col("_k")) & (F.col("n_tokens") == F.col("_t")), "left")
    dealt = spread.withColumn("bucket", bucket).withColumn("h", F.when(F.col("_t").isNull(), F.xxhash64("key", "n_tokens")).otherwise(F.xxhash64("at"))).withColumn("shard", F.pmod("h", of(shards))).drop("at")
    w = Window.partitionBy("bucket", "shard").orderBy("h", "key")
    at = (F.row_number().over(w) - 1).cast("long")
    out = dealt.withColumn("at", at).withColumn("per", of(fit))
    return out.select(F.col("key").alias(key), "n_tokens", "bucket", of(bounds).cast("long").alias("bucket_len"), F.concat_ws("-", "bucket", "shard", F.floor(F.col("at") / F.col("per"))).alias("batch"), (F.col("at") % F.col("per")).cast("int").alias("slot"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch and slot of every document by its words, as pack with the default buckets and budget."""
    ship(spark)
    return pack(table(spark, sf_dir, "documents"))
