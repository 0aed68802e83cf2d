"""Embedding near-duplicates by randomised-rotation binary codes.

A vector's code is the signs of its coordinates after a seeded random rotation; with it goes the correction factor, the
inner product of the unit vector with its code. For a code and another rotated vector y, <code, y> / factor is an unbiased
estimate of the cosine, and its error is normal with deviation sqrt((1 - f*f) / (f*f * (D - 1))) * sqrt(1 - cos*cos). A
pair is recomputed exactly, in double precision, only if the estimate's confidence bound reaches the threshold.

Candidates meet in buckets of further sign bits. A key has as many bits as leave about `FILL` unrelated vectors in a bucket of
the largest label, and there are as many keys as keep a pair at cosine 0.98 from being missed by all of them but `MISS` of the
time; closer pairs are missed less. Equal vectors are one class from the start. A bucket's rows are dealt into blocks, and
blocks are compared block by block: first by codes alone (bits that differ, then estimates); the vectors themselves go only to
the tasks and rows that have a pair left to decide. Counts and one edge for each row come out, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, ship, table, tasks
from .textkit import mix

#: Fewest and most bits of a key; unrelated vectors of a label in a bucket; share of pairs at the threshold that no key finds.
BITS, MOST_BITS, FILL, MISS = 16, 32, 32, 2e-4
#: Deviations that the confidence bound of an estimate allows for (a true pair is left out once in 10**9); of differing bits.
SURE, SURE_BITS = 6.0, 8.0
#: Rows of a block.
BLOCK = 2048


def key_sizes(largest: int, least: float = 0.98) -> tuple[int, int]:
    """(keys, bits of each) for a table whose largest label has so many vectors."""
    bits = min(MOST_BITS, max(BITS, math.ceil(math.log2(max(1, largest) / FILL))))
    found = (1 - math.acos(least) / math.pi) ** bits
    return math.ceil(math.log(MISS) / math.log1p(-found)), bits


@lru_cache(4)
def rotation(dim: int, seed: int = 20) -> np.ndarray:
    """A random orthogonal matrix (dim, dim), the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(4)
def planes(dim: int, n: int) -> np.ndarray:
    """n directions (dim, n) of key bits, in random orthogonal sets."""
    return np.concatenate([rotation(dim, 1000 + i) for i in range(-(-n // dim))], axis=1)[:, :n]


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed codes (n, bytes), correction factors) of unit vectors."""
    turned = unit @ rotation(unit.shape[1])
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(unit.shape[1])


def estimate(codes: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Unbiased cosines (codes, vectors) from codes with factors and rotated unit vectors."""
    dim = turned.shape[1]
    signs = np.unpackbits(codes, axis=1)[:, :dim].astype(np.float32) * 2 - 1
    return (signs @ turned.T.astype(np.float32)) / (np.sqrt(dim) * factors[:, None]).astype(np.float32)


def margin(factors: np.ndarray, dim: int, least: float) -> np.ndarray:
    """How far below `least` the estimate of a pair at `least` can lie."""
    f2 = np.clip(factors, 1e-6, 1) ** 2
    return SURE * np.sqrt((1 - f2) / f2 / max(dim - 1, 1)) * np.sqrt(1 - least * least) + 1e-5


def bits_apart(dim: int, least: float) -> float:
    """Bits in which the codes of a pair at `least` can differ: binomial with the share of its angle."""
    p = math.acos(least) / math.pi
    return dim * p + SURE_BITS * math.sqrt(dim * p * (1 - p))


def signed(vectors: DataFrame, keys: int, bits: int) -> DataFrame:
    """(vec_id, label, raw, dim, hash_a, hash_b, code, factor, turned, keys); raw is null for vectors that link with nothing.

    turned: the rotated unit vector in half precision; keys: 4 bytes for each key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.uint32(1) << np.arange(bits, dtype=np.uint32)
        for b in batches:
            n, col, labels = b.num_rows, b.column(2), b.column(1)
            sizes = np.array([x or 0 for x in col.value_lengths().to_pylist()], np.int64)
            flat = col.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            edge = np.concatenate([[0], np.cumsum(sizes)])
            raw, codes, turned, slots = ([None] * n for _ in range(4))
            factor, ha, hb = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            named = ~np.asarray(labels.is_null())
            for dim in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero((sizes == dim) & named)
                if not len(rows):
                    continue
                v = flat[edge[rows][:, None] + np.arange(dim)]
                with np.errstate(over="ignore", invalid="ignore"):
                    norm = np.linalg.norm(v, axis=1)
                    big = np.isinf(norm) & np.isfinite(v).all(1)
                    v[big] /= np.abs(v[big]).max(1, keepdims=True)
                    norm = np.where(big, np.linalg.norm(v, axis=1), norm)
                ok = np.isfinite(norm) & (norm > 0)
                rows, v, norm = rows[ok], v[ok], norm[ok]
                if not len(rows):
                    continue
                unit = v / norm[:, None]
                c, f = encode(unit)
                half = (unit @ rotation(int(dim))).astype(np.float16)
                bit = (unit @ planes(int(dim), keys * bits) > 0).reshape(len(rows), keys, bits)
                k = (bit * place).sum(2, dtype=np.uint32)
                words64 = (v + 0.0).view(np.uint64)  # -0.0 and 0.0 alike
                with np.errstate(over="ignore"):
                    at = mix(np.arange(1, dim + 1, dtype=np.uint64))
                    ha[rows] = (mix(words64 ^ at).sum(1, dtype=np.uint64)).view(np.int64)
                    hb[rows] = (mix(words64 + at).sum(1, dtype=np.uint64)).view(np.int64)
                factor[rows] = f
                for q, r in enumerate(rows):
                    raw[r], codes[r], turned[r], slots[r] = v[q].tobytes(), c[q].tobytes(), half[q].tobytes(), k[q].tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), labels, pa.array(raw, pa.binary()), pa.array(sizes.astype(np.int32)), pa.array(ha), pa.array(hb), pa.array(codes, pa.binary()), pa.array(factor), pa.array(turned, pa.binary()), pa.array(slots, pa.binary())],
                ["vec_id", "label", "raw", "dim", "hash_a", "hash_b", "code", "factor", "turned", "keys"],
            )

    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(run, "vec_id long, label long, raw binary, dim int, hash_a long, hash_b long, code binary, factor double, turned binary, keys binary")


def _close(codes: np.ndarray, others: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of packed codes that differ in at most so many bits."""
    wide = lambda c: np.pad(c, ((0, 0), (0, -c.shape[1] % 8))).view(np.uint64)
    a, b = wide(codes), wide(others)
    apart = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        apart += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return np.nonzero(apart <= most)


class Side:
    """The rows of one side of a pair of blocks; raw only where it was sent."""

    def __init__(self, t: pa.Table) -> None:
        num = lambda c: t.column(c).to_numpy()
        wide = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(t.num_rows, -1)
        self.id, self.factor, self.table = num("id"), num("factor"), int(num("table")[0])
        self.code, self.turned, self.keys = wide("code", np.uint8), wide("turned", np.float16).astype(np.float32), wide("keys", np.uint32)
        if "raw" in t.column_names:
            self.raw, self.weight = wide("raw", np.float64), num("weight")
            self.unit = self.raw / np.linalg.norm(self.raw, axis=1, keepdims=True)


def undecided(x: Side, y: Side, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the two sides that codes and estimates can't rule out, and that no earlier table has had."""
    dim = x.turned.shape[1]
    i, j = _close(x.code, y.code, bits_apart(dim, least))
    if same:
        i, j = i[i < j], j[i < j]
    low = least - margin(x.factor, dim, least) - 5e-4  # half precision
    if 8 * len(i) > len(x.id) * len(y.id):
        est = estimate(x.code, x.factor, y.turned)[i, j]
    else:
        signs = np.unpackbits(x.code, axis=1)[:, :dim].astype(np.float32) * 2 - 1
        est = np.concatenate([np.zeros(0, np.float32), *(np.einsum("ij,ij->i", signs[i[s : s + 65536]], y.turned[j[s : s + 65536]]) for s in range(0, len(i), 65536))]) / (np.sqrt(dim) * x.factor[i]).astype(np.float32)
    on = est >= low[i]
    i, j = i[on], j[on]
    met = np.zeros(len(i), bool)  # a pair that met in an earlier table was counted there
    for t in range(x.table):
        met |= x.keys[i, t] == y.keys[j, t]
    return i[~met], j[~met]


def linked(x: Side, y: Side, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs have a cosine of `least` or more; those near it by the plain formula in double precision."""
    if 8 * len(i) > len(x.id) * len(y.id):
        cos = (x.unit @ y.unit.T)[i, j]
    else:
        cos = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x.unit[i[s : s + 65536]], y.unit[j[s : s + 65536]]) for s in range(0, len(i), 65536))])
    hit = cos >= least
    near = np.flatnonzero(np.abs(cos - least) < 1e-9)
    for s in range(0, len(near), 65536):
        q = near[s : s + 65536]
        p, r = x.raw[i[q]], y.raw[j[q]]
        hit[q] = (p * r).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((r * r).sum(1))) >= least
    return hit


def _by_task(settle):
    """Batches in order of their first column -> what settle makes of each task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            task = b.column(0).to_numpy()
            edge = np.flatnonzero(np.diff(task)) + 1
            for s, e in zip([0, *edge], [*edge, b.num_rows]):
                if e <= s:
                    continue
                if held and task[s] != last:
                    if (out := settle(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                last = task[s]
                held.append(b.slice(s, e - s))
        if held and (out := settle(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def _sides(t: pa.Table) -> tuple[Side, Side, bool]:
    side = t.column("side").to_numpy()
    sides = [Side(t.filter(pa.array(side == s))) for s in np.unique(side)]
    return sides[0], sides[-1], len(sides) == 1


_CODES = ("code", "factor", "turned", "keys")


def left_open(placed: DataFrame, least: float, parts: int) -> DataFrame:
    """(task, side, id, table): rows with a pair that codes leave undecided. placed: (task, side, table, id, codes).

    side 0 or 1 by block, both blocks in one task; a block with itself has side 0 alone.
    """

    def settle(t: pa.Table) -> pa.RecordBatch | None:
        x, y, same = _sides(t)
        i, j = undecided(x, y, same, least)
        if not len(i):
            return None
        rows = [np.unique(np.concatenate([i, j]))] if same else [np.unique(i), np.unique(j)]
        ids = np.concatenate([s.id[r] for s, r in zip((x, y), rows)])
        side = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t.column("task")[0].as_py(), np.int64)), pa.array(side.astype(np.int32)), pa.array(ids), pa.array(np.full(len(ids), x.table, np.int32))], ["task", "side", "id", "table"])

    met = placed.select("task", "side", "id", "table", *_CODES).repartition(parts, "task").sortWithinPartitions("task", "side", "id")
    return met.mapInArrow(_by_task(settle), "task long, side int, id long, table int")


def compare(placed: DataFrame, least: float, parts: int) -> DataFrame:
    """(id, n, to): links and one linked id of smaller rank for each row of each pair of blocks; placed as in left_open, with weight and raw."""

    def settle(t: pa.Table) -> pa.RecordBatch | None:
        x, y, same = _sides(t)
        i, j = undecided(x, y, same, least)
        hit = linked(x, y, i, j, least)
        i, j = i[hit], j[hit]
        if not len(i):
            return None
        ids = x.id if same else np.concatenate([x.id, y.id])
        w = x.weight if same else np.concatenate([x.weight, y.weight])
        j = j if same else j + len(x.id)
        n = np.bincount(i, w[j], minlength=len(ids)) + np.bincount(j, w[i], minlength=len(ids))
        low = ids.copy()
        while True:  # least id of each component of this block, by repeated minima over its links
            now = low.copy()
            np.minimum.at(now, i, low[j])
            np.minimum.at(now, j, low[i])
            if (now == low).all():
                break
            low = now
        on = np.unique(np.concatenate([i, j]))
        return pa.RecordBatch.from_arrays([pa.array(ids[on], pa.int64()), pa.array(n[on].astype(np.int64)), pa.array(low[on], pa.int64())], ["id", "n", "to"])

    met = placed.select("task", "side", "id", "table", *_CODES, "weight", "raw").repartition(parts, "task").sortWithinPartitions("task", "side", "id")
    return met.mapInArrow(_by_task(settle), "id long, n long, to long")


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of vectors (vec_id, label, embedding).

    Vectors link within a label and a dimension. Null or empty vectors, those with null or non-finite components or zero
    norm, and those without a label link with nothing. A row without vec_id links with nothing and is kept, its
    component null. Rows are what links, whatever their vec_id: repeated rows of one vec_id and vector are copies like any
    others, and rows of one vec_id with different vectors have their own links and components. No vectors: no rows.
    """
    labelled = vectors.where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    keys, bits = key_sizes(labelled.agg(F.max("n")).first()[0] or 0, least)
    all_rows = cut(signed(vectors, keys, bits).withColumn("live", F.col("raw").isNotNull() & F.col("vec_id").isNotNull()).withColumn("id", F.when(F.col("live"), F.xxhash64("label", "dim", "hash_a", "hash_b"))))
    # equal vectors are one class, known by a hash of label and vector; one of its rows stands for it
    names = ("label", "dim", "raw", *_CODES)
    reps = cut(all_rows.where("live").groupBy("id").agg(F.min("vec_id").alias("of"), F.count("*").alias("weight"), F.first(F.struct(*names)).alias("x")).select("id", "of", "weight", "x.*"))
    spots = reps.select("id", "label", "dim", F.explode(F.expr(f"transform(sequence(0, {keys - 1}), t -> struct(t as table, substring(keys, t * 4 + 1, 4) as slot))")).alias("s")).select("id", "label", "dim", "s.table", "s.slot")
    full = spots.groupBy("label", "dim", "table", "slot").agg(F.count("*").alias("m")).where("m > 1")
    # blocks of a bucket: each row goes to every pair of blocks that its own is in
    dealt = spots.join(full, ["label", "dim", "table", "slot"]).withColumn("blocks", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("id", "table", F.xxhash64("label", "dim", "table", "slot", F.least("own", "other"), F.greatest("own", "other")).alias("task"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    parts = tasks(vectors.sparkSession)
    left = cut(left_open(dealt.join(reps.select("id", *_CODES), "id"), least, parts))
    met = cut(compare(left.join(reps.select("id", "weight", "raw", *_CODES), "id"), least, parts))
    counts = met.groupBy("id").agg(F.sum("n").alias("n"))
    found = components(met.select(F.col("id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("component", "c")
    named = reps.select("id", "of", "weight").join(found, "id", "left").withColumn("c", F.coalesce("c", "id"))
    first = named.groupBy("c").agg(F.min("of").alias("component_id"))
    per_class = named.join(first, "c").join(counts, "id", "left").select("id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = all_rows.select("vec_id", "id").join(per_class, "id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors of the whole embeddings table, as near_vectors."""
    ship(spark)
    return near_vectors(table(spark, sf_dir, "embeddings"))
