"""Nearest neighbours by an inverted file with product codes.

Unit vectors are dealt to cells by the nearest of some centroids; what is left of a vector beside its centroid is kept as a
code of a byte for every few dimensions. k-means for both runs distributed over a bounded sample; every row is indexed. A
query visits its nearest cells: table look-ups score all codes of a cell, the best are scored exactly from the vector beside
the code. How many cells are visited follows from the sample and the recall asked for.

Answers can be made exact: a stored length of the coding error bounds every look-up (Cauchy-Schwarz), so within a cell all
rows that could reach the k-th score are scored; and the greatest angle in a cell bounds what its rows can reach, so a second
visit takes in every cell that may still hold one of the k.

Queries are a table and never on the driver. A cell with many rows or many queries is many groups: rows are dealt to parts,
queries to blocks, and each part meets each block once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import matrix, packed
from ..session import shared_dir
from .search import best_of, places, ranked

#: Cells follow the square root of the rows up to this number; sampled rows for each cell; dimensions of a byte; values of a byte.
MOST_CELLS, SAMPLED, WIDTH, VALUES = 4096, 64, 4, 256
#: Steps of k-means; vectors that the number of visits is measured on; share of neighbours that visits must reach there.
STEPS, MEASURED, RECALL = 4, 4096, 0.97
#: Rows of a part and queries of a block; neighbours scored exactly for each one asked for.
PART, BLOCK, DEEP = 16_384, 4096, 16

_ROWS = "cell int, code binary, err double, v binary"


def _parts(x: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """(n, parts, width), with zeros behind the last dimensions."""
    more = -x.shape[1] % width
    return np.pad(x, ((0, 0), (0, more))).reshape(len(x), -1, width)


#: Most numbers of a table that a task makes at once, of rows by centres or of queries by codes: 8 MB.
NUMBERS = 1 << 20


def _slices(n: int, wide: int) -> list[slice]:
    """n rows in runs whose tables of `wide` numbers a row have NUMBERS numbers at most."""
    step = max(1, NUMBERS // max(1, wide))
    return [slice(i, i + step) for i in range(0, n, step)]


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre in each subspace: x (n, m, d), centres (m, k, d) -> (n, m)."""
    half, out = (centres**2).sum(2) / 2, np.zeros(x.shape[:2], np.int64)
    for s in _slices(len(x), centres.shape[1]):
        for j in range(x.shape[1]):
            out[s, j] = (x[s, j] @ centres[j].T - half[j]).argmax(1)
    return out


def _cells(x: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The cell of each row: that of greatest product."""
    out = np.zeros(len(x), np.int64)
    for s in _slices(len(x), len(cells)):
        out[s] = (x[s] @ cells.T).argmax(1)
    return out


def k_means(rows: DataFrame, dim: int, centres: np.ndarray, steps: int, cells: np.ndarray | None = None) -> np.ndarray:
    """Lloyd's steps over rows (v), or over what `cells` leave of them in subspaces; sums are made in each task, centres (m, k, d) come to the driver."""
    m, k, d = centres.shape

    def sums(centres: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((m * k, d)), np.zeros(m * k, np.int64)
            for b in batches:
                x = matrix(b.column(0), dim)
                if cells is not None:
                    x = x - cells[_cells(x, cells)]
                x = x[:, None] if m == 1 and d == dim else _parts(x)
                of = _closest(x, centres) + np.arange(m) * k
                np.add.at(total, of.ravel(), x.reshape(-1, d))
                n += np.bincount(of.ravel(), minlength=m * k)
            u = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int32)), pa.array(n[u]), pa.array(list(total[u]), pa.list_(pa.float64()))], ["c", "n", "s"])

        return run

    for _ in range(steps):
        one = rows.select("v").mapInArrow(sums(centres), "c int, n long, s array<double>")
        all_ = one.select("c", "n", F.posexplode("s").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        got = all_.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("s"), F.max("n").alias("n")).collect()
        centres = centres.copy().reshape(m * k, d)
        for r in got:  # a centre that no row is near to stays
            centres[r["c"]] = np.array(r["s"]) / r["n"]
        centres = centres.reshape(m, k, d)
    return centres


@dataclass
class Model:
    """What tasks need: unit centroids (cells, dim), code centres (parts, values, width), how many cells a query visits for RECALL."""

    cells: np.ndarray
    codes: np.ndarray
    visits: int

    @property
    def dim(self) -> int:
        return self.cells.shape[1]


@dataclass
class Index:
    """model, rows (id, cell, code, err, v) and cells {cell: (rows, greatest angle)}."""

    model: Model
    rows: DataFrame
    cells: dict[int, tuple[int, float]]


def fit(vectors: DataFrame, most_cells: int = MOST_CELLS, sampled: int = SAMPLED, recall: float = RECALL, k: int = 10) -> Model | None:
    """From about `sampled` random rows of vectors (id, v) for each cell, of the dimension that most of them have. None where there is no row.

    The driver gets centroids and codes, and MEASURED vectors for the number of visits.
    """
    shared_dir(vectors.sparkSession)
    n = vectors.count()
    if not n:
        return None
    cells = max(1, min(most_cells, math.isqrt(n)))
    drawn = vectors.select("v").where(F.rand(17) < max(MEASURED, cells * sampled) / n).checkpoint()
    some = [r["v"] for r in drawn.limit(max(MEASURED, cells)).collect()]
    size = Counter(map(len, some)).most_common(1)[0][0]
    dim, drawn = size // 8, drawn.where(F.octet_length("v") == size)
    x = matrix(pa.array([v for v in some if len(v) == size]), dim)
    rng = np.random.default_rng(17)
    start = x[rng.permutation(len(x))[:cells]]
    centroids = k_means(drawn, dim, start[None], STEPS)[0]
    lengths = np.linalg.norm(centroids, axis=1, keepdims=True)
    centroids = np.where(lengths > 1e-9, centroids / np.maximum(lengths, 1e-9), start)
    left = _parts(x - centroids[(x @ centroids.T).argmax(1)])
    values = min(VALUES, len(x))
    codes = np.ascontiguousarray(left[rng.permutation(len(x))[:values]].transpose(1, 0, 2))
    codes = k_means(drawn, dim, codes, STEPS, centroids)
    return Model(centroids, codes, _visits(x, centroids, recall, k))


def _visits(x: np.ndarray, centroids: np.ndarray, recall: float, k: int, queries: int = 256) -> int:
    """How many of its nearest cells a query must visit to meet `recall` of its k neighbours, among x."""
    near, cell = x[:queries] @ x.T, (x @ centroids.T).argmax(1)
    near[np.arange(len(near)), np.arange(len(near))] = -2
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    top = np.argpartition(-near, k - 1, 1)[:, :k]
    place = np.argsort(np.argsort(-(x[:queries] @ centroids.T), 1, kind="stable"), 1)
    needed = np.sort(np.take_along_axis(place, cell[top], 1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1


def encode(vectors: DataFrame, model: Model) -> DataFrame:
    """vectors (id, v) with cell, code and err, the length of what the code loses. Vectors of another dimension are left out."""
    shared, kind = vectors.sparkSession.sparkContext.broadcast(model), vectors.schema["id"].dataType.simpleString()  # cells x dim, values x dim: bounded by the parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = matrix(b.column(1), m.dim)
            cell = _cells(x, m.cells)
            left = _parts(x - m.cells[cell])
            code = _closest(left, m.codes)
            err = np.sqrt(((left - m.codes[np.arange(left.shape[1]), code]) ** 2).sum((1, 2))) + 1e-9
            angle = np.arccos(np.clip((x * m.cells[cell]).sum(1), -1, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary()), pa.array(err), b.column(1), pa.array(angle)], ["id", "cell", "code", "err", "v", "angle"])

    return vectors.where(F.octet_length("v") == 8 * model.dim).mapInArrow(run, f"id {kind}, {_ROWS}, angle double")


def build(corpus: DataFrame, path: str, id: str = "id", embedding: str = "embedding", **options) -> None:
    """Writes the index of a corpus under path: `rows` in partitions of the cell, and the small tables `cells` and `codes`."""
    spark, vectors = corpus.sparkSession, packed(corpus, id, embedding)
    model = fit(vectors, **options)
    if model is None:
        model = Model(np.zeros((1, 1)), np.zeros((1, 1, WIDTH)), 1)
    rows = encode(vectors, model)
    # a cell may be many files, so that a hot one is written by many tasks
    rows.write.partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist(), model.visits) for i, c in enumerate(model.cells)], "cell int, centroid array<double>, visits int").coalesce(1).write.parquet(f"{path}/cells")
    spark.createDataFrame([(j, i, c.tolist()) for j, part in enumerate(model.codes) for i, c in enumerate(part)], "part int, value int, centre array<double>").coalesce(1).write.parquet(f"{path}/codes")


def load(spark: SparkSession, path: str, id_type: str = "long") -> Index:
    """A written index. Centroids, codes and a row for each cell come to the driver; all are bounded by the parameters."""
    rows = spark.read.schema(f"id {id_type}, code binary, err double, v binary, angle double, cell int").parquet(f"{path}/rows")
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    codes = spark.read.parquet(f"{path}/codes").orderBy("part", "value").collect()
    parts = 1 + max(r["part"] for r in codes)
    model = Model(np.array([r["centroid"] for r in cells]), np.array([r["centre"] for r in codes]).reshape(parts, len(codes) // parts, -1), cells[0]["visits"])
    held = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()
    return Index(model, rows.drop("angle"), {r["cell"]: (r["n"], r["angle"]) for r in held})


def _asked(queries: DataFrame, index: Index, visits: int, far: bool) -> DataFrame:
    """(qid, q, low, cell) for each cell that a query of queries (qid, q, low) visits: its nearest ones; or, with `far`, those others that can hold a score of `low`."""
    spark = queries.sparkSession
    live = np.array(sorted(index.cells), np.int64)
    reach = np.array([index.cells[c][1] for c in live]) + 1e-7
    shared, kind = spark.sparkContext.broadcast((index.model.cells[live], live, reach)), queries.schema["qid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, names, angles = shared.value
        for b in (b.slice(part.start, part.stop - part.start) for b in batches if len(names) for part in _slices(b.num_rows, len(names))):
            s = matrix(b.column(1), centroids.shape[1]) @ centroids.T
            near = np.zeros(s.shape, bool)
            np.put_along_axis(near, np.argsort(-s, 1, kind="stable")[:, :visits], True, 1)
            if far:
                best = np.cos(np.maximum(np.arccos(np.clip(s, -1, 1)) - angles, 0))
                near = ~near & (best >= b.column(2).to_numpy()[:, None] - 1e-9)
            row, col = np.nonzero(near)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(names[col].astype(np.int32))], ["qid", "q", "low", "cell"])

    return queries.select("qid", "q", "low").mapInArrow(run, f"qid {kind}, q binary, low double, cell int")


def _visit(index: Index, asked: DataFrame, k: int, exact: bool, part: int, block: int) -> DataFrame:
    """(qid, id, score): the k best of each cell's parts for each query that visits it, of scores from `low` on."""
    spark, model = asked.sparkSession, index.model
    shared = spark.sparkContext.broadcast(model)
    sizes = spark.createDataFrame([(c, -(-n // part)) for c, (n, _) in index.cells.items()], "cell int, parts int")
    layout = asked.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).join(F.broadcast(sizes), "cell")
    layout = F.broadcast(layout)  # a row for each cell: MOST_CELLS at most
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    some = lambda c: F.least(F.floor(F.rand(3) * F.col(c)), F.col(c) - 1).cast("int")
    # drawn once for a row, before it is repeated
    left = index.rows.join(layout, "cell").withColumn("part", some("parts")).select("cell", "part", every("blocks").alias("block"), "id", "code", "err", "v")
    right = asked.join(layout, "cell").withColumn("block", some("blocks")).select("cell", every("parts").alias("part"), "block", "qid", "q", "low")
    kind_q, kind_i = asked.schema["qid"].dataType.simpleString(), index.rows.schema["id"].dataType.simpleString()

    def meet(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        m = shared.value
        ids, qids = rows.column("id").combine_chunks(), queries.column("qid").combine_chunks()
        empty = pa.table({"qid": qids.slice(0, 0), "id": ids.slice(0, 0), "score": pa.array([], pa.float64())})
        if not len(ids) or not len(qids):
            return empty
        x, q = matrix(rows.column("v"), m.dim), matrix(queries.column("q"), m.dim)
        code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
        err, low, cell = rows.column("err").to_numpy(), queries.column("low").to_numpy(), m.cells[key[0].as_py()]
        order = places(ids)
        n, deep = len(x), min(len(x), DEEP * k)
        found_q, found_i, found_s = [], [], []
        step = max(1, NUMBERS // max(n, m.codes.shape[0] * m.codes.shape[1]))
        for i in range(0, len(q), step):
            part = q[i : i + step]
            table = np.einsum("qmd,mkd->qmk", _parts(part), m.codes)
            guess = np.repeat((part @ cell)[:, None], n, 1)
            for j in range(code.shape[1]):
                guess += table[:, j, code[:, j]]
            for r in range(len(part)):
                own = np.argpartition(-guess[r], deep - 1)[:deep]
                s = (x[own] * part[r]).sum(1)
                at = max(low[i + r], np.partition(s, -k)[-k] if len(s) >= k else -2.0)
                if exact:
                    own = np.flatnonzero(guess[r] + err >= at - 1e-9)
                    s = (x[own] * part[r]).sum(1)
                best, s = best_of(own, s, order, k, at)
                found_q.append(np.full(len(best), i + r))
                found_i.append(best)
                found_s.append(s)
        rows_q, rows_i = pa.array(np.concatenate(found_q)), pa.array(np.concatenate(found_i))
        return pa.table({"qid": qids.take(rows_q), "id": ids.take(rows_i), "score": pa.array(np.concatenate(found_s))})

    names = ("cell", "part", "block")
    return left.groupBy(*names).cogroup(right.groupBy(*names)).applyInArrow(meet, f"qid {kind_q}, id {kind_i}, score double")


def nearest(index: Index, queries: DataFrame, k: int, exact: bool = False, visits: int | None = None, part: int = PART, block: int = BLOCK) -> DataFrame:
    """(qid, id, score, rank) of the k rows of greatest cosine for each of queries (qid, vector), ties by id.

    Approximate by default: `visits` cells, as many as the index was fitted for. With exact, the rows that brute force gives.
    Queries without a direction or of another dimension, and an empty index, have no rows; a qid that stands twice is two
    queries whose rows are merged.
    """
    shared_dir(queries.sparkSession)
    asked = packed(queries, "qid", "vector", "qid").where(F.octet_length("v") == 8 * index.model.dim)
    asked = asked.select("qid", F.col("v").alias("q"), F.lit(-2.0).alias("low"))
    visits = visits or index.model.visits
    found = ranked(_visit(index, _asked(asked, index, visits, False), k, exact, part, block), k)
    if not exact:
        return found
    found = found.checkpoint()
    low = found.where(F.col("rank") == k).select("qid", F.col("score").alias("_low"))
    again = asked.join(low, "qid", "left").select("qid", "q", F.coalesce("_low", "low").alias("low"))
    more = _visit(index, _asked(again, index, visits, True), k, True, part, block)
    return ranked(found.drop("rank").unionByName(more), k)
