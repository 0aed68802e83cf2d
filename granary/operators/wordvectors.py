"""An embedder fitted to the corpus: word vectors from positive mutual information by a randomised decomposition.

Words near each other are counted over all rows; counts are whole numbers, so no order of adding changes them. The matrix of
positive mutual information stays distributed, a row of it for each word; its leading part is found by multiplying it with a
few dense columns, which are all that the driver holds (MOST_WORDS x (dimensions + EXTRA) numbers). A text's vector is the mean of
its words', frequent ones weighing less.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import shared_dir

#: Words of the vocabulary at most, occurrences of each at least, words on either side that are near.
MOST_WORDS, LEAST, WINDOW = 4000, 5, 4
#: Columns beyond the dimensions, and multiplications after the first, of the decomposition.
EXTRA, POWERS = 32, 5
#: Weight of a word of share p in a text: SMOOTH / (SMOOTH + p).
SMOOTH = 1e-3

_TOKEN = re.compile("[a-z0-9]+")


def vocabulary(docs: DataFrame, text: str = "content", most: int = MOST_WORDS, least: int = LEAST) -> list[tuple[str, int]]:
    """(word, occurrences) of the most frequent words, ties by word: `most` rows on the driver."""
    n = docs.select(F.explode(words(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return [(r["word"], r["n"]) for r in n.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect()]


def cooccurrences(docs: DataFrame, vocabulary: list[str], text: str = "content", window: int = WINDOW, block: int = 1 << 20) -> DataFrame:
    """(i, j, n), i <= j: how often two words of the vocabulary stand within `window` words of each other, whatever stands between.

    Pairs are summed over blocks of about `block` words before the shuffle; a pair's rows meet by (i, j), so that no word is one task's.
    """
    number = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, held, n = number.value.get, [], 0

        def out() -> pa.RecordBatch:
            t = np.concatenate(held) if held else np.zeros(0, np.int64)
            found = []
            for d in range(1, window + 1):
                a, b = t[:-d], t[d:]
                good = (a >= 0) & (b >= 0)
                a, b = a[good], b[good]
                found.append(np.minimum(a, b) * size + np.maximum(a, b))
            pair, n = np.unique(np.concatenate(found), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((pair // size).astype(np.int32)), pa.array((pair % size).astype(np.int32)), pa.array(n.astype(np.int64))], ["i", "j", "n"])

        gap = np.full(window, -1, np.int64)  # texts are not near each other
        for b in batches:
            for t in b.column(0):
                own = np.array([get(w, -1) for w in _TOKEN.findall(t.as_py() or "")], np.int64)
                held += [own, gap]
                n += len(own)
                if n > block:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    return docs.select(F.lower(text).alias("t")).where("t is not null").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


def mutual_information(pairs: DataFrame) -> DataFrame:
    """(i, j, x), both ways round: the positive logarithm of how much likelier a pair is than chance. The counts are kept, since they are used three times."""
    shared_dir(pairs.sparkSession)
    pairs = pairs.checkpoint()
    both = pairs.unionByName(pairs.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "n"))
    total = both.groupBy("i").agg(F.sum("n").alias("t"))  # a row for each word of the vocabulary
    all_ = total.agg(F.sum("t").alias("all"))
    met = both.join(F.broadcast(total), "i").join(F.broadcast(total.select(F.col("i").alias("j"), F.col("t").alias("u"))), "j").crossJoin(F.broadcast(all_))
    return met.select("i", "j", F.log(F.col("n").cast("double") * F.col("all") / F.col("t") / F.col("u")).alias("x")).where("x > 0")


def _times(rows: DataFrame, columns: np.ndarray) -> np.ndarray:
    """The product of the matrix of rows (i, at, x) with dense columns; each row's is summed in one place, in order."""
    shared = rows.sparkSession.sparkContext.broadcast(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            out = [(x.values.to_numpy() @ c[at.values.to_numpy()]).tobytes() for at, x in zip(b.column(1), b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["i", "y"])

    y = np.zeros_like(columns)
    for r in rows.mapInArrow(run, "i int, y binary").collect():
        y[r["i"]] = np.frombuffer(r["y"])
    return y


def decomposed(info: DataFrame, size: int, dim: int, extra: int = EXTRA, powers: int = POWERS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, strengths) of the dim strongest directions of a symmetric matrix (i, j, x): a vector for each of `size` words, a sign for each direction fixed."""
    rows = info.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("r")).select("i", F.col("r")["j"].alias("at"), F.col("r")["x"].alias("x")).checkpoint()
    columns = min(size, dim + extra)
    q = np.random.default_rng(seed).normal(size=(size, columns))
    for _ in range(powers + 1):
        q, _ = np.linalg.qr(_times(rows, q))
    small = q.T @ _times(rows, q)
    strength, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-np.abs(strength), kind="stable")[:dim]
    u = q @ turn[:, best]
    u *= np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0) if size else 1.0
    return u * np.sqrt(np.abs(strength[best])), strength[best]


@dataclass
class WordVectors:
    """An embedder: a callable from texts to unit rows, zeros for texts without a word that it knows."""

    words: dict[str, int]
    vectors: np.ndarray
    weights: np.ndarray

    @property
    def dim(self) -> int:
        return self.vectors.shape[1]

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            at = [i for w in _TOKEN.findall((text or "").lower()) if (i := self.words.get(w)) is not None]
            if at:
                row += self.weights[at] @ self.vectors[at]
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 1e-12)

    def embed(self, text: str) -> list[float]:
        return self([text])[0].tolist()


def fit(docs: DataFrame, text: str = "content", dim: int = 64, most: int = MOST_WORDS, least: int = LEAST, window: int = WINDOW) -> WordVectors:
    """From all rows of docs; null texts count as none. A corpus of fewer words than dim gets as many dimensions as words."""
    shared_dir(docs.sparkSession)
    found = vocabulary(docs, text, most, least)
    names = [w for w, _ in found]
    if not names:
        return WordVectors({}, np.zeros((0, dim)), np.zeros(0))
    vectors, _ = decomposed(mutual_information(cooccurrences(docs, names, text, window)), len(names), dim)
    n = np.array([c for _, c in found], float)
    return WordVectors({w: i for i, w in enumerate(names)}, vectors, SMOOTH / (SMOOTH + n / n.sum()))
