"""Vector functions. Products are summed in double precision, in order, so results do not hang on the plan."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no direction or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when((n > 0) & (F.size(a) == F.size(b)), dot(a, b) / n)


def packed(df: DataFrame, id: str, vector: str, name: str = "id") -> DataFrame:
    """(name, v): unit vectors as bytes of doubles; rows whose vector is null, has no direction or a component that is null or not finite are left out."""
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            at, flat = np.asarray(lists.offsets), lists.values.to_numpy(zero_copy_only=False)
            norms = np.sqrt(np.add.reduceat(np.append(flat * flat, 0.0), np.minimum(at[:-1], len(flat)))) if len(lists) else np.zeros(0)
            good = (np.diff(at) > 0) & np.isfinite(norms) & (norms > 0)
            keep = pa.array(np.flatnonzero(good))
            v = [(flat[at[i] : at[i + 1]] / norms[i]).tobytes() for i in np.flatnonzero(good)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), pa.array(v, pa.binary())], [name, "v"])

    rows = df.select(F.col(id).alias(name), as_double(vector).alias("v")).where("v is not null and not exists(v, x -> x is null)")
    return rows.mapInArrow(run, f"{name} {kind}, v binary")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def batch_cosine(query: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Cosines of one query with many rows; empty in, empty out; NaN where a vector has no direction."""
    if not len(docs):
        return np.zeros(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (docs @ query) / (np.linalg.norm(docs, axis=1) * np.linalg.norm(query))


@functools.lru_cache(1 << 16)
def _place(feature: str) -> tuple[int, int]:
    """A number below 2**32 and a sign, from the SHA-256 of a feature."""
    h = hashlib.sha256(feature.encode()).hexdigest()
    return int(h[:8], 16), 1 if h[8] < "8" else -1


class HashingEmbedder:
    """Deterministic default embedder: signed feature hashing of words and word pairs, L2-normalised.

    A feature counts at the number of its SHA-256's first 8 hex digits modulo the dimension, positively if the ninth is below 8.
    Any callable from a list of texts to a matrix of rows can take its place.
    """

    def __init__(self, dim: int = 768) -> None:
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            words = re.findall(r"[a-z0-9]+", (text or "").lower())
            if found := [_place(f) for f in (*words, *map(" ".join, zip(words, words[1:])))]:
                at, sign = np.array(found, np.int64).T
                np.add.at(row, at % self.dim, sign)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)

    def embed(self, text: str) -> list[float]:
        return self([text])[0].tolist()

    def embed_with_hash(self, text: str) -> tuple[list[float], str]:
        return self.embed(text), hashlib.sha256(text.encode()).hexdigest()[:16]


#: Texts that are embedded at once; vectors stay in Arrow's memory, never as Python's numbers.
EMBEDDED = 1024


def embed_column(df: DataFrame, text: str, out: str = "embedding", embedder=None, skip: bool = False) -> DataFrame:
    """df with an embedding column, made in Arrow batches; nulls where `skip` or the text is null."""
    if skip:
        return df.withColumn(out, F.lit(None).cast("array<double>"))
    model = embedder or HashingEmbedder()

    def vectors(texts: pa.Array) -> pa.Array:
        rows = [np.asarray(model([x or "" for x in texts.slice(i, EMBEDDED).to_pylist()]), np.float64) for i in range(0, len(texts), EMBEDDED)]
        flat = np.concatenate([np.zeros(0), *(r.ravel() for r in rows)])
        sizes = np.concatenate([np.zeros(1, np.int64), *(np.full(len(r), r.shape[1]) for r in rows)])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(flat), mask=pc.is_null(texts))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return map(vectors, batches)

    return df.withColumn(out, F.arrow_udf(run, "array<double>", F.ArrowUDFType.SCALAR_ITER)(F.col(text)))
