"""Language identification by error-correcting output codes over hashed byte n-grams.

Every language has a codeword of +1 and -1. For each bit a binary n-gram classifier (naive Bayes log odds, from counts
over all training rows) says on which side of the bit a text lies; loss-weighted decoding picks the codeword at least
loss and flags texts for which the two best codewords are close.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, ship, table
from .textkit import blocks, buffers

#: Buckets for each n-gram order, and the orders in bytes.
BUCKETS, ORDERS = 1 << 13, (1, 2, 3)

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(n, bits) of +1 and -1. Exhaustive up to 6 languages, else the best of 200 seeded random codes by least distance."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        bits = [x for x in itertools.product((1, -1), repeat=n) if x[0] == 1 and -1 in x]
        return np.array(bits, np.int8).T
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, most = None, -1
    for _ in range(200):
        c = rng.choice(np.array([-1, 1], np.int8), (n, width))
        apart = (c[:, None, :] != c[None, :, :]).sum(2)
        if (least := int(apart[~np.eye(n, dtype=bool)].min())) > most:
            best, most = c, least
    return best


def grams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) arrays for one order after the other; runs of blanks and non-letters count as one blank each."""
    d = _FOLD[data]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != 32) | (d[:-1] != 32) | (row[1:] != row[:-1])
    d, row = d[keep].astype(np.uint32), row[keep]
    for k, n in enumerate(ORDERS):
        if len(d) < n:
            continue
        h = np.zeros(len(d) - n + 1, np.uint32)
        for i in range(n):
            h = h * np.uint32(0x01000193) + d[i : len(d) - n + 1 + i]
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 13)
        same = row[: len(h)] == row[n - 1 :]
        yield h[same].astype(np.int64) + k * BUCKETS, row[: len(h)][same]


def counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n) over all rows: summed in each task first, so a task sends at most languages x buckets rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs, (data, at) = np.array(b.column(1).to_pylist(), object), buffers(b.column(0))
            for i, j in blocks(at):
                names, of = np.unique(langs[i:j].astype(str), return_inverse=True)
                size = len(ORDERS) * BUCKETS
                c = np.zeros(len(names) * size, np.int64)
                for bucket, row in grams(data[at[i] : at[j]], at[i : j + 1] - at[i]):
                    c += np.bincount(of[row] * size + bucket, minlength=len(c))
                for k, name in enumerate(names):
                    total[name] = total.get(name, 0) + c[k * size : (k + 1) * size]
        for name, c in total.items():
            u = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(u), pa.string()), pa.array(u.astype(np.int32)), pa.array(c[u])], ["lang", "bucket", "n"])

    return docs.select(docs[text].alias("text"), docs[lang].alias("lang")).where("lang is not null and text is not null").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages, codewords (languages, bits), weights (buckets, bits) and the weight of each bit's loss."""

    def __init__(self, langs: list[str], c: np.ndarray, smooth: float = 0.5) -> None:
        self.langs, self.code = langs, codewords(len(langs))
        share = np.zeros_like(c, float)
        for k in range(len(ORDERS)):
            part = slice(k * BUCKETS, (k + 1) * BUCKETS)
            share[:, part] = (c[:, part] + smooth) / (c[:, part].sum(1, keepdims=True) + smooth * BUCKETS)
        bits = self.code.shape[1]
        self.weights, self.bit_weight = np.zeros((c.shape[1], bits), np.float32), np.ones(bits)
        for b in range(bits):
            plus, minus = share[self.code[:, b] > 0], share[self.code[:, b] < 0]
            if not len(minus):
                continue
            odds = np.log(plus.mean(0)) - np.log(minus.mean(0))
            self.weights[:, b] = odds
            # what a text of each language can expect on this bit: weak bits count for less
            margin = (share @ odds) * self.code[:, b]
            self.bit_weight[b] = max(float(margin.min()), 1e-3)
        self.bit_weight /= self.bit_weight.sum()

    def decide(self, margin: np.ndarray, sharp: float = 4.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's index, score and second-best's score, from the mean log odds (texts, bits)."""
        loss = np.logaddexp(0, -sharp * margin[:, None, :] * self.code[None, :, :]) @ self.bit_weight
        p = np.exp(-(loss - loss.min(1, keepdims=True)) * 4)
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        rows = np.arange(len(p))
        second = p[rows, order[:, 1]] if p.shape[1] > 1 else np.zeros(len(p))
        return order[:, 0], p[rows, order[:, 0]], second


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learns from every row whose text and lang are not null. The driver gets languages x buckets counts at most."""
    got = counts(docs, text, lang).toPandas()
    langs = sorted(got["lang"].unique())
    c = np.zeros((len(langs), len(ORDERS) * BUCKETS))
    c[got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int) if len(got) else [], got["bucket"].to_numpy(int)] = got["n"].to_numpy()
    return Model(langs, c)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", close: float = 0.15) -> DataFrame:
    """(key, lang_pred, score, ambiguous): `und`, 0.0 and false for texts that are null or have no letter.

    With nothing learned, every text is `und`. Only the key and the text are read; a row in, a row out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x bits, buckets x bits: fixed by parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, at = buffers(b.column(1))
            names: list[str] = []
            scores: list[float] = []
            close_calls: list[bool] = []
            for i, j in blocks(at):
                own, to = data[at[i] : at[j]], at[i : j + 1] - at[i]
                n, bits = j - i, m.weights.shape[1]
                total, num = np.zeros((n, bits)), np.zeros(n)
                for bucket, row in grams(own, to):
                    num += np.bincount(row, minlength=n)
                    for k in range(bits):
                        total[:, k] += np.bincount(row, m.weights[:, k][bucket], minlength=n)
                letters = np.bincount(np.repeat(np.arange(n), np.diff(to)), _ASCII_LETTER[own], minlength=n) > 0
                for r in np.flatnonzero(~letters & (np.diff(to) > 0)):
                    letters[r] = any(map(str.isalpha, own[to[r] : to[r + 1]].tobytes().decode("utf-8", "replace")))
                letters &= len(m.langs) > 0
                best, score, second = m.decide(total / np.maximum(num, 1)[:, None]) if m.langs else (np.zeros(n, int), np.zeros(n), np.zeros(n))
                names += [m.langs[x] if y else "und" for x, y in zip(best, letters)]
                scores += np.where(letters, score, 0.0).tolist()
                close_calls += (letters & (score - second < close)).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(close_calls, pa.bool_())], ["key", "lang_pred", "score", "ambiguous"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("key", key)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns where crc32(doc_id) mod 4 is not 2 and predicts every document; a null doc_id is never learned from."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(crc_mod("doc_id", 4) != 2))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
