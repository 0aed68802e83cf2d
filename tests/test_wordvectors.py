"""Word vectors against a whole decomposition, and the same in any partitioning."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions.vector import HashingEmbedder
from granary.operators import wordvectors as W


@pytest.fixture(scope="module")
def docs(spark, sf):
    base = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("text").alias("content"))
    return base.unionByName(spark.createDataFrame([(None,), ("",), ("one",), ("the the the",)], "content string")).cache()


def brute(docs, names, window=4):
    at, n = {w: i for i, w in enumerate(names)}, Counter()
    for r in docs.collect():
        t = [at.get(w) for w in re.findall("[a-z0-9]+", (r["content"] or "").lower())]
        for i, a in enumerate(t):
            for b in t[i + 1 : i + 1 + window]:
                if a is not None and b is not None:
                    n[min(a, b), max(a, b)] += 1
    return n


def matrix(n, size):
    m = np.zeros((size, size))
    for (a, b), c in n.items():
        m[a, b] = m[b, a] = c
    t = m.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.log(m * t.sum() / t[:, None] / t[None])
    return np.where(np.isfinite(x) & (x > 0), x, 0)


def test_counts_and_information(docs):
    found = W.vocabulary(docs, most=300)
    plain = Counter(w for r in docs.collect() for w in re.findall("[a-z0-9]+", (r["content"] or "").lower()))
    assert found == sorted(((w, c) for w, c in plain.items() if c >= 5), key=lambda x: (-x[1], x[0]))[:300]
    names = [w for w, _ in found]
    want = brute(docs, names)
    for block in (50, 1 << 20):
        pairs = W.cooccurrences(docs, names, block=block)
        assert {(r["i"], r["j"]): r["n"] for r in pairs.collect()} == dict(want)
    x = matrix(want, len(names))
    got = np.zeros_like(x)
    for r in W.mutual_information(pairs).collect():
        got[r["i"], r["j"]] = r["x"]
    assert np.allclose(got, x)


def test_against_a_whole_decomposition(docs):
    names = [w for w, _ in W.vocabulary(docs, most=400)]
    x = matrix(brute(docs, names), len(names))
    vectors, strength = W.decomposed(W.mutual_information(W.cooccurrences(docs, names)), len(names), 24)
    u, s, _ = np.linalg.svd(x)
    # four directions stand out; the rest are close to each other
    assert np.allclose(np.abs(strength[:4]), s[:4], rtol=1e-4) and np.allclose(np.abs(strength), s[:24], rtol=0.1) and s[4] < 0.5 * s[3]
    own = vectors[:, :4] / np.linalg.norm(vectors[:, :4], axis=0)
    assert np.linalg.svd(u[:, :4].T @ own)[1].min() > 0.9999


def test_same_in_any_partitioning(docs):
    a, b = (W.fit(docs.repartition(n), dim=16, most=200) for n in (1, 7))
    assert a.words == b.words and np.array_equal(a.vectors, b.vectors) and np.array_equal(a.weights, b.weights)
    texts = ["the license of the work", "", None, "zzz qqq"]
    assert np.array_equal(a(texts), b(texts)) and np.allclose(np.linalg.norm(a(texts), axis=1), [1, 0, 0, 0]) and a.embed("the") == a(["the"])[0].tolist()


def test_small_corpora(spark):
    none = spark.createDataFrame([], "content string")
    assert W.fit(none)(["a"]).shape == (1, 64)
    e = W.fit(spark.createDataFrame([("a b " * 9,), ("c",)], "content string"), dim=8)
    assert set(e.words) == {"a", "b"} and e(["a b"]).shape[1] == e.dim <= 8


def test_words_used_alike_are_near(spark):
    rng = np.random.default_rng(1)
    pick = lambda xs: xs[rng.integers(len(xs))]
    texts = [f"the {pick(['cat', 'dog'])} eats {pick(['meat', 'fish'])} while the {pick(['car', 'truck'])} burns {pick(['fuel', 'oil'])}" for _ in range(600)]
    e = W.fit(spark.createDataFrame([(t,) for t in texts], "content string"), dim=6, window=2)
    cos = lambda a, b: float(e([a])[0] @ e([b])[0])
    assert cos("cat", "dog") > 0.9 > cos("cat", "truck") and cos("car", "truck") > 0.9


def test_hashing_embedder():
    e = HashingEmbedder(64)
    m = e(["a b a", "", None, "A-b A!"])
    assert np.allclose(np.linalg.norm(m, axis=1), [1, 0, 0, 1]) and np.array_equal(m[0], m[3])
