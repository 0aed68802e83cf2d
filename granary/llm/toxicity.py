"""Toxicity by class-conditional Kneser-Ney language models.

One bigram model for toxic and one for ordinary text, interpolated down to shared backoff counts. Counts are types at either
order: a pair counts the different words before it, a word the different words before it, texts that hold it at most. A line
repeated in one text, or a passage copied through many, is one witness. Occurrences at the upper order, as is usual, learn the
copies of a text by heart instead (figures in the README).

What an n-gram's count in a class has above its discount is that class's own; the discount, DISCOUNT counts of the smaller
class and EXCESS times what the other class's rate would give, goes to the order below, and at the lowest to the shared
counts. So an expression that is rare, or alike in both classes, has the same probability in both up to a constant, every
count is in the sums, and the probabilities after any context sum to one.

A text's evidence is the difference of its length-normalised log-likelihoods: the mean log ratio over all of its words. A
monotone curve fitted on labelled rows that the models have not seen makes it a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, ship, table
from .textkit import PLAIN, Words, thrifty, words

#: The discount of an n-gram: counts of the smaller class, and times the other class's rate; that of the shared counts.
DISCOUNT, EXCESS, SHARED = 4.0, 4.0, 0.75
#: Bound in expectation, for each class, of the labelled sample that a quarter of is kept for the curve. Whole texts are used.
SAMPLE = 4000
#: Bytes of text for each shard of the counts, and counted at once.
SHARD, COUNTED = 4 << 20, 3 << 20
#: Labels that are joined by broadcast; more are joined by shuffle.
MOST_LABELS = 1_000_000

_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def _ids(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(previous word, word) of each word, as 48 bits of their hashes; a text's first word follows 0."""
    word, before = w.hash >> np.uint64(16), np.zeros(w.n, np.uint64)
    before[1:] = np.where(w.row[1:] == w.row[:-1], word[:-1], np.uint64(0))
    return before, word


#: Bytes of a packed triple: previous word, word, and 23 bits of the word before them with the class.
_TRIPLE = 15
_BITS = np.uint64((1 << 23) - 1)


def _squeeze(h: np.ndarray, w: np.ndarray, g: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty((len(h), _TRIPLE), np.uint8)
    out[:, :6], out[:, 6:12] = (x.view(np.uint8).reshape(-1, 8)[:, :6] for x in (h, w))
    out[:, 12:] = ((g & _BITS) << np.uint64(1) | c).view(np.uint8).reshape(-1, 8)[:, :3]
    return out


def _unsqueeze(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous word, word, word before them with the class in the last bit)."""
    out = np.zeros((3, len(b), 8), np.uint8)
    out[0, :, :6], out[1, :, :6], out[2, :, :3] = b[:, :6], b[:, 6:12], b[:, 12:]
    return tuple(x.view(np.uint64)[:, 0] for x in out)


def one_label(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): labels 0 and 1, one row for each document (1 if any says so)."""
    return labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sample_labels(labels: DataFrame, bound: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """one_label(labels), thinned by hash to `bound` a class; rows of each class."""
    one = one_label(labels)
    n = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    scale = 1 << 20
    keep = F.pmod(F.xxhash64("doc_id"), F.lit(scale))
    limit = {c: int(scale * min(1.0, bound / max(1, n.get(c, 0)))) for c in (0, 1)}
    return one.where(keep < F.when(F.col("toxic") == 1, limit[1]).otherwise(limit[0])), n


def ratios(size: dict[int, float]) -> np.ndarray:
    """Of each class's size to the other's; without text in one of them nothing can be told apart: infinite."""
    a, b = (float(size.get(c, 0) or 0) for c in (0, 1))
    return np.array([a / b, b / a]) if a and b else np.full(2, np.inf)


def excess(n: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """What counts (n-grams, 2) have above their discounts. It depends on the n-gram's own two counts alone.

    Types grow about with the root of the text that they are in, so the other class's count is scaled by the root of `ratio`.
    """
    if not np.isfinite(ratio).all():
        return np.zeros(n.shape)
    return np.maximum(n - (DISCOUNT * np.maximum(ratio, 1) + EXCESS * n[:, ::-1] * np.sqrt(ratio)), 0)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their rows of values."""
    u, at = np.unique(keys, return_inverse=True)
    return u, np.column_stack([np.bincount(at, values[:, j], len(u)) for j in range(values.shape[1])]) if len(u) else np.zeros((0, values.shape[1]))


def _dealt(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by shard, then key, and the place where each shard starts in it (shards + 1)."""
    s = keys % np.uint64(shards)
    o = np.lexsort((keys, s))
    return o, np.searchsorted(s[o], np.arange(shards + 1, dtype=np.uint64))


def _read(b, kind, width: int = 0) -> np.ndarray:
    out = np.frombuffer(b.as_py(), kind)
    return out.reshape(-1, width) if width else out


#: Packed n-grams of a shard. Kind 0: words and their values; 1: pairs (previous word, word) that have an excess, and their
#: counts in each class; 2: words and the texts that hold them in each class.
_PACKED = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("k", pa.binary()), ("v", pa.binary())])
_DDL = "kind int, shard int, k binary, v binary"
#: Values of a word: different predecessors in each class; counts of the pairs that it begins, in each class; whether such a
#: pair, or one that it ends, has an excess.
_WORD = 5


def _pack(kind: int, keys: np.ndarray, values: np.ndarray, shards: int) -> list[tuple]:
    """Rows of _PACKED: keys with their values by the keys' shards."""
    o, start = _dealt(keys, shards)
    keys, values = keys[o], values[o]
    return [(kind, j, keys[a:z].tobytes(), values[a:z].astype(np.int32).tobytes()) for j, (a, z) in enumerate(zip(start, start[1:])) if z > a]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def count(rows: DataFrame, ratio: np.ndarray, shards: int) -> DataFrame:
    """Packed counts of rows (text, toxic): parts of the sums over all pairs by word, the pairs that have an excess, texts by word.

    Triples (word before, previous word, word) are made distinct in each batch first, then by shard of the pair's hash. What a
    shard's pairs say about their words goes to the words' own shards, so a frequent word is a sum of one part a shard.
    """

    sent = pa.schema([("shard", pa.int32()), ("triples", pa.binary()), ("k", pa.binary()), ("v", pa.binary())])

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            for i, _, x in words(b.column(0), lower=True, most=COUNTED, apart=PLAIN):
                if not x.n:
                    continue
                (h, word), g = _ids(x), np.zeros(x.n, np.uint64)
                g[1:] = np.where(x.row[1:] == x.row[:-1], h[:-1], np.uint64(0))
                c = toxic[i + x.row].astype(np.uint64)
                key = _key(h, word)
                _, first = np.unique(_key(key, (g & _BITS) << np.uint64(1) | c), return_index=True)
                order, start = _dealt(key[first], shards)
                first = first[order]
                triples = _squeeze(h[first], word[first], g[first], c[first])
                some = [(j, triples[a:z].tobytes()) for j, (a, z) in enumerate(zip(start, start[1:])) if z > a]
                _, one = np.unique(_key(x.row.astype(np.uint64), word), return_index=True)  # a word once a text
                texts = _pack(2, *_sums(word[one], np.column_stack([c[one] == k for k in (0, 1)])), shards)
                rows = [(j, t, b"", b"") for j, t in some] + [(j, b"", k, v) for _, j, k, v in texts]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), sent)], schema=sent)

    def merge(t: pa.Table) -> pa.Table:
        triples, k, v = (np.concatenate([_read(x, kind) for x in t[name]]) for name, kind in (("triples", np.uint8), ("k", np.uint64), ("v", np.int32)))
        shard, rows = t["shard"][0].as_py(), []
        if len(k):
            k, v = _sums(k, v.reshape(-1, 2))
            rows.append((2, shard, k.tobytes(), v.astype(np.int32).tobytes()))
        if len(triples):
            h, w, g = _unsqueeze(triples.reshape(-1, _TRIPLE))
            key = _key(h, w)
            _, first = np.unique(_key(key, g), return_index=True)
            h, w, c = h[first], w[first], g[first] & np.uint64(1)
            key, first, at = np.unique(key[first], return_index=True, return_inverse=True)
            n = np.column_stack([np.bincount(at[c == j], minlength=len(key)) for j in (0, 1)]).astype(np.int32)
            h, w = h[first], w[first]
            own = (excess(n, ratio) > 0).any(1)
            kinds, none, needed = (n > 0).astype(float), np.zeros((len(h), 2)), own[:, None].astype(float)
            rows.append((1, shard, np.column_stack([h, w])[own].tobytes(), n[own].tobytes()))
            rows += _pack(0, *_sums(np.concatenate([w, h]), np.concatenate([np.column_stack([kinds, none, needed]), np.column_stack([none, n, needed])])), shards)
        return _table(rows, _PACKED)

    counted = rows.select("text", F.col("toxic").cast("int")).mapInArrow(run, "shard int, triples binary, k binary, v binary")
    return counted.groupBy("shard").applyInArrow(merge, _DDL)


def total(counted: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Words that have an excess or are in a pair that has one, their parts added up; each shard's sums over all words; the pairs."""
    schema = pa.schema([*_PACKED, *((c, pa.float64()) for c in ("size", "k0", "k1", "e0", "e1"))])

    def run(t: pa.Table) -> pa.Table:
        rows = [(1, s.as_py(), k.as_py(), v.as_py(), *[0.0] * 5) for kind, s, k, v in zip(*t.select(_PACKED.names)) if kind.as_py() == 1]
        own, held = (t.filter(pa.compute.equal(t["kind"], i)) for i in (0, 2))
        if len(own):
            x, v = _sums(np.concatenate([_read(k, np.uint64) for k in own["k"]]), np.concatenate([_read(b, np.int32, _WORD) for b in own["v"]]))
            of, texts = _sums(np.concatenate([_read(k, np.uint64) for k in held["k"]]), np.concatenate([_read(b, np.int32, 2) for b in held["v"]]))
            v[:, :2] = np.minimum(v[:, :2], _find(of, x, texts, np.zeros(2)))
            k = v[:, :2]
            e = excess(k, ratio)
            sums = [float((k.sum(1) > 0).sum()), *k.sum(0).tolist(), *e.sum(0).tolist()]
            some = (e > 0).any(1) | (v[:, 4] > 0)
            rows.append((0, own["shard"][0].as_py(), x[some].tobytes(), v[some].tobytes(), *sums))
        return _table(rows, schema)

    return counted.groupBy("shard").applyInArrow(run, f"{_DDL}, size double, k0 double, k1 double, e0 double, e1 double")


def gather(rows: DataFrame, ratio: np.ndarray, shards: int) -> tuple:
    """What the models need of rows (text, toxic): (totals, words, pairs) as pandas frames.

    Sums over all n-grams are made in Spark. The driver gets those that speak for a class, and the words in such pairs; all
    others have the shared probability times a constant, which the sums give.
    """
    packed = total(count(rows, ratio, shards), ratio).toPandas()
    words_of, pairs_of = packed[packed["kind"] == 0], packed[packed["kind"] == 1]
    join = lambda c, kind, width: np.concatenate([np.zeros((0, width), kind), *(np.frombuffer(b, kind).reshape(-1, width) for b in c)])
    x, v = join(words_of["k"], np.int64, 1)[:, 0], join(words_of["v"], float, _WORD)
    hw, n = join(pairs_of["k"], np.int64, 2), join(pairs_of["v"], np.int32, 2).astype(float)
    own = pd.DataFrame({"w": x, "k0": v[:, 0], "k1": v[:, 1], "s0": v[:, 2], "s1": v[:, 3]})
    return words_of[["size", "k0", "k1", "e0", "e1"]].sum(), own, pd.DataFrame({"h": hw[:, 0], "w": hw[:, 1], "n0": n[:, 0], "n1": n[:, 1]})


class Model:
    """Sorted hashes with probabilities of both classes: p (words, 2), carry (contexts, 2), add (pairs, 2); then the curve.

    p is relative to the shared probability of the word where the word is not in the table: the ratio of the classes is what
    counts, and there it is that of `spare`, the mass that each class leaves to the shared counts.
    """

    def __init__(self, totals, own, pairs, ratio: np.ndarray) -> None:
        two = lambda f, x: f[[x + "0", x + "1"]].to_numpy(float)
        key = lambda f, c: f[c].to_numpy(np.int64).view(np.uint64)
        size, kinds = float(totals["size"]), np.array([totals["k0"], totals["k1"]], float)
        both, of = max(kinds.sum(), 1.0), np.maximum(kinds, 1.0)
        self.unknown = SHARED * size / both / (size + 1) if size else 1.0
        self.spare = 1 - np.array([totals["e0"], totals["e1"]], float) / of
        k = two(own, "k")
        self.shared = np.maximum(k.sum(1) - SHARED, 0) / both + self.unknown
        p = excess(k, ratio) / of + self.spare * self.shared[:, None]
        o = np.argsort(key(own, "w"))
        self.word, self.p, self.shared, begun = key(own, "w")[o], p[o], self.shared[o], two(own, "s")[o]
        e = excess(two(pairs, "n"), ratio)
        h, lost = _sums(key(pairs, "h"), e)
        total = np.maximum(_find(self.word, h, begun, np.ones(2)), 1)
        self.context, self.carry = h, 1 - lost / total
        add = e / np.maximum(_find(self.word, key(pairs, "h"), begun, np.ones(2)), 1)
        pair = _key(key(pairs, "h"), key(pairs, "w"))
        o = np.argsort(pair)
        self.pair, self.add = pair[o], add[o]
        self.x, self.y = np.zeros(1), np.zeros(1)

    @property
    def base(self) -> float:
        """The log ratio of a word that speaks for no class, and of a text without words."""
        return float(np.log(self.spare[1]) - np.log(self.spare[0]))

    def probabilities(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """(words, 2), after the words `before`; of words outside of the table relative to their shared probability."""
        p = _find(self.word, word, self.p, self.spare)
        return p * _find(self.context, before, self.carry, np.ones(2)) + _find(self.pair, _key(before, word), self.add, np.zeros(2))

    def features(self, w: Words, n: int) -> np.ndarray:
        """(texts,): the difference of the length-normalised log-likelihoods, toxic less ordinary, of whole texts."""
        out = np.full(n, self.base)
        if w.n:
            p = np.log(self.probabilities(*_ids(w)))
            total = np.concatenate([[0.0], np.cumsum(p[:, 1] - p[:, 0])])
            num = np.diff(w.first)
            some = np.flatnonzero(num)
            out[some] = (total[w.first[some + 1]] - total[w.first[some]]) / num[some]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """The monotone curve of least squares (pool adjacent violators), straight between its steps.

        Without both classes it is flat: 1 for toxic texts alone, else 0.
        """
        if len(set(y.tolist())) < 2:
            self.x, self.y = np.zeros(1), np.full(1, float(len(y) > 0 and y[0] == 1))
            return
        x = np.round(x, 12)  # sums in another order are equal evidence
        at, of = np.unique(x, return_inverse=True)
        mass = np.bincount(of, weight)
        steps: list[list[float]] = []  # from, to, mean, mass
        for a, p, m in zip(at.tolist(), (np.bincount(of, weight * y) / mass).tolist(), mass.tolist()):
            steps.append([a, a, p, m])
            while len(steps) > 1 and steps[-2][2] >= steps[-1][2]:
                _, to, p, m = steps.pop()
                last = steps[-1]
                last[1:] = [to, (last[2] * last[3] + p * m) / (last[3] + m), last[3] + m]
        self.x = np.array([v for s in steps for v in s[:2]])
        self.y = np.array([s[2] for s in steps for _ in range(2)])


def _key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h * _PAIR) ^ (w + (h >> np.uint64(29)))


def _find(keys: np.ndarray, x: np.ndarray, values: np.ndarray, default: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.broadcast_to(default, (len(x), 2)).copy()
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where((keys[i] == x)[:, None], values[i], default)


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """Models from all labelled texts but a quarter of about `bound` texts of each class, from which the curve is.

    Null and empty texts have no n-grams; a doc_id that is labelled both ways is toxic. docs may hold texts that must not be learned from only if labels doesn't name them. The ids of the quarter are joined
    by broadcast: their number is bounded by `bound`, whatever the input.
    """
    sample, n = sample_labels(labels, bound)
    aside = sample.where(F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(4)) == 0)
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    own = one_label(labels).join(F.broadcast(aside), "doc_id", "left_anti")
    learned = texts.join(F.broadcast(own) if sum(n.values()) <= MOST_LABELS else own, "doc_id")
    size = {r["toxic"]: r["n"] for r in learned.groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    ratio, shards = ratios(size), 1 + int(sum(x or 0 for x in size.values()) // SHARD)
    model = Model(*gather(learned, ratio, shards), ratio)
    held = describe(texts.join(F.broadcast(aside), "doc_id").select("text", "toxic"), model, "toxic").toPandas()  # bounded by `bound`
    y = held["key"].to_numpy(float)
    have = np.array([(y == k).sum() for k in (0, 1)])
    # as in all labelled rows, where classes need not be as even as in the sample
    weight = np.array([n.get(k, 0) / max(1, have[k]) for k in (0, 1)])
    weight = weight / max(weight.sum(), 1e-9)
    model.calibrate(held["evidence"].to_numpy(), y, weight[y.astype(int)])
    return model


def _evidence(model: Model, texts: pa.Array) -> np.ndarray:
    x = [model.features(w, j - i) for i, j, w in words(texts, lower=True, apart=PLAIN)]
    return np.round(np.concatenate(x), 12) if x else np.zeros(0)


def describe(docs: DataFrame, model: Model, key: str) -> DataFrame:
    """(key, evidence, score) of whole texts, row by row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n-grams that speak for a class

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _evidence(shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x), pa.array(shared.value.score(x))], ["key", "evidence", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs["text"]).mapInArrow(run, f"key {kind}, evidence double, score double")


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, score, predicted): null and empty texts have no evidence; repeated rows stay repeated; a score of 0.5 is predicted 1."""
    return describe(docs, model, key).select(F.col("key").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that score 0.5 or more, all columns as they were. Rows are judged where they are read: no shuffle.

    Rows with null or empty texts and without doc_id are judged like any others; repeated rows go or stay together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score(_evidence(shared.value, b.column(at))) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns labels where crc32(doc_id) mod 5 is not 0 and scores every document; a row without doc_id is not held out."""
    ship(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
