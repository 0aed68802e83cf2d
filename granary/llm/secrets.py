"""Secrets: three base expressions, and a character convolutional network over every other candidate in its surroundings.

A candidate is a run of token characters that could be a key. The network reads the characters of the whole candidate, window
by window, with those before and after it, and is trained with numpy on labelled findings: every distinct candidate of this
input, labelled by the base expressions, and findings of public key formats and of look-alikes (identifiers, dates, paths,
versions), put in the places of candidates. They are dealt into shards by hash; each shard trains from the same weights, and
the shards' weights are averaged some times. Probabilities are calibrated on all findings that the network was not fitted
to, and each shape of candidate gets the greatest threshold that keeps RECALL of them.

Texts are read once: what is kept of them is the base spans and the candidates with their surroundings.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship, table

# The base expressions and the fewest characters of what they find; letters of names in either case.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "network")

#: Fewest characters of a candidate with a digit, and of one without.
SHORT, LONG = 12, 20
#: Characters read before a candidate, of it in one window, and after it.
BEFORE, WIDE, AFTER = 24, 64, 16
#: Distinct candidates of a shard, about; findings made of each label in every shard; fewest shards.
SHARD, MADE, SHARDS = 2000, 1000, 4
#: Share of calibration findings that thresholds keep; findings of a shape below which the threshold of all shapes holds.
RECALL, FEW = 0.95, 20
#: Times that the network sees each finding, and after how many of them the shards' weights are averaged.
ROUNDS, MEET = 16, 4
#: Steps of a unit of logits in which calibration findings are counted, and the greatest logit told apart.
GRID, FAR = 256, 64
#: Averaged weights are sums of whole numbers of this part of a unit: the same in any order.
UNIT = 2.0**-32

_ASSIGN, _ACCESS, _HEX = (re.compile(r, re.ASCII) for r in (ASSIGN, ACCESS, HEX))
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{SHORT},}}")
_DIGIT, _INNER = re.compile("[0-9]"), re.compile("[a-z][A-Z]|[A-Za-z0-9][+/_=-][A-Za-z0-9]")
_HEXISH, _NUMERIC = re.compile(r"[0-9A-Fa-f-]+\Z"), re.compile(r"[0-9+/_.=-]+\Z")

Span = tuple[str, int, int]


# --- candidates -----------------------------------------------------------------------------------------------------


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by start, then kind as listed: leftmost matches that are long enough, in code points."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of runs of token characters with a digit, or long ones with a case change or a joint; outer dots, dashes and slashes are not part."""
    out = []
    for m in _RUN.finditer(text):
        value = m[0]
        core = value.lstrip("./-=_+").rstrip("./-_+")
        if len(core) >= (SHORT if _DIGIT.search(core) else LONG) and (_DIGIT.search(core) or _INNER.search(core)):
            start = m.start() + value.index(core)
            out.append((start, start + len(core)))
    return out


def shape(value: str) -> int:
    """0 digits and joints only, 1 hexadecimal, 2 any other: what thresholds are chosen for."""
    return 0 if _NUMERIC.match(value) else 1 if _HEXISH.match(value) else 2


_SCANNED = "base array<struct<kind:string,start:long,end:long>>, cand array<struct<start:long,end:long,base:boolean,before:string,value:string,after:string>>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, cand) of each row's whole text; a null text is an empty one. cand says which candidates a base span meets."""
    kind = docs.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    one = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("before", pa.string()), ("value", pa.string()), ("after", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bases, cands = [], []
            for t in b.column(1):
                s = t.as_py() or ""
                spans = base_spans(s)
                found, i, reach = [], 0, -1
                for a, z in candidates(s):
                    while i < len(spans) and spans[i][1] < z:  # both in order: the furthest end of what starts before z
                        reach, i = max(reach, spans[i][2]), i + 1
                    found.append({"start": a, "end": z, "base": reach > a, "before": s[max(0, a - BEFORE) : a], "value": s[a:z], "after": s[z : z + AFTER]})
                bases.append([{"kind": k, "start": a, "end": z} for k, a, z in spans])
                cands.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bases, span), pa.array(cands, one)], ["key", "base", "cand"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, {_SCANNED}").withColumnRenamed("key", key)


# --- labelled findings ----------------------------------------------------------------------------------------------

Finding = tuple[str, str, str]  # before, value, after

# Public key formats, by prefix, alphabet, length and the joints within; phrases that stand before keys.
_ALNUM, _B64, _URL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
_UPPER, _LOWHEX, _UPHEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef", "0123456789ABCDEF"
_FORMATS = [
    [("ghp_", _ALNUM, 36)], [("github_pat_", _ALNUM, 22), ("_", _ALNUM, 59)], [("xoxb-", "0123456789", 12), ("-", "0123456789", 12), ("-", _ALNUM, 24)],
    [("AIza", _URL, 35)], [("sk_live_", _ALNUM, 24)], [("eyJ", _URL, 33), (".eyJ", _URL, 60), (".", _URL, 43)], [("AKIA", _UPPER, 16)], [("glpat-", _URL, 20)],
    [("", _B64, 43), ("=", "", 0)], [("", _B64, 86), ("==", "", 0)], [("", _B64, 40)], [("", _UPHEX, 32)], [("", _UPHEX, 40)], [("", _UPHEX, 64)],
    [("", _LOWHEX, 32)], [("", _LOWHEX, 40)], [("", _LOWHEX, 64)], [("", _ALNUM, 24)], [("", _ALNUM, 32)], [("", _ALNUM, 48)],
]
_PHRASES = ('api key: "', "Authorization: Bearer ", "secret=", 'private_key = "', "aws_secret_access_key=", "pwd: ", "credentials: ", "auth_token: ", "client_secret: '", "access key ", "signing key is ", 'token = "')

_PLAIN_PHRASES = ("version: ", "see file ", 'id = "', "date: ", "order no. ", "url=", "name: '", "path = ", "tracking number ", 'title="', "page ", "host is ")


def _drawn(rng: np.random.Generator, alphabet: str, n: int) -> str:
    return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n)) if n else ""


def made_secret(rng: np.random.Generator) -> str:
    parts = _FORMATS[rng.integers(len(_FORMATS))]
    return "".join(prefix + _drawn(rng, alphabet, n) for prefix, alphabet, n in parts)


def made_harmless(rng: np.random.Generator) -> str:
    """What looks like a key and is none: identifiers, dates, numbers, paths, names, versions."""
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    word = lambda a=3, z=9: _drawn(rng, low, int(rng.integers(a, z)))
    num = lambda n: _drawn(rng, digits, n)
    year, month, day = int(rng.integers(1970, 2040)), int(rng.integers(1, 13)), int(rng.integers(1, 29))
    date = f"{year}-{month:02d}-{day:02d}"
    forms = [
        lambda: "-".join(_drawn(rng, _LOWHEX, n) for n in (8, 4, 4, 4, 12)),
        lambda: f"{date}T{rng.integers(24):02d}-{rng.integers(60):02d}-{rng.integers(60):02d}",
        lambda: num(int(rng.integers(12, 21))),
        lambda: "/".join([word() for _ in range(rng.integers(2, 6))] + [f"{word()}{num(1)}.py"]),
        lambda: "_".join([word() for _ in range(rng.integers(2, 5))] + [num(2)]),
        lambda: "-".join([word() for _ in range(rng.integers(2, 6))] + [str(year)]),
        lambda: f"{word()}_{year}{month:02d}{day:02d}_{num(6)}.jpg",
        lambda: f"{num(1)}.{num(2)}.{num(1)}-rc{num(1)}+build.{num(3)}",
        lambda: "".join(word(4, 10).capitalize() for _ in range(3)) + num(1),
        lambda: f"{word()}{num(2)}.{word()}.example.com",
        lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}",
        lambda: ".".join(str(rng.integers(256)) for _ in range(4)),
        lambda: f"SKU-{num(5)}-{num(5)}",
        lambda: f"+{num(2)}-{num(3)}-{num(7)}",
        lambda: "".join(word(3, 8) for _ in range(4)) + num(1),
        lambda: f"{word()}={word()}/{word()}={num(4)}",
    ]
    return forms[rng.integers(len(forms))]()


def made(sampled: list[Finding], n: int, seed: int = 12) -> tuple[list[Finding], list[int]]:
    """n secrets and n harmless values, half of them in the surroundings of sampled candidates, the rest among made words or alone.

    Half of the values stand behind a phrase, so that neither a phrase nor unknown surroundings make a secret.
    """
    rng, around = np.random.default_rng(seed), sampled or [("", "", "")]
    words = lambda: " ".join(_drawn(rng, "abcdefghijklmnopqrstuvwxyz", int(rng.integers(2, 9))) for _ in range(4))
    out, labels = [], []
    for i in range(2 * n):
        before, _, after = around[rng.integers(len(around))]
        if (kind := rng.random()) < 0.25:
            before, after = "", ""
        elif kind < 0.5:
            before, after = f"{words()} "[-BEFORE:], f" {words()}"[:AFTER]
        if rng.random() < 0.5:
            phrases = _PHRASES if i % 2 else _PLAIN_PHRASES
            before = f"{before} {phrases[rng.integers(len(phrases))]}"[-BEFORE:]
        out.append((before, made_secret(rng) if i % 2 else made_harmless(rng), after))
        labels.append(i % 2)
    return out, labels


# --- the network ----------------------------------------------------------------------------------------------------

#: 0 is nothing; ASCII characters have classes of their own, white space one, all others one.
_CLASS = np.arange(1, 129, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 33
_OTHER, CLASSES = 129, 130
SIZE = BEFORE + WIDE + AFTER


def codes(s: str) -> np.ndarray:
    points = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CLASS[np.minimum(points, 127)], _OTHER).astype(np.uint8)


def windows(findings: list[Finding]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of SIZE character classes and the finding of each: a longer value has as many windows as cover it."""
    rows, of = [], []
    for i, (before, value, after) in enumerate(findings):
        v = codes(value)
        b, a = codes(before)[-BEFORE:], codes(after)[:AFTER]
        for at in range(0, max(1, len(v)), WIDE):
            row = np.zeros(SIZE, np.uint8)
            part = v[at : at + WIDE]
            row[BEFORE - len(b) : BEFORE] = b
            row[BEFORE : BEFORE + len(part)] = part
            row[BEFORE + WIDE : BEFORE + WIDE + len(a)] = a
            rows.append(row)
            of.append(i)
    return np.array(rows, np.uint8).reshape(-1, SIZE), np.array(of, np.int64)


def _around(x: np.ndarray, width: int) -> np.ndarray:
    """(n, size, width * channels): each place with its neighbours, zeros beyond the ends."""
    side = width // 2
    wide = np.pad(x, ((0, 0), (side, side), (0, 0)))
    return np.concatenate([wide[:, k : k + x.shape[1]] for k in range(width)], 2)


def _folded(g: np.ndarray, width: int) -> np.ndarray:
    """The transpose of _around."""
    side, c, n = width // 2, g.shape[2] // width, g.shape[1]
    out = np.zeros((g.shape[0], n + 2 * side, c), g.dtype)
    for k in range(width):
        out[:, k : k + n] += g[:, :, k * c : (k + 1) * c]
    return out[:, side : side + n]


_PARTS = (slice(0, BEFORE), slice(BEFORE, BEFORE + WIDE), slice(BEFORE + WIDE, SIZE))


@dataclass
class Network:
    """Embedding, two convolutions, the greatest value of each filter in front of, in and behind the candidate and its mean in it, one logit."""

    weights: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    thresholds: list[float] = field(default_factory=lambda: [2.0, 2.0, 2.0])

    @classmethod
    def new(cls, seed: int = 5, channels: int = 8, filters: int = 20, dtype=np.float32) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s, fan: rng.normal(0, np.sqrt(2 / fan), s).astype(dtype)
        return cls({"e": draw(CLASSES, channels, fan=4), "w1": draw(5 * channels, filters, fan=5 * channels), "b1": np.zeros(filters, dtype), "w2": draw(3 * filters, filters, fan=3 * filters), "b2": np.zeros(filters, dtype), "w3": draw(4 * filters, fan=4 * filters), "b3": np.zeros(1, dtype)})

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.weights
        e = w["e"][x] * (x > 0)[:, :, None]
        p1 = _around(e, 5)
        h1 = np.maximum(p1 @ w["w1"] + w["b1"], 0)
        p2 = _around(h1, 3)
        h2 = np.maximum(p2 @ w["w2"] + w["b2"], 0)
        best = [h2[:, s].argmax(1) for s in _PARTS]
        inside = (x[:, _PARTS[1]] > 0)[:, :, None]
        size = np.maximum(inside.sum(1), 1)
        f = np.concatenate([np.take_along_axis(h2[:, s], k[:, None], 1)[:, 0] for s, k in zip(_PARTS, best)] + [(h2[:, _PARTS[1]] * inside).sum(1) / size], 1)
        return f @ w["w3"] + w["b3"][0], (x, p1, h1, p2, h2, best, inside, size, f)

    def gradients(self, g: np.ndarray, state: tuple) -> dict[str, np.ndarray]:
        """Of the sum of g * logit."""
        x, p1, h1, p2, h2, best, inside, size, f = state
        w, n = self.weights, self.weights["b1"].size
        df = g[:, None] * w["w3"]
        dh2 = np.zeros_like(h2)
        for i, (s, k) in enumerate(zip(_PARTS, best)):
            np.put_along_axis(dh2[:, s], k[:, None], df[:, None, i * n : (i + 1) * n], 1)
        dh2[:, _PARTS[1]] += df[:, None, 3 * n :] / size[:, None] * inside
        dh2 *= h2 > 0
        dh1 = _folded(dh2 @ w["w2"].T, 3) * (h1 > 0)
        de = _folded(dh1 @ w["w1"].T, 5) * (x > 0)[:, :, None]
        grad = np.zeros_like(w["e"])
        np.add.at(grad, x.ravel(), de.reshape(-1, de.shape[2]))
        flat = lambda a: a.reshape(-1, a.shape[2])
        return {"e": grad, "w1": flat(p1).T @ flat(dh1), "b1": dh1.sum((0, 1)), "w2": flat(p2).T @ flat(dh2), "b2": dh2.sum((0, 1)), "w3": f.T @ g, "b3": g.sum(keepdims=True)}

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, batch: int = 128, rate: float = 3e-3, seed: int = 6, done: int = 0, total: int | None = None) -> None:
        """Adam on the logistic loss, both labels weighing the same; the rate falls to nothing at the end of `total` rounds, of which `done` came before."""
        rng, m = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        share = y.mean() if len(y) else 0.5
        weight = np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)).astype(np.float32)
        each = -(-len(x) // batch)
        steps, before, t = (total or rounds) * each, done * each, 0
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                k = order[i : i + batch]
                z, state = self.forward(x[k])
                g = self.gradients(((1 / (1 + np.exp(-z)) - y[k]) * weight[k] / len(k)).astype(z.dtype), state)
                t += 1
                for name, d in g.items():
                    a, b = m[name]
                    a += 0.1 * (d - a)
                    b += 0.001 * (d * d - b)
                    self.weights[name] -= (rate * (1 - (before + t - 1) / steps)) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def logits(self, findings: list[Finding], most: int = 256) -> np.ndarray:
        """The greatest logit of each finding's windows, taken in blocks so that memory follows none of their numbers."""
        out = np.full(len(findings), -np.inf)
        for i in range(0, len(findings), most):
            x, of = windows(findings[i : i + most])
            for j in range(0, len(x), most):
                np.maximum.at(out, of[j : j + most] + i, self.forward(x[j : j + most])[0])
        return out

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -500, 500)))

    def calibrate(self, z: np.ndarray, y: np.ndarray, shapes: np.ndarray, recall: float = RECALL, num: np.ndarray | None = None) -> None:
        """Platt's slope and shift by Newton steps; then for each shape the greatest threshold at which `recall` of its secrets are kept. num: findings that each row stands for."""
        a, b, num = 1.0, 0.0, np.ones(len(y), np.int64) if num is None else num
        secrets = (num * y).sum()
        up, down = (secrets + 1) / (secrets + 2), 1 / (num.sum() - secrets + 2)  # targets that keep the curve finite
        target = np.where(y > 0, up, down)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
            d, v = num * (p - target), num * p * (1 - p)
            g = np.array([(d * z).sum(), d.sum()])
            h = np.array([[(v * z * z).sum(), (v * z).sum()], [(v * z).sum(), v.sum()]]) + 1e-6 * np.eye(2)
            step = np.linalg.solve(h, g)
            size = max(1.0, float(np.abs(step).max()))
            a, b = a - step[0] / size, b - step[1] / size
        self.slope, self.shift = float(max(a, 1e-6)), float(b)
        p = self.probability(z)

        def greatest(own: np.ndarray) -> float:
            own = own & (y > 0)
            o = np.argsort(p[own])
            upto = np.cumsum(num[own][o])
            return float(p[own][o][np.searchsorted(upto, np.floor((1 - recall) * upto[-1]), "right")]) if len(o) else 2.0

        every = greatest(np.ones(len(y), bool))
        self.thresholds = [greatest(shapes == k) if num[(shapes == k) & (y > 0)].sum() >= FEW else every for k in range(3)]

    def secret(self, findings: list[Finding]) -> tuple[np.ndarray, np.ndarray]:
        """(probability, whether it is one) of each finding."""
        p = self.probability(self.logits(findings)) if findings else np.zeros(0)
        return p, p >= np.array([self.thresholds[shape(v)] for _, v, _ in findings], float).reshape(-1)


def divided(labelled: list[Finding], labels: list[int]) -> tuple[list[Finding], np.ndarray, list[Finding], np.ndarray]:
    """Two thirds of the labelled findings, by hash, to fit to, and the rest to calibrate on."""
    side = np.array([int.from_bytes(hashlib.blake2b("\0".join(f).encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big") % 3 for f in labelled]) if labelled else np.zeros(0)
    y = np.array(labels, np.float32)
    return [f for f, s in zip(labelled, side) if s], y[side > 0], [f for f, s in zip(labelled, side) if not s], y[side == 0]


def fitted(labelled: list[Finding], labels: list[int], rounds: int = ROUNDS, recall: float = RECALL) -> Network:
    """A network fitted to two thirds of the labelled findings and calibrated on the rest."""
    fit, y, rest, y_rest = divided(labelled, labels)
    net = Network.new()
    x, of = windows(fit)
    net.train(x, y[of] if len(of) else np.zeros(0, np.float32), rounds)
    net.calibrate(net.logits(rest), y_rest, np.array([shape(v) for _, v, _ in rest]), recall)
    return net


def shards(scanned: DataFrame, size: int = SHARD, least: int = SHARDS) -> DataFrame:
    """(shard, base, before, value, after): every distinct candidate, dealt by hash, a shard's rows together; a row without value for each shard."""
    c = cut(scanned.select(F.explode("cand").alias("c")).select("c.base", "c.before", "c.value", "c.after").distinct())
    n = max(least, -(-c.count() // size))
    dealt = c.select(F.pmod(F.xxhash64("before", "value", "after"), F.lit(n)).cast("int").alias("shard"), *c.columns)
    every = c.sparkSession.range(n).select(F.col("id").cast("int").alias("shard"), F.lit(None).cast("boolean").alias("base"), *(F.lit(None).cast("string").alias(x) for x in c.columns[1:]))
    return cut(dealt.unionByName(every).repartitionByRange(n, "shard").sortWithinPartitions("shard", "value", "before", "after", "base"))


def _labelled(batches: Iterator[pa.RecordBatch], made_each: int) -> Iterator[tuple[list[Finding], list[int]]]:
    """The findings of one shard after the other, with those made in their places, and their labels."""

    def whole(shard: int, own: list[Finding], labels: list[int]) -> tuple[list[Finding], list[int]]:
        new, more = made(own, made_each, seed=12 + shard)
        return own + new, labels + more

    now, own, labels = None, [], []
    for b in batches:
        for shard, base, before, value, after in zip(*(c.to_pylist() for c in b.columns)):
            if shard != now:
                if now is not None:
                    yield whole(now, own, labels)
                now, own, labels = shard, [], []
            if value is not None:
                own.append((before, value, after))
                labels.append(int(base))
    if now is not None:
        yield whole(now, own, labels)


def averaged(net: Network, held: DataFrame, rounds: int, done: int, total: int, made_each: int = MADE) -> Network:
    """The mean of what the network becomes in each shard by `rounds` rounds over the shard's findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for labelled, labels in _labelled(batches, made_each):
            fit, y, _, _ = divided(labelled, labels)
            x, of = windows(fit)
            own = Network({k: v.copy() for k, v in net.weights.items()})
            own.train(x, y[of], rounds, seed=6 + done, done=done, total=total)
            w = np.concatenate([v.ravel() for v in own.weights.values()]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w), dtype=np.int32)), pa.array(np.round(w / UNIT).astype(np.int64))], ["place", "w"])

    sums = held.mapInArrow(run, "place int, w long").groupBy("place").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()  # a row for each weight
    flat = np.array([r["w"] / r["n"] * UNIT for r in sorted(sums)])
    ends = np.cumsum([v.size for v in net.weights.values()])
    return Network({k: part.reshape(v.shape).astype(v.dtype) for (k, v), part in zip(net.weights.items(), np.split(flat, ends[:-1]))})


def counted(net: Network, held: DataFrame, made_each: int = MADE) -> DataFrame:
    """(label, shape, cell, num): how many calibration findings have a logit in each step of the grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for labelled, labels in _labelled(batches, made_each):
            _, _, rest, y = divided(labelled, labels)
            cell = np.floor(np.clip(net.logits(rest), -FAR, FAR) * GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array([shape(v) for _, v, _ in rest], pa.int32()), pa.array(cell)], ["label", "shape", "cell"])

    return held.mapInArrow(run, "label int, shape int, cell int").groupBy("label", "shape", "cell").agg(F.count("*").alias("num"))


def fit(scanned: DataFrame, rounds: int = ROUNDS, size: int = SHARD, made_each: int = MADE, recall: float = RECALL) -> Network:
    """Learns from every distinct candidate and from `made_each` made findings of each label in every shard of some `size` candidates.

    A candidate that a base span meets is a secret; one that none meets counts as harmless, which it mostly is. The driver
    gets the sums of the weights and the counts of a grid of logits, whose sizes are fixed.
    """
    held, net = shards(scanned, size), Network.new()
    for done in range(0, rounds, MEET):
        net = averaged(net, held, min(MEET, rounds - done), done, rounds, made_each)
    rows = counted(net, held, made_each).collect()  # 2 labels, 3 shapes, 2 * FAR * GRID steps
    label, kind, cell, num = (np.array([r[c] for r in rows], np.int64) for c in ("label", "shape", "cell", "num"))
    o = np.lexsort((cell, kind, label))
    net.calibrate(cell[o] / GRID, label[o], kind[o], recall, num[o])
    return net


# --- on DataFrames --------------------------------------------------------------------------------------------------


def find(scanned: DataFrame, net: Network, key: str = "doc_id") -> DataFrame:
    """(key, spans): every row's spans (kind, start, end, score) by start, then kind. The network scores every candidate. It adds those that no base span meets and that reach their threshold; base spans stay whatever it says, with the greatest score of a candidate they meet (1 without one)."""
    kind, shared = scanned.schema[key].dataType.simpleString(), scanned.sparkSession.sparkContext.broadcast(net)  # some 20 kB
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            bases, cands = b.column(1).to_pylist(), b.column(2).to_pylist()
            p, yes = model.secret([(c["before"], c["value"], c["after"]) for x in cands for c in x])
            out, at = [], 0
            for base, own in zip(bases, cands):
                scored = list(zip(own, p[at : at + len(own)].tolist(), yes[at : at + len(own)].tolist()))
                at += len(own)
                ends, spans = [c["end"] for c in own], []  # candidates are apart and in order
                for s in base:
                    met = range(bisect.bisect_right(ends, s["start"]), bisect.bisect_left(own, s["end"], key=lambda c: c["start"]))
                    spans.append(s | {"score": max((scored[i][1] for i in met), default=1.0)})
                spans += [{"kind": KINDS[-1], "start": c["start"], "end": c["end"], "score": q} for c, q, y in scored if y and not c["base"]]
                out.append(sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, span)], ["key", "spans"])

    return scanned.select(F.col(key).alias("key"), "base", "cand").mapInArrow(run, f"key {kind}, spans array<struct<kind:string,start:long,end:long,score:double>>").withColumnRenamed("key", key)


def secrets(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_network), a row for each of docs (doc_id, text).

    Null texts count as empty, and a text without spans has empty strings. Every row is judged by itself, so repeated rows
    and rows that share a doc_id each get theirs; equal texts get equal spans. Positions count code points, ends are exclusive.
    A table without rows gives none.
    """
    scanned = cut(scan(docs))
    found = find(scanned, net or fit(scanned))
    line = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"] != KINDS[-1])
    return found.select("doc_id", *(count(k) for k in KINDS[:-1]), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), count(KINDS[-1]))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and the network's of every whole text of documents, with a network fitted to this input."""
    ship(spark)
    return secrets(table(spark, sf_dir, "documents"))
