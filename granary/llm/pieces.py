"""SentencePiece segmentations: encoding, decoding, and distinct samples by Gumbel top-k without replacement.

The lattice of a text has a node for each character position and an edge for each vocabulary piece. Texts are split into
units (blanks and the characters up to the next blank; a line break by itself) that no piece crosses, so a text's lattice is
the chain of its units' lattices, and each distinct unit is built once for a batch. An edge's weight is the piece's log
probability times `TEMPER`; a model whose scores are merge ranks (byte-pair models) gives a piece of rank r the Zipf weight
-log(r + 2). Backward sums over a unit's lattice turn weights into probabilities of the next piece.

Sampling is a perturbed A-star search, exact and lazy. A search node is a prefix with the perturbed bound of all
segmentations that continue it. Popping the greatest bound follows the sampled best continuation to the text's end, for all
units at once in numpy; the siblings left behind along it stay one group for each step, with the largest bound that a
truncated Gumbel gives them, until a group's bound is the greatest in the queue. Prefixes with a smaller bound are never
opened, and no two results are equal. The first result is an ordinary sample, the next come without replacement; with the
(k+1)-th bound as threshold, each result gets its inclusion probability 1 - exp(-exp(log p - threshold)).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table
from .textkit import Powers, mix

#: The sign that stands for a blank in pieces.
BLANK = "▁"
#: Results for each text, weight of log probabilities (below 1: more varied), units kept between batches.
K, TEMPER, KEPT = 2, 1.0, 600_000
#: log2 of the slots of the piece table.
SLOTS = 20
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

_UNITS = regex.compile(rf"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")


class Vocabulary:
    """Pieces with ids and log weights, and hashes of pieces by length. Characters that no piece covers are spelled in bytes."""

    def __init__(self, path: str, temper: float = TEMPER) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte: dict[int, int] = {}
        self.piece: list[bytes] = [b""] * n
        score = np.array([sp.get_score(i) for i in range(n)])
        usual = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ranks = bool((score[usual] == np.round(score[usual])).all())
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.byte[b], self.piece[i] = i, bytes([b])
        #: hash of each piece, and of each beginning of one, to its id; beginnings that are no pieces have ids from n on
        ids: dict[int, int] = {}
        for i in usual:
            p = sp.id_to_piece(i)
            self.piece[i] = p.encode()
            ids[int(_prefix(_points(p))[-1])] = i
        longer = set()
        for i in usual:
            h = _prefix(_points(sp.id_to_piece(i))).tolist()
            longer.update(ids.setdefault(x, n + len(ids)) for x in h[1:-1])
        #: id of each slot (-1: none), hashes by id, whether a longer piece goes on; ids whose slot another one has, by hash
        self.n, most = n, max(ids.values(), default=0) + 1
        self.slot, self.hash, self.more, self.crowded = np.full(1 << SLOTS, -1, np.int32), np.zeros(most, np.uint64), np.zeros(most, bool), {}
        self.more[list(longer)] = True
        for h, i in ids.items():
            self.hash[i] = h
            at = int(_slot(np.array([h], np.uint64))[0])
            if self.slot[at] < 0:
                self.slot[at] = i
            else:
                self.crowded[h] = i
        self.crowded_slots = np.zeros(1 << SLOTS, bool)
        self.crowded_slots[_slot(np.array(list(self.crowded), np.uint64))] = True
        #: pieces as text; those that are parts of a character only
        self.text = [p.decode("utf-8", "replace").replace(BLANK, " ") for p in self.piece]
        self.wide = np.zeros(n, bool)
        self.wide[[i for b, i in self.byte.items() if b > 127]] = True
        self.weight = temper * np.where(score <= 0, -np.log(2 - score) if ranks else score, 0.0)
        self.rare = float(self.weight[usual].min()) - 1 if usual else -1.0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashed stretches, -1 where they are no piece."""
        at = _slot(h)
        i = self.slot[at]
        wrong = self.hash[i] != h
        if self.crowded:
            odd = np.flatnonzero(wrong & self.crowded_slots[at])
            i[odd] = [self.crowded.get(x, -1) for x in h[odd].tolist()]
            wrong[odd] = False
        i[wrong] = -1
        return i

    def spell(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "replace")]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_POINT_POWERS = Powers(0xB492B66FBE98F273)
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


def _prefix(points: np.ndarray) -> np.ndarray:
    """Sums of hashed code points times powers, from which the hash of any stretch follows."""
    total = np.zeros(len(points) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(77)) * _POINT_POWERS.upto(len(points) + 1)[0][: len(points)], out=total[1:])
    return total


def _slot(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h * _STEP[0]) >> np.uint64(64 - SLOTS)


def normalise(text: str) -> str:
    """The model's view of a text: blanks become BLANK, one goes in front. A BLANK in the source can't be told from a blank."""
    return BLANK + text.replace(" ", BLANK) if text else ""


def units_of(text: str) -> list[str]:
    """The units of a text; together they are its normalised form."""
    if not text:
        return []
    if "  " in text or "\0" in text or BLANK in text:
        return _UNITS.findall(normalise(text))
    # single blanks: cutting the string is faster than matching
    units = (BLANK + text.replace(" ", "\0" + BLANK).replace("\n", "\0\n\0")).split("\0")
    return list(filter(None, units)) if "\n" in text else units


def _uniform(seed: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit seeds: the same for a seed in any process and any order."""
    return (mix(seed) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


class Seed:
    """A stream of single uniform numbers."""

    def __init__(self, seed: np.uint64) -> None:
        self.seed, self.n = seed, 0

    def next(self) -> float:
        self.n += 1
        with np.errstate(over="ignore"):
            return float(_uniform(self.seed + np.uint64(self.n) * _STEP[1]))


class Lattices:
    """Lattices of distinct units as one automaton: state s has the edges edge[s] .. edge[s+1] - 1."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.clear()
        self.edge = np.zeros(1, np.int64)  # of states, first edges; one more at the end
        self.target, self.piece = np.zeros(0, np.int32), np.zeros(0, np.int32)  # state after (-1: unit ends); id or -1 - spelled
        self.cum, self.logp, self.left = np.zeros(0, np.float32), np.zeros(0), np.zeros(0, np.float32)

    def clear(self) -> None:
        """Forgets the units; the arrays stay for the next ones."""
        self.known: dict[str, int] = {}
        self.spelled: list[list[int]] = []
        self.n_states = self.n_edges = 0

    def _room(self, states: int, edges: int) -> None:
        def grow(a: np.ndarray, n: int) -> np.ndarray:
            if len(a) >= n:
                return a
            out = np.zeros(max(n, 3 * len(a) // 2), a.dtype)
            out[: len(a)] = a
            return out

        self.edge = grow(self.edge, self.n_states + states + 1)
        self.target, self.piece, self.cum, self.logp, self.left = (grow(a, self.n_edges + edges) for a in (self.target, self.piece, self.cum, self.logp, self.left))

    def build(self, units: list[str]) -> None:
        """Adds the lattices of new units, all at once."""
        v, text = self.v, "".join(units)
        points = _points(text)
        n, sizes = len(points), np.fromiter(map(len, units), np.int64, len(units))
        stop = np.repeat(np.cumsum(sizes), sizes)
        total, down = _prefix(points), _POINT_POWERS.upto(n + 1)[1]
        at = np.arange(n)
        src, size, ids, single = [], [], [], np.zeros(n, bool)
        i, length = at, 0
        while len(i):
            length += 1
            with np.errstate(over="ignore"):
                found = v.find((total[i + length] - total[i]) * down[i])
            hit = (found >= 0) & (found < v.n)
            src.append(i[hit])
            size.append(np.full(len(src[-1]), length))
            ids.append(found[hit].astype(np.int64))
            if length == 1:
                single[src[-1]] = True
            on = (found >= 0) & v.more[found]
            i = i[on]
            i = i[i + length < stop[i]]
        bare = np.flatnonzero(~single)
        chars, of = np.unique(points[bare], return_inverse=True)
        first = len(self.spelled)
        self.spelled += [v.spell(chr(c)) for c in chars.tolist()]
        spelled_weight = v.rare * np.array([len(x) for x in self.spelled[first:]], float)
        # one byte is a piece like any other
        spelled_id = np.array([x[0] if len(x) == 1 else -1 - first - k for k, x in enumerate(self.spelled[first:])], np.int64)
        # edges by position, the longest first: it is the likeliest one mostly
        i, size = np.concatenate([bare, *src[::-1]]), np.concatenate([np.ones(len(bare), np.int64), *size[::-1]])
        w = np.concatenate([spelled_weight[of] if len(bare) else np.zeros(0), *(v.weight[x] for x in ids[::-1])])
        piece = np.concatenate([spelled_id[of] if len(bare) else of, *ids[::-1]])
        o = np.argsort(i, kind="stable")
        i, size, w, piece = i[o], size[o], w[o], piece[o]
        # backward sums, from the units' ends
        left, ends, to = stop[i] - i, i + size == stop[i], i + size
        o = np.argsort(left.astype(np.uint16) if sizes.max() < 1 << 16 else left, kind="stable")
        back, level = np.zeros(n + 1), left[o]
        levels = np.flatnonzero(np.diff(level, prepend=0))
        for a, b in zip(levels.tolist(), [*levels[1:].tolist(), len(i)]):
            e = o[a:b]
            x = w[e] + np.where(ends[e], 0.0, back[to[e]])
            heads = np.flatnonzero(np.diff(i[e], prepend=-1))
            back[i[e[heads]]] = np.logaddexp.reduceat(x, heads)
        logp = w + np.where(ends, 0.0, back[to]) - back[i]
        num = np.bincount(i, minlength=n)
        self._room(n, len(i))
        s, e = self.n_states, self.n_edges
        self.edge[s + 1 : s + n + 1] = e + np.cumsum(num)
        self.target[e : e + len(i)] = np.where(ends, -1, s + to)
        self.piece[e : e + len(i)], self.logp[e : e + len(i)] = piece, logp
        p = np.exp(logp)
        #: share of a state's other edges, inverted: what makes their group's bound
        alone = np.repeat(num, num) < 2
        with np.errstate(divide="ignore"):
            self.left[e : e + len(i)] = np.where(alone, np.inf, 1 / np.maximum(-np.expm1(logp), 1e-300))
        p = np.cumsum(p)
        own = p - np.repeat(np.concatenate([[0.0], p])[np.cumsum(num) - num], num)
        own[np.cumsum(num) - 1] = 1.0
        self.cum[e : e + len(i)] = own
        self.known.update(zip(units, (s + np.cumsum(sizes) - sizes).tolist()))
        self.n_states, self.n_edges = s + n, e + len(i)

    def states(self, units: list[str]) -> np.ndarray:
        """First states of units, built where new. Forgets all first when KEPT units are held; earlier states are void then."""
        if len(self.known) > KEPT:
            self.clear()
        known = self.known
        got = np.fromiter(map(known.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(got < 0)
        if len(missing):
            names = [units[k] for k in missing.tolist()]
            self.build(list(dict.fromkeys(names)))
            got[missing] = list(map(known.__getitem__, names))
        return got

    def draw(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each state by its probability."""
        e = self.edge[state]
        on = np.flatnonzero(u > self.cum[e])
        while len(on):
            e[on] += 1
            on = on[u[on] > self.cum[e[on]]]
        return e

    def walk(self, start: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges, unit) of a sampled path through each unit, in text order; seed: of each unit."""
        found, of = [], []
        state, unit = start, np.arange(len(start))
        while len(state):
            with np.errstate(over="ignore"):
                seed = seed + _STEP[0]
            e = self.draw(state, _uniform(seed))
            found.append(e)
            of.append(unit)
            after = self.target[e]
            on = np.flatnonzero(after >= 0)
            state, unit, seed = after[on], unit[on], seed[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        e, of = np.concatenate(found), np.concatenate(of)
        o = np.argsort(of, kind="stable")
        return e[o], of[o]


def _truncated(location, u, most):
    """Gumbel variables at `location` given that they are at most `most`."""
    return -np.logaddexp(-most, np.log(-np.log(u)) - location)


class Walks:
    """k independent walks through the units of a block of texts: the first is each text's first sample, the others are what
    later samples continue with behind the place where they part."""

    def __init__(self, lat: Lattices, start: np.ndarray, text: np.ndarray, seeds: np.ndarray, k: int) -> None:
        n = len(seeds)
        self.first = np.searchsorted(text, np.arange(n + 1))
        self.lat, self.seeds, self.k = lat, seeds, k
        with np.errstate(over="ignore"):
            base = mix(seeds[text] + (np.arange(len(text)) - self.first[text]).astype(np.uint64) * _STEP[1]) if len(text) else np.zeros(0, np.uint64)
            both = [lat.walk(start, mix(base + np.uint64(q + 1))) for q in range(k)]
        self.edges = [e for e, _ in both]
        self.units = [u for _, u in both]
        #: where each unit's steps begin in each walk
        self.at = [np.searchsorted(u, np.arange(len(start) + 1)) for u in self.units]
        self.log = [lat.logp[e] for e in self.edges]

    def sample(self, t: int) -> list[tuple[np.ndarray, float, float]]:
        """Up to k distinct paths (edges, log p, log inclusion probability) of text t, greatest perturbed value first."""
        lat, k, a, b = self.lat, self.k, int(self.first[t]), int(self.first[t + 1])
        with np.errstate(over="ignore"):
            own = mix(self.seeds[t : t + 1] + np.uint64(0x51ED27))[0]
        one = Seed(own)
        queue: list[tuple] = []

        def siblings(e: np.ndarray, log: np.ndarray, unit: np.ndarray, first: int, mass: float, most: float, salt: int) -> float:
            """Queues the groups left behind by path e from step `first` on, whose prefix has log mass `mass`; returns log p.

            A group of mass m has the bound -log(exp(-most) + E / m) with E exponential, a Gumbel variable truncated at
            `most`: the least E / m are the greatest bounds.
            """
            log = log[first:]
            total = np.cumsum(log)
            with np.errstate(over="ignore"):
                u = _uniform(own + (np.arange(len(log)) + (salt << 40)).astype(np.uint64) * _STEP[0])
                cost = -np.log(u) * np.exp(log - total) * lat.left[e[first:]]
            # k + 1 results at most are wanted: lesser groups of one path can never be reached
            near = np.argpartition(cost, k)[: k + 1].tolist() if len(cost) > k + 1 else range(len(cost))
            for s in near:
                if cost[s] < np.inf:
                    bound = -np.logaddexp(-most, np.log(cost[s]) - mass)
                    heapq.heappush(queue, (-float(bound), len(queue) + salt * 1000, first + s, e, unit, float(mass + total[s] - log[s]), (int(e[first + s]),)))
            return float(mass + (total[-1] if len(total) else 0.0))

        top = -np.log(-np.log(one.next()))
        i, j = self.at[0][a], self.at[0][b]
        e, unit = self.edges[0][i:j], self.units[0][i:j]
        found = [(e, siblings(e, self.log[0][i:j], unit, 0, 0.0, top, 1))]
        while len(found) < k and queue:
            bound, tick, s, e, unit, mass, barred = heapq.heappop(queue)
            bound, q = -bound, len(found)
            state = int(np.searchsorted(lat.edge[: lat.n_states + 1], e[s], "right")) - 1
            free = np.array([x for x in range(int(lat.edge[state]), int(lat.edge[state + 1])) if x not in barred])
            if not len(free):
                continue
            logs = lat.logp[free]
            share = np.cumsum(np.exp(logs - logs.max()))
            pick = min(int(np.searchsorted(share, one.next() * share[-1])), len(free) - 1)
            chosen = int(free[pick])
            if len(free) > 1:  # the group goes back without the chosen edge
                left = mass + float(np.logaddexp.reduce(np.delete(logs, pick)))
                heapq.heappush(queue, (-float(_truncated(left, one.next(), bound)), tick, s, e, unit, mass, (*barred, chosen)))
            # the rest of this unit by single draws, then what walk q has for all units after it
            here = [chosen]
            while (after := int(lat.target[here[-1]])) >= 0:
                here.append(int(lat.draw(np.array([after]), np.array([one.next()]))[0]))
            u = int(unit[s])
            i, j = self.at[q][u + 1], self.at[q][b]
            new = np.concatenate([e[:s], here, self.edges[q][i:j]])
            new_unit = np.concatenate([unit[:s], np.full(len(here), u), self.units[q][i:j]])
            mass_in = mass + float(lat.logp[chosen])
            new_log = np.concatenate([np.zeros(s + 1), lat.logp[here[1:]], self.log[q][i:j]])
            found.append((new, siblings(new, new_log, new_unit, s + 1, mass_in, bound, q + 1)))
        limit = -queue[0][0] if queue else -np.inf  # the (k+1)-th perturbed value
        out = []
        for e, logp in found:
            # log(1 - exp(-exp(d))); for small exp(d) it is d
            d = logp - limit
            out.append((e, logp, d if d < -30 else 0.0 if d > 5 else float(np.log(-np.expm1(-np.exp(d))))))
        return out


def path_ids(lat: Lattices, edges: np.ndarray) -> np.ndarray:
    """Piece ids along a path; spelled characters become their byte pieces."""
    x = lat.piece[edges]
    odd = np.flatnonzero(x < 0)
    if not len(odd):
        return x
    spelled = [lat.spelled[-1 - i] for i in x[odd].tolist()]
    size = np.ones(len(x), np.int64)
    size[odd] = list(map(len, spelled))
    out = np.repeat(x, size)
    own = np.flatnonzero(out < 0)
    out[own] = list(chain.from_iterable(spelled))
    return out


def decode_ids(vocabulary: Vocabulary, ids: list[int] | np.ndarray) -> str:
    """The text of piece ids: the exact inverse of any segmentation of a text without BLANK signs."""
    wide = vocabulary.wide[ids].any() if len(ids) else False
    ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
    if not wide:
        text = "".join(map(vocabulary.text.__getitem__, ids))
    else:
        text = b"".join(map(vocabulary.piece.__getitem__, ids)).decode("utf-8", "replace").replace(BLANK, " ")
    return text[1:] if text[:1] == " " else text


def segmentations(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, model: str = MODEL, seed: int = 1, temper: float = TEMPER) -> DataFrame:
    """(key, rank, ids, log_p, log_inclusion, exact): up to k distinct sampled segmentations of each row's whole text.

    Seeded by the key and `seed` alone: the same row gives the same samples in any partitioning. Texts with fewer than k
    segmentations give all of them, with inclusion 1. Null and empty texts give one row with no ids, log p 0. `exact`
    says that decoding the ids gives the text back (with BLANK signs read as blanks).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(model, temper))  # the model's pieces: fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = Lattices(shared.value)
        for b in batches:
            texts, keys, hashes = b.column(1).to_pylist(), b.column(0), b.column(2).to_pylist()
            at = 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size < 1 << 20):
                    size += len(texts[end] or "")
                    end += 1
                units = [units_of(x) if x else [] for x in texts[at:end]]
                starts = lat.states(list(chain.from_iterable(units)))
                of = np.repeat(np.arange(end - at), list(map(len, units)))
                walks = Walks(lat, starts, of, mix(np.array(hashes[at:end], np.int64).view(np.uint64) ^ mix(np.array([seed], np.uint64))), k)
                row, rank, flat, sizes, logp, incl, exact = [], [], [], [], [], [], []
                for r, us in enumerate(units):
                    want = (texts[at + r] or "").replace(BLANK, " ")
                    for q, (e, lp, li) in enumerate(walks.sample(r) if us else [(np.zeros(0, np.int64), 0.0, 0.0)]):
                        ids = path_ids(lat, e)
                        row.append(at + r)
                        rank.append(q)
                        flat.append(ids)
                        sizes.append(len(ids))
                        logp.append(lp)
                        incl.append(li)
                        exact.append(decode_ids(shared.value, ids) == want)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = pa.array(np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), pa.array(rank, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(logp, pa.float64()), pa.array(incl, pa.float64()), pa.array(exact, pa.bool_())], ["key", "rank", "ids", "log_p", "log_inclusion", "exact"])
                at = end

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), F.xxhash64(docs[key]).alias("h"))
    return rows.mapInArrow(run, f"key {kind}, rank int, ids array<int>, log_p double, log_inclusion double, exact boolean").withColumnRenamed("key", key)


def decode(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """encoded with a column `decoded`: the texts of an id column; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model))
    names = encoded.columns
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else decode_ids(shared.value, x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    from pyspark.sql.types import StringType, StructField, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of every document; ids are digested, `exact` is the round trip through decoding."""
    ship(spark)
    out = segmentations(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "rank", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.round("log_p", 6).alias("log_p"), F.round("log_inclusion", 6).alias("log_inclusion"), "exact")
