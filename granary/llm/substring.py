"""Substring deduplication: words in a window of `k` words that starts earlier in the corpus are removed.

1. Sketch: every task hashes its windows and counts them in a count-min sketch; tasks send their cells sparsely and the
   merged sketch keeps a bit for each cell: counted twice or more. A window is counted through its minimiser, the least
   hash of its 10-word runs, once for each place where that run stands: equal windows have equal minimisers at equal
   offsets, so an estimate is never below the window's true count, with about a sixth of the cells in use.
2. Exact: a second pass sends on only windows that the sketch holds for repeated. A task first settles what repeats
   among its own rows, so a passage in a third of all documents crosses the shuffle once for each batch, not once for each
   document. The rest meet by hash, and all but the earliest are marked.
3. Marks go to their documents, whose words they cover.

The sketch has about four cells a minimiser of the input, by its bytes, so about one window in twenty goes on by chance. Its
bits go to every task; past 2 x 2**29 cells (128 MB as bits) it grows no more, and on larger inputs more windows go to the exact
pass: it takes longer, in proportion to the input, and none is lost.

Windows are equal if 95 bits of hashes of their words agree, itself made of 64-bit hashes of words: of n distinct windows, two
are taken for equal with a probability of about n * n / 2**96.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table, tasks
from .textkit import Words, kept_text, mix, thrifty, words

#: log2 of the fewest and most cells of a sketch row, and of the cells of a shard; rows; cells that a task holds before it sends them.
CELLS, MOST_CELLS, SHARD, DEPTH, HELD = 20, 29, 18, 2, 1 << 22
#: Bytes of text for each minimiser, about: six words of six bytes.
SPREAD = 36

_SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))


def _minimisers(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of each window's first word, which minimiser it has, hash of each minimiser), windows in text order."""
    sub = (k + 1) // 2
    if w.n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = w.rolling(sub)
    spread, have = k - sub + 1, 1
    b = np.arange(len(h))

    def lower(a: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.where(h[c] < h[a], c, a)  # the left one of equals

    while have * 2 <= spread:
        b = lower(b[:-have], b[have:])
        have *= 2
    if have < spread:
        b = lower(b[: len(b) - (spread - have)], b[spread - have :])
    i = np.flatnonzero(w.row[: w.n - k + 1] == w.row[k - 1 :])
    at = b[i]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    return i, np.cumsum(new) - 1, h[at[new]]


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(h ^ _SEEDS[row]) >> np.uint64(64 - bits)).astype(np.uint32)


def _pack(cells: np.ndarray) -> bytes:
    """Sorted uint32 as differences, byte planes apart, deflated."""
    d = np.diff(cells, prepend=np.uint32(0)).astype(np.uint32)
    return zlib.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(b), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def cells_for(size: int) -> int:
    """log2 of the cells of a sketch row for so many bytes of text."""
    return min(MOST_CELLS, max(CELLS, (4 * size // SPREAD).bit_length()))


def sketch(docs: DataFrame, k: int, cells_log: int | None = None, shard_log: int = SHARD) -> Broadcast:
    """The merged sketch as bits (row, byte): set where a cell was counted twice or more."""
    if cells_log is None:
        cells_log = cells_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    per_row = 1 << (cells_log - shard_log)

    @thrifty
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
        size = 0

        def send() -> pa.RecordBatch:
            shards, once, more = [], [], []
            for r in range(DEPTH):
                u, n = np.unique(np.concatenate(held[r]), return_counts=True)
                edge = np.searchsorted(u, np.arange(per_row + 1, dtype=np.uint64) << np.uint64(shard_log))
                for s in np.flatnonzero(np.diff(edge)):
                    part, c = u[edge[s] : edge[s + 1]] & np.uint32((1 << shard_log) - 1), n[edge[s] : edge[s + 1]]
                    shards.append(r * per_row + s)
                    once.append(_pack(part[c == 1]))
                    more.append(_pack(part[c > 1]))
                held[r] = []
            return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["shard", "once", "more"])

        for b in batches:
            for _, _, w in words(b.column(0)):
                h = _minimisers(w, k)[2]
                for r in range(DEPTH):
                    held[r].append(_cells(h, r, cells_log))
                size += len(h)
                if size >= HELD:
                    yield send()
                    size = 0
        if size:
            yield send()

    @thrifty
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, np.ndarray] = {}
        for b in batches:
            for s, once, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                c = cells.setdefault(s, np.zeros(1 << shard_log, np.uint8))
                i = _unpack(once)
                c[i] = np.minimum(c[i] + 1, 2)
                c[_unpack(more)] = 2
        for s, c in cells.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(np.packbits(c > 1).tobytes(), 1)], pa.binary())], ["shard", "bits"])

    spark = docs.sparkSession
    parts = docs.select("text").mapInArrow(count, "shard int, once binary, more binary")
    merged = parts.repartition(min(DEPTH * per_row, tasks(spark)), "shard").mapInArrow(merge, "shard int, bits binary")
    bits = np.zeros((DEPTH * per_row, (1 << shard_log) // 8), np.uint8)
    for r in merged.toLocalIterator():  # DEPTH x per_row shards at most, whatever the input
        bits[r["shard"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return spark.sparkContext.broadcast(bits.reshape(DEPTH, -1))


def _repeated(w: Words, k: int, bits: np.ndarray) -> np.ndarray:
    """First words of the windows that the sketch holds for repeated."""
    i, which, h = _minimisers(w, k)
    hot = np.ones(len(h), bool)
    for r in range(DEPTH):
        c = _cells(h, r, bits.shape[1].bit_length() + 2)
        hot &= (bits[r][c >> np.uint32(3)] >> (7 - (c & np.uint32(7))).astype(np.uint8)) & 1 > 0
    return i[hot[which]]


_MARKS = "key long, side int, mark boolean, doc long, start int, n int"


def _batch(key, side, mark, doc, start, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(side, pa.int32()), pa.array(mark, pa.bool_()), pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32())], ["key", "side", "mark", "doc", "start", "n"])


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first start, count) of runs of successive starts."""
    o = np.lexsort((start, doc))
    doc, start = doc[o], start[o]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], (start[last] - start[at] + 1) if len(at) else start[at]


def later_windows(docs: DataFrame, k: int, bits: Broadcast) -> DataFrame:
    """(doc, start, n): runs of windows that also start earlier in the corpus."""

    @thrifty
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            key, side, doc, start = [], [], [], []
            for i, _, w in words(b.column(1)):
                at = _repeated(w, k, bits.value)
                key.append(w.rolling(k)[at] if len(at) else np.zeros(0, np.uint64))
                side.append((w.rolling(k, 1)[at] >> np.uint64(33)).astype(np.int32) if len(at) else np.zeros(0, np.int32))
                doc.append(ids[i + w.row[at]].astype(np.int64))
                start.append((at - w.first[w.row[at]]).astype(np.int32))
            if not key:
                continue
            key, side, doc, start = (np.concatenate(x) for x in (key, side, doc, start))
            o = np.lexsort((start, doc, side, key))
            key, side, doc, start = key[o], side[o], doc[o], start[o]
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (side[1:] != side[:-1])
            head = np.flatnonzero(first)[np.cumsum(first) - 1] if len(key) else np.zeros(0, int)
            late = (doc != doc[head]) | (start != start[head])
            key = key.view(np.int64)
            yield _batch(key[first], side[first], np.zeros(int(first.sum()), bool), doc[first], start[first], np.ones(int(first.sum()), np.int32))
            d, s, n = _runs(doc[late], start[late])
            # marks only pass through the exchange: spread them by document
            yield _batch(mix(d.view(np.uint64)).view(np.int64), np.zeros(len(d), np.int32), np.ones(len(d), bool), d, s, n)

    @thrifty
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the earliest window of the last key, which may go on in the next batch
        for b in batches:
            key, side, mark, doc, start, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            out = [(doc[mark], start[mark], n[mark])]
            key, side, doc, start = key[~mark], side[~mark], doc[~mark], start[~mark]
            if len(key):
                if held:
                    key, side, doc, start = (np.concatenate([[h], x]).astype(x.dtype) for h, x in zip(held, (key, side, doc, start)))
                first = np.ones(len(key), bool)
                first[1:] = (key[1:] != key[:-1]) | (side[1:] != side[:-1])
                head = np.flatnonzero(first)[np.cumsum(first) - 1]
                late = (doc != doc[head]) | (start != start[head])
                out.append(_runs(doc[late], start[late]))
                held = tuple(x[head[-1]] for x in (key, side, doc, start))
            doc, start, n = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32())], ["doc", "start", "n"])

    found = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(find, _MARKS)
    met = found.repartition(tasks(docs.sparkSession), "key").sortWithinPartitions("key", "side", "mark", "doc", "start")
    return met.mapInArrow(settle, "doc long, start int, n int")


def _marked(docs: DataFrame, k: int, **sizes: int) -> DataFrame:
    """(doc, starts, ns): the later windows of each document that has any."""
    bits = sketch(docs.where("doc_id is not null"), k, **sizes)
    runs = later_windows(docs, k, bits).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return runs.select("doc", F.col("runs.start").alias("starts"), F.col("runs.n").alias("ns"))


def _covered(b: pa.RecordBatch, text: int, runs: int, k: int) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """(first row, end row, Words, which words later windows cover) for a batch with columns starts, ns from `runs` on."""
    starts, ns = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in (runs, runs + 1))
    sizes = np.array([x or 0 for x in b.column(runs).value_lengths().to_pylist()], np.int64)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    for i, j, w in words(b.column(text)):
        own = slice(edge[i], edge[j])
        first = np.repeat(w.first[:-1], sizes[i:j]) + starts[own]
        over = np.repeat(w.first[1:], sizes[i:j])
        ok = first < over  # rows of one doc_id may differ in length
        cover = np.zeros(w.n + 1, np.int64)
        np.add.at(cover, first[ok], 1)
        np.add.at(cover, np.minimum(first + ns[own] + (k - 1), over)[ok], -1)
        yield i, j, w, np.cumsum(cover)[:-1] > 0


def drop_repeats(docs: DataFrame, k: int = 20) -> DataFrame:
    """docs with the words that remove_repeats finds gone from `text`, and `n_chars`, where there is one, counted anew.

    The other columns are as they were. A text from which nothing goes, null too, is unchanged.
    """
    names = docs.columns
    marks = _marked(docs, k).toDF("_doc", "_starts", "_ns")
    both = docs.alias("d").join(marks.alias("m"), F.col("d.doc_id") == F.col("m._doc"), "left").select(*(F.col(f"d.`{c}`") for c in names), F.col("m._starts"), F.col("m._ns"))
    at, runs = names.index("text"), len(names)

    @thrifty
    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w, gone in _covered(b, at, runs, k):
                part, old = b.slice(i, j - i), b.column(at).slice(i, j - i)
                changed = np.bincount(w.row[gone], minlength=j - i) > 0
                new = pc.if_else(pa.array(changed), kept_text(w, ~gone).cast(old.type), old) if changed.any() else old
                yield pa.RecordBatch.from_arrays([new if c == at else part.column(c) for c in range(runs)], names)

    out = both.mapInArrow(cover, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in names else out


def remove_repeats(docs: DataFrame, k: int = 20, **sizes: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the words left, joined by one space.

    Windows are judged on the input. Null and empty texts have no words. A row without doc_id has no place in the order: it
    is kept whole and removes nothing. Rows of one doc_id count as one document: equal windows at the same start
    don't remove each other, and a removal in one applies to all. sizes: cells_log, shard_log of the sketch.
    """
    both = docs.select("doc_id", "text").join(_marked(docs, k, **sizes), F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "starts", "ns")

    @thrifty
    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w, gone in _covered(b, 1, 2, k):
                num = np.diff(w.first)
                lost = np.bincount(w.row[gone], minlength=j - i)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(num, pa.int64()), pa.array(lost, pa.int64()), kept_text(w, ~gone).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(cover, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text of documents that stay and go, as remove_repeats with windows of 20; the kept ones as a digest."""
    ship(spark)
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
