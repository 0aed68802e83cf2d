"""A positional index of texts: postings in blocks with their greatest score, written once and read by the query's words.

Runs of PER_SEGMENT documents, as they are read, are segments, and a lexeme's postings of one segment are one block: documents
and positions as differences, counts, lengths, and the greatest score that a document of the block gets for the lexeme. A hot
lexeme is many blocks, none of which grows with the corpus. Blocks lie in folders by the hash of the lexeme, in order of
lexeme and segment, so a query's words name the folders and row groups that are read.

Ranked queries bound what each segment can hold from the blocks' greatest scores alone, score the most promising segments, and
read of the others only those whose bound reaches the score that is then safe (MaxScore over blocks). Phrases are matched by
positions. `english` is the configuration with stop words and stems; `simple` takes words as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.english import STOP_WORDS, is_stop_word, stem
from ..functions.text import words
from .search import B, K1, Query, parse_query

#: Most documents and about most words of a segment; folders; documents for which a folder's blocks are written by one task.
PER_SEGMENT, MOST_WORDS, BUCKETS, PER_TASK = 512, 1 << 19, 32, 1_000_000
#: Words and lexemes that a task keeps the numbers of from one segment to the next.
MOST_KNOWN = 1 << 20
#: Segments that a ranked query scores first, for each result asked for; more than these are not named in the filter but joined.
FIRST, NAMED = 2, 512
#: Positions of a lexeme in a document that ts_rank looks at.
RANKED_POSITIONS = 256

_TOKEN = re.compile("[a-z0-9]+")


# --- building -------------------------------------------------------------------------------------------------------


class _Segment:
    """The words of a run of documents as numbers, and their blocks."""

    def __init__(self, english: bool, avg: float) -> None:
        self.english, self.avg, self.number, self.lexemes = english, avg, {}, []
        self.clear()

    def clear(self) -> None:
        """For the next run. Only here may a full table of numbers be emptied: those of a run are looked up until its blocks are made."""
        if len(self.number) > MOST_KNOWN:
            self.number, self.lexemes = {}, []
        self.rows: list[int] = []
        self.words: list[np.ndarray] = []
        self.held = 0

    def _new(self, word: str) -> int:
        """The number of a word's lexeme, -1 for a stop word; kept for the next time."""
        lexeme = -1 if self.english and word in _STOPS else stem(word) if self.english else word
        if lexeme != -1:
            key = "\0" + lexeme  # no word has that character
            if (n := self.number.get(key)) is None:
                n = self.number[key] = len(self.lexemes)
                self.lexemes.append(lexeme)
            lexeme = n
        self.number[word] = lexeme
        return lexeme

    def add(self, row: int, text: str) -> None:
        get, new = self.number.get, self._new
        own = np.array([n if (n := get(w)) is not None else new(w) for w in _TOKEN.findall(text)], np.int32)
        self.rows.append(row)
        self.words.append(own)
        self.held += len(own)

    def blocks(self, ids: pa.Array, whole: bool, segment: int) -> pa.RecordBatch:
        """A row for each lexeme of the run; ids are those of its documents."""
        order = pc.sort_indices(ids).to_numpy()  # so that a block's documents rise
        own = [self.words[i] for i in order]
        sizes = np.array([len(w) for w in own])
        lex, doc = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
        pos = np.arange(1, len(lex) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = lex >= 0
        lex, doc, pos = lex[kept], doc[kept], pos[kept]
        lens = np.bincount(doc, minlength=len(own))
        by = np.argsort(lex, kind="stable")
        lex, doc, pos = lex[by], doc[by], pos[by]
        first = np.flatnonzero(np.r_[True, (lex[1:] != lex[:-1]) | (doc[1:] != doc[:-1])]) if len(lex) else np.zeros(0, np.int64)
        gaps = np.diff(pos, prepend=0)
        gaps[first] = pos[first]
        plex, pdoc, tf = lex[first], doc[first], np.diff(np.r_[first, len(lex)])
        n = lens[pdoc]
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / self.avg))
        at = np.flatnonzero(np.r_[True, plex[1:] != plex[:-1]]) if len(plex) else np.zeros(0, np.int64)
        outer = pa.array(np.r_[at, len(plex)].astype(np.int32))
        lists = lambda flat: pa.ListArray.from_arrays(outer, flat)
        if whole:
            number = ids.cast(pa.int64()).to_numpy()[order][pdoc]
            delta = np.diff(number, prepend=0)
            delta[at] = number[at]
            held = pa.array(delta)
        else:
            held = ids.take(pa.array(order[pdoc]))
        inner = pa.ListArray.from_arrays(pa.array(np.r_[first, len(lex)].astype(np.int32)), pa.array(gaps.astype(np.int32)))
        cols = [
            pa.array([self.lexemes[i] for i in plex[at]], pa.string()), pa.array(np.full(len(at), segment, np.int64)), pa.array(np.diff(np.r_[at, len(plex)]).astype(np.int32)),
            pa.array(np.add.reduceat(tf, at).astype(np.int64) if len(at) else np.zeros(0, np.int64)), pa.array(np.maximum.reduceat(part, at) if len(at) else np.zeros(0)),
            lists(held), lists(pa.array(tf.astype(np.int32))), lists(pa.array(n.astype(np.int32))), lists(inner),
        ]
        return pa.RecordBatch.from_arrays(cols, ["lexeme", "segment", "docs", "occurrences", "best", "ids", "tfs", "lens", "gaps"])


_STOPS = frozenset(STOP_WORDS)


def _sums(c: Column) -> Column:
    """The array of longs whose differences c holds: for a block's documents, which are few."""
    none = F.array().cast("array<long>")
    return F.aggregate(c, F.struct(none.alias("out"), F.lit(0).cast("long").alias("last")), lambda s, x: F.struct(F.array_append(s["out"], s["last"] + x).alias("out"), (s["last"] + x).alias("last")), lambda s: s["out"])


def _running_sums(c: pa.Array) -> pa.Array:
    at, flat = np.asarray(c.offsets, np.int64), np.asarray(c.values, np.int64)
    total = np.concatenate([[0], np.cumsum(flat)])
    own = total[1:][at[0] : at[-1]] - np.repeat(total[at[:-1]], np.diff(at))
    return pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(own.astype(np.int32)))


#: The same for positions, of which a long text has many: linear in their number, in Arrow batches.
_running = F.arrow_udf(_running_sums, ArrayType(IntegerType()))


def _tf_part(tf: Column, length: Column, avg: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(avg)))


def build(docs: DataFrame, path: str, id: str = "id", text: str = "content", english: bool = True, per_segment: int = PER_SEGMENT, buckets: int = BUCKETS, per_task: int = PER_TASK, mode: str = "error") -> None:
    """Writes the index of docs under path: `blocks` and `lexicon` in folders by bucket, and `about`, a row of statistics.

    Rows whose id is null or whose text has no word are in the counts and in no block. Ids should be unique: a row is a
    document, and one whose id stands twice is found twice. Words are stemmed where they are read and blocks made there, so
    blocks alone are shuffled. With mode `overwrite`, an index at path is replaced, `about` last.
    """
    spark, kind = docs.sparkSession, docs.schema[id].dataType.simpleString()
    w = words(text)
    size = F.size(F.filter(w, lambda x: ~is_stop_word(x))) if english else F.size(w)
    n, total = docs.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col(text).isNotNull(), size)), F.lit(0))).first()
    avg, slots, whole = max(total / n, 1e-9) if n else 1.0, max(1, n // per_task), kind in _WHOLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment, made = TaskContext.get().partitionId() << 32, _Segment(english, avg)
        for b in batches:
            ids = b.column(0)
            for i, t in enumerate(b.column(1)):
                made.add(i, t.as_py() or "")
                if len(made.rows) == per_segment or made.held > MOST_WORDS or i == b.num_rows - 1:
                    own = made.blocks(ids.take(pa.array(made.rows)), whole, segment)
                    yield from _sealed(own, segment, buckets)
                    segment += 1
                    made.clear()

    rows = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.lower(text).alias("t"))
    sealed = rows.mapInArrow(run, "bucket int, segment long, blocks binary")
    dealt = sealed.repartition("bucket", F.pmod(F.xxhash64("segment"), F.lit(slots))).mapInArrow(_opened, f"{_blocks_ddl(kind)}, bucket int")
    write = lambda df, name: df.sortWithinPartitions("bucket", "lexeme").write.mode(mode).option("partitionOverwriteMode", "static").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/{name}")
    write(dealt, "blocks")
    written = spark.read.schema(f"{_blocks_ddl(kind)}, bucket int").parquet(f"{path}/blocks")
    write(written.groupBy("bucket", "lexeme").agg(F.sum("docs").alias("df"), F.sum("occurrences").alias("cf"), F.max("best").alias("best")).repartition("bucket"), "lexicon")
    about = [(n, avg, english, buckets, kind)]
    spark.createDataFrame(about, "docs long, avg_len double, english boolean, buckets int, id_type string").coalesce(1).write.mode(mode).parquet(f"{path}/about")


def _bucket(lexemes: pa.Array, buckets: int) -> np.ndarray:
    return np.array([zlib.crc32(x.encode()) % buckets for x in lexemes.to_pylist()], np.int32)


def _sealed(blocks: pa.RecordBatch, segment: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, segment, blocks): a segment's blocks of a bucket as one compressed value, since rows of short arrays shuffle at many times their size."""
    of, out = _bucket(blocks.column(0), buckets), ([], [])
    for k in np.unique(of):
        sink = pa.BufferOutputStream()
        own = blocks.take(pa.array(np.flatnonzero(of == k)))
        with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(own)
        out[0].append(k)
        out[1].append(sink.getvalue().to_pybytes())
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array([segment] * len(out[0]), pa.int64()), pa.array(out[1], pa.binary())], ["bucket", "segment", "blocks"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for bucket, blob in zip(b.column(0).to_pylist(), b.column(2)):
            for own in pa.ipc.open_stream(blob.as_buffer()):
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(own.num_rows, bucket, np.int32))], [*own.schema.names, "bucket"])


_WHOLE = ("bigint", "int", "smallint", "tinyint")


def _blocks_ddl(id_type: str) -> str:
    return f"lexeme string, segment long, docs int, occurrences long, best double, ids array<{'long' if id_type in _WHOLE else id_type}>, tfs array<int>, lens array<int>, gaps array<array<int>>"


# --- reading --------------------------------------------------------------------------------------------------------


@dataclass
class Index:
    spark: SparkSession
    path: str
    docs: int
    avg_len: float
    english: bool
    buckets: int
    id_type: str

    @property
    def whole(self) -> bool:
        return self.id_type in _WHOLE

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(f"{_blocks_ddl(self.id_type)}, bucket int").parquet(f"{self.path}/blocks")

    def lexicon(self) -> DataFrame:
        """(lexeme, df, cf, best, bucket)"""
        return self.spark.read.schema("lexeme string, df long, cf long, best double, bucket int").parquet(f"{self.path}/lexicon")

    def of(self, rows: DataFrame, lexemes: list[str]) -> DataFrame:
        """rows of some lexemes: their buckets are known here, so only those folders are listed and read."""
        own = _bucket(pa.array(lexemes, pa.string()), self.buckets).tolist()
        return rows.where(F.col("bucket").isin(sorted(set(own))) & F.col("lexeme").isin(lexemes))


def load(spark: SparkSession, path: str) -> Index:
    r = spark.read.parquet(f"{path}/about").first()
    return Index(spark, path, r["docs"], r["avg_len"], r["english"], r["buckets"], r["id_type"])


Phrase = list[tuple[int, str]]  # distances from the first lexeme


def lexical(index: Index, query: str | Query) -> list[tuple[list[Phrase], list[Phrase]]]:
    """The alternatives of a web-search query as (required, excluded) phrases of lexemes; stop words go, what stands around them keeps its distance.

    A required phrase of stop words alone is dropped; so is an alternative of which nothing required is left.
    """
    q = parse_query(query) if isinstance(query, str) else query
    every = sorted({w for must, never in q.any_of for p in [*must, *never] for w in p})
    stems = {w: stem(w) if index.english else w for w in every}

    def phrase(p: list[str]) -> Phrase:
        kept = [(i, stems[w]) for i, w in enumerate(p) if not (index.english and w in STOP_WORDS)]
        return [(i - kept[0][0], x) for i, x in kept]

    out = [([x for p in must if (x := phrase(p))], [x for p in never if (x := phrase(p))]) for must, never in q.any_of]
    return [(must, never) for must, never in out if must]


def _postings(index: Index, blocks: DataFrame, positions: bool) -> DataFrame:
    """(lexeme, segment, id, tf, len, at) of blocks; at only with positions, so that otherwise their column isn't read."""
    ids = _sums(F.col("ids")) if index.whole else F.col("ids")
    cols = [ids.alias("id"), F.col("tfs").alias("tf"), F.col("lens").alias("len")] + ([F.col("gaps").alias("gap")] if positions else [])
    rows = blocks.select("lexeme", "segment", F.arrays_zip(*cols).alias("z")).select("lexeme", "segment", F.inline("z"))
    if positions:
        rows = rows.withColumn("at", _running(F.col("gap"))).drop("gap")
    return rows.withColumn("id", F.col("id").cast(index.id_type))


def _at(lexeme: str, place: dict[str, int]) -> Column:
    return F.coalesce(F.col("places")[place[lexeme]], F.array().cast("array<int>"))


def _matches(alternatives: list[tuple[list[Phrase], list[Phrase]]], place: dict[str, int]) -> Column:
    """Whether a document with the bits `mask` of lexemes, and their positions `places` where phrases are asked for, satisfies one alternative."""

    def one(p: Phrase) -> Column:
        need = sum({1 << place[x] for _, x in p})
        held = F.col("mask").bitwiseAND(need) == need
        if len(p) > 1:
            follows = lambda s: reduce(lambda a, b: a & b, (F.array_contains(_at(x, place), s + d) for d, x in p[1:]))
            held = held & F.exists(_at(p[0][1], place), follows)
        return held

    out = F.lit(False)
    for must, never in alternatives:
        hit = F.lit(True)
        for p in must:
            hit = hit & one(p)
        for p in never:
            hit = hit & ~one(p)
        out = out | hit
    return out


def _lexemes(alternatives: list[tuple[list[Phrase], list[Phrase]]], excluded: bool = True) -> list[str]:
    return sorted({x for must, never in alternatives for p in [*must, *(never if excluded else [])] for _, x in p})


def _candidates(index: Index, blocks: DataFrame, alternatives: list, df: dict[str, int], positions: bool) -> DataFrame:
    """(id, mask, score, places): documents of blocks that satisfy the query, with their BM25 over what is required."""
    every, scored = _lexemes(alternatives), _lexemes(alternatives, False)
    place = {x: i for i, x in enumerate(every)}
    bit = reduce(lambda c, x: c.when(F.col("lexeme") == x, 1 << place[x]), every, F).otherwise(0).cast("long")
    weight = reduce(lambda c, x: c.when(F.col("lexeme") == x, _idf(index.docs, df.get(x, 0)) if x in scored else 0.0), every, F).otherwise(0.0)
    part = weight * _tf_part(F.col("tf"), F.col("len"), index.avg_len)
    # summed in order of the lexemes, so that equal documents have equal scores however rows arrive
    parts = F.array_sort(F.collect_list(F.struct("lexeme", part.alias("s"))))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["s"])
    aggs = [F.bit_or(bit).alias("mask"), total.alias("score")]
    if positions:
        aggs.append(F.array(*(F.max(F.when(F.col("lexeme") == x, F.col("at"))) for x in every)).alias("places"))
    rows = _postings(index, blocks, positions).groupBy("segment", "id").agg(*aggs)
    return rows.where(_matches(alternatives, place)).drop("segment")


def _idf(n: int, df: int) -> float:
    return float(np.log(1 + (n - df + 0.5) / (df + 0.5)))


def _needs_positions(alternatives: list) -> bool:
    return any(len(p) > 1 for must, never in alternatives for p in [*must, *never])


def _frequencies(index: Index, lexemes: list[str]) -> dict[str, int]:
    return {r["lexeme"]: r["df"] for r in index.of(index.lexicon(), lexemes).select("lexeme", "df").collect()}


def _none(index: Index) -> DataFrame:
    return index.spark.createDataFrame([], f"id {index.id_type}, score double")


def match(index: Index, query: str | Query) -> DataFrame:
    """(id, score) of all documents that satisfy the query, by BM25; phrases by position."""
    alternatives = lexical(index, query)
    if not alternatives:
        return _none(index)
    blocks = index.of(index.blocks(), _lexemes(alternatives))
    return _candidates(index, blocks, alternatives, _frequencies(index, _lexemes(alternatives)), _needs_positions(alternatives)).select("id", "score")


def topk(index: Index, query: str | Query, limit: int = 20) -> DataFrame:
    """(id, score), greatest first, ties by id: the first rows of `match`, from as few blocks as their bounds allow.

    The driver gets the most promising segments, FIRST for each row asked for, and one score.
    """
    alternatives = lexical(index, query)
    if not alternatives:
        return _none(index)
    every, scored = _lexemes(alternatives), _lexemes(alternatives, False)
    df = _frequencies(index, every)
    place = {x: i for i, x in enumerate(every)}
    heads = segment_bounds(index, alternatives, df, place)
    first = heads.orderBy(F.desc("bound"), "segment").limit(max(8, FIRST * limit)).collect()
    blocks, positions = index.of(index.blocks(), every), _needs_positions(alternatives)
    seen = [r["segment"] for r in first]
    best = _candidates(index, blocks.where(F.col("segment").isin(seen)), alternatives, df, positions).select("id", "score").orderBy(F.desc("score"), "id").limit(limit)
    held = best.collect()
    sure = held[-1]["score"] if len(held) == limit else -1.0
    rest = heads.where((F.col("bound") >= sure - 1e-9) & ~F.col("segment").isin(seen)).select("segment")
    more = rest.limit(NAMED + 1).collect()
    known = index.spark.createDataFrame([tuple(r) for r in held], f"id {index.id_type}, score double")
    if not more:
        return known.orderBy(F.desc("score"), "id").limit(limit)
    left = blocks.where(F.col("segment").isin([r["segment"] for r in more])) if len(more) <= NAMED else blocks.join(rest, "segment", "left_semi")
    found = _candidates(index, left, alternatives, df, positions).select("id", "score")
    return known.unionByName(found).orderBy(F.desc("score"), "id").limit(limit)


def segment_bounds(index: Index, alternatives: list, df: dict[str, int], place: dict[str, int]) -> DataFrame:
    """(segment, bound): what a document of a segment can score at most, by the blocks' greatest scores; segments that cannot satisfy the query are left out."""
    every, scored = list(place), _lexemes(alternatives, False)
    bit = reduce(lambda c, x: c.when(F.col("lexeme") == x, 1 << place[x]), every, F).otherwise(0).cast("long")
    weight = reduce(lambda c, x: c.when(F.col("lexeme") == x, _idf(index.docs, df.get(x, 0)) if x in scored else 0.0), every, F).otherwise(0.0)
    heads = index.of(index.blocks(), every).select("lexeme", "segment", "best").groupBy("segment").agg(F.bit_or(bit).alias("mask"), F.sum(weight * F.col("best")).alias("bound"))
    can = F.lit(False)
    for must, _ in alternatives:
        need = sum({1 << place[x] for p in must for _, x in p})
        can = can | (F.col("mask").bitwiseAND(need) == need)
    return heads.where(can).select("segment", "bound")


# --- rank by weighted positions -------------------------------------------------------------------------------------

# The weight of a word without a label, the limit of a sum of inverse squares, and the decay of distance.
_WEIGHT, _SQUARES = 0.1, 1.64493406685


def _closeness(distance: Column) -> Column:
    return F.when(distance > 100, 1e-30).otherwise(1.0 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2.0)))


def _apart(a: Column, b: Column) -> Column:
    """The product over all pairs of positions of what their closeness leaves."""
    near = lambda p, q: F.when(p == q, 1.0).otherwise(1.0 - _WEIGHT * F.sqrt(_closeness(F.abs(p - q).cast("double"))))
    return F.aggregate(a, F.lit(1.0), lambda s, p: F.aggregate(b, s, lambda t, q: t * near(p, q)))


def rank(index: Index, query: str | Query) -> DataFrame:
    """(id, score) of all documents that satisfy the query, ranked by where its lexemes stand.

    Of a query of alternatives: the mean over its lexemes of weights that fall with the square of the occurrence. Of one
    with several required lexemes: pairs of occurrences, the nearer the more. The first RANKED_POSITIONS positions count.
    """
    alternatives = lexical(index, query)
    if not alternatives:
        return _none(index)
    every = _lexemes(alternatives)
    place = {x: i for i, x in enumerate(every)}
    rows = _candidates(index, index.of(index.blocks(), every), alternatives, {}, True)
    at = {x: F.slice(_at(x, place), 1, RANKED_POSITIONS) for x in every}
    if len(alternatives) > 1 or len(every) < 2:
        squares = lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c)), F.lit(0.0), lambda s, j: s + _WEIGHT / (j.cast("double") * j))
        score = reduce(lambda a, b: a + b, (F.when(F.size(c) > 0, squares(c) / _SQUARES).otherwise(0.0) for c in at.values())) / len(every)
    else:
        far = (_apart(at[x], at[y]) for i, x in enumerate(every) for y in every[:i])
        score = 1.0 - reduce(lambda a, b: a * b, far)
    return rows.select("id", score.alias("score"))
