"""Lexical, vector and hybrid search, rank fusion and reranking.

The corpus is a DataFrame with an id column. Postings and document statistics are DataFrames too, so they can be written once
and bucketed by token; a query reads its own tokens' postings only. Queries may come in numbers: functions with `queries` take
a table of them and give each its own top k.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..functions.text import words
from ..functions.vector import as_double, cosine, literal, matrix, packed
from ..session import shared_dir

K1, B, RRF_K = 1.2, 0.75, 60


# --- query language -------------------------------------------------------------------------------------------------


@dataclass
class Query:
    """Alternatives (or) of required terms and phrases (and), with excluded ones."""

    any_of: list[tuple[list[list[str]], list[list[str]]]] = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        return sorted({w for must, _ in self.any_of for phrase in must for w in phrase})


def parse_query(text: str) -> Query:
    """Web-search syntax: words are all required, "quoted words" stand together, `or` between alternatives, - excludes."""
    out, must, never = Query(), [], []
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        if not quoted and word.lower() == "or" and not minus:
            if must or never:
                out.any_of.append((must, never))
            must, never = [], []
            continue
        phrase = re.findall(r"[a-z0-9]+", (quoted or word).lower())
        if phrase:
            (never if minus else must).append(phrase)
    if must or never:
        out.any_of.append((must, never))
    return out


def _has(tokens: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.array_contains(tokens, phrase[0])
    line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return line.contains(f" {' '.join(phrase)} ")


def matches(tokens: Column, query: Query | str) -> Column:
    """Whether a token array satisfies the query; a query without words matches nothing."""
    q = parse_query(query) if isinstance(query, str) else query
    out = F.lit(False)
    for must, never in q.any_of:
        one = F.lit(True)
        for p in must:
            one = one & _has(tokens, p)
        for p in never:
            one = one & ~_has(tokens, p)
        out = out | one
    return out


# --- lexical --------------------------------------------------------------------------------------------------------


def postings(docs: DataFrame, id: str = "id", text: str = "content") -> DataFrame:
    """(token, id, tf, len), ready to be bucketed by token. A document's tokens are counted before any shuffle."""
    t = docs.select(F.col(id).alias("id"), words(text).alias("w"))
    counted = t.select("id", F.size("w").cast("long").alias("len"), F.explode("w").alias("token"))
    return counted.groupBy("token", "id").agg(F.count("*").alias("tf"), F.max("len").alias("len"))


def corpus_stats(docs: DataFrame, text: str = "content") -> DataFrame:
    """One row (n, avg_len)."""
    n = F.size(words(text))
    return docs.agg(F.count("*").alias("n"), F.avg(n).alias("avg_len"))


def _count(tokens: Column, term: str) -> Column:
    return (F.size(tokens) - F.size(F.array_remove(tokens, term))).cast("double")


def bm25(docs: DataFrame, query: str, id: str = "id", text: str = "content", k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of the documents that satisfy the query, by Okapi BM25 over its terms.

    The terms are few and known, so their counts are columns of one scan; document frequencies and lengths are one partial
    aggregate of one row, which is all that is broadcast.
    """
    q = parse_query(query)
    rows, stats = _counted(docs.select(F.col(id).alias("id"), words(text).alias("w")), q)
    return rows.where("hit").crossJoin(F.broadcast(stats)).select("id", _okapi(len(q.terms), k1, b).alias("score"))


def _counted(base: DataFrame, q: Query) -> tuple[DataFrame, DataFrame]:
    """base (w, ...) with len, tf0, tf1, ... and hit in place of its tokens w, and its corpus statistics: one row."""
    tf = [_count(F.col("w"), t).alias(f"tf{i}") for i, t in enumerate(q.terms)]
    rows = base.select(*(c for c in base.columns if c != "w"), F.size("w").alias("len"), *tf, matches(F.col("w"), q).alias("hit"))
    return rows, rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(tf))))


def _okapi(terms: int, k1: float = K1, b: float = B) -> Column:
    """The score of a row of _counted beside the statistics."""
    score = F.lit(0.0)
    for i in range(terms):
        t, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return score


def bm25_postings(index: DataFrame, stats: DataFrame, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """bm25 over written postings and statistics: reads the query's tokens only, where bm25 scans all texts.

    With the postings bucketed or sorted by token the filter prunes files. Which terms a document has is a bit mask, from
    which the query's alternatives and exclusions follow. Phrases need positions, which postings don't have: ValueError.
    """
    q = parse_query(query)
    if any(len(p) > 1 for must, never in q.any_of for p in [*must, *never]):
        raise ValueError("phrases need the texts: use bm25")
    terms = q.terms
    every = sorted({p[0] for must, never in q.any_of for p in [*must, *never]})
    if not every:
        return index.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    place = {t: i for i, t in enumerate(every)}
    own = index.where(F.col("token").isin(every))
    df = own.groupBy("token").agg(F.count("*").cast("double").alias("df"))  # a row for each term of the query
    rows = own.join(F.broadcast(df), "token").crossJoin(F.broadcast(stats))
    n, d, tf = F.col("n"), F.col("df"), F.col("tf")
    part = F.log(1 + (n - d + 0.5) / (d + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    bit = F.element_at(F.create_map(*(F.lit(x) for t, i in place.items() for x in (t, 1 << i))), F.col("token"))
    per = rows.groupBy("id").agg(F.sum(F.when(F.col("token").isin(terms), part).otherwise(0.0)).alias("score"), F.bit_or(bit).alias("mask"))
    hit = F.lit(False)
    for must, never in q.any_of:
        need, bad = sum({1 << place[p[0]] for p in must}), sum({1 << place[p[0]] for p in never})
        if need:  # a query of exclusions alone would need the documents that have no posting
            hit = hit | ((F.col("mask").bitwiseAND(need) == need) & (F.col("mask").bitwiseAND(bad) == 0))
    return per.where(hit).select("id", "score")


def lexical_topk(docs: DataFrame, query: str, limit: int = 20, id: str = "id", text: str = "content") -> DataFrame:
    """(id, score), greatest first, ties by id."""
    return bm25(docs, query, id, text).orderBy(F.desc("score"), "id").limit(limit)


# --- vectors --------------------------------------------------------------------------------------------------------


def vector_scores(corpus: DataFrame, query: list[float], id: str = "id", embedding: str = "embedding", min_similarity: float | None = None) -> DataFrame:
    """(id, score): cosines with one vector, null vectors left out."""
    rows = corpus.where(F.col(embedding).isNotNull()).select(F.col(id).alias("id"), cosine(as_double(embedding), literal(query)).alias("score"))
    return rows.where(F.col("score") >= min_similarity) if min_similarity is not None else rows.where(F.col("score").isNotNull())


def vector_topk(corpus: DataFrame, query: list[float], limit: int = 20, min_similarity: float = 0.5, id: str = "id", embedding: str = "embedding") -> DataFrame:
    """(id, score): a scan with a top-k in each task (TakeOrderedAndProject)."""
    return vector_scores(corpus, query, id, embedding, min_similarity).orderBy(F.desc("score"), "id").limit(limit)


#: Rows of the corpus and queries that meet as one product of matrices.
PART, BLOCK = 16_384, 4096


def batch_topk(corpus: DataFrame, queries: DataFrame, k: int, id: str = "id", embedding: str = "embedding", part: int = PART, block: int = BLOCK) -> DataFrame:
    """(qid, id, score, rank) of every query (qid, vector) against all rows, in one plan whatever their numbers.

    Rows are dealt to parts of about `part` and queries to blocks of about `block` at random; each part meets each block once,
    as a product of two matrices, and gives k rows for each query. Work and what is shuffled grow with rows times queries:
    `ann.nearest` visits a part of the rows. Vectors that are null, have no direction or another dimension meet none.
    """
    rows, asked = packed(corpus, id, embedding), packed(queries, "qid", "vector", "qid")
    many = lambda df, most: max(1, -(-df.count() // most))
    parts, blocks = many(corpus, part), many(queries, block)
    place = lambda n: F.least(F.floor(F.rand(3) * n), F.lit(n - 1)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    size = F.octet_length("v").alias("size")
    # drawn once for a row, before it is repeated
    left = rows.withColumn("part", place(parts)).select(size, "part", every(blocks).alias("block"), "id", "v")
    right = asked.withColumn("block", place(blocks)).select(size, every(parts).alias("part"), "block", "qid", "v")
    kind_q, kind_i = queries.schema["qid"].dataType.simpleString(), corpus.schema[id].dataType.simpleString()

    def meet(key: tuple, own: pa.Table, questions: pa.Table) -> pa.Table:
        ids, qids = own.column("id").combine_chunks(), questions.column("qid").combine_chunks()
        if not len(ids) or not len(qids):
            return pa.table({"qid": qids.slice(0, 0), "id": ids.slice(0, 0), "score": pa.array([], pa.float64())})
        x, q = (matrix(t.column("v"), key[0].as_py() // 8) for t in (own, questions))
        order, found = places(ids), []
        step = max(1, (1 << 22) // len(x))
        for i in range(0, len(q), step):
            s = q[i : i + step] @ x.T
            for r in range(len(s)):
                at = np.partition(s[r], -k)[-k] if len(x) > k else -2.0
                near = np.flatnonzero(s[r] >= at - 1e-9)
                best, score = best_of(near, (x[near] * q[i + r]).sum(1), order, k)
                found.append((np.full(len(best), i + r), best, score))
        a, b, c = (np.concatenate(z) for z in zip(*found))
        return pa.table({"qid": qids.take(pa.array(a)), "id": ids.take(pa.array(b)), "score": pa.array(c)})

    names = ("size", "part", "block")
    near = left.groupBy(*names).cogroup(right.groupBy(*names)).applyInArrow(meet, f"qid {kind_q}, id {kind_i}, score double")
    return ranked(near, k)


def places(ids: pa.Array) -> np.ndarray:
    """The place of each id among all."""
    out = np.empty(len(ids), np.int64)
    out[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return out


def best_of(rows: np.ndarray, scores: np.ndarray, order: np.ndarray, k: int, low: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The k of rows of greatest score, from `low` on, ties by `order`; scores are sums in one order, so equal vectors tie."""
    good = scores >= low - 1e-9
    rows, scores = rows[good], scores[good]
    best = np.lexsort((order[rows], -scores))[:k]
    return rows[best], scores[best]


def ranked(scored: DataFrame, k: int | None = None, by: str = "qid") -> DataFrame:
    """scored (by, id, score) with the rank in each group from 1; rows beyond k left out (Spark limits groups before the sort)."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    out = scored.withColumn("rank", F.row_number().over(w).cast("long"))
    return out if k is None else out.where(F.col("rank") <= k)


def ranked_whole(scored: DataFrame) -> DataFrame:
    """(id, rank) of a whole list (id, score), greatest first, ties by id: sorted by ranges, each of which starts where the last ended.

    The sorted list is checkpointed (cached in a session without a folder for it), since the ranges' bounds are sampled. Only the ranges' sizes come to the driver.
    """
    place = F.monotonically_increasing_id()  # the partition above bit 33, the row in it below
    rows = scored.select("id", "score").orderBy(F.desc("score"), "id").select("id", F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND((1 << 33) - 1).alias("at"))
    rows = rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.cache()
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, done = [], 0
    for part, n in sizes:
        starts.append((part, done))
        done += n
    first = rows.sparkSession.createDataFrame(starts, "part int, done long")
    return rows.join(F.broadcast(first), "part").select("id", (F.col("done") + F.col("at") + 1).alias("rank"))


# --- fusion ---------------------------------------------------------------------------------------------------------


def normalised(scores: DataFrame) -> DataFrame:
    """Scores divided by the greatest one, so that they lie in [0, 1]."""
    top = scores.agg(F.max("score").alias("top"))
    return scores.crossJoin(F.broadcast(top)).select("id", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0).alias("score"))


def hybrid(dense: DataFrame | None, sparse: DataFrame | None, alpha: float = 0.7, limit: int = 20) -> DataFrame:
    """(id, dense_score, sparse_score, combined_score) from two (id, score) lists.

    Cosines below 0 count as 0 and lexical scores are divided by their greatest. At alpha 1 only dense hits are candidates
    and sparse scores are 0, at alpha 0 the other way round; between them, either list's hits are.
    """
    zero = lambda df: df.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    if dense is None and sparse is None:
        raise ValueError("a dense or a sparse list is needed")
    d = dense.select("id", F.greatest("score", F.lit(0.0)).alias("score")) if dense is not None and alpha > 0 else None
    s = normalised(sparse) if sparse is not None and alpha < 1 else None
    d, s = d if d is not None else zero(s), s if s is not None else zero(d)
    both = d.withColumnRenamed("score", "d").join(s.withColumnRenamed("score", "s"), "id", "full")
    dense_score, sparse_score = F.coalesce("d", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    out = both.select("id", dense_score.alias("dense_score"), sparse_score.alias("sparse_score"))
    return out.withColumn("combined_score", alpha * F.col("dense_score") + (1 - alpha) * F.col("sparse_score")).orderBy(F.desc("combined_score"), "id").limit(limit)


def hybrid_rows(corpus: DataFrame, query: str, query_vector: list[float] | None, alpha: float = 0.7, limit: int = 20, min_similarity: float = 0.0) -> DataFrame:
    """hybrid for a corpus (id, content, embedding, ...) that holds texts and vectors, with the corpus columns.

    Both scores are columns of one projection, so no list is shuffled or joined by id: a scan for the statistics, one for the
    greatest lexical score, one for the top k. A row counts by its cosine from min_similarity on, by its text if that satisfies
    the query; one without either is no candidate. Without a vector, or at alpha 0, only texts count; at alpha 1 only vectors.
    """
    alpha = alpha if query_vector is not None else 0.0
    q = parse_query(query if alpha < 1 else "")
    rows = corpus.select(F.struct(*corpus.columns).alias("row"), *([cosine(as_double("embedding"), literal(query_vector)).alias("d")] if alpha > 0 else [F.lit(None).cast("double").alias("d")]), *([words("content").alias("w")] if alpha < 1 else []))
    near = F.when(F.col("d") >= min_similarity, F.greatest("d", F.lit(0.0)))
    if alpha < 1:
        rows, stats = _counted(rows, q)
        rows = rows.crossJoin(F.broadcast(stats))
        found = F.when(F.col("hit"), _okapi(len(q.terms)))
    else:
        found = F.lit(None).cast("double")
    both = rows.select("row", near.alias("d"), found.alias("s")).where("d is not null or s is not null")
    sparse = F.lit(0.0)
    if alpha < 1:
        both = both.crossJoin(F.broadcast(both.agg(F.max("s").alias("top"))))
        sparse = F.coalesce(F.when(F.col("top") > 0, F.col("s") / F.col("top")), F.lit(0.0))
    out = both.select("row", F.coalesce("d", F.lit(0.0)).alias("dense_score"), sparse.alias("sparse_score"))
    out = out.withColumn("combined_score", alpha * F.col("dense_score") + (1 - alpha) * F.col("sparse_score"))
    return out.orderBy(F.desc("combined_score"), F.col("row")["id"]).limit(limit).select("row.*", "dense_score", "sparse_score", "combined_score")


def reciprocal_rank_fusion(lists: list[DataFrame], limit: int = 20, k: int = RRF_K) -> DataFrame:
    """(id, score): the sum of 1 / (k + rank) over ranked lists (id, rank)."""
    parts = [x.select("id", (1.0 / (k + F.col("rank"))).alias("s")) for x in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def fused_topk(lists: list[DataFrame], limit: int = 20, k: int = RRF_K) -> DataFrame:
    """(id, score): the first rows of the reciprocal rank fusion of whole lists (id, score), none of which is sorted.

    The `limit`-th of a list alone has 1 / (k + limit), and an id beyond the first m of every list at most lists / (k + m + 1):
    with m = lists * (k + limit) - k - 1 the result is among the first m of each. Those of them that can still get there
    are looked up in the other lists, and their ranks there counted. The driver gets m rows for each list and a count for each.
    An id stands once in a list.
    """
    spark = lists[0].sparkSession
    shared_dir(spark)
    kept = [x.select("id", "score").where("score is not null").checkpoint() for x in lists]
    m = len(kept) * (k + limit) - k - 1
    heads = [x.orderBy(F.desc("score"), "id").limit(m).collect() for x in kept]
    ranks = [{r["id"]: i for i, r in enumerate(h, 1)} for h in heads]
    seen = sorted({i for r in ranks for i in r})
    least = {i: sum(1 / (k + r[i]) for r in ranks if i in r) for i in seen}
    most = {i: least[i] + sum(1 / (k + m + 1) for r in ranks if i not in r) for i in seen}
    sure = sorted(least.values(), reverse=True)[:limit][-1:] or [0.0]
    able = [i for i in seen if most[i] >= sure[0] - 1e-12]
    for x, r, h in zip(kept, ranks, heads):
        if len(h) == m:  # a shorter list is known whole
            r.update(_ranks(x, [i for i in able if i not in r]))
    kind = lists[0].schema["id"].dataType.simpleString()
    scored = sorted(((i, sum(1 / (k + r[i]) for r in ranks if i in r)) for i in able), key=lambda s: (-s[1], s[0]))[:limit]
    return spark.createDataFrame(scored, f"id {kind}, score double").orderBy(F.desc("score"), "id")


def _ranks(scored: DataFrame, ids: list) -> dict:
    """The ranks of some ids of a list: rows are counted between the ids' own, in one aggregate."""
    if not ids:
        return {}
    own = sorted(((-r["score"], r["id"]) for r in scored.where(F.col("id").isin(ids)).collect()))
    if not own:
        return {}
    place = lambda s, i: F.struct(s.alias("s"), i.alias("i"))
    bounds = F.array(*(place(F.lit(s), F.lit(i).cast(scored.schema["id"].dataType)) for s, i in own))
    before = F.size(F.filter(bounds, lambda b: b < place(-F.col("score"), F.col("id"))))
    counts = {r["b"]: r["n"] for r in scored.where(F.col("score") >= -own[-1][0]).groupBy(before.alias("b")).agg(F.count("*").alias("n")).collect()}
    out, ahead = {}, 0
    for j, (_, i) in enumerate(own):
        ahead += counts.get(j, 0)
        out[i] = ahead  # the id itself is the last that has j bounds before it
    return out


# --- reranking and filters ------------------------------------------------------------------------------------------


def overlap_score(query: str, text: Column | str) -> Column:
    """Share of the query's distinct words that the text has."""
    q = sorted(set(re.findall(r"[a-z0-9]+", query.lower())))
    if not q:
        return F.lit(0.0)
    return F.size(F.array_intersect(F.array(*map(F.lit, q)), words(text))) / F.lit(float(len(q)))


def rerank(results: DataFrame, query: str, top_n: int = 20, scorer=None, score: str = "combined_score", text: str = "content", id: str = "id") -> DataFrame:
    """The best top_n by `scorer` (query, text column) -> score column; without a scorer the first top_n as they are.

    The score takes the old one's place and, where results have a map `metadata`, is its `rerank_score` too.
    """
    out = results.withColumn(score, scorer(query, F.col(text))) if scorer else results
    if scorer and "metadata" in results.columns and isinstance(results.schema["metadata"].dataType, MapType):
        own = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: k != "rerank_score")
        out = out.withColumn("metadata", F.map_concat(own, F.create_map(F.lit("rerank_score"), F.col(score).cast("string"))))
    return out.orderBy(F.desc(score), id).limit(top_n)


def relevance_filter(scored: DataFrame, threshold: float = 0.5, score: str = "score") -> DataFrame:
    """Rows scored at the threshold or above; rows whose score is null could not be judged and stay at 0.5."""
    return scored.withColumn(score, F.coalesce(score, F.lit(0.5))).where(F.col(score) >= threshold)


def filter_relevance(results: DataFrame, query: str, threshold: float = 0.5, scorer=overlap_score, score: str = "relevance", text: str = "content") -> DataFrame:
    """results scored by `scorer` (query, text column) -> 0..1, by default the share of the query's words, and cut at the threshold."""
    return relevance_filter(results.withColumn(score, scorer(query, F.col(text))), threshold, score)


def metadata_filter(rows: DataFrame, filters: dict[str, str] | None, metadata: str = "metadata") -> DataFrame:
    """Rows whose metadata map has all the given values; applied before any top k."""
    for k, v in (filters or {}).items():
        rows = rows.where(F.element_at(metadata, F.lit(k)) == F.lit(str(v)))
    return rows


def search(corpus: DataFrame, query: str, query_vector: list[float] | None = None, limit: int = 20, alpha: float = 0.7, scorer=None, top_k_rerank: int = 50, filters: dict[str, str] | None = None, min_similarity: float = 0.0) -> DataFrame:
    """Filter, hybrid candidates, optional rerank of the top_k_rerank best, then `limit` of them, with the corpus columns."""
    rows = metadata_filter(corpus, filters) if filters else corpus
    fetch = top_k_rerank if scorer else limit
    return rerank(hybrid_rows(rows, query, query_vector, alpha, fetch, min_similarity), query, limit, scorer)
