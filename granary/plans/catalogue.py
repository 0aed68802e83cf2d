"""The query catalogue: the engine's operators over the driver tables, with SQL for those that SQL can express.

Stand-ins: documents are the corpus, embeddings their vectors, conversations agents' notes, customers, suppliers, nations and
regions a graph, events a log of file states, part names error patterns. Every query reads its whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.english import STOP_WORDS, stem_sql
from ..functions.vector import HashingEmbedder, embed_column
from ..operators import ann, containment, errors, graph, knowledge, manifest, memory, notelog, search, tables, textindex, wordvectors
from ..schemas import MEMORY_TYPES, conform, empty, schema
from ..session import prepare, shared_dir
from ..sources import files as src
from ..sources.chunks import ChunkConfig
from ..streaming import files
from ..streaming.ingest import event_counts
from . import ingest, retrieval

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, d: f(prepare(spark), d)
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("source_file"), "lang")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _probe(spark: SparkSession, d: str, id: int = 0) -> list[float]:
    return [float(x) for x in _t(spark, d, "embeddings").where(F.col("vec_id") == id).first()["embedding"]]


# --- vectors --------------------------------------------------------------------------------------------------------

_COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"
_SIM0 = f"SELECT a.vec_id, a.label, {_COS} AS sim FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b"


@query("vector_topk", f"SELECT vec_id AS id, round(sim, 6) AS score FROM ({_SIM0}) WHERE sim >= 0.2 ORDER BY sim DESC, vec_id LIMIT 20")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.vector_topk(_vectors(spark, d), _probe(spark, d), 20, 0.2).select("id", F.round("score", 6).alias("score"))


@query("vector_threshold", f"SELECT label, count(*) AS n FROM ({_SIM0}) WHERE sim >= 0.1 GROUP BY label")
def vector_threshold(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    hits = search.vector_scores(rows, _probe(spark, d), min_similarity=0.1)
    return rows.select("id", "label").join(hits, "id").groupBy("label").agg(F.count("*").alias("n"))


_ASKED = "(SELECT * FROM embeddings WHERE vec_id % 20 = 0)"


def _twentieth(rows: DataFrame) -> DataFrame:
    return rows.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))


@query("vector_batch_topk", f"""
WITH s AS (SELECT b.vec_id AS qid, a.vec_id AS id, {_COS} AS sim FROM embeddings a, {_ASKED} b),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM s)
SELECT qid, id, round(sim, 6) AS score, rank FROM r WHERE rank <= 5""")
def vector_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest of every id divisible by 20, so that the work grows with the table."""
    rows = _vectors(spark, d)
    return search.batch_topk(rows, _twentieth(rows), 5).withColumn("score", F.round("score", 6))


_NEAR = f"""
WITH s AS (SELECT b.vec_id AS qid, a.vec_id AS id, {_COS} AS sim FROM embeddings a, {_ASKED} b),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM s)
SELECT qid, id, round(sim, 6) AS score, rank FROM r WHERE rank <= 10"""


def _inverted(spark: SparkSession, d: str) -> tuple[ann.Index, DataFrame]:
    """An index over all vectors, written and read again, and as queries every id divisible by 20."""
    rows, path = _vectors(spark, d), f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    ann.build(rows, path)
    return ann.load(spark, path), _twentieth(rows)


@query("vector_ivf_topk")
def vector_ivf_topk(spark: SparkSession, d: str) -> DataFrame:
    """About the 10 nearest of every id divisible by 20; recall is measured in a test."""
    return ann.nearest(*_inverted(spark, d), 10).withColumn("score", F.round("score", 6))


@query("vector_ivf_exact", _NEAR)
def vector_ivf_exact(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest from the same index, cells and rows left out only by bounds."""
    return ann.nearest(*_inverted(spark, d), 10, exact=True).withColumn("score", F.round("score", 6))


@query("vector_label_knn", f"""
WITH s AS (SELECT b.vec_id AS qid, a.vec_id AS id, a.label, {_COS} AS sim FROM embeddings a, {_ASKED} b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS k FROM s),
v AS (SELECT qid, label, count(*) AS n FROM r WHERE k <= 5 GROUP BY qid, label),
w AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, label) AS k FROM v)
SELECT qid, label AS vote, n FROM w WHERE k = 1""")
def vector_label_knn(spark: SparkSession, d: str) -> DataFrame:
    """Majority label of the 5 nearest other vectors, for every id divisible by 20."""
    rows = _vectors(spark, d)
    near = search.ranked(search.batch_topk(rows, _twentieth(rows), 6).where("id <> qid").drop("rank"), 5).join(rows.select("id", "label"), "id")
    votes = near.groupBy("qid", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("qid").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("vote"), F.max("n").alias("n"))


# --- lexical --------------------------------------------------------------------------------------------------------

_W = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"
_TOKENS = f"SELECT doc_id, source, lang, {_W} AS w FROM documents"


def _match(q: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = _corpus(spark, d)
        return c.where(search.matches(T.words("content"), q)).select("id")

    return run


for _name, _q, _cond in (
    ("lexical_match_and", "licensed under license", "list_contains(w, 'licensed') AND list_contains(w, 'under') AND list_contains(w, 'license')"),
    ("lexical_match_or", "moron or clown or trash", "list_contains(w, 'moron') OR list_contains(w, 'clown') OR list_contains(w, 'trash')"),
    ("lexical_match_not", "licensed -gnu", "list_contains(w, 'licensed') AND NOT list_contains(w, 'gnu')"),
    ("lexical_match_phrase", '"licensed under the" work', "contains(' ' || array_to_string(w, ' ') || ' ', ' licensed under the ') AND list_contains(w, 'work')"),
):
    query(_name, f"SELECT doc_id AS id FROM ({_TOKENS}) WHERE {_cond}")(_match(_q))


def _bm25_sql(terms: list[str], where: str, tokens: str = _TOKENS) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl))" for i in range(len(terms)))
    return f"""SELECT doc_id AS id, {score} AS score FROM (SELECT doc_id, w, CAST(len(w) AS DOUBLE) AS dl, {tf} FROM ({tokens})),
      (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avg_dl, {df} FROM (SELECT CAST(len(w) AS DOUBLE) AS dl, {tf} FROM ({tokens}))) WHERE {where}"""


_LICENSE = _bm25_sql(["license", "work"], "tf0 > 0 AND tf1 > 0")


@query("lexical_bm25_topk", f"SELECT id, round(score, 6) AS score FROM ({_LICENSE}) ORDER BY score DESC, id LIMIT 20")
def lexical_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.lexical_topk(_corpus(spark, d), "license work").select("id", F.round("score", 6).alias("score"))


@query("lexical_postings_topk", f"SELECT id, round(score, 6) AS score FROM ({_LICENSE}) ORDER BY score DESC, id LIMIT 20")
def lexical_postings_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same list from an inverted index."""
    c = _corpus(spark, d)
    hits = search.bm25_postings(search.postings(c), search.corpus_stats(c), "license work")
    return hits.orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 6).alias("score"))


# --- English index --------------------------------------------------------------------------------------------------

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: Common table expressions: each position's lexeme, x (doc_id, pos, lexeme), with stop words left out.
ENGLISH_SQL = f"""o AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM ({_TOKENS})),
v AS {stem_sql(f"(SELECT DISTINCT word FROM o WHERE word NOT IN ({_STOPS}))")},
x AS (SELECT doc_id, pos, lexeme FROM o JOIN v USING (word))"""
_PAIR = """,
c AS (SELECT doc_id, CAST(count(*) AS DOUBLE) AS len, count(*) FILTER (lexeme = 'licens') AS t0, count(*) FILTER (lexeme = 'work') AS t1,
      list(pos ORDER BY pos) FILTER (lexeme = 'licens') AS a, list(pos ORDER BY pos) FILTER (lexeme = 'work') AS b FROM x GROUP BY doc_id),
s AS (SELECT (SELECT count(*) FROM documents) AS n, sum(len) / (SELECT count(*) FROM documents) AS avg, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM c)"""


def _english(spark: SparkSession, d: str) -> textindex.Index:
    """The positional index of all documents, written and read again."""
    path = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    textindex.build(_corpus(spark, d), path)
    return textindex.load(spark, path)


@query("english_bm25_topk", f"""WITH {ENGLISH_SQL}{_PAIR},
r AS (SELECT doc_id AS id, ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * len / avg)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * len / avg)) AS score FROM c, s WHERE t0 > 0 AND t1 > 0)
SELECT id, round(score, 6) AS score FROM r ORDER BY r.score DESC, id LIMIT 20""")
def english_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Stems meet: `licensing works` finds licensed work. Blocks are left out by their greatest scores."""
    return textindex.topk(_english(spark, d), "licensing works", 20).select("id", F.round("score", 6).alias("score"))


@query("english_ts_rank", f"""WITH {ENGLISH_SQL}{_PAIR},
r AS (SELECT doc_id AS id, list_reduce(list_prepend(1.0::DOUBLE, flatten(list_transform(a[1:256], lambda p: list_transform(b[1:256], lambda q: 1.0::DOUBLE - 0.1 * sqrt(CASE WHEN abs(p - q) > 100 THEN 1e-30 ELSE 1.0 / (1.005 + 0.05 * exp(abs(p - q) / 1.5 - 2.0)) END))))), lambda m, k: m * k) AS missing FROM c WHERE t0 > 0 AND t1 > 0)
SELECT id, round(1.0 - missing, 6) AS score FROM r""")
def english_ts_rank(spark: SparkSession, d: str) -> DataFrame:
    """All matches, ranked by how near the words stand to each other."""
    return textindex.rank(_english(spark, d), "licensing works").select("id", F.round("score", 6).alias("score"))


@query("english_phrase", f"""WITH {ENGLISH_SQL}
SELECT DISTINCT a.doc_id AS id FROM x a JOIN x b ON b.doc_id = a.doc_id AND b.pos = a.pos + 3 WHERE a.lexeme = 'licens' AND b.lexeme = 'gnu'
AND a.doc_id IN (SELECT doc_id FROM x WHERE lexeme = 'work')""")
def english_phrase(spark: SparkSession, d: str) -> DataFrame:
    """A phrase over stop words, by positions from the written index."""
    return textindex.match(_english(spark, d), '"licensed under the gnu" work').select("id")


_THE = _bm25_sql(["the", "and"], "tf0 > 0 AND tf1 > 0")
_DENSE = f"SELECT vec_id AS id, sim AS score FROM ({_SIM0}) WHERE sim >= 0.0"


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return search.vector_scores(_vectors(spark, d), _probe(spark, d), min_similarity=0.0), search.bm25(_corpus(spark, d), "the and")


def _hybrid(alpha: float) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = search.hybrid(*_lists(spark, d), alpha=alpha)
        return out.select("id", *(F.round(c, 6).alias(c) for c in ("dense_score", "sparse_score", "combined_score")))

    return run


for _a in (0.0, 0.7, 1.0):
    query(
        f"hybrid_alpha_{str(_a).replace('.', '')}",
        f"""WITH d AS (SELECT * FROM ({_DENSE}) WHERE {_a} > 0), s AS (SELECT id, score / max(score) OVER () AS score FROM ({_THE}) WHERE {_a} < 1),
        j AS (SELECT coalesce(d.id, s.id) AS id, coalesce(d.score, 0.0) AS ds, coalesce(s.score, 0.0) AS ss FROM d FULL JOIN s ON d.id = s.id)
        SELECT id, round(ds, 6) AS dense_score, round(ss, 6) AS sparse_score, round({_a} * ds + (1 - {_a}) * ss, 6) AS combined_score FROM j
        ORDER BY {_a} * ds + (1 - {_a}) * ss DESC, id LIMIT 20""",
    )(_hybrid(_a))


@query("hybrid_rrf", f"""
WITH d AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({_DENSE})),
s AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({_THE})),
u AS (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT * FROM d UNION ALL SELECT * FROM s) GROUP BY id)
SELECT id, round(score, 9) AS score FROM u ORDER BY u.score DESC, id LIMIT 20""")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """The fusion of both whole lists, of which the first rows and a few ranks are looked at."""
    return search.fused_topk(list(_lists(spark, d))).select("id", F.round("score", 9).alias("score"))


_EN = _bm25_sql(["the", "of"], "tf0 > 0 AND tf1 > 0", f"SELECT * FROM ({_TOKENS}) WHERE lang = 'en'")


@query("search_filtered", f"SELECT id, round(score, 6) AS score FROM ({_EN}) ORDER BY score DESC, id LIMIT 20")
def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = _corpus(spark, d).withColumn("metadata", F.create_map(F.lit("lang"), "lang"))
    return search.lexical_topk(search.metadata_filter(rows, {"lang": "en"}), "the of").select("id", F.round("score", 6).alias("score"))


@query("rerank_overlap", f"""
WITH c AS (SELECT id FROM ({_THE}) ORDER BY score DESC, id LIMIT 50),
r AS (SELECT id, len(list_intersect(list_distinct({_W}), ['and', 'clown', 'license', 'the', 'work'])) / 5.0::DOUBLE AS s FROM c JOIN documents ON doc_id = id)
SELECT id, round(s, 6) AS score FROM r ORDER BY s DESC, id LIMIT 5""")
def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    hits = search.lexical_topk(c, "the and", 50)
    out = search.rerank(c.join(F.broadcast(hits), "id"), "the and license work clown", 5, search.overlap_score, "score")
    return out.select("id", F.round("score", 6).alias("score"))


_SUBS = [("the license", ["license", "the"]), ("the clown", ["clown", "the"]), ("und der", ["der", "und"])]


@query("par_act_review", "WITH h AS (" + " UNION ALL ".join(
    f"SELECT {i} AS ord, id, row_number() OVER (ORDER BY score DESC, id) AS rank, score FROM ({_bm25_sql(t, 'tf0 > 0 AND tf1 > 0')}) QUALIFY rank <= 10" for i, (_, t) in enumerate(_SUBS)
) + """), m AS (SELECT h.*, substr(text, 1, 100) AS sig FROM h JOIN documents ON doc_id = id),
f AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY ord, rank, id) AS k FROM m)
SELECT CAST(ord AS BIGINT) AS ord, id, rank, 'Assumed Relevant' AS relevance FROM f WHERE k = 1""")
def par_act_review(spark: SparkSession, d: str) -> DataFrame:
    p = retrieval.RetrievalPlan("", sub_questions=[q for q, _ in _SUBS])
    out = retrieval.review(retrieval.act(_corpus(spark, d), p))
    return out.select(F.col("ord").cast("long").alias("ord"), "id", F.col("rank").cast("long").alias("rank"), "relevance")


@query("llm_relevance_filter", "SELECT d.doc_id AS id, coalesce(CAST(l.quality AS DOUBLE), 0.5) AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(CAST(l.quality AS DOUBLE), 0.5) >= 0.5")
def llm_relevance_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left")
    return search.relevance_filter(rows.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("score")))


@query("relevance_scored", f"""
SELECT doc_id AS id, round(s, 6) AS relevance FROM (SELECT doc_id, len(list_intersect(list_distinct({_W}), ['license', 'the', 'under', 'work'])) / 4.0::DOUBLE AS s FROM documents) WHERE s >= 0.5""")
def relevance_scored(spark: SparkSession, d: str) -> DataFrame:
    """Texts that have at least half of a question's words, by the default scorer."""
    return search.filter_relevance(_corpus(spark, d), "the work under the license").select("id", F.round("relevance", 6).alias("relevance"))


# --- errors ---------------------------------------------------------------------------------------------------------

_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', CAST(i AS INT), 3)))))"


@query("trigram_lookup", f"""
WITH t AS (SELECT p_partkey, p_name, {_TRI.format('p_name')} AS a, {_TRI.format("'large red widgets'")} AS b FROM part),
s AS (SELECT p_partkey, p_name, len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) AS sim FROM t)
SELECT p_partkey AS id, p_name AS message_pattern, round(sim, 6) AS similarity FROM s WHERE sim > 0.3 ORDER BY sim DESC, id LIMIT 5""")
def trigram_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("message_pattern"), F.col("p_type").alias("exception_type"), F.lit("en").alias("language"))
    return errors.lookup_similar(p, "large red widgets", language="en").select("id", "message_pattern", F.round("similarity", 6).alias("similarity"))


@query("trigram_join", f"""
WITH n AS (SELECT DISTINCT p_name FROM part), t AS (SELECT p_name, {_TRI.format('p_name')} AS t FROM n),
s AS (SELECT a.p_name AS left_id, b.p_name AS right_id, len(list_intersect(a.t, b.t)) / CAST(len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) AS DOUBLE) AS sim FROM t a, t b)
SELECT left_id, right_id, round(sim, 6) AS similarity FROM s WHERE sim > 0.3""")
def trigram_join(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "part").select(F.col("p_name").alias("id"), F.col("p_name").alias("text")).distinct()
    return errors.similarity_join(n, n).withColumn("similarity", F.round("similarity", 6))


@query("error_exact_regex", """
WITH l AS (SELECT p_brand AS lib, min(p_type) AS api FROM part GROUP BY p_brand)
SELECT p_partkey AS id, p_name = 'red widget' AS exact, p_type AS api_element, p_brand AS library
FROM part WHERE p_name = 'red widget' OR regexp_full_match('red widget', '(?:' || split_part(p_name, ' ', 1) || ' .*)')
ORDER BY CASE WHEN p_name = 'red widget' THEN 0 ELSE 1 END, id LIMIT 5""")
def error_exact_regex(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    p = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("message_pattern"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" .*")).alias("message_regex"), F.concat_ws("/", "p_brand", "p_type").alias("api_element_id"))
    api = part.select(F.concat_ws("/", "p_brand", "p_type").alias("id"), F.col("p_type").alias("name"), F.col("p_brand").alias("library_id")).distinct()
    lib = part.select(F.col("p_brand").alias("id"), F.col("p_brand").alias("name")).distinct()
    return errors.lookup_exact(p, api, lib, "red widget").select("id", "exact", "api_element", "library")


@query("error_match_messages", """
WITH p AS (SELECT DISTINCT p_name AS pattern, split_part(p_name, ' ', 1) || ' .*' AS rx FROM part)
SELECT pattern AS pattern_id, exact, count(*) AS n FROM (
  SELECT pattern, true AS exact FROM part JOIN p ON p_name = pattern
  UNION ALL SELECT pattern, false FROM part JOIN p ON regexp_full_match(p_name, rx) AND p_name <> pattern) GROUP BY ALL""")
def error_match_messages(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    p = part.select(F.col("p_name").alias("id"), F.col("p_name").alias("message_pattern"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" .*")).alias("message_regex")).distinct()
    hits = errors.match_messages(part.select(F.col("p_partkey").alias("message_id"), F.col("p_name").alias("message")), p)
    return hits.groupBy("pattern_id", "exact").agg(F.count("*").alias("n"))


# --- graph ----------------------------------------------------------------------------------------------------------

_NODES_SQL = """(SELECT 'r:' || r_regionkey AS id, 'Region' AS label FROM region UNION ALL SELECT 'n:' || n_nationkey, 'Nation' FROM nation
 UNION ALL SELECT 's:' || s_suppkey, 'Supplier' FROM supplier UNION ALL SELECT 'c:' || c_custkey, 'Customer' FROM customer)"""
_EDGES_SQL = """(SELECT 'n:' || n_nationkey AS src, 'r:' || n_regionkey AS dst, 'IN_REGION' AS relation FROM nation
 UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'IN_NATION' FROM supplier UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'IN_NATION' FROM customer)"""
_BOTH_SQL = f"(SELECT src AS u, dst AS v, relation, src || dst AS e FROM {_EDGES_SQL} UNION ALL SELECT dst, src, relation, src || dst FROM {_EDGES_SQL})"


def _id(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    parts = [("region", "r:", "r_regionkey", "r_name", "Region"), ("nation", "n:", "n_nationkey", "n_name", "Nation"), ("supplier", "s:", "s_suppkey", "s_name", "Supplier"), ("customer", "c:", "c_custkey", "c_name", "Customer")]
    nodes = [_t(spark, d, t).select(_id(p, k).alias("id"), F.lit(label).alias("label"), F.col(n).alias("name")) for t, p, k, n, label in parts]
    ends = [("nation", "n:", "n_nationkey", "r:", "n_regionkey", "IN_REGION"), ("supplier", "s:", "s_suppkey", "n:", "s_nationkey", "IN_NATION"), ("customer", "c:", "c_custkey", "n:", "c_nationkey", "IN_NATION")]
    edges = [_t(spark, d, t).select(_id(a, x).alias("src"), _id(b, y).alias("dst"), F.lit(r).alias("relation"), F.lit(1.0).alias("weight")) for t, a, x, b, y, r in ends]
    return nodes[0].union(nodes[1]).union(nodes[2]).union(nodes[3]), edges[0].union(edges[1]).union(edges[2])


@query("graph_load", """
WITH n AS (SELECT 'o:' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'c:' || c_custkey FROM customer UNION ALL SELECT 'p:' || p_partkey FROM part),
e AS (SELECT 'o:' || o_orderkey AS src, 'c:' || o_custkey AS dst, 'PLACED_BY' AS relation FROM orders UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey, 'CONTAINS' FROM lineitem)
SELECT relation, count(*) AS n FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) GROUP BY relation""")
def graph_load(spark: SparkSession, d: str) -> DataFrame:
    """Orders, customers and parts as a graph; edges of orders that aren't nodes are left out."""
    orders, items = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    node = lambda df, p, k, label: df.select(_id(p, k).alias("id"), F.lit(label).alias("label"))
    nodes = node(orders.where("o_orderstatus = 'F'"), "o:", "o_orderkey", "Order").union(node(_t(spark, d, "customer"), "c:", "c_custkey", "Customer")).union(node(_t(spark, d, "part"), "p:", "p_partkey", "Part"))
    placed = orders.select(_id("o:", "o_orderkey").alias("src"), _id("c:", "o_custkey").alias("dst"), F.lit("PLACED_BY").alias("relation"))
    has = items.select("l_orderkey", "l_partkey").distinct().select(_id("o:", "l_orderkey").alias("src"), _id("p:", "l_partkey").alias("dst"), F.lit("CONTAINS").alias("relation"))
    _, edges = graph.load_graph(empty(spark, "graph_nodes"), empty(spark, "graph_edges"), nodes, placed.union(has), "tpch")
    return graph.edge_stats(edges)


@query("graph_callers", f"SELECT id, label FROM {_NODES_SQL} WHERE id IN (SELECT src FROM {_EDGES_SQL} WHERE dst = 'n:3' AND relation = 'IN_NATION')")
def graph_callers(spark: SparkSession, d: str) -> DataFrame:
    return graph.callers(*_graph(spark, d), "n:3", "IN_NATION").select("id", "label")


@query("graph_callees", f"SELECT id, label FROM {_NODES_SQL} WHERE id IN (SELECT dst FROM {_EDGES_SQL} WHERE src = 'n:3' AND relation = 'IN_REGION')")
def graph_callees(spark: SparkSession, d: str) -> DataFrame:
    return graph.callees(*_graph(spark, d), "n:3", "IN_REGION").select("id", "label")


@query("graph_context", f"""
WITH b AS {_BOTH_SQL}, t1 AS (SELECT v, relation, e FROM b WHERE u = 'n:3'),
t2 AS (SELECT b.v, b.relation FROM t1 JOIN b ON t1.v = b.u WHERE b.e <> t1.e),
t AS (SELECT v, relation, 1 AS distance FROM t1 UNION ALL SELECT v, relation, 2 FROM t2)
SELECT v AS connected_id, label, relation AS relationship, CAST(distance AS BIGINT) AS distance FROM t JOIN {_NODES_SQL} n ON n.id = t.v ORDER BY distance, connected_id, relationship LIMIT 50""")
def graph_context(spark: SparkSession, d: str) -> DataFrame:
    return graph.entity_context(*_graph(spark, d), "n:3")


@query("graph_context_hub", f"""
WITH e AS (SELECT src, dst, relation, row_number() OVER (ORDER BY src, dst, relation) AS e FROM (SELECT * FROM {_EDGES_SQL} UNION ALL SELECT * FROM {_EDGES_SQL} WHERE relation = 'IN_REGION')),
b AS (SELECT src AS u, dst AS v, relation, e FROM e UNION ALL SELECT dst, src, relation, e FROM e),
t1 AS (SELECT v, relation, e FROM b WHERE u = 'r:1'),
t2 AS (SELECT b.v, b.relation FROM t1 JOIN b ON t1.v = b.u WHERE b.e <> t1.e),
t AS (SELECT v, relation, 1 AS distance FROM t1 UNION ALL SELECT v, relation, 2 FROM t2)
SELECT v AS connected_id, label, relation AS relationship, CAST(distance AS BIGINT) AS distance FROM t JOIN {_NODES_SQL} n ON n.id = t.v ORDER BY distance, connected_id, relationship LIMIT 200""")
def graph_context_hub(spark: SparkSession, d: str) -> DataFrame:
    """A region at depth 2, whose nations are hubs, with each nation's edge to it twice."""
    nodes, edges = _graph(spark, d)
    return graph.entity_context(nodes, edges.unionByName(edges.where("relation = 'IN_REGION'")), "r:1", limit=200)


_PROX = f"""
WITH b AS {_BOTH_SQL}, s AS (SELECT unnest(['n:3', 'n:7']) AS seed),
t1 AS (SELECT seed, v, [e] AS p FROM s JOIN b ON seed = u),
t2 AS (SELECT seed, b.v, list_append(p, e) AS p FROM t1 JOIN b ON t1.v = b.u WHERE NOT list_contains(p, e)),
t3 AS (SELECT seed, b.v, list_append(p, e) AS p FROM t2 JOIN b ON t2.v = b.u WHERE NOT list_contains(p, e)),
t AS (SELECT v, 1 AS d FROM t1 UNION ALL SELECT v, 2 FROM t2 UNION ALL SELECT v, 3 FROM t3)
SELECT v AS id, round(1.0::DOUBLE / (min(d) + 1), 9) AS score FROM t GROUP BY v ORDER BY score DESC, id LIMIT 20"""


@query("graph_proximity", _PROX)
def graph_proximity(spark: SparkSession, d: str) -> DataFrame:
    return graph.proximity(_graph(spark, d)[1], ["n:3", "n:7"]).withColumn("score", F.round("score", 9))


def _ppr_sql(rounds: int) -> str:
    ctes = [f"b AS (SELECT u AS src, v AS dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY u) AS share FROM {_BOTH_SQL})", "p AS (SELECT unnest(['n:3', 'n:7']) AS id, 0.5::DOUBLE AS p)", "r0 AS (SELECT id, p AS r FROM p)"]
    for i in range(rounds):
        ctes.append(f"r{i + 1} AS (SELECT coalesce(s.id, p.id) AS id, 0.15 * coalesce(p.p, 0.0) + 0.85 * coalesce(s.s, 0.0) AS r FROM (SELECT dst AS id, sum(r * share) AS s FROM b JOIN r{i} ON src = r{i}.id GROUP BY dst) s FULL JOIN p ON s.id = p.id)")
    return f"WITH {', '.join(ctes)} SELECT id, round(r, 9) AS score FROM r{rounds}"


@query("graph_ppr", _ppr_sql(5))
def graph_ppr(spark: SparkSession, d: str) -> DataFrame:
    e = _graph(spark, d)[1].where("src <> dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "weight"))
    return graph.personalised_pagerank(both, ["n:3", "n:7"], iterations=5, limit=None).select("id", F.round("score", 9).alias("score"))


_PUSH_ERROR, _PUSH_ROUNDS = 0.00002, 6


def _push_sql() -> str:
    ctes = [f"share AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM {_EDGES_SQL})", "z AS (SELECT c_mktsegment AS s, 'c:' || c_custkey AS id, 1.0::DOUBLE / count(*) OVER (PARTITION BY c_mktsegment) AS r FROM customer)", "l0 AS (SELECT * FROM z)"]
    for i in range(_PUSH_ROUNDS):
        hot = f"(SELECT * FROM l{i} WHERE r > {_PUSH_ERROR})"
        ctes.append(f"""l{i + 1} AS (SELECT s, id, sum(r) AS r FROM (SELECT s, id, r FROM l{i} WHERE r <= {_PUSH_ERROR}
          UNION ALL SELECT h.s, e.dst, h.r * 0.85 * e.share FROM {hot} h JOIN share e ON e.src = h.id
          UNION ALL SELECT z.s, z.id, z.r * d.m FROM z JOIN (SELECT s, sum(r) * 0.85 AS m FROM {hot} WHERE id NOT IN (SELECT src FROM share) GROUP BY s) d ON d.s = z.s) GROUP BY s, id)""")
    kept = " UNION ALL ".join(f"SELECT s, id, r * (1 - 0.85) AS p FROM l{i} WHERE r > {_PUSH_ERROR}" for i in range(_PUSH_ROUNDS))
    return f'WITH {", ".join(ctes)} SELECT s AS "set", id, round(sum(p), 9) AS score FROM ({kept}) GROUP BY s, id'


@query("graph_push", _push_sql())
def graph_push(spark: SparkSession, d: str) -> DataFrame:
    """Ranks for the customers of each market segment, whose mass comes back from the regions."""
    seeds = _t(spark, d, "customer").select(F.col("c_mktsegment").alias("set"), _id("c:", "c_custkey").alias("id"))
    ranks, _ = graph.push_pagerank(_graph(spark, d)[1], seeds, error=_PUSH_ERROR, rounds=_PUSH_ROUNDS)
    return ranks.withColumn("score", F.round("score", 9))


@query("graph_stats_nodes", f"SELECT label, count(*) AS n FROM {_NODES_SQL} GROUP BY label")
def graph_stats_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_stats(_graph(spark, d)[0])


@query("graph_stats_edges", f"SELECT relation, count(*) AS n FROM {_EDGES_SQL} GROUP BY relation")
def graph_stats_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_stats(_graph(spark, d)[1])


# --- manifest and chunks --------------------------------------------------------------------------------------------

_STATUS = {"view": "pending", "signup": "processing", "click": "completed", "purchase": "completed", "error": "failed"}
_STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " END"


def _log(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.create_map(*(F.lit(x) for kv in _STATUS.items() for x in kv)), F.col("event_type"))
    return _t(spark, d, "events").select(F.concat(F.lit("f"), "user_id").alias("source_file"), status.alias("status"), F.get_json_object("props", "$.k").cast("int").alias("chunk_count"), F.sha2(F.col("value").cast("decimal(12,2)").cast("string"), 256).alias("content_hash"), F.col("ts").cast("timestamp").alias("ingested_at"), "event_id", "event_type")


@query("manifest_upsert", f"""
WITH e AS (SELECT 'f' || user_id AS f, {_STATUS_SQL} AS status, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id, event_type, ts FROM events),
o AS (SELECT * FROM e WHERE event_type IN ('view', 'click') QUALIFY row_number() OVER (PARTITION BY f ORDER BY event_id DESC) = 1),
n AS (SELECT * FROM e WHERE event_type NOT IN ('view', 'click') QUALIFY row_number() OVER (PARTITION BY f ORDER BY event_id DESC) = 1)
SELECT coalesce(n.f, o.f) AS source_file, CASE WHEN n.f IS NULL THEN o.status ELSE n.status END AS status, CASE WHEN n.f IS NULL THEN o.k ELSE n.k END AS chunk_count,
 CASE WHEN n.status = 'completed' THEN 'now' WHEN o.f IS NOT NULL THEN 'kept' ELSE 'none' END AS ingested FROM o FULL JOIN n ON o.f = n.f""")
def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of a log, each folded to the latest entry of a file; then the second is put over the first."""
    log = _log(spark, d)
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    old = manifest.upsert_manifest(empty(spark, "ingestion_manifest"), log.where("event_type in ('view', 'click')"), order=[F.desc("event_id")])
    old = old.withColumn("ingested_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    out = manifest.upsert_manifest(old, log.where("event_type not in ('view', 'click')"), now, [F.desc("event_id")])
    return out.select("source_file", "status", "chunk_count", F.when(F.col("ingested_at") == now, "now").when(F.col("ingested_at").isNotNull(), "kept").otherwise("none").alias("ingested"))


@query("manifest_status", f"""
WITH e AS (SELECT user_id, event_id, event_type, {_STATUS_SQL} AS status FROM events),
o AS (SELECT DISTINCT user_id FROM e WHERE event_type = 'view'),
u AS (SELECT user_id, status FROM e WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT coalesce(u.status, 'pending') AS status, count(*) AS n FROM o LEFT JOIN u USING (user_id) GROUP BY 1""")
def manifest_status(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    base = manifest.create_entries(empty(spark, "ingestion_manifest"), log.where("event_type = 'view'").select("source_file"))
    news = log.where("event_type <> 'view'").groupBy("source_file").agg(F.max_by(F.struct("status", "chunk_count", "content_hash"), "event_id").alias("s")).select("source_file", "s.*", F.lit(None).cast("string").alias("error_message"))
    return manifest.update_status(base, news).groupBy("status").agg(F.count("*").alias("n"))


@query("needs_reingest", """
SELECT doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents m WHERE m.doc_id = d.doc_id AND m.source <> 'src3' AND m.lang <> 'es'
 AND sha256(CASE WHEN m.lang = 'de' THEN m.text || '!' ELSE m.text END) = sha256(d.text))""")
def needs_reingest(spark: SparkSession, d: str) -> DataFrame:
    """A manifest in which one source is missing, Spanish files are pending, and German ones have another hash."""
    docs = _t(spark, d, "documents").withColumn("source_file", F.col("doc_id").cast("string"))
    files = docs.select("source_file", T.content_hash("text").alias("content_hash"))
    known = docs.where("source <> 'src3'").select("source_file", T.content_hash(F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"), F.when(F.col("lang") == "es", "pending").otherwise("completed").alias("status"))
    return manifest.needs_reingestion(files, known).select(F.col("source_file").cast("long").alias("id"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return conform(_t(spark, d, "documents").select(F.col("source").alias("source_file"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("content"), F.col("lang").alias("header_path"), T.content_hash16("text").alias("content_hash")), "semantic_chunks")


@query("chunk_upsert", """
SELECT source AS source_file, CAST(doc_id AS INT) AS chunk_index, CASE WHEN lang = 'de' THEN 'neu' ELSE lang END AS header_path, substr(sha256(CASE WHEN lang = 'de' THEN text || ' neu' ELSE text END), 1, 16) AS content_hash FROM documents
UNION ALL SELECT 'added', CAST(doc_id AS INT), 'neu', substr(sha256(text || ' neu'), 1, 16) FROM documents WHERE lang = 'fr'""")
def chunk_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = tables.upsert_chunks(empty(spark, "semantic_chunks"), _chunks(spark, d))
    new = old.where("header_path in ('de', 'fr')").withColumn("source_file", F.when(F.col("header_path") == "fr", "added").otherwise(F.col("source_file")))
    new = new.withColumns({"content": F.concat("content", F.lit(" neu")), "header_path": F.lit("neu")}).withColumn("content_hash", T.content_hash16("content")).drop("id")
    return tables.upsert_chunks(old, new).select("source_file", "chunk_index", "header_path", "content_hash")


@query("chunk_delete", "SELECT source AS source_file, count(*) AS n FROM documents WHERE source <> 'src0' GROUP BY source")
def chunk_delete(spark: SparkSession, d: str) -> DataFrame:
    rest, _ = tables.delete_where(_chunks(spark, d), F.col("source_file") == "src0")
    return rest.groupBy("source_file").agg(F.count("*").alias("n"))


@query("chunks_by_file", "SELECT CAST(doc_id AS INT) AS chunk_index, substr(sha256(text), 1, 16) AS content_hash FROM documents WHERE source = 'src1' ORDER BY 1")
def chunks_by_file(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).where("source_file = 'src1'").orderBy("chunk_index").select("chunk_index", "content_hash")


# --- memory ---------------------------------------------------------------------------------------------------------

_ROLE = "CASE role WHEN 'assistant' THEN 'semantic' WHEN 'system' THEN 'procedural' ELSE 'episodic' END"


def _notes(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations")
    kind = F.when(F.col("role") == "assistant", MEMORY_TYPES[1]).when(F.col("role") == "system", MEMORY_TYPES[2]).otherwise(MEMORY_TYPES[0])
    new = c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("agent_id"), kind.alias("memory_type"), F.col("text").alias("content"))
    return memory.insert(empty(spark, "memory_notes"), new, F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query("memory_insert_types", f"SELECT {_ROLE} AS memory_type, count(*) AS n, count(DISTINCT conv_id) AS agents FROM conversations GROUP BY 1")
def memory_insert_types(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).groupBy("memory_type").agg(F.count("*").alias("n"), F.countDistinct("agent_id").alias("agents"))


@query("memory_update_patch", "SELECT conv_id || ':' || turn AS id, sha256(CASE WHEN role = 'user' THEN '[edited] ' || text ELSE text END) AS h FROM conversations")
def memory_update_patch(spark: SparkSession, d: str) -> DataFrame:
    notes = _notes(spark, d)
    p = notes.where("memory_type = 'episodic'").select("id", F.concat(F.lit("[edited] "), "content").alias("content"), F.lit(None).cast("array<string>").alias("keywords"))
    return memory.update(notes, p).select("id", T.content_hash("content").alias("h"))


@query("memory_soft_delete", "SELECT CAST(conv_id AS VARCHAR) AS agent_id, count(*) FILTER (role <> 'assistant') AS active, count(*) FILTER (role = 'assistant') AS deleted FROM conversations GROUP BY conv_id")
def memory_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    notes = _notes(spark, d)
    out = memory.soft_delete(notes, notes.where("memory_type = 'semantic'").select("id"), "stale")
    return out.groupBy("agent_id").agg(F.count_if("is_active").alias("active"), F.count_if(F.col("deleted_reason") == "stale").alias("deleted"))


@query("memory_checkpoint", "SELECT CAST(conv_id AS VARCHAR) AS agent_id, count(*) AS n, string_agg(conv_id || ':' || turn, ',' ORDER BY conv_id || ':' || turn) AS ids FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def memory_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    notes = _notes(spark, d)
    active = memory.soft_delete(notes, notes.where("memory_type = 'procedural'").select("id"))
    snap = memory.snapshot(active)
    ids = F.transform(F.from_json("memories", memory.SNAPSHOT), lambda m: m["id"])
    return snap.select("agent_id", "n", F.array_join(ids, ",").alias("ids"))


@query("memory_rollback", f"""
SELECT CAST(conv_id AS VARCHAR) AS agent_id, {_ROLE} AS memory_type, conv_id <> 1 AS is_active, false AS restored, count(*) AS n FROM conversations GROUP BY ALL
UNION ALL SELECT CAST(conv_id AS VARCHAR), {_ROLE}, true, true, count(*) FROM conversations WHERE conv_id = 1 AND role = 'user' GROUP BY ALL""")
def memory_rollback(spark: SparkSession, d: str) -> DataFrame:
    """Agent 1 returns to a checkpoint that held its user notes only."""
    notes = _notes(spark, d)
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    cps = memory.checkpoint(empty(spark, "memory_checkpoints"), notes.where("memory_type = 'episodic'"), "start", "1", "test", now)
    kept = cps.select(F.inline(F.from_json("memory_snapshot", memory.SNAPSHOT)))
    out = memory.rollback(notes, kept, "cp-1", "start", "1", now)
    return out.groupBy("agent_id", "memory_type", "is_active", F.col("restored_from").isNotNull().alias("restored")).agg(F.count("*").alias("n"))


_CHANGES_SQL = """(SELECT 'n' || conv_id AS id, CAST(conv_id % 10 AS VARCHAR) AS agent, turn, text, role <> 'system' AND turn % 4 <> 3 AS live FROM conversations)"""


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Each turn of a conversation as a change of one note; every fourth one deletes it."""
    c = _t(spark, d, "conversations")
    at = F.timestamp_add("HOUR", F.col("turn").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows = c.select(F.concat(F.lit("n"), "conv_id").alias("id"), (F.col("conv_id") % 10).cast("string").alias("agent_id"), F.col("text").alias("content"), ((F.col("role") != "system") & (F.col("turn") % 4 != 3)).alias("is_active"), at.alias("changed_at"), F.format_string("%010d", "turn").alias("change_id"))
    return rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema("memory_notes")), "changed_at", "change_id")


@query("memory_as_of", f"""
SELECT id, agent, sha256(text) AS content_hash, live AS is_active FROM {_CHANGES_SQL} WHERE turn <= 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn DESC) = 1""")
def memory_as_of(spark: SparkSession, d: str) -> DataFrame:
    """What every note was two hours after the first."""
    notes = notelog.as_of(_changes(spark, d), F.lit("2024-01-01 02:00:00").cast("timestamp"))
    return notes.select("id", F.col("agent_id").alias("agent"), T.content_hash("content").alias("content_hash"), "is_active")


@query("memory_intervals", f"""
SELECT agent, n - turn AS hours, count(*) AS n FROM (SELECT *, lead(turn) OVER (PARTITION BY id ORDER BY turn) AS n FROM {_CHANGES_SQL}) GROUP BY ALL""")
def memory_intervals(spark: SparkSession, d: str) -> DataFrame:
    """How long changes hold, by agent; null for those that still do."""
    rows = notelog.intervals(_changes(spark, d))
    hours = F.timestamp_diff("HOUR", F.col("valid_from"), F.col("valid_to"))
    return rows.groupBy(F.col("agent_id").alias("agent"), hours.alias("hours")).agg(F.count("*").alias("n"))


@query("memory_rollback_log", f"""
WITH c AS (SELECT * FROM {_CHANGES_SQL} WHERE agent = '1'),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn DESC) = 1),
k AS (SELECT * FROM c WHERE turn <= 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn DESC) = 1)
SELECT sha256(text) AS content_hash, false AS is_active, false AS restored FROM o UNION ALL SELECT sha256(text), true, true FROM k WHERE live""")
def memory_rollback_log(spark: SparkSession, d: str) -> DataFrame:
    """An agent's notes after going back, twice, to the first hour."""
    log, cp = _changes(spark, d), F.lit("2024-01-01 01:00:00").cast("timestamp")
    for day in (1, 2):
        log = log.unionByName(notelog.rolled_back(log, cp, "cp", "first hour", "1", F.lit(f"2025-01-0{day} 00:00:00").cast("timestamp")))
    return notelog.as_of(log.where("agent_id = '1'")).select(T.content_hash("content").alias("content_hash"), "is_active", F.col("restored_from").isNotNull().alias("restored"))


def _features_sql(relation: str) -> str:
    """(id, at, x): the places of the hashing embedder's 256 dimensions that a relation (id, w) of word lists has, with their counts."""
    digits = "list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substr(h, CAST(i AS INT), 1)) - 1) * CAST(pow(16, 8 - i) AS BIGINT)))"
    return f"""(SELECT id, CAST({digits} % 256 AS INT) AS at, sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS x FROM (
      SELECT id, sha256(unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS h FROM {relation}) GROUP BY ALL)"""


_NOTE_WORDS = "(SELECT conv_id || ':' || turn AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM conversations)"


@query("memory_search", f"""
WITH n AS {_features_sql(_NOTE_WORDS)},
q AS {_features_sql("(SELECT 'q' AS id, ['the', 'work', 'is', 'licensed', 'under', 'the', 'license'] AS w)")},
s AS (SELECT n.id, sum(n.x * q.x) AS dot FROM n JOIN q ON n.at = q.at GROUP BY n.id),
z AS (SELECT s.id, dot / (sqrt((SELECT sum(x * x) FROM q)) * sqrt(l.n)) AS sim FROM s JOIN (SELECT id, sum(x * x) AS n FROM n GROUP BY id) l ON l.id = s.id WHERE l.n > 0)
SELECT id, round(sim, 6) AS similarity FROM z WHERE sim >= 0.05 ORDER BY sim DESC, id LIMIT 10""")
def memory_search(spark: SparkSession, d: str) -> DataFrame:
    """Notes near a query by the default embedder."""
    e = HashingEmbedder(256)
    notes = embed_column(_notes(spark, d).drop("embedding").withColumn("agent_id", F.lit("all")), "content", embedder=e)
    return memory.search(notes, e.embed("the work is licensed under the license"), "all", 10, 0.05).select("id", F.round("similarity", 6).alias("similarity"))


@query("memory_search_fitted")
def memory_search_fitted(spark: SparkSession, d: str) -> DataFrame:
    """Notes near a query by word vectors fitted to all documents; the fit is compared with a whole decomposition in a test."""
    e = wordvectors.fit(_corpus(spark, d))
    notes = embed_column(_notes(spark, d).drop("embedding").withColumn("agent_id", F.lit("all")), "content", embedder=e)
    return memory.search(notes, e.embed("the work is licensed under the license"), "all", 10, -1.0).select("id", F.round("similarity", 6).alias("similarity"))


@query("word_information", f"""
WITH o AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM ({_TOKENS})),
v AS (SELECT word, count(*) AS c FROM o GROUP BY word HAVING count(*) >= 5 ORDER BY c DESC, word LIMIT 1000),
x AS (SELECT doc_id, pos, word FROM o JOIN v USING (word)),
d AS (SELECT a.word AS u, b.word AS v, count(*) AS n FROM x a JOIN x b ON b.doc_id = a.doc_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 4 GROUP BY ALL),
p AS (SELECT u, v, sum(n) AS n FROM (SELECT u, v, n FROM d UNION ALL SELECT v, u, n FROM d WHERE u <> v) GROUP BY ALL),
t AS (SELECT u, sum(n) AS t FROM p GROUP BY u),
r AS (SELECT p.u, p.v, p.n, ln(CAST(p.n AS DOUBLE) * (SELECT sum(t) FROM t) / a.t / b.t) AS x FROM p JOIN t a ON a.u = p.u JOIN t b ON b.u = p.v)
SELECT u AS word, v AS near, round(x, 6) AS information FROM r WHERE x > 0 AND u <= v""")
def word_information(spark: SparkSession, d: str) -> DataFrame:
    """How much likelier than chance two of the 1000 most frequent words stand near each other."""
    docs = _corpus(spark, d)
    names = [w for w, _ in wordvectors.vocabulary(docs, most=1000)]
    info = wordvectors.mutual_information(wordvectors.cooccurrences(docs, names))
    table = spark.createDataFrame(list(enumerate(names)), "i int, word string")
    met = info.join(F.broadcast(table), "i").join(F.broadcast(table.select(F.col("i").alias("j"), F.col("word").alias("near"))), "j")
    return met.where("word <= near").select("word", "near", F.round("x", 6).alias("information"))


@query("checkpoint_history", "SELECT turn AS checkpoint, CAST(epoch(TIMESTAMP '2024-01-01' + to_hours(CAST(turn AS INT))) AS BIGINT) AS created FROM conversations WHERE conv_id = 2 ORDER BY turn DESC LIMIT 20")
def checkpoint_history(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations")
    at = F.timestamp_add("HOUR", F.col("turn").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    cps = c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("turn").alias("checkpoint"), F.col("conv_id").cast("string").alias("created_by"), at.alias("created_at"))
    return memory.history(cps, "2").select("checkpoint", F.unix_timestamp("created_at").alias("created"))


# --- texts ----------------------------------------------------------------------------------------------------------


@query("content_hash16", "SELECT doc_id AS id, substr(sha256(text), 1, 16) AS h16, sha256(text) AS h FROM documents")
def content_hash16(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), T.content_hash16("text").alias("h16"), T.content_hash("text").alias("h"))


@query("exact_duplicates", "SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(T.content_hash("text").alias("h"), "doc_id").groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("token_estimate", "SELECT doc_id AS id, CAST(floor(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), T.token_estimate("text").alias("tokens"))


def _as_files(spark: SparkSession, d: str, ext: str, text: Column | None = None) -> DataFrame:
    return _t(spark, d, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(ext)).alias("source_file"), (F.col("text") if text is None else text).alias("text"))


_STRIP = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"


@query("chunk_fit_sections", rf"""
WITH s AS (SELECT doc_id, {_STRIP} AS t FROM documents)
SELECT 'docs/' || doc_id || '.txt' AS source_file, CAST(floor(length(t) / 4.0) AS INT) AS token_count, substr(sha256(t), 1, 16) AS content_hash FROM s WHERE floor(length(t) / 4.0) BETWEEN 50 AND 512""")
def chunk_fit_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents that fit into one chunk; shorter ones are dropped, longer ones are the next queries' business."""
    docs = src.parse(_as_files(spark, d, ".txt"))
    fit = docs.where(T.token_estimate("content") <= 512)
    return src.chunk(fit).select("source_file", "token_count", "content_hash")


@query("chunk_sentences")
def chunk_sentences(spark: SparkSession, d: str) -> DataFrame:
    """All chunks of all documents as plain texts: long ones are split at sentences with overlap."""
    return src.chunk(src.parse(_as_files(spark, d, ".txt"))).select("source_file", "chunk_index", "token_count", "content_hash")


@query("chunk_paragraphs")
def chunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Each line a paragraph: packed with overlap."""
    files = _as_files(spark, d, ".txt", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))
    return src.chunk(src.parse(files), ChunkConfig(max_tokens=256, min_tokens=20)).select("source_file", "chunk_index", "token_count", "content_hash")


@query("keywords", r"SELECT doc_id AS id, array_to_string(list_filter(list_transform(range(1, len(u) + 1), lambda i: u[i]), lambda x: true)[1:10], ',') AS keywords FROM (SELECT doc_id, list_transform(list_filter(list_zip(k, range(1, len(k) + 1)), lambda p: list_position(k, p[1]) = p[2]), lambda p: p[1]) AS u FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g'), '\b[A-Za-z][A-Za-z0-9_]{3,}\b') AS k FROM documents))")
def keywords(spark: SparkSession, d: str) -> DataFrame:
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]", " ")  # word boundaries beside other letters differ between engines
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(T.keywords(ascii_only), ",").alias("keywords"))


_EXT = [*T.EXTENSION_LANGUAGE, ".md", ".txt", ""]
_PATH_SQL = "('src/' || source || CASE lang WHEN 'de' THEN '/auth/error_' WHEN 'fr' THEN '/docs/guide_' WHEN 'es' THEN '/tests/view_' ELSE '/api/' END || doc_id || list_value(" + ", ".join(f"'{e}'" for e in _EXT) + f")[doc_id % {len(_EXT)} + 1])"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    folder = F.when(F.col("lang") == "de", "/auth/error_").when(F.col("lang") == "fr", "/docs/guide_").when(F.col("lang") == "es", "/tests/view_").otherwise("/api/")
    ext = F.element_at(F.array(*map(F.lit, _EXT)), (F.col("doc_id") % len(_EXT) + 1).cast("int"))
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("src/"), "source", folder, F.col("doc_id").cast("string"), ext).alias("path"), "text")


_LANG_SQL = f"CASE regexp_extract({_PATH_SQL}, '(\\.[^.]+)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.EXTENSION_LANGUAGE.items()) + " END"
_DOMAIN_SQL = "array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower({_PATH_SQL}), '{w}')" for w in ws) + f" THEN '{k}' END" for k, ws in T.DOMAIN_WORDS.items()) + "], lambda x: x IS NOT NULL), ',')"
_KIND_SQL = f"""CASE WHEN contains({_PATH_SQL}, 'error') OR contains({_PATH_SQL}, 'traceback') THEN 'error_fixes' WHEN {' OR '.join(f"contains({_PATH_SQL}, '{e}')" for e in T.EXTENSION_LANGUAGE)} THEN 'snippets'
 WHEN (contains({_PATH_SQL}, 'doc') OR contains({_PATH_SQL}, '.md') OR contains({_PATH_SQL}, '.txt')) AND (contains(lower(text), 'api') OR contains(lower(text), 'reference')) THEN 'library_docs' ELSE 'guidance' END"""


@query("detect_language", f"SELECT doc_id AS id, {_LANG_SQL} AS language FROM documents")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("id", T.detect_language("path").alias("language"))


@query("detect_domains", f"SELECT doc_id AS id, {_DOMAIN_SQL} AS domains FROM documents")
def detect_domains(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("id", F.array_join(T.detect_domains("path"), ",").alias("domains"))


@query("knowledge_type", f"SELECT doc_id AS id, {_KIND_SQL} AS knowledge_type FROM documents")
def knowledge_type(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("id", T.knowledge_type("path", "text").alias("knowledge_type"))


@query("universal_metadata", f"""SELECT doc_id AS id, regexp_extract({_PATH_SQL}, '[^/]*$') AS title, {_KIND_SQL} AS knowledge_type, {_DOMAIN_SQL} AS domain_tags, coalesce({_LANG_SQL}, '') AS language_tags,
CASE WHEN regexp_extract({_PATH_SQL}, '\\.([^.]+)$', 1) = '' THEN 'text' ELSE regexp_extract({_PATH_SQL}, '\\.([^.]+)$', 1) END AS original_format, sha256(text) AS content_hash FROM documents""")
def universal_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = _paths(spark, d).select("id", T.universal_metadata("path", "text").alias("m"))
    return m.select("id", "m.title", "m.knowledge_type", F.array_join("m.domain_tags", ",").alias("domain_tags"), F.array_join("m.language_tags", ",").alias("language_tags"), "m.original_format", "m.content_hash")


_MD = "'# ' || lang || chr(10) || chr(10) || replace(text, chr(10), '  ' || chr(10) || chr(10) || chr(10) || chr(10) || '## part' || chr(10)) || chr(10) || '[Back to top](#x)'"


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("# "), "lang", F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("  \n\n\n\n## part\n")), F.lit("\n[Back to top](#x)"))
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), body.alias("text"))


@query("clean_markdown", rf"""
WITH m AS (SELECT doc_id, {_MD} AS t FROM documents),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\[Back to top\]\([^)]*\)', '', 'g') AS t FROM m)
SELECT doc_id AS id, sha256(regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '')) AS h FROM c""")
def clean_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _markdown(spark, d).select("id", T.content_hash(T.clean_markdown("text")).alias("h"))


@query("sections", r"""
SELECT 'docs/' || doc_id || '.md' AS source_file, CAST(1 + len(regexp_extract_all(text, '\n')) AS BIGINT) AS n, CAST(len(regexp_extract_all(text, '\n')) AS BIGINT) AS parts, lang AS title FROM documents""")
def sections(spark: SparkSession, d: str) -> DataFrame:
    """A header for every line: sections counted, those under the second level by their breadcrumb."""
    files = _markdown(spark, d).select(F.concat(F.lit("docs/"), "id", F.lit(".md")).alias("source_file"), "text")
    shared_dir(spark)
    docs = src.parse(files).drop("content").checkpoint()  # parsed once
    per = src.sections(docs).groupBy("source_file").agg(F.count("*").alias("n"), F.count_if(F.col("header_path").endswith(" > part") & (F.col("header_level") == 2)).alias("parts"))
    return per.join(docs.select("source_file", "title"), "source_file")


@query("html_title", r"""SELECT page_id AS id, trim(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS title FROM pages""")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    docs = src.parse(_pages(spark, d))
    return docs.select(F.regexp_extract("source_file", r"(\d+)", 1).cast("long").alias("id"), F.coalesce("title", F.lit("")).alias("title"))


@query("html_cleaning", r"""
SELECT page_id AS id, 'html' AS kind, true AS unwanted_gone,
 len(regexp_extract_all(html, '<h1>')) AS h1 FROM pages""")
def html_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """The main part of every page: its headings are kept, nothing of scripts, styles, navigation lists and advertisements is."""
    docs = src.parse(_pages(spark, d))
    gone = ~F.col("content").contains("track(") & ~F.col("content").contains("p{margin") & ~F.col("content").rlike(r"(?m)^\s*\* \[[^\]]*\]\(/")
    return docs.select(F.regexp_extract("source_file", r"(\d+)", 1).cast("long").alias("id"), F.col("document_type").alias("kind"), gone.alias("unwanted_gone"), F.size(F.regexp_extract_all("content", F.lit(r"(?m)^# "), F.lit(0))).cast("long").alias("h1"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select(F.concat(F.lit("page"), "page_id", F.lit(".html")).alias("source_file"), F.col("html").alias("text"))


@query("html_main_text")
def html_main_text(spark: SparkSession, d: str) -> DataFrame:
    docs = src.parse(_pages(spark, d))
    return docs.select("source_file", "title", F.length("content").cast("long").alias("n_chars"), F.size("sections").cast("long").alias("n_sections"), "content_hash", "error")


@query("json_props", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS INT) = 7) AS sevens FROM events GROUP BY event_type")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "events").select("event_type", F.try_variant_get(F.parse_json("props"), "$.k", "int").alias("k"))
    return v.groupBy("event_type").agg(F.sum("k").alias("k"), F.count_if(F.col("k") == 7).alias("sevens"))


@query("network_path_guard", r"SELECT page_id AS id, starts_with(url, '//') OR regexp_matches(lower(url), '^https?://') AS blocked FROM pages")
def network_path_guard(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select(F.col("page_id").alias("id"), T.is_network_path("url").alias("blocked"))


@query("tool_format", f"""
WITH t AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS k FROM ({_LICENSE}) ORDER BY score DESC, id LIMIT 5)
SELECT string_agg(k || '. [' || printf('%.2f', score) || '] ' || source || chr(10) || '   ' || substr(text, 1, 200) || '...', chr(10) || chr(10) ORDER BY k) AS listing FROM t JOIN documents ON doc_id = id""")
def tool_format(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    top = search.ranked(search.lexical_topk(c, "license work", 5).withColumn("qid", F.lit(0)))
    line = F.concat(F.col("rank").cast("string"), F.lit(". ["), F.format_string("%.2f", "score"), F.lit("] "), "source_file", F.lit("\n   "), T.preview("content"), F.lit("..."))
    rows = c.join(F.broadcast(top), "id").select("rank", line.alias("line"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n").alias("listing"))


@query("ingest_manifest", "SELECT CASE WHEN floor(length(text) / 4.0) >= 0 THEN 'completed' END AS status, lang AS kind, count(*) AS n FROM documents GROUP BY ALL")
def ingest_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The whole ingestion plan over all documents: parse, chunk, manifest rows."""
    files = _t(spark, d, "documents").select(F.concat("lang", F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("source_file"), "text")
    found = ingest.ingest(files, skip_embedding=True)
    return found.entries.groupBy("status", F.regexp_extract("source_file", "^([a-z]+)/", 1).alias("kind")).agg(F.count("*").alias("n"))


@query("ingest_changed", rf"""
WITH s AS (SELECT lang, {_STRIP} AS t FROM documents)
SELECT 'completed' AS status, lang AS kind, count(*) AS n, count(*) FILTER (floor(length(t) / 4.0) >= 50) AS with_chunks FROM s WHERE lang <> 'de' GROUP BY lang""")
def ingest_changed(spark: SparkSession, d: str) -> DataFrame:
    """Ingestion against a manifest: German files are known as they are, French ones with another hash, Spanish ones as failed. Texts of under 50 tokens have no chunk."""
    docs = _t(spark, d, "documents").withColumn("source_file", F.concat("lang", F.lit("/"), F.col("doc_id"), F.lit(".txt")))
    known = docs.where("lang in ('de', 'fr', 'es')").select("source_file", T.content_hash(F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"), F.when(F.col("lang") == "es", "failed").otherwise("completed").alias("status"))
    found = ingest.ingest(docs.select("source_file", "text"), known, skip_embedding=True)
    kind = F.regexp_extract("source_file", "^([a-z]+)/", 1).alias("kind")
    return found.entries.groupBy("status", kind).agg(F.count("*").alias("n"), F.count_if(F.col("chunk_count") > 0).alias("with_chunks"))


# --- stored knowledge -----------------------------------------------------------------------------------------------


@query("library_elements", """
WITH l AS (SELECT 'pypi:' || p_brand || ':2' AS id, count(DISTINCT p_type) AS elements FROM part GROUP BY p_brand)
SELECT id, 'pypi' AS ecosystem, 'MIT' AS license, elements, elements AS links FROM l""")
def library_elements(spark: SparkSession, d: str) -> DataFrame:
    """Libraries of brands and elements of types, merged twice: the second time replaces, and adds no edge."""
    part = _t(spark, d, "part")
    lib = part.select(F.lit("pypi").alias("ecosystem"), F.col("p_brand").alias("name"), F.lit("2").alias("version")).distinct()
    libraries = knowledge.add_libraries(empty(spark, "libraries"), lib)
    libraries = knowledge.add_libraries(libraries, lib.withColumn("license", F.lit("MIT")))
    new = part.select(F.concat_ws("/", "p_brand", "p_type").alias("id"), F.concat(F.lit("pypi:"), "p_brand", F.lit(":2")).alias("library_id"), F.col("p_type").alias("name")).distinct()
    new = new.unionByName(spark.createDataFrame([("lost", "no such library", "f")], new.schema))
    elements, edges = knowledge.add_api_elements(empty(spark, "api_elements"), empty(spark, "graph_edges"), new, libraries)
    elements, edges = knowledge.add_api_elements(elements, edges, new, libraries)
    per = elements.groupBy("library_id").agg(F.count("*").alias("elements")).join(edges.where("relation = 'CONTAINS'").groupBy(F.col("src").alias("library_id")).agg(F.count("*").alias("links")), "library_id")
    return libraries.join(per, F.col("library_id") == F.col("id")).select("id", "ecosystem", "license", "elements", "links")


@query("error_pattern_links", "SELECT p_brand || '/' || p_type AS element, count(*) AS patterns FROM part WHERE p_size > 10 GROUP BY 1 UNION ALL SELECT 'none', count(*) FROM part WHERE p_size <= 10")
def error_pattern_links(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of parts raise from the element that they name, if it exists; small parts name one that doesn't."""
    part = _t(spark, d, "part")
    element = F.concat_ws("/", "p_brand", "p_type")
    elements = part.select(element.alias("id"), F.col("p_type").alias("name")).distinct()
    new = part.select(F.concat(F.lit("e"), F.col("p_partkey")).alias("id"), F.when(F.col("p_size") > 10, element).otherwise("gone").alias("api_element_id"), F.col("p_name").alias("message_pattern"))
    patterns, edges = knowledge.add_error_patterns(empty(spark, "error_patterns"), empty(spark, "graph_edges"), new, elements)
    both = patterns.join(edges.where("relation = 'RAISES'").select(F.col("dst").alias("id"), "src"), "id", "left")
    return both.groupBy(F.coalesce("src", F.lit("none")).alias("element")).agg(F.count("*").alias("patterns"))


@query("knowledge_get", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey = 7")
def knowledge_get(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.get(_t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), 7)


@query("file_chunks", "SELECT CAST(doc_id AS INT) AS chunk_index, substr(sha256(text), 1, 16) AS content_hash FROM documents WHERE source = 'src2'")
def file_chunks(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.by_file(_chunks(spark, d), "src2").select("chunk_index", "content_hash")


@query("chunk_replace", """
SELECT source AS source_file, count(*) AS n, count(*) FILTER (source IN ('src0', 'src1')) AS renewed FROM documents
WHERE source NOT IN ('src0', 'src1') OR doc_id % 3 = 0 GROUP BY source""")
def chunk_replace(spark: SparkSession, d: str) -> DataFrame:
    """Two files shrink to a third of their chunks; the other files stay as they were."""
    old = tables.upsert_chunks(empty(spark, "semantic_chunks"), _chunks(spark, d))
    new = _chunks(spark, d).where("source_file in ('src0', 'src1') and chunk_index % 3 = 0").withColumn("header_path", F.lit("renewed"))
    out = tables.replace_file_chunks(old, new)
    return out.groupBy("source_file").agg(F.count("*").alias("n"), F.count_if(F.col("header_path") == "renewed").alias("renewed"))


@query("manifest_tallies", f"SELECT count(*) AS total, count(*) FILTER (s = 'completed') AS successful, count(*) FILTER (s = 'failed') AS failed FROM (SELECT {_STATUS_SQL} AS s FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)")
def manifest_tallies(spark: SparkSession, d: str) -> DataFrame:
    return manifest.tallies(manifest.upsert_manifest(empty(spark, "ingestion_manifest"), _log(spark, d), order=[F.desc("event_id")]))


@query("manifest_entry", f"SELECT 'f' || user_id AS source_file, {_STATUS_SQL} AS status FROM events WHERE user_id = 3 QUALIFY row_number() OVER (ORDER BY event_id DESC) = 1")
def manifest_entry(spark: SparkSession, d: str) -> DataFrame:
    m = manifest.upsert_manifest(empty(spark, "ingestion_manifest"), _log(spark, d), order=[F.desc("event_id")])
    return manifest.entry(m, "f3").select("source_file", "status")


@query("memory_nearest", f"SELECT vec_id || '' AS id, round(sim, 6) AS similarity FROM ({_SIM0}) WHERE label = 3 AND vec_id % 7 <> 0 AND sim >= -0.1 ORDER BY sim DESC, id LIMIT 10")
def memory_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The agent's active notes nearest to a vector; every seventh note is deleted."""
    new = _vectors(spark, d).select(F.col("id").cast("string").alias("id"), F.col("label").cast("string").alias("agent_id"), F.lit("semantic").alias("memory_type"), F.lit("note").alias("content"), F.col("embedding").cast("array<double>").alias("embedding"))
    notes = memory.insert(empty(spark, "memory_notes"), new)
    notes = memory.soft_delete(notes, new.where("cast(id as long) % 7 = 0").select("id"))
    return memory.search(notes, _probe(spark, d), "3", 10, -0.1).select("id", F.round("similarity", 6).alias("similarity"))


@query("memory_touch", "SELECT role = 'user' AS used, count(*) AS n, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS uses FROM conversations GROUP BY 1")
def memory_touch(spark: SparkSession, d: str) -> DataFrame:
    notes = _notes(spark, d)
    out = memory.touch(notes, notes.where("memory_type = 'episodic'").select("id"))
    return out.groupBy(F.col("last_accessed").isNotNull().alias("used")).agg(F.count("*").alias("n"), F.sum("usage_count").alias("uses"))


@query("memory_restored_ids", r"""
WITH h AS (SELECT sha256('cp-1' || chr(1) || conv_id || ':' || turn) AS h, conv_id || ':' || turn AS old FROM conversations WHERE conv_id = 1)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id, 'cp-1' AS restored_from FROM h""")
def memory_restored_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of restored notes follow from checkpoint and old id, through the checkpoint's JSON and back."""
    notes = _notes(spark, d)
    cps = memory.checkpoint(empty(spark, "memory_checkpoints"), notes, "start", "1", "test", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    kept = memory.snapshot_rows(cps.withColumn("id", F.lit("cp-1")), "cp-1")
    return memory.restored(kept, "cp-1").select("id", "restored_from")


@query("search_whole", f"""
WITH c AS (SELECT d.doc_id, d.source, d.lang, d.text, e.embedding FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id),
s AS (SELECT id, score / max(score) OVER () AS score FROM ({_THE})),
v AS (SELECT a.doc_id AS id, {_COS} AS score FROM c a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b WHERE a.embedding IS NOT NULL),
j AS (SELECT coalesce(v.id, s.id) AS id, coalesce(v.score, 0.0) AS ds, coalesce(s.score, 0.0) AS ss FROM (SELECT * FROM v WHERE score >= 0) v FULL JOIN s ON v.id = s.id)
SELECT id, source AS source_file, round(0.7 * ds + 0.3 * ss, 6) AS combined_score FROM j JOIN documents ON doc_id = id ORDER BY 0.7 * ds + 0.3 * ss DESC, id LIMIT 20""")
def search_whole(spark: SparkSession, d: str) -> DataFrame:
    """The search entry over chunks that carry their vectors."""
    corpus = _corpus(spark, d).join(_vectors(spark, d).select("id", "embedding"), "id", "left")
    return search.search(corpus, "the and", _probe(spark, d), 20).select("id", "source_file", F.round("combined_score", 6).alias("combined_score"))


@query("search_reranked", f"""
WITH s AS (SELECT id, score / max(score) OVER () AS score FROM ({_THE})), c AS (SELECT id FROM s ORDER BY score DESC, id LIMIT 50),
r AS (SELECT id, len(list_intersect(list_distinct({_W}), ['and', 'the'])) / 2.0::DOUBLE AS s FROM c JOIN documents ON doc_id = id)
SELECT id, round(s, 6) AS combined_score FROM r ORDER BY s DESC, id LIMIT 5""")
def search_reranked(spark: SparkSession, d: str) -> DataFrame:
    out = search.search(_corpus(spark, d), "the and", None, 5, scorer=search.overlap_score, top_k_rerank=50)
    return out.select("id", F.round("combined_score", 6).alias("combined_score"))


@query("anchor_expansion", _PROX.replace("(SELECT unnest(['n:3', 'n:7']) AS seed)", "(SELECT 'n:' || n_nationkey AS seed FROM nation WHERE n_name = (SELECT n_name FROM nation WHERE n_nationkey = 3) UNION ALL SELECT 'c:' || c_custkey FROM customer WHERE c_name = (SELECT n_name FROM nation WHERE n_nationkey = 3))"))
def anchor_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Nodes near those that carry the name of a question's anchor."""
    nodes, edges = _graph(spark, d)
    name = _t(spark, d, "nation").where("n_nationkey = 3").first()["n_name"]
    return retrieval.expand_anchors(nodes, edges, retrieval.RetrievalPlan("", anchors=[f"world.{name}"])).withColumn("score", F.round("score", 9))


@query("evidence_boosted", f"""
WITH s AS (SELECT id, score / max(score) OVER () AS score FROM ({_THE}) ORDER BY score DESC, id LIMIT 30),
e AS (SELECT s.id, source, score * (1 + CASE WHEN source IN ('src1', 'src2') THEN 1.0 / (1 + CAST(substr(source, 4) AS INT)) ELSE 0 END) AS score, CASE WHEN source IN ('src1', 'src2') THEN 1.0::DOUBLE / (1 + CAST(substr(source, 4) AS INT)) ELSE 0.0::DOUBLE END AS boost FROM s JOIN documents ON doc_id = s.id)
SELECT id, round(boost, 6) AS boost, round(score, 6) AS combined_score, CAST(row_number() OVER (ORDER BY e.score DESC, id) AS BIGINT) AS rank FROM e""")
def evidence_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Evidence from the files of nodes near a question's anchors comes before what scored a little more."""
    raw = retrieval.act(_corpus(spark, d), retrieval.RetrievalPlan("", sub_questions=["the and"]), 30)
    near = spark.createDataFrame([("a", 0.5), ("b", 1 / 3), ("c", 0.1)], "id string, score double")
    nodes = spark.createDataFrame([("a", "src1"), ("b", "src2"), ("c", "src2")], "id string, file_path string")
    out = retrieval.boosted(raw, near, nodes)
    return out.select("id", F.round("boost", 6).alias("boost"), F.round("combined_score", 6).alias("combined_score"), F.col("rank").cast("long").alias("rank"))


@query("graph_resolved", """
SELECT 'src/n.py:' || n_name AS src, 'src/r.py:' || r_name AS dst, true AS resolved FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'src/n.py:' || n_name, 'print', false FROM nation""")
def graph_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Nations call regions by a dotted name and a builtin that is no node."""
    nation, region = _t(spark, d, "nation"), _t(spark, d, "region")
    entity = lambda df, file, name: df.select(F.concat(F.lit(f"src/{file}:"), name).alias("id"), F.lit("function").alias("entity_type"), F.col(name).alias("name"), F.lit(f"src/{file}").alias("file_path"), *(F.lit(None).cast(k).alias(n) for n, k in (("parent_class", "string"), ("start_line", "int"), ("end_line", "int"), ("language", "string"), ("content_hash", "string"), ("docstring", "string"), ("signature", "string"), ("modifiers", "array<string>"))))
    calls = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("src/n.py:"), "n_name").alias("source"), F.concat(F.lit("world."), "r_name").alias("target"), F.lit("CALLS").alias("relation"))
    calls = calls.unionByName(calls.withColumn("target", F.lit("print")))
    nodes, edges = graph.graph_from_entities(entity(nation, "n.py", "n_name").unionByName(entity(region, "r.py", "r_name")), calls)
    found, rest = graph.resolve_targets(edges, nodes)
    return found.select("src", "dst", F.lit(True).alias("resolved")).unionByName(rest.select("src", "dst", F.lit(False).alias("resolved")))


@query("graph_ambiguous", """
WITH n AS (SELECT DISTINCT p_brand || '.py' AS f, p_name AS x, p_brand || '.py:' || p_type || '.' || p_name AS id FROM part),
e AS (SELECT DISTINCT 'Brand#' || (1 + p_size % 25) || '.py' AS f, p_name AS x FROM part),
a AS (SELECT f, x, count(*) AS n, min(id) AS id FROM n GROUP BY f, x), b AS (SELECT x, count(*) AS n, min(id) AS id FROM n GROUP BY x)
SELECT e.f || ':call' AS src, coalesce(CASE WHEN a.n = 1 THEN a.id WHEN a.n IS NULL AND b.n = 1 THEN b.id END, e.x) AS dst,
 CASE WHEN a.n = 1 OR (a.n IS NULL AND b.n = 1) THEN 1 ELSE coalesce(a.n, b.n) END AS owners
FROM e LEFT JOIN a ON a.f = e.f AND a.x = e.x LEFT JOIN b ON b.x = e.x""")
def graph_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    """Calls by names that many nodes have: one owner in the caller's file, one anywhere, or how many there are."""
    part = _t(spark, d, "part")
    nodes = part.select(F.concat("p_brand", F.lit(".py:"), "p_type", F.lit("."), "p_name").alias("id"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit(".py")).alias("file_path"))
    calls = part.select(F.concat(F.lit("Brand#"), (1 + F.col("p_size") % 25).cast("string"), F.lit(".py:call")).alias("src"), F.col("p_name").alias("dst")).distinct()
    found, rest = graph.resolve_targets(calls.withColumn("relation", F.lit("CALLS")), nodes)
    return found.select("src", "dst", F.lit(1).cast("long").alias("owners")).unionByName(rest.select("src", "dst", F.col("owners").cast("long").alias("owners")))


# --- sources --------------------------------------------------------------------------------------------------------


@query("code_entities", """
SELECT 'f' || p_partkey || '.py:C' || p_size AS id, 'class' AS entity_type, 1 AS start_line FROM part
UNION ALL SELECT 'f' || p_partkey || '.py:C' || p_size || '.run', 'method', 2 FROM part
UNION ALL SELECT 'f' || p_partkey || '.py:top', 'function', 4 FROM part""")
def code_entities(spark: SparkSession, d: str) -> DataFrame:
    return src.entities(_code(spark, d)).select("id", "entity_type", "start_line")


@query("code_relations", """
SELECT 'f' || p_partkey || '.py:C' || p_size || '.run' AS source, 'helper' AS target, 'CALLS' AS relation FROM part
UNION ALL SELECT 'f' || p_partkey || '.py:C' || p_size, 'Base', 'INHERITS' FROM part
UNION ALL SELECT 'f' || p_partkey || '.py:top', 'C' || p_size, 'CALLS' FROM part""")
def code_relations(spark: SparkSession, d: str) -> DataFrame:
    return src.relations(_code(spark, d)).select("source", "target", "relation")


def _code(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("class C"), size, F.lit("(Base):\n    def run(self):\n        return helper(self)\ndef top():\n    return C"), size, F.lit("()\n"))
    return src.index_code(_t(spark, d, "part").select(F.concat(F.lit("f"), "p_partkey", F.lit(".py")).alias("file_path"), text.alias("text")))


@query("document_types", f"""
SELECT doc_id AS id, CASE regexp_extract({_PATH_SQL}, '(\\.[^.]+)$', 1) WHEN '.md' THEN 'markdown' WHEN '.txt' THEN 'text' ELSE 'text' END AS kind FROM documents""")
def document_types(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("id", src.document_type("path", F.lit("plain")).alias("kind"))


@query("rst_and_front_matter", "SELECT doc_id AS id, lang AS title, source AS kept, 1::BIGINT AS n FROM documents UNION ALL SELECT -1 - doc_id, lang || ' guide', '', 2 FROM documents")
def rst_and_front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Markdown with front matter and RST with underlined headings: title, metadata, number of sections."""
    docs = _t(spark, d, "documents")
    name = lambda ext: F.concat(F.lit("x/"), "doc_id", F.lit(ext))
    md = docs.select(name(".md").alias("source_file"), F.concat(F.lit("---\ntitle: "), "lang", F.lit("\nkept: "), "source", F.lit("\n---\n# head\n\nbody\n")).alias("text"))
    rst = docs.select(name(".rst").alias("source_file"), F.concat("lang", F.lit(" guide\n========\n\nbody\n\nmore\n----\n\nrest\n")).alias("text"))
    out = src.parse(md.unionByName(rst))
    id = F.regexp_extract("source_file", r"(\d+)", 1).cast("long")
    return out.select(F.when(F.col("document_type") == "rst", -1 - id).otherwise(id).alias("id"), "title", F.coalesce(F.element_at("metadata", F.lit("kept")), F.lit("")).alias("kept"), F.size("sections").cast("long").alias("n"))


@query("glob_paths", f"SELECT doc_id AS id FROM documents WHERE {_PATH_SQL} GLOB 'src/src[0-4]/*_?*.[jmt]*' AND NOT ({_PATH_SQL} GLOB '*auth*')")
def glob_paths(spark: SparkSession, d: str) -> DataFrame:
    """Files by an include and an exclude pattern."""
    p = _paths(spark, d)
    return p.where(F.col("path").rlike(T.glob_regex("src/src[0-4]/*_?*.[jmt]*")) & ~F.col("path").rlike(T.glob_regex("*auth*"))).select("id")


@query("json_containment", "SELECT event_id AS id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) = 7 AND event_type IN ('click', 'view')")
def json_containment(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose JSON contains an object, and whose type is a member of an array."""
    e = _t(spark, d, "events")
    return e.where(T.json_contains("props", {"k": 7}) & F.array_contains(F.array(F.lit("click"), F.lit("view")), F.col("event_type"))).select(F.col("event_id").alias("id"))


@query("keyword_members", r"SELECT doc_id AS id FROM (SELECT doc_id, list_transform(list_filter(list_zip(k, range(1, len(k) + 1)), lambda p: list_position(k, p[1]) = p[2]), lambda p: p[1])[1:10] AS u FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g'), '\b[A-Za-z][A-Za-z0-9_]{3,}\b') AS k FROM documents)) WHERE list_contains(u, 'that') OR list_contains(u, 'nicht')")
def keyword_members(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have one of some words among their keywords."""
    k = T.keywords(F.regexp_replace("text", r"[^\x00-\x7F]", " "))
    return _t(spark, d, "documents").where(F.arrays_overlap(k, F.array(F.lit("that"), F.lit("nicht")))).select(F.col("doc_id").alias("id"))


_NESTED = "(SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id % 5 AS a, user_id % 7 AS b FROM events)"


@query("json_containment_index", f"SELECT event_id AS id FROM {_NESTED} WHERE (event_type = 'click' AND k = 7) OR (a = 3 AND b = 4) OR (a = 4 AND b = 3)")
def json_containment_index(spark: SparkSession, d: str) -> DataFrame:
    """Nested objects and arrays that contain one of two others, by bitmaps."""
    e = _t(spark, d, "events")
    doc = F.to_json(F.struct(F.col("event_type").alias("type"), F.struct(F.get_json_object("props", "$.k").cast("int").alias("k")).alias("props"), F.array(F.col("user_id") % 5, F.col("user_id") % 7).alias("groups")))
    rows, path = e.select(F.col("event_id").alias("id"), doc.alias("doc")), f"{shared_dir(spark)}/bits-{uuid.uuid4().hex}"
    containment.build(rows, path, "id", "doc")
    return containment.json_matches(rows, path, [{"type": "click", "props": {"k": 7}}, {"groups": [3, 4]}], "id", "doc").select("id")


@query("keyword_members_index", SQL["keyword_members"])
def keyword_members_index(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have one of some words among their keywords, by bitmaps."""
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), T.keywords(F.regexp_replace("text", r"[^\x00-\x7F]", " ")).alias("words"))
    path = f"{shared_dir(spark)}/bits-{uuid.uuid4().hex}"
    containment.build(rows, path, "id", "words")
    return containment.member_matches(rows, path, ["that", "nicht"], "id", "words").select("id")


@query("stream_file_states", """
WITH e AS (SELECT 'f' || user_id AS f, CAST(CAST(json_extract_string(props, '$.k') AS INT) % 4 AS VARCHAR) AS h, ts, event_type = 'error' AS del FROM events),
w AS (SELECT *, coalesce(NOT lag(del) OVER p, false) AS there, last_value(CASE WHEN NOT del THEN h END IGNORE NULLS) OVER (PARTITION BY f ORDER BY ts, del, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM e WINDOW p AS (PARTITION BY f ORDER BY ts, del, h))
SELECT f AS source_file, epoch_us(ts) AS us, CASE WHEN del THEN CASE WHEN there THEN 'deleted' ELSE 'gone' END WHEN NOT there THEN 'added' WHEN was = h THEN 'unchanged' ELSE 'changed' END AS action FROM w""")
def stream_file_states(spark: SparkSession, d: str) -> DataFrame:
    """A log of events as a stream of file changes, through Spark's state store."""
    log = _t(spark, d, "events")
    stream = spark.readStream.schema(log.schema).parquet(f"{d}/[e]vents.parquet")  # a pattern may be a file as well as a folder
    changes = stream.select(F.concat(F.lit("f"), "user_id").alias("source_file"), (F.get_json_object("props", "$.k").cast("int") % 4).cast("string").alias("content_hash"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "error").alias("deleted"))
    top, (key, store) = f"{shared_dir(spark)}/states-{uuid.uuid4().hex}", next(iter(files.STORE.items()))
    old = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        files.actions(changes).writeStream.format("parquet").option("checkpointLocation", f"{top}/mark").trigger(availableNow=True).start(f"{top}/out").awaitTermination()
    finally:
        spark.conf.set(key, old)
    return spark.read.schema(files.ACTION).parquet(f"{top}/out").select("source_file", F.unix_micros("at").alias("us"), "action")


@query("stable_ids", r"""
WITH h AS (SELECT doc_id, sha256(source || chr(1) || lang) AS h FROM documents)
SELECT doc_id AS id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid FROM h""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), tables.stable_id("source", "lang").alias("uuid"))


@query("code_language", f"SELECT doc_id AS id, CASE regexp_extract({_PATH_SQL}, '(\\.[^.]+)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.CODE_EXTENSION_LANGUAGE.items()) + " END AS language FROM documents")
def code_language(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("id", T.detect_code_language("path").alias("language"))


@query("tag_lists", "SELECT event_id AS id, event_type || '|' || user_id AS tags FROM events")
def tag_lists(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit(" "), "event_type", F.lit(" ,, "), F.col("user_id").cast("string"), F.lit(","))
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), F.array_join(T.split_tags(line), "|").alias("tags"))


@query("truncations", "SELECT doc_id AS id, sha256(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END) AS h FROM documents")
def truncations(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), T.content_hash(T.truncated("text")).alias("h"))


@query("event_windows", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """The streaming windows over the whole table at once."""
    e = _t(spark, d, "events")
    return event_counts(e).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")
