"""Plan, act, review, answer: retrieval in steps over a corpus of chunks."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.questions import bm25_many
from ..operators.search import bm25, hybrid, vector_scores

_SPLIT = re.compile(r"\s*(?:\?|;|\band\b|\bversus\b|\bvs\.?)\s*", re.I)
_IDENTIFIER = re.compile(r"\b(?:[A-Za-z]+_[A-Za-z_]\w*|[a-z]+[A-Z]\w*|[A-Z][a-z]+[A-Z]\w*|\w+\.\w+(?:\.\w+)*)\b")

#: Hits up to this number are sent to the corpus; more are joined by id.
FEW = 10_000


@dataclass
class RetrievalPlan:
    original_query: str
    complexity: str = "simple"
    query_type: str = "local"
    sub_questions: list[str] = field(default_factory=list)
    anchors: list[str] = field(default_factory=list)


def plan(query: str) -> RetrievalPlan:
    """Parts joined by `and`, `vs`, `;` or `?` are questions of their own; identifier-shaped words are anchors."""
    parts = [p for p in _SPLIT.split(query.strip()) if len(p.split()) > 1]
    many = len(parts) > 1
    anchors = list(dict.fromkeys(_IDENTIFIER.findall(query)))
    wide = bool(re.search(r"\b(overview|architecture|all|every|overall|summar\w+)\b", query, re.I))
    return RetrievalPlan(query, "complex" if many else "simple", "global" if wide else "local", parts if many else [query], anchors)


def act(corpus: DataFrame, p: RetrievalPlan, limit: int = 10, embed: Callable[[str], list[float]] | None = None, alpha: float = 0.7) -> DataFrame:
    """(sub_question, ord, rank, id, content, source_file, combined_score): the best of every sub-question, one after the other.

    Without `embed` all sub-questions are one table, and the corpus is read as often for any number of them; with it each has
    a hybrid search of its own.
    """
    if embed is None:
        asked = corpus.sparkSession.createDataFrame([(i, q) for i, q in enumerate(p.sub_questions)], "qid int, question string")
        hits = bm25_many(corpus, asked, limit)
        # scores are shares of each question's best
        best = F.max("score").over(Window.partitionBy("qid"))
        score = F.when(best > 0, F.col("score") / best).otherwise(0.0)
        out = hits.withColumn("combined_score", score).join(F.broadcast(asked), "qid").select(F.col("question").alias("sub_question"), F.col("qid").alias("ord"), F.col("rank").cast("int").alias("rank"), "id", "combined_score")
    else:
        out = None
        for i, q in enumerate(p.sub_questions):
            hits = hybrid(vector_scores(corpus, embed(q), min_similarity=0.0), bm25(corpus, q), alpha, limit)
            # `limit` rows at most: the rank needs no partition of its own
            w = Window.partitionBy(F.lit(i)).orderBy(F.desc("combined_score"), "id")
            rows = hits.select(F.lit(q).alias("sub_question"), F.lit(i).alias("ord"), F.row_number().over(w).alias("rank"), "id", "combined_score")
            out = rows if out is None else out.unionByName(rows)
    few = len(p.sub_questions) * limit <= FEW
    return corpus.select("id", "content", "source_file").join(F.broadcast(out) if few else out, "id")


def expand_anchors(nodes: DataFrame, edges: DataFrame, p: RetrievalPlan, limit: int = 20) -> DataFrame:
    """(id, score) of nodes near those that carry an anchor's name."""
    names = [a.rsplit(".", 1)[-1] for a in p.anchors]
    if not names:
        return nodes.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    return graph.proximity(edges, nodes.where(F.col("name").isin(names)).select(F.col("id").alias("seed")), limit)


def review(raw: DataFrame, scorer=None) -> DataFrame:
    """The first result of every 100-character beginning. `scorer` (question, text column) -> 0..1 grades it, else it is trusted."""
    w = Window.partitionBy(F.substring("content", 1, 100)).orderBy("ord", "rank", "id")
    rows = raw.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    if scorer is None:
        return rows.withColumns({"relevance": F.lit("Assumed Relevant"), "reasoning": F.lit("Top-k retrieval")})
    s = scorer(F.col("sub_question"), F.col("content"))
    return rows.withColumns({"relevance": F.when(s >= 0.66, "RELEVANT").when(s >= 0.33, "PARTIAL").otherwise("IRRELEVANT"), "reasoning": F.format_string("score %.2f", s)})


def boosted(evidence: DataFrame, related: DataFrame, nodes: DataFrame, weight: float = 1.0) -> DataFrame:
    """evidence with `boost`, and ranked anew by combined_score * (1 + weight * boost) within each sub-question.

    boost is the greatest nearness of a node of related (id, score) that lies in the evidence's file, 0 without one.
    related is what the anchors' expansion is limited to, so it is sent to every task.
    """
    files = nodes.select("id", F.col("file_path").alias("source_file")).join(F.broadcast(related), "id").groupBy("source_file").agg(F.max("score").alias("boost"))
    both = evidence.join(F.broadcast(files), "source_file", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    both = both.withColumn("combined_score", F.col("combined_score") * (1 + weight * F.col("boost")))
    w = Window.partitionBy("ord").orderBy(F.desc("combined_score"), "id")
    return both.withColumn("rank", F.row_number().over(w)).select(*evidence.columns, "boost")


def evidence_text(evidence: DataFrame) -> str:
    rows = evidence.orderBy("ord", "rank", "id").select("source_file", "content").collect()  # sub-questions x limit rows
    return "\n\n".join(f"Source: {r['source_file']}\nContent: {r['content']}" for r in rows)


def extractive(query: str, context: str) -> str:
    """Default generator: the context's sentence that shares most words with the query."""
    q = set(re.findall(r"[a-z0-9]+", query.lower()))
    sentences = re.split(r"(?<=[.!?])\s+", re.sub(r"(?m)^(Source: .*|Content: )", "", context))
    return max(sentences, key=lambda s: (len(q & set(re.findall(r"[a-z0-9]+", s.lower()))), -len(s))).strip() if context else ""


def answer(corpus: DataFrame, query: str, generate: Callable[[str, str], str] = extractive, nodes: DataFrame | None = None, edges: DataFrame | None = None, **options) -> dict:
    """{answer, plan, verified_evidence_count}; with a graph, evidence near the question's anchors comes first, and `related` has their ids, nearest first."""
    p = plan(query)
    raw, more = act(corpus, p, **options), {}
    if nodes is not None and edges is not None:
        related = expand_anchors(nodes, edges, p)
        near = related.collect()  # 20 rows at most
        more = {"related": [r["id"] for r in near]}
        if near and "file_path" in nodes.columns:
            raw = boosted(raw, corpus.sparkSession.createDataFrame(near, related.schema), nodes)
    evidence = review(raw).cache()
    try:
        return {"answer": generate(query, evidence_text(evidence)), "plan": p, "verified_evidence_count": evidence.count()} | more
    finally:
        evidence.unpersist()
