"""Many questions against one search for each; fusion by bounds against the fusion of sorted lists."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from granary.operators import questions
from granary.operators.questions import bm25_many
from granary.operators.search import bm25, fused_topk, ranked, ranked_whole, reciprocal_rank_fusion
from granary.plans.retrieval import RetrievalPlan, act

QUESTIONS = ["the license", "license or clown", '"licensed under"', '"licensed under the" -gnu', "-the", "", None, "the the", '"the the"', "nosuchword or license", "und der", "license -\"licensed under\"", '"under licensed" or "the license"']


@pytest.fixture(scope="module")
def corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("source_file"))
    return docs.unionByName(spark.createDataFrame([(9001, None, "s"), (9002, "", "s"), (9003, "the the license", "s"), (9004, "the the license", "s"), (9005, "licensed under the gnu license clown", "s")], docs.schema)).cache()


def test_as_one_by_one(spark, corpus):
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "qid int, question string").withColumn("alt", F.lit(1))
    rows = bm25_many(corpus.withColumns({c: F.lit(1) for c in ("word", "at", "len", "qid", "token")}), asked, 7)
    got = {}
    for r in rows.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["id"], round(r["score"], 9), r["rank"]))
    for i, q in enumerate(QUESTIONS):
        want = [(r["id"], round(r["score"], 9), r["rank"]) for r in ranked(bm25(corpus, q or "").withColumn("qid", F.lit(i)), 7).orderBy("rank").collect()]
        assert got.get(i, []) == (want if q != "-the" else []), q  # nothing required: no rows
    assert {0, 1, 2, 3, 9, 11, 12} <= set(got)
    assert bm25_many(corpus, asked.where("false"), 3).count() == bm25_many(corpus.where("false"), asked, 3).count() == 0


def test_scans_do_not_grow_with_questions(spark, sf):
    """The text is tokenized in as many plans for two questions as for forty."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("source_file"))

    def scans(n):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            act(docs, RetrievalPlan("", sub_questions=["the license", "und der"] * n)).explain()
        return out.getvalue().count("FileScan parquet")

    assert scans(1) == scans(20) <= 2


def test_the_texts_are_read_once(spark, sf, corpus):
    """The only other scan is of the hits' texts, and tasks send only words that were asked for."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("source_file"))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        act(docs, RetrievalPlan("", sub_questions=["the license", "und der"])).explain()
    assert out.getvalue().count("FileScan parquet") == 1
    odd = spark.createDataFrame([(1, "The cat; the DOG"), (2, None), (3, "dog"), (None, "the"), (4, "")], "id long, content string").coalesce(1)
    rows = questions.asked_places(odd, "id", "content", {"the": True, "dog": False, "cow": True}).collect()
    assert sorted(tuple(r)[:5] for r in rows if r["word"]) == [(1, "dog", 4, 1, None), (1, "the", 4, 2, [1, 3]), (3, "dog", 1, 1, None)]
    sums = [tuple(r)[5:] for r in rows if not r["word"]]
    assert tuple(map(sum, zip(*sums))) == (5, 4, 6)


def test_more_words_than_are_sent(spark, corpus, monkeypatch):
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "qid int, question string")
    rows = lambda: sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in bm25_many(corpus, asked, 7).collect())
    sent = rows()
    monkeypatch.setattr(questions, "FEW", 0)
    assert rows() == sent and sent


@pytest.mark.parametrize("seed", range(4))
def test_fusion_by_bounds(spark, seed):
    rng = random.Random(seed)
    def made(n, ties):
        return spark.createDataFrame([(f"i{i:04d}", float(rng.randrange(ties))) for i in rng.sample(range(1500), n)], "id string, score double")
    for sizes, limit in (((900, 1200), 20), ((900, 30, 1100), 5), ((10, 5), 20), ((400, 0), 20)):
        lists = [made(n, rng.choice([10, 10_000])) for n in sizes]
        want = [(r["id"], round(r["score"], 12)) for r in reciprocal_rank_fusion([ranked_whole(x) for x in lists], limit).collect()]
        got = [(r["id"], round(r["score"], 12)) for r in fused_topk(lists, limit).collect()]
        assert sorted(got, key=lambda r: (-r[1], r[0])) == sorted(want, key=lambda r: (-r[1], r[0]))
