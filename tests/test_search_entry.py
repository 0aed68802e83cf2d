"""The search entry: every kind of search in one projection; scores of reranking; boosted evidence; file hashes."""

import contextlib
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from granary.operators.search import bm25, filter_relevance, hybrid, hybrid_rows, overlap_score, rerank, search, vector_scores
from granary.plans.retrieval import answer
from granary.sources.guards import file_hash


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.array(F.length("text").cast("double"), F.col("doc_id").cast("double")).alias("embedding"), F.create_map(F.lit("lang"), "lang").alias("metadata"))


@pytest.mark.parametrize("alpha", [0.0, 0.3, 1.0])
@pytest.mark.parametrize("vector", [None, [1.0, 0.5]])
def test_one_projection_equals_joined_lists(spark, corpus, alpha, vector):
    near = lambda df: [(r[0], *(round(x, 9) for x in r[1:])) for r in df.select("id", "dense_score", "sparse_score", "combined_score").collect()]
    dense = vector_scores(corpus, vector, min_similarity=0.9) if vector else None
    want = near(hybrid(dense, bm25(corpus, "the and"), alpha if vector else 0.0))
    df = hybrid_rows(corpus, "the and", vector, alpha, 20, 0.9)
    assert near(df) == want and len(want) == 20
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        search(corpus, "the and", vector, alpha=alpha, filters={"lang": "en"}).explain("formatted")
    assert not any(j in out.getvalue() for j in ("SortMergeJoin", "HashJoin", "CartesianProduct"))


def test_rerank_score_in_metadata(spark, corpus):
    rows = search(corpus, "the and", None, 4, scorer=overlap_score)
    for r in rows.collect():
        assert float(r["metadata"]["rerank_score"]) == r["combined_score"] and r["metadata"]["lang"]
    same = rerank(corpus.limit(3).withColumn("combined_score", F.lit(1.0)), "x", 3)
    assert all("rerank_score" not in r["metadata"] for r in same.collect())
    empty = corpus.limit(1).withColumn("metadata", F.lit(None).cast("map<string,string>")).withColumn("combined_score", F.lit(1.0))
    assert set(rerank(empty, "the", 1, overlap_score).first()["metadata"]) == {"rerank_score"}


def test_anchors_bring_their_files_forward(spark):
    corpus = spark.createDataFrame([(f"c{i}", f"how does load_table work {'really ' * i}", f"f{i}.py") for i in range(6)], "id string, content string, source_file string")
    nodes = spark.createDataFrame([("f4.py:load_table", "load_table", "f4.py"), ("f5.py:helper", "helper", "f5.py")], "id string, name string, file_path string")
    edges = spark.createDataFrame([("f5.py:helper", "f4.py:load_table", "CALLS")], "src string, dst string, relation string")
    seen = []
    keep = lambda q, context: seen.append(context) or ""
    answer(corpus, "how does load_table work", keep)
    got = answer(corpus, "how does load_table work", keep, nodes, edges)
    first = [c.split("\n")[0] for c in seen]
    assert first == ["Source: f0.py", "Source: f5.py"] and got["related"][0] == "f5.py:helper"


def test_file_hashes(spark):
    df = spark.createDataFrame([(b"", ), (b"abc",), (None,)], "content binary")
    for name in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        assert [r["file_hash"] for r in file_hash(df, algorithm=name).collect()] == [hashlib.new(name, b"").hexdigest(), hashlib.new(name, b"abc").hexdigest(), None]
    with pytest.raises(ValueError, match="crc"):
        file_hash(df, algorithm="crc")


def test_relevance_by_any_scorer(spark):
    df = spark.createDataFrame([(1, "red fox"), (2, "fox"), (3, "hen"), (4, None)], "id int, content string")
    got = lambda **more: [(r["id"], r["relevance"]) for r in filter_relevance(df, "red fox", **more).orderBy("id").collect()]
    assert got() == [(1, 1.0), (2, 0.5), (4, 0.5)]  # what cannot be judged stays at 0.5
    assert got(threshold=0.6, scorer=lambda q, t: F.length(t) / 10.0) == [(1, 0.7)]
    assert filter_relevance(df.where("false"), "x").count() == 0
