"""What the physical plans must look like."""

import contextlib
import io

import pytest

from pyspark.sql import functions as F

from granary.operators.search import bm25, hybrid, hybrid_rows, search, vector_scores
from granary.plans.catalogue import QUERIES


def plan(name, spark, sf):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES[name](spark, sf).explain("formatted")
    return out.getvalue()


def test_topk_is_taken_in_tasks(spark, sf):
    for name in ("vector_topk", "lexical_bm25_topk", "trigram_lookup", "graph_proximity"):
        assert "TakeOrderedAndProject" in plan(name, spark, sf), name


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan("chunks_by_file", spark, sf)
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)]" in p and "n_chars" not in p
    p = plan("token_estimate", spark, sf)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
    assert "ReadSchema: struct<event_type:string,props:string>" in plan("json_props", spark, sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"lexical_postings_topk"}))
def test_no_cross_join_of_tables(name, spark, sf):
    """Nested loops only with one row, a top k or checked patterns on the broadcast side; no cartesian product at all."""
    assert "CartesianProduct" not in plan(name, spark, sf)


def test_hybrid_of_one_corpus_joins_nothing_by_id(spark, sf):
    corpus = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.array(F.length("text").cast("double"), F.col("doc_id").cast("double")).alias("embedding"))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        search(corpus, "the and", [1.0, 0.5]).explain("formatted")
    assert "TakeOrderedAndProject" in out.getvalue() and not any(j in out.getvalue() for j in ("SortMergeJoin", "HashJoin", "CartesianProduct"))
    names = ("id", "dense_score", "sparse_score", "combined_score")
    two = hybrid(vector_scores(corpus, [1.0, 0.5], min_similarity=0.9), bm25(corpus, "the and"), 0.3)
    near = lambda df: [(r[0], *(round(x, 9) for x in r[1:])) for r in df.select(*names).collect()]
    assert near(hybrid_rows(corpus, "the and", [1.0, 0.5], 0.3, 20, 0.9)) == near(two)


def test_hybrid_rows_of_odd_corpora(spark):
    """Null texts and vectors, an empty query, an empty table."""
    corpus = spark.createDataFrame([("a", "fox", [1.0, 0.0]), ("b", None, [1.0, 0.0]), ("c", "fox", None), ("d", None, None), ("e", "", [0.0, 0.0])], "id string, content string, embedding array<double>")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(hybrid_rows(corpus, "fox", [1.0, 0.0])) == ["a", "b", "c"]
    assert ids(hybrid_rows(corpus, "", [1.0, 0.0])) == ["a", "b"] and ids(hybrid_rows(corpus.where("false"), "fox", [1.0, 0.0])) == []
