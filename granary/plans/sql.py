"""The published SQL functions over a session's views: `hybrid_search` and `lookup_error` as table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.notelog import NoteLog
from ..operators.tables import Catalog

_WORDS = "filter(split(lower({0}), '[^a-z0-9]+'), w -> w <> '')"
_TRIGRAMS = "array_distinct(flatten(transform(" + _WORDS + ", w -> transform(sequence(1, length(w) + 1), i -> substr(concat('  ', w, ' '), i, 3)))))"


def register(spark: SparkSession, catalog: Catalog) -> None:
    """Views of the tables, and the functions on them.

    hybrid_search(query, query_vector, alpha) scores all rows by alpha * cosine + (1 - alpha) * share of the query's words; the
    DataFrame operator of that name has BM25 and the query language. lookup_error(message, type, language) gives patterns
    of more than 0.3 trigram similarity; null parameters filter nothing.
    """
    for t in ("semantic_chunks", "error_patterns", "ingestion_manifest", "graph_nodes", "graph_edges"):
        catalog.read(t).createOrReplaceTempView(t)
    NoteLog(spark, f"{catalog.root}/memory").current().createOrReplaceTempView("memory_notes")
    p, m = _TRIGRAMS.format("message_pattern"), _TRIGRAMS.format("p_message")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION lookup_error(p_message STRING, p_type STRING, p_language STRING)
        RETURNS TABLE(error_id STRING, pattern STRING, `condition` STRING, api_element_id STRING, library_id STRING, similarity DOUBLE)
        RETURN SELECT id, message_pattern, `condition`, api_element_id, library_id, sim FROM (
            SELECT *, size(array_intersect({p}, {m})) / greatest(1, size(array_union({p}, {m}))) AS sim FROM error_patterns
            WHERE (p_language IS NULL OR language = p_language) AND (p_type IS NULL OR exception_type = p_type)) WHERE sim > 0.3""")
    q = "array_distinct(" + _WORDS.format("p_query") + ")"
    dot = "aggregate(zip_with(embedding, p_vector, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    norm = "sqrt(aggregate({0}, 0D, (s, x) -> s + x * x))"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION hybrid_search(p_query STRING, p_vector ARRAY<DOUBLE>, p_alpha DOUBLE)
        RETURNS TABLE(id STRING, content STRING, source_file STRING, header_path STRING, dense_score DOUBLE, sparse_score DOUBLE, combined_score DOUBLE)
        RETURN SELECT id, content, source_file, header_path, d, s, p_alpha * d + (1 - p_alpha) * s FROM (
            SELECT *, CASE WHEN p_alpha > 0 THEN greatest(coalesce(try_divide({dot}, {norm.format('embedding')} * {norm.format('p_vector')}), 0D), 0D) ELSE 0D END AS d,
                CASE WHEN p_alpha < 1 THEN size(array_intersect({q}, {_WORDS.format('content')})) / greatest(1, size({q})) ELSE 0D END AS s FROM semantic_chunks)
        WHERE d > 0 OR s > 0""")
