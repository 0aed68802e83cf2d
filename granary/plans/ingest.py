"""Ingestion: files -> documents -> chunks -> vectors -> tables, with the manifest; and code -> graph."""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, knowledge_type
from ..functions.vector import embed_column
from ..operators import graph, manifest, tables
from ..operators.tables import Catalog
from ..schemas import KNOWLEDGE_TYPES, conform, empty, parse_member
from ..sources import files as src
from ..sources.chunks import ChunkConfig


@dataclass
class Ingested:
    """chunks: rows for the chunk table; entries: rows for the manifest, one for each file, failed and empty ones too."""

    chunks: DataFrame
    entries: DataFrame


def ingest(files: DataFrame, known: DataFrame | None = None, knowledge: str | None = None, metadata: dict[str, str] | None = None, config: ChunkConfig = ChunkConfig(), skip_embedding: bool = False, embedder=None, keep=lambda df: df, **options) -> Ingested:
    """files (source_file, text) that `known` (a manifest) doesn't have completed at their hash, in one plan.

    keep: what holds contents, documents and chunks between their uses, so that a file is read once; nothing by default.
    Metadata keys of the caller go before those of front matter, these before title, type and knowledge type.
    """
    if knowledge is not None:
        parse_member(knowledge, KNOWLEDGE_TYPES, "knowledge_type")
    todo = files.select("source_file", "text", content_hash("text").alias("content_hash"))
    if known is not None:
        todo = manifest.needs_reingestion(todo, known)
    todo = keep(todo)
    docs = keep(src.parse(todo, **options))
    kind = F.lit(knowledge) if knowledge else knowledge_type("source_file", F.coalesce("content", F.lit("")))
    base = F.map_concat(
        F.create_map(F.lit("title"), F.coalesce("title", F.lit("")), F.lit("document_type"), F.col("document_type"), F.lit("knowledge_type"), kind),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")),
        F.create_map(*(F.lit(str(x)) for kv in (metadata or {}).items() for x in kv)).cast("map<string,string>"),
    )
    heads = docs.select("source_file", base.alias("metadata"))
    chunks = src.chunk(docs, config).join(heads, "source_file")
    chunks = keep(embed_column(chunks, "content", embedder=embedder, skip=skip_embedding))
    per = chunks.groupBy("source_file").agg(F.count("*").cast("int").alias("chunk_count"))
    entries = docs.select("source_file", "document_type", "error", kind.alias("knowledge_type")).join(todo.select("source_file", "content_hash"), "source_file").join(per, "source_file", "left")
    failed = F.col("error").isNotNull()
    entries = entries.select(
        "source_file", F.when(failed, "unknown").otherwise(F.col("document_type")).alias("file_type"), F.when(~failed, F.col("knowledge_type")).alias("knowledge_type"),
        F.when(~failed, F.coalesce("chunk_count", F.lit(0))).alias("chunk_count"), F.when(failed, "failed").otherwise("completed").alias("status"),
        F.col("error").alias("error_message"), F.when(~failed, F.col("content_hash")).alias("content_hash"),
    )
    return Ingested(conform(chunks, "semantic_chunks"), conform(entries, "ingestion_manifest"))


def run(catalog: Catalog, files: DataFrame, **options) -> dict:
    """Ingests into a catalog and returns the totals. Chunks are written before the manifest names them.

    Contents, documents and chunks are kept while this runs (checkpointed where the session has a folder for it), so hash,
    chunks and manifest entry of a file come from one reading. Buckets without a changed file are not touched.
    """
    held: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        if catalog.spark.sparkContext.getCheckpointDir():
            return df.checkpoint()
        held.append(df.persist(StorageLevel.DISK_ONLY))
        return held[-1]

    try:
        found = ingest(files, catalog.read("ingestion_manifest"), keep=keep, **options)
        entries = keep(found.entries)
        now = F.lit(datetime.now(timezone.utc))
        chunks = found.chunks.withColumns({"created_at": now, "updated_at": now})
        done = entries.where("status = 'completed'").select("source_file")

        def replace(old: DataFrame, files: DataFrame) -> DataFrame:
            # files without chunks lose their old ones too
            rest = old.join(files.join(chunks.select("source_file").distinct(), "source_file", "left_anti"), "source_file", "left_anti")
            return tables.replace_file_chunks(rest, chunks)

        catalog.merge("semantic_chunks", done, replace)
        catalog.merge("ingestion_manifest", entries, lambda old, new: manifest.upsert_manifest(old, new, now))
        return manifest.tallies(entries).first().asDict()
    finally:
        for df in held:
            df.unpersist()


def ingest_directory(catalog: Catalog, folder: str, pattern: str = "*", recursive: bool = True, exclude: tuple[str, ...] = (), **options) -> dict:
    return run(catalog, src.scan(catalog.spark, folder, pattern, recursive, exclude), **options)


def ingest_file(catalog: Catalog, path: str, **options) -> dict:
    """One file; 'status' is skipped where it is completed at its hash. With its chunk_count and content_hash, and the time that it took."""
    began = time.perf_counter()
    totals = run(catalog, src.scan(catalog.spark, path), **options)
    known = manifest.entry(catalog.read("ingestion_manifest"), src.scan(catalog.spark, path).select("source_file").first()["source_file"]).select("chunk_count", "content_hash").first()
    status = "skipped" if not totals["total"] else "completed" if totals["successful"] else "failed"
    return totals | {"status": status, "chunk_count": known["chunk_count"] or 0, "content_hash": known["content_hash"], "elapsed_ms": round(1000 * (time.perf_counter() - began))}


def index_code(catalog: Catalog, folder: str, project_id: str = "default", exclude: tuple[str, ...] = (), output: str | None = None, embedder=None) -> dict:
    """Indexes a code tree: replaces the project's graph, upserts the entities, optionally writes one JSON document."""
    indexed = src.index_code(src.scan_code(catalog.spark, folder, exclude))
    entities, rel = src.entities(indexed), src.relations(indexed)
    nodes, edges = graph.graph_from_entities(entities, rel)
    resolved, _ = graph.resolve_targets(edges, nodes)
    project = catalog.spark.range(1).select(F.lit(project_id).alias("project_id"))
    load = lambda n, e: graph.load_graph(n, e, nodes, resolved, project_id)
    none = empty(catalog.spark, "graph_nodes"), empty(catalog.spark, "graph_edges")
    catalog.merge("graph_nodes", project, lambda old, _: load(old, none[1])[0])
    catalog.merge("graph_edges", project, lambda old, _: load(none[0], old)[1])
    text = F.concat_ws("\n", F.coalesce("signature", "name"), "docstring")
    rows = embed_column(entities.withColumn("_text", text), "_text", "docstring_embedding", embedder)
    catalog.merge("code_entities", conform(rows, "code_entities"), lambda old, new: tables.upsert(old, new, ("id",)))
    if output:
        src.write_graph_json(nodes, resolved, output)
    return indexed.agg(F.countDistinct("file_path").alias("files"), F.coalesce(F.sum(F.size("entities")), F.lit(0)).alias("entities"), F.coalesce(F.sum(F.size("relations")), F.lit(0)).alias("relationships"), F.count("error").alias("errors")).first().asDict()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """python -m granary.plans.ingest --catalog DIR (--files F... | --directory D [--pattern P] | --code D [--output F])"""
    p = argparse.ArgumentParser(description="Ingest documents or index code into a catalog.")
    p.add_argument("--catalog", required=True)
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("--files", nargs="+")
    what.add_argument("--directory")
    what.add_argument("--code")
    p.add_argument("--pattern", default="*")
    p.add_argument("--output")
    p.add_argument("--type", choices=KNOWLEDGE_TYPES)
    p.add_argument("--skip-embedding", action="store_true")
    a = p.parse_args(argv)
    if spark is None:
        from ..session import session

        spark = session()
    catalog = Catalog(spark, a.catalog)
    if a.code:
        return index_code(catalog, a.code, output=a.output)
    more = {"knowledge": a.type, "skip_embedding": a.skip_embedding}
    if a.directory:
        return ingest_directory(catalog, a.directory, a.pattern, **more)
    listed = src.scan(spark, a.files[0])
    for f in a.files[1:]:
        listed = listed.unionByName(src.scan(spark, f))
    return run(catalog, listed, **more)


if __name__ == "__main__":
    print(main())
