"""The ingestion manifest: one row for each source file, and what has to be ingested again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import INGESTION_STATUS, conform, latest, parse_member, row_hash


def upsert_manifest(existing: DataFrame, new: DataFrame, now: Column | None = None, order: list[Column] | None = None) -> DataFrame:
    """By source_file. All columns are overwritten, nulls too, but for created_at, and ingested_at unless completed."""
    now = now if now is not None else F.current_timestamp()
    new = conform(latest(new, ("source_file",), order or [row_hash(new).desc()]), "ingestion_manifest")
    old = existing.select("source_file", F.col("created_at").alias("_created"), F.col("ingested_at").alias("_ingested"), F.lit(True).alias("_old"))
    rows = new.join(old, "source_file", "left").withColumns(
        {"created_at": F.coalesce("_created", now), "updated_at": now, "ingested_at": F.when(F.col("status") == "completed", now).otherwise(F.col("_ingested"))}
    )
    rest = conform(existing, "ingestion_manifest").join(new.select("source_file"), "source_file", "left_anti")
    return rest.unionByName(rows.drop("_created", "_ingested", "_old"))


def create_entries(existing: DataFrame, files: DataFrame, now: Column | None = None) -> DataFrame:
    """files (source_file, file_type, knowledge_type) as pending entries, known ones set back to pending."""
    return upsert_manifest(existing, files.withColumn("status", F.lit("pending")), now)


def update_status(existing: DataFrame, updates: DataFrame, now: Column | None = None) -> DataFrame:
    """updates (source_file, status, chunk_count, error_message, content_hash); files that aren't known are left out.

    Of several updates of a file one counts, the greatest hash of a row.
    """
    now = now if now is not None else F.current_timestamp()
    names = ("status", "chunk_count", "error_message", "content_hash")
    one = latest(updates.select("source_file", *names), ("source_file",), [row_hash(updates, ("source_file", *names)).desc()])
    u = one.select("source_file", *(F.col(c).alias(f"_{c}") for c in names), F.lit(True).alias("_hit"))
    both = existing.join(u, "source_file", "left")
    hit = F.col("_hit").isNotNull()
    new = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in names}
    new["updated_at"] = F.when(hit, now).otherwise(F.col("updated_at"))
    new["ingested_at"] = F.when(hit & (F.col("_status") == "completed"), now).otherwise(F.col("ingested_at"))
    return both.withColumns(new).select(*existing.columns)


def needs_reingestion(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files (source_file, content_hash, ...) that are missing, not completed, or completed with another hash."""
    done = manifest.where("status = 'completed'").select("source_file", "content_hash")
    return files.join(done, ["source_file", "content_hash"], "left_anti")


def tallies(entries: DataFrame) -> DataFrame:
    """total, successful, failed."""
    return entries.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"))


def entry(manifest: DataFrame, source_file: str) -> DataFrame:
    return manifest.where(F.col("source_file") == source_file)


def parse_status(value: str) -> str:
    return parse_member(value, INGESTION_STATUS, "status")
