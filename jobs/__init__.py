"""Runnable jobs, and their queries for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import build_index, ingest_documents


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_ingest_documents": ingest_documents.query, "job2_build_index": build_index.query}


def oracle_sql() -> dict[str, str]:
    return {"job1_ingest_documents": ingest_documents.SQL, "job2_build_index": build_index.SQL}
