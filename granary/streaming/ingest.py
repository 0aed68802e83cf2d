"""Incremental ingestion as a stream of files: an addition to batch ingestion, with the same tables.

`availableNow` keeps it under manual control: each call takes what has arrived since the last and ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tables import Catalog
from ..plans import ingest

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_stream(catalog: Catalog, folder: str, checkpoint: str, pattern: str = "*", files_per_batch: int = 1000, **options) -> StreamingQuery:
    """Ingests new files of a folder in micro-batches. A batch that runs twice changes nothing: writes are upserts by hash and key."""
    files = catalog.spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    rows = files.select(F.regexp_replace("path", r"^file:/+", "/").alias("source_file"), F.expr("make_valid_utf8(cast(content as string))").alias("text"))

    def batch(df: DataFrame, _: int) -> None:
        ingest.run(catalog, df, **options)

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by type in tumbling windows of an event stream (ts, event_type, value), late rows up to `late`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
