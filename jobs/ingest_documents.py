"""Incremental ingestion of a documents table into chunks, with a manifest.

    python -m jobs.ingest_documents --documents DIR --output DIR --checkpoint DIR [--config FILE]

Each run takes the Parquet files that have come since the last one (a file stream with availableNow; its checkpoint is the
mark) and writes, in partitions of the micro-batch, the manifest: what became of each document; and, in partitions of the
micro-batch and the language, the chunks of those documents that are new or have another text than before. A batch that runs
again after a failure overwrites its own partitions and reads the manifest of earlier batches only, so it writes the same.
`current` shows the newest version of every document.
"""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import content_hash, keywords, token_estimate
from granary.operators.windows import word_windows
from granary.session import prepare, session, shared_dir

from .common import configured, log

CHUNKS = "doc_id long, chunk_index int, source string, content string, n_words int, token_count long, content_hash string, keywords array<string>, batch_id long, lang string"
MANIFEST = "doc_id long, source string, text_hash string, status string, error string, chunk_count long, batch_id long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _write(df: DataFrame, path: str, *parts: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def classified(batch: DataFrame, known: DataFrame) -> DataFrame:
    """batch (doc_id, text, lang, source) with text_hash and status, one row for each document and each row without an id.

    completed: new, or its newest completed text in `known` (a manifest) is another; skipped: that text is this one; failed:
    a row without doc_id. Of several rows of a document the one of the greatest text hash counts.
    """
    rows = batch.withColumn("text_hash", content_hash(F.coalesce("text", F.lit(""))))
    one = F.max(F.struct("text_hash", "lang", "source", "text"))  # taken in each task first: a document may be repeated often
    named = rows.where("doc_id is not null").groupBy("doc_id").agg(one.alias("_one")).select("doc_id", "_one.*")
    before = known.where("status = 'completed'").groupBy("doc_id").agg(F.max_by("text_hash", "batch_id").alias("_before"))
    both = named.join(before, "doc_id", "left")
    same = F.coalesce(F.col("_before") == F.col("text_hash"), F.lit(False))
    done = both.withColumn("status", F.when(same, "skipped").otherwise("completed")).drop("_before")
    return done.unionByName(rows.where("doc_id is null").withColumn("status", F.lit("failed")))


def ingest_batch(batch: DataFrame, batch_id: int, output: str, window_words: int, overlap_words: int) -> dict:
    """Writes one micro-batch's partitions and returns the rows it read, its counts by status and the number of chunks."""
    spark = batch.sparkSession
    known = _read(spark, f"{output}/manifest", MANIFEST).where(F.col("batch_id") < batch_id)
    rows = classified(batch.select("doc_id", "text", "lang", "source"), known).withColumn("batch_id", F.lit(batch_id).cast("long"))
    chunks = word_windows(rows.where("status = 'completed'").drop("status", "text_hash"), "text", window_words, overlap_words)
    chunks = chunks.select("doc_id", "chunk_index", "source", "content", "n_words", token_estimate("content").alias("token_count"), content_hash("content").alias("content_hash"), keywords("content").alias("keywords"), "batch_id", "lang")
    _write(chunks, f"{output}/chunks", "batch_id", "lang")
    # counted from what was written; the manifest names a document only after its chunks are there
    count = _read(spark, f"{output}/chunks", CHUNKS).where(F.col("batch_id") == batch_id).groupBy("doc_id").agg(F.count("*").alias("_n"))
    entries = rows.join(count, "doc_id", "left").select(
        "doc_id", "source", "text_hash", "status", F.when(F.col("status") == "failed", "no doc_id").alias("error"),
        F.when(F.col("status") == "completed", F.coalesce("_n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("chunk_count"), "batch_id",
    )
    _write(entries, f"{output}/manifest", "batch_id")
    done = _read(spark, f"{output}/manifest", MANIFEST).where(F.col("batch_id") == batch_id)
    return done.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("completed", "skipped", "failed")), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks")).first().asDict() | {"read": batch.count()}


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, window_words: int = 200, overlap_words: int = 40, files_per_batch: int = 1000) -> dict:
    """Takes what has come to `documents` since the last run with this checkpoint, and returns totals by status.

    A file counts once, under the name that it first had; documents change by files that come later.
    """
    schema = spark.read.parquet(documents).schema
    for name, ddl, parts in (("chunks", CHUNKS, ("batch_id", "lang")), ("manifest", MANIFEST, ("batch_id",))):
        spark.createDataFrame([], ddl).write.mode("append").partitionBy(*parts).parquet(f"{output}/{name}")  # so that there is a folder to read
    # a path with a pattern may be a file as well as a folder
    head, _, last = documents.rstrip("/").rpartition("/")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{head}/[{last[0]}]{last[1:]}")
    totals = {"batches": 0, "read": 0, "completed": 0, "skipped": 0, "failed": 0, "chunks": 0}

    def one(batch: DataFrame, batch_id: int) -> None:
        got = ingest_batch(batch, batch_id, output, window_words, overlap_words)
        log.info("batch %d of %s: %s; written to %s", batch_id, documents, got, output)
        totals["batches"] += 1
        for k, v in got.items():
            totals[k] += v

    query = files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start()
    query.awaitTermination()
    log.info("read %d rows of %s in %d batches; wrote %d chunks under %s", totals["read"], documents, totals["batches"], totals["chunks"], output)
    return totals


def current(spark: SparkSession, output: str) -> DataFrame:
    """The chunks of every document's newest version."""
    newest = _read(spark, f"{output}/manifest", MANIFEST).where("status = 'completed'").groupBy("doc_id").agg(F.max("batch_id").alias("batch_id"))
    return _read(spark, f"{output}/chunks", CHUNKS).join(newest, ["doc_id", "batch_id"], "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job, run twice over documents into a new folder; the second run finds nothing new."""
    top = f"{shared_dir(prepare(spark))}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", f"{top}/output", f"{top}/checkpoint")
    return current(spark, f"{top}/output").select("doc_id", "chunk_index", "lang", "source", "n_words", "token_count", "content_hash")


SQL = r"""
WITH w AS (SELECT doc_id, lang, source, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, lang, source, CAST(unnest(range(0, greatest(len(w) - 200, 0) + 160, 160)) AS BIGINT) AS s, w FROM w WHERE len(w) > 0),
t AS (SELECT doc_id, CAST(s // 160 AS INT) AS chunk_index, lang, source, w[s + 1 : s + 200] AS part FROM c)
SELECT doc_id, chunk_index, lang, source, CAST(len(part) AS INT) AS n_words, length(array_to_string(part, ' ')) // 4 AS token_count, sha256(array_to_string(part, ' ')) AS content_hash FROM t
"""


def main(argv: list[str] | None = None) -> dict:
    options = configured("Ingest new files of a documents table.", Path(__file__).with_suffix(".json"), argv)
    spark = session()
    try:
        return run(spark, **options)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
