"""The corpus pipeline: documents in, a packing manifest out. Each stage calls one operator of the `llm` subpackage.

Stages take (spark, docs, sf_dir) and work on all that the one before has kept; all but the last return the columns of
documents. A row without doc_id can be neither learned from nor compared and passes the filters.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import minhash, packing, pii, substring, toxicity
from granary.llm.common import crc_mod, drop, shared_dir, ship, table


#: Bytes of rows that a Python worker gets at once. It needs several times as much, and so do the buffers that they are sent through.
BATCH = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Lets workers import the operators and take batches of BATCH; stages are lazy, so the session's setting stays."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of this input and drops the documents scored 0.5 or more; scores and texts stay in one pass."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: the smallest doc_id of each group stays."""
    prepare(spark)
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 20 that start earlier go; a text from which none goes keeps its white space."""
    prepare(spark)
    return substring.drop_repeats(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; n_chars, where there is a text, is counted anew."""
    prepare(spark)
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: (doc_id, n_tokens, bucket, bucket_len, batch, slot); its text stays in the stage before."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("substring", remove_repeated_passages),
    ("pii", redact_personal_data),
    ("packing", pack_batches),
]

#: Learned models, similarity over shingle sets and optimal buckets are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Applies the stages to documents and returns the manifest.

    Each result is written under `folder` (one of its own in the shared folder, without it) as `<stage>` and read again.
    What remains there is the product: `<folder>/pii`, the texts, and `<folder>/packing`, the manifest, whose doc_id joins
    them; the other stages' tables go once the next is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    top = folder or f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before and name != STAGES[-1][0]:
            drop(spark, f"{top}/{before}")
        before = name
    return docs
