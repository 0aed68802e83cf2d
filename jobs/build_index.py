"""The English text index of a documents table, built anew.

    python -m jobs.build_index --documents DIR --output DIR [--config FILE]

Reads the table's ids and texts, writes positional postings in blocks and a lexicon, both in folders by the hash of the
lexeme, and replaces what an earlier run left there: the same table gives the same index. `granary.operators.textindex` reads
it: top-k, phrases and ranks by position.
"""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import textindex
from granary.plans.catalogue import ENGLISH_SQL
from granary.session import prepare, session, shared_dir

from .common import configured, log


def run(spark: SparkSession, documents: str, output: str, per_segment: int = textindex.PER_SEGMENT, buckets: int = textindex.BUCKETS) -> dict:
    """Builds the index and returns what it holds."""
    docs = spark.read.parquet(documents).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    textindex.build(docs, output, per_segment=per_segment, buckets=buckets, mode="overwrite")
    index = textindex.load(spark, output)
    held = index.lexicon().agg(F.count("*").alias("lexemes"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"), F.coalesce(F.sum("cf"), F.lit(0)).alias("occurrences")).first().asDict()
    log.info("read %d documents of %s; wrote %s in %d folders under %s", index.docs, documents, held, buckets, output)
    return {"documents": index.docs} | held


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job, run twice over documents into a new folder: its lexicon after the second run."""
    output = f"{shared_dir(prepare(spark))}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", output)
    return textindex.load(spark, output).lexicon().select("lexeme", "df", "cf")


SQL = f"WITH {ENGLISH_SQL} SELECT lexeme, count(DISTINCT doc_id) AS df, count(*) AS cf FROM x GROUP BY lexeme"


def main(argv: list[str] | None = None) -> dict:
    options = configured("Build the English index of a documents table.", Path(__file__).with_suffix(".json"), argv)
    spark = session()
    try:
        return run(spark, **options)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
