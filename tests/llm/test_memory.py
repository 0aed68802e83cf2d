"""What Python workers get at once and what they keep after a task."""

import re
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm.textkit import thrifty

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def held():
    """MB that this process holds."""
    return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_a_task_gives_memory_back():
    last = []

    def run(batches):
        some = [b"x" * (60_000 + i) for i in range(3000)]  # too small to be mapped one by one
        last.append(b"x" * 60_000)  # what lies behind them stays
        yield from batches
        del some

    before = held()
    assert list(thrifty(run)(iter([1, 2]))) == [1, 2]
    assert held() - before < 60


def test_stages_take_bounded_batches(spark, sf):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    try:
        corpus_pipeline.redact_personal_data(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
        rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
        sizes = rows.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in bs), "n long").collect()
        assert 30 << 20 < sum(r["n"] for r in sizes) and max(r["n"] for r in sizes) <= 10 << 20
    finally:
        spark.conf.set(key, old)
