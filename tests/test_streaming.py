"""File states: stopped and started again, against the batch; late rows, repeats, deletions, expiry."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from granary.streaming import files


@pytest.fixture
def stored(spark):
    key = next(iter(files.STORE))
    old = spark.conf.get(key, None)
    spark.conf.set(key, files.STORE[key])
    yield
    spark.conf.set(key, old) if old else spark.conf.unset(key)


def write(spark, folder, rows):
    spark.createDataFrame(rows, files.CHANGE).coalesce(1).write.mode("append").parquet(folder)


def run(spark, top, **more):
    src = spark.readStream.schema(files.CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
    files.actions(src, **more).writeStream.format("parquet").option("checkpointLocation", f"{top}/mark").trigger(availableNow=True).start(f"{top}/out").awaitTermination()
    return sorted(((r["source_file"], r["at"].isoformat(), r["action"], r["content_hash"]) for r in spark.read.schema(files.ACTION).parquet(f"{top}/out").collect()), key=str)


T = datetime(2024, 1, 1)


def test_restarted_equals_the_batch(spark, stored, tmp_path):
    rng, top = random.Random(4), f"file://{tmp_path}"
    rows = sorted(((f"f{rng.randrange(6)}", rng.choice(["a", "b", None]), T + timedelta(minutes=i // 2), rng.random() < 0.2) for i in range(120)), key=lambda r: r[2])
    rows += [(None, "a", T, False)]
    for i in (0, 40, 80):  # three runs, each over what is new
        write(spark, f"{top}/in", rows[i : i + 20])
        write(spark, f"{top}/in", rows[i + 20 : i + 40] + rows[120:])
        got = run(spark, top)
    batch = files.batch_actions(spark.createDataFrame(rows, files.CHANGE))
    want = sorted(((r["source_file"], r["at"].isoformat(), r["action"], r["content_hash"]) for r in batch.collect()), key=str)
    assert got == want and len(got) == 120 and {a for _, _, a, _ in got} == {"added", "changed", "unchanged", "deleted", "gone"}
    assert run(spark, top) == got


def test_late_and_expired(spark, stored, tmp_path):
    top, hour = f"file://{tmp_path}", timedelta(hours=1)
    write(spark, f"{top}/in", [("a", "1", T + 2 * hour, False), ("b", "1", T + 2 * hour, False)])
    run(spark, top, keep=timedelta(hours=3), late="10 hours")
    write(spark, f"{top}/in", [("a", "0", T + hour, False), ("a", "1", T + 2 * hour, False)])
    got = run(spark, top, keep=timedelta(hours=3), late="10 hours")
    assert [(f, a) for f, _, a, _ in got] == [("a", "late"), ("a", "added"), ("a", "unchanged"), ("b", "added")]
    write(spark, f"{top}/in", [("c", "1", T + 30 * hour, False)])
    got = run(spark, top, keep=timedelta(hours=3), late="10 hours")
    write(spark, f"{top}/in", [("c", "1", T + 31 * hour, False)])
    got = run(spark, top, keep=timedelta(hours=3), late="10 hours")
    assert {(f, t) for f, t, a, _ in got if a == "expired"} == {("a", (T + 5 * hour).isoformat()), ("b", (T + 5 * hour).isoformat())}
    # a file that expired begins anew
    write(spark, f"{top}/in", [("a", "1", T + 32 * hour, False)])
    assert ("a", (T + 32 * hour).isoformat(), "added", "1") in run(spark, top, keep=timedelta(hours=3), late="10 hours")


def test_batch_of_nothing(spark):
    assert files.batch_actions(spark.createDataFrame([], files.CHANGE)).count() == 0
    one = spark.createDataFrame([("a", None, T, None), ("a", None, T + timedelta(1), None)], files.CHANGE)
    assert [r["action"] for r in files.batch_actions(one).orderBy("at").collect()] == ["added", "unchanged"]
    assert files.batch_actions(one.withColumn("at", F.lit(None).cast("timestamp"))).count() == 0
