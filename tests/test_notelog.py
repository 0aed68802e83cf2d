"""Notes as a log of changes."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from granary.operators import notelog
from granary.operators.tables import Catalog
from granary.plans.tools import MemoryTools


@pytest.fixture
def tools(spark, tmp_path):
    return MemoryTools(Catalog(spark, f"file://{tmp_path}/c"))


def contents(tools, **where):
    rows = tools.notes.current().where("is_active")
    return sorted(r["content"] for r in rows.collect() if all(r[k] == v for k, v in where.items()))


def test_a_life_of_notes(tools):
    ids = [tools.memory_add(f"note {i} about caches", agent_id="a").rsplit(" ", 1)[-1] for i in range(3)]
    tools.memory_add("another agent's", agent_id="b")
    cp = tools.memory_checkpoint("first", "why", "a").rsplit(" ", 1)[-1].rstrip(")")
    assert tools.memory_update(ids[0], content="note 0 changed") == f"Memory {ids[0]} updated." and tools.memory_delete(ids[1], "old").endswith("deleted.")
    tools.memory_add("later", agent_id="a")
    assert contents(tools, agent_id="a") == ["later", "note 0 changed", "note 2 about caches"]
    kept = {r["id"]: r for r in tools.notes.current().collect()}
    assert kept[ids[1]]["deleted_reason"] == "old" and kept[ids[0]]["updated_at"] is not None and kept[ids[0]]["embedding"] == tools.embedder.embed("note 0 changed")
    for _ in range(2):  # twice leaves one copy
        assert tools.memory_rollback(cp, "a") == f"Successfully rolled back to checkpoint {cp}"
        assert contents(tools, agent_id="a") == [f"note {i} about caches" for i in range(3)] and contents(tools, agent_id="b") == ["another agent's"]
    rows = tools.notes.current().where("restored_from is not null").collect()
    assert len(rows) == 3 and {r["restored_from"] for r in rows} == {cp} and not {r["id"] for r in rows} & set(ids)
    assert "first | why" in tools.memory_history("a") and tools.memory_history("b") == "No checkpoints found."
    assert tools.memory_update("00000000-0000-0000-0000-000000000000", content="x").endswith("not found.")


def test_adding_is_one_append_whatever_the_log_holds(spark, tools):
    """A note writes one file and reads none: its jobs and bytes do not follow the size of the log."""
    tools.memory_add("first")
    big = spark.range(20_000).selectExpr("uuid() as id", "'x' as agent_id", "'episodic' as memory_type", "repeat('text ', 20) as content", "true as is_active", "current_timestamp() as changed_at", "uuid() as change_id")
    names = [f.name for f in tools.notes.log().schema]
    tools.notes.append(big.select(*(F.col(c) if c in big.columns else F.lit(None).cast(tools.notes.log().schema[c].dataType).alias(c) for c in names)))
    tracker = spark.sparkContext.statusTracker()
    before, seen = set(tools.notes.log().inputFiles()), []
    spark.sparkContext.setJobGroup("one-note", "a note")
    try:
        tools.memory_add("second")
        seen = tracker.getJobIdsForGroup("one-note")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(set(tools.notes.log().inputFiles()) - before) == 1 and len(seen) <= 1
    assert tools.notes.current().count() == 20_002


def test_times_and_ties(spark):
    t = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [("a", "x", "one", True, t, "1"), ("a", "x", "two", True, t, "2"), ("a", "x", "three", False, t + timedelta(hours=2), "0"), ("b", "x", "four", True, t + timedelta(hours=1), "1"), (None, "x", "lost", True, t, "1"), ("b", "x", "four", True, t + timedelta(hours=1), "1")]
    df = spark.createDataFrame(rows, "id string, agent_id string, content string, is_active boolean, changed_at timestamp, change_id string")
    got = lambda at: sorted((r["id"], r["content"]) for r in notelog.as_of(df, F.lit(at) if at else None).collect())
    assert got(t) == [("a", "two")] and got(t + timedelta(hours=1)) == [("a", "two"), ("b", "four")] and got(None) == [("a", "three"), ("b", "four")] and got(t - timedelta(1)) == []
    spans = sorted((r["content"], r["valid_to"] is None) for r in notelog.intervals(df.where("id = 'a'")).collect())
    assert spans == [("one", False), ("three", True), ("two", False)] and notelog.as_of(df.where("false")).count() == 0
