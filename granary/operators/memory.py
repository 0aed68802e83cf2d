"""Agent memory: notes with soft deletes, checkpoints and rollback. Each function returns the table as it will be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import as_double, cosine, literal
from ..schemas import checked, conform, latest, row_hash
from .tables import stable_id

#: What a snapshot keeps of a note.
SNAPSHOT = "array<struct<id:string,agent_id:string,memory_type:string,content:string,context:string,keywords:array<string>,source_ref:string,embedding:array<double>>>"
_FIELDS = ("id", "agent_id", "memory_type", "content", "context", "keywords", "source_ref", "embedding")


def _once(rows: DataFrame) -> DataFrame:
    """One row for each id: the greatest hash of a row wins, whatever order the rows come in."""
    return latest(rows, ("id",), [row_hash(rows).desc()])


def insert(notes: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """Adds notes; memory types are checked, defaults filled, ids derived from agent, content and time where missing.

    An id has one row: a new note of a known id takes the old one's place, and of several new ones with one id one is added.
    """
    now = now if now is not None else F.current_timestamp()
    rows = conform(new, "memory_notes")
    rows = rows.withColumns({"agent_id": F.coalesce("agent_id", F.lit("default")), "created_at": F.coalesce("created_at", now), "usage_count": F.coalesce("usage_count", F.lit(0)), "is_active": F.coalesce("is_active", F.lit(True)), "keywords": F.coalesce("keywords", F.array().cast("array<string>"))})
    rows = rows.withColumn("id", F.coalesce("id", stable_id("agent_id", "memory_type", "content", F.col("created_at").cast("string"))))
    rows = _once(checked(rows, "memory_notes"))
    return conform(notes, "memory_notes").join(rows.select("id"), "id", "left_anti").select(*rows.columns).unionByName(rows)


def update(notes: DataFrame, patches: DataFrame, now: Column | None = None) -> DataFrame:
    """patches (id, content, keywords, embedding): the values that are not null replace those of the note. One patch an id counts."""
    now = now if now is not None else F.current_timestamp()
    names = [c for c in ("content", "keywords", "embedding") if c in patches.columns]
    p = _once(patches.select("id", *names)).select("id", *(F.col(c).alias(f"_{c}") for c in names), F.lit(True).alias("_hit"))
    both = notes.join(p, "id", "left")
    changed = F.coalesce(*(F.col(f"_{c}").isNotNull() for c in names), F.lit(False)) if len(names) == 1 else F.greatest(*(F.col(f"_{c}").isNotNull() for c in names))
    out = {c: F.coalesce(f"_{c}", c) for c in names}
    out["updated_at"] = F.when(F.col("_hit").isNotNull() & changed, now).otherwise(F.col("updated_at"))
    return both.withColumns(out).select(*notes.columns)


def soft_delete(notes: DataFrame, gone: DataFrame, reason: str = "Deleted by user", now: Column | None = None) -> DataFrame:
    """gone (id[, reason]): those notes become inactive with a reason; nothing is removed."""
    now = now if now is not None else F.current_timestamp()
    own = F.col("reason") if "reason" in gone.columns else F.lit(None).cast("string")
    g = gone.groupBy("id").agg(F.max(F.coalesce(own, F.lit(reason))).alias("_why"))
    both = notes.join(g, "id", "left")
    hit = F.col("_why").isNotNull()
    return both.withColumns({"is_active": F.when(hit, False).otherwise(F.col("is_active")), "deleted_reason": F.when(hit, F.col("_why")).otherwise(F.col("deleted_reason")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).select(*notes.columns)


def search(notes: DataFrame, query: list[float], agent_id: str = "default", limit: int = 10, min_similarity: float = 0.4, include_inactive: bool = False) -> DataFrame:
    """The agent's notes nearest to a vector, with `similarity`; ties by id."""
    rows = notes.where((F.col("agent_id") == agent_id) & F.col("embedding").isNotNull())
    rows = rows if include_inactive else rows.where("is_active")
    return rows.withColumn("similarity", cosine(as_double("embedding"), literal(query))).where(F.col("similarity") >= min_similarity).orderBy(F.desc("similarity"), "id").limit(limit)


def touch(notes: DataFrame, used: DataFrame, now: Column | None = None) -> DataFrame:
    """Counts a use of the notes in used (id)."""
    now = now if now is not None else F.current_timestamp()
    both = notes.join(used.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    hit = F.col("_hit").isNotNull()
    return both.withColumns({"usage_count": F.col("usage_count") + hit.cast("int"), "last_accessed": F.when(hit, now).otherwise(F.col("last_accessed"))}).select(*notes.columns)


def snapshot(notes: DataFrame) -> DataFrame:
    """(agent_id, memories, n): every agent's active notes as one JSON text, in order of id.

    A cell per agent is the published shape. For agents whose notes outgrow a cell, `checkpoint_rows` keeps rows instead.
    """
    rows = notes.where("is_active").groupBy("agent_id").agg(F.array_sort(F.collect_list(F.struct(*_FIELDS))).alias("m"))
    return rows.select("agent_id", F.to_json("m").alias("memories"), F.size("m").cast("long").alias("n"))


def checkpoint(checkpoints: DataFrame, notes: DataFrame, name: str, agent_id: str = "default", reason: str | None = None, now: Column | None = None) -> DataFrame:
    """Adds a checkpoint of the agent's active notes; an agent without any gets an empty one."""
    now = now if now is not None else F.current_timestamp()
    one = notes.sparkSession.range(1).select(F.lit(agent_id).alias("agent_id"))
    made = one.join(snapshot(notes.where(F.col("agent_id") == agent_id)), "agent_id", "left").select(
        stable_id(F.lit(name), "agent_id", now.cast("string")).alias("id"), F.lit(name).alias("checkpoint_name"), now.alias("created_at"), F.col("agent_id").alias("created_by"), F.lit(reason).cast("string").alias("reason"), F.coalesce("memories", F.lit("[]")).alias("memory_snapshot"), F.lit(True).alias("is_current")
    )
    others = conform(checkpoints, "memory_checkpoints").withColumn("is_current", F.col("is_current") & (F.col("created_by") != agent_id))
    return others.unionByName(conform(made, "memory_checkpoints"))


def checkpoint_rows(notes: DataFrame, checkpoint_id: str) -> DataFrame:
    """The active notes as rows of a snapshot, to be written under the checkpoint's partition."""
    return notes.where("is_active").select(F.lit(checkpoint_id).alias("checkpoint_id"), *_FIELDS)


def restored(kept: DataFrame, checkpoint_id: Column | str, now: Column | None = None) -> DataFrame:
    """Notes of a snapshot as new active notes that say where they came from; their ids follow from checkpoint and old id."""
    cp = F.lit(checkpoint_id) if isinstance(checkpoint_id, str) else checkpoint_id
    rows = kept.withColumn("restored_from", cp).withColumn("id", stable_id("restored_from", "id"))
    return conform(rows.withColumns({"is_active": F.lit(True), "usage_count": F.lit(0), "created_at": now if now is not None else F.current_timestamp()}), "memory_notes")


def rollback(notes: DataFrame, kept: DataFrame, checkpoint_id: str, name: str, agent_id: str = "default", now: Column | None = None) -> DataFrame:
    """All the agent's active notes become inactive, those of the snapshot come back as new rows.

    Rolling back twice to one checkpoint leaves one active copy: restored rows have ids of their own, so a row that was
    restored before is brought back to life instead of added again.
    """
    hit = (F.col("agent_id") == agent_id) & F.col("is_active")
    why = F.concat(F.lit("Rolled back to checkpoint: "), F.lit(name))
    old = conform(notes, "memory_notes").withColumns({"deleted_reason": F.when(hit, why).otherwise(F.col("deleted_reason")), "is_active": F.col("is_active") & ~hit})
    new = restored(kept, checkpoint_id, now)
    return old.join(new.select("id"), "id", "left_anti").select(*new.columns).unionByName(new)


def snapshot_rows(checkpoints: DataFrame, checkpoint_id: str) -> DataFrame:
    """The notes in a checkpoint's JSON."""
    return checkpoints.where(F.col("id") == checkpoint_id).select(F.inline(F.from_json("memory_snapshot", SNAPSHOT)))


def history(checkpoints: DataFrame, agent_id: str = "default", limit: int = 20) -> DataFrame:
    return checkpoints.where(F.col("created_by") == agent_id).orderBy(F.desc("created_at"), "id").limit(limit)
