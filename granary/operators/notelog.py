"""Agent memory as a log of changes: a change is a row, appended; what holds at a time is the newest change of each note by then.

A row has a whole note as it is from `changed_at` on, so a note's changes are intervals: each is valid until the next. Adding
is one append, whatever the log holds. A checkpoint is a row with a time, not a copy: what it kept is the log as of that
time. Rolling back closes the notes that are active now and opens those that were active then, as one append.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import TABLES, conform, schema
from .tables import stable_id

NOTE = TABLES["memory_notes"]
LOG = f"{NOTE}, changed_at timestamp, change_id string"
CHECKPOINT = "id string, checkpoint_name string, created_at timestamp, created_by string, reason string"


# --- on tables of changes -------------------------------------------------------------------------------------------


def as_of(log: DataFrame, at: Column | None = None) -> DataFrame:
    """Notes as they were at a time, now without one: the newest change of each by then; of two at one time the greater change_id.

    The newest is taken in each task first, so a note that changes often is no task's burden.
    """
    rows = log if at is None else log.where(F.col("changed_at") <= at)
    names = [c for c in log.columns if c not in ("changed_at", "change_id")]
    newest = F.max_by(F.struct(*names), F.struct("changed_at", "change_id")).alias("n")
    return rows.where("id is not null").groupBy("id").agg(newest).select("n.*")


def intervals(log: DataFrame) -> DataFrame:
    """log with valid_from and valid_to: each change holds until the next of its note, the last one without end."""
    w = Window.partitionBy("id").orderBy("changed_at", "change_id")
    return log.where("id is not null").select("*", F.col("changed_at").alias("valid_from"), F.lead("changed_at").over(w).alias("valid_to"))


def rolled_back(log: DataFrame, at: Column, checkpoint_id: str, name: str, agent_id: str, now: Column) -> DataFrame:
    """The changes that bring an agent's memory back to what it was: closing rows for its active notes, and the notes of then as new ones.

    A restored note's id follows from the checkpoint and its old id: going back to one checkpoint twice leaves one active copy.
    """
    own = F.col("agent_id") == agent_id
    why = f"Rolled back to checkpoint: {name}"
    closed = as_of(log.where(own)).where("is_active").withColumns({"is_active": F.lit(False), "deleted_reason": F.lit(why), "updated_at": now})
    then = as_of(log.where(own), at).where("is_active").withColumn("restored_from", F.lit(checkpoint_id))
    then = then.withColumn("id", stable_id("restored_from", "id")).withColumns({"created_at": now, "usage_count": F.lit(0), "deleted_reason": F.lit(None).cast("string")})
    # a copy that is active already is closed and opened again at one time: only the opening is written
    closed = closed.join(then.select("id"), "id", "left_anti")
    both = conform(closed, "memory_notes").unionByName(conform(then, "memory_notes"))
    return both.withColumns({"changed_at": now, "change_id": stable_id(F.lit(checkpoint_id), now.cast("string"), "id")})


# --- a log in a folder ----------------------------------------------------------------------------------------------


class NoteLog:
    """`<root>/notes` and `<root>/checkpoints`: Parquet folders that Spark appends to."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, ddl: str) -> DataFrame:
        try:
            return self.spark.read.schema(ddl).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ddl)

    def log(self) -> DataFrame:
        return self._read("notes", LOG)

    def checkpoints(self) -> DataFrame:
        return self._read("checkpoints", CHECKPOINT)

    def current(self) -> DataFrame:
        return as_of(self.log())

    def append(self, changes: DataFrame) -> None:
        """Changes (columns of LOG) as they are."""
        changes.write.mode("append").parquet(f"{self.root}/notes")

    def _one(self, row: dict, now: datetime) -> None:
        names = [f.name for f in schema("memory_notes")]
        self.append(self.spark.createDataFrame([(*(row.get(c) for c in names), now, str(uuid.uuid4()))], LOG).coalesce(1))

    def add(self, content: str, memory_type: str, context: str | None, keywords: list[str], agent_id: str, embedding: list[float]) -> str:
        """One append; the id is made here."""
        now, made = datetime.now(timezone.utc), str(uuid.uuid4())
        self._one({"id": made, "agent_id": agent_id, "memory_type": memory_type, "content": content, "context": context, "keywords": keywords, "embedding": embedding, "usage_count": 0, "created_at": now, "is_active": True}, now)
        return made

    def change(self, id: str, values: dict) -> bool:
        """A note with some values replaced, those that are None as they were; whether there is such a note."""
        old = as_of(self.log().where(F.col("id") == id)).first()
        if old is None:
            return False
        now = datetime.now(timezone.utc)
        self._one(old.asDict() | {k: v for k, v in values.items() if v is not None} | {"updated_at": now}, now)
        return True

    def checkpoint(self, name: str, reason: str | None, agent_id: str) -> str:
        made = str(uuid.uuid4())
        self.spark.createDataFrame([(made, name, datetime.now(timezone.utc), agent_id, reason)], CHECKPOINT).coalesce(1).write.mode("append").parquet(f"{self.root}/checkpoints")
        return made

    def rollback(self, checkpoint_id: str, agent_id: str) -> bool:
        row = self.checkpoints().where(F.col("id") == checkpoint_id).first()
        if row is None:
            return False
        now = F.lit(datetime.now(timezone.utc))
        self.append(rolled_back(self.log(), F.lit(row["created_at"].astimezone(timezone.utc)), checkpoint_id, row["checkpoint_name"], agent_id, now))
        return True
