"""File states over a stream of changes: what became of each file, with late, repeated and deleted ones told apart, and expiry.

The state of a file is its newest hash, when it was seen and whether it is there. It is kept by Spark's state store under the
query's checkpoint, so a stream that is stopped and started again goes on where it was. `batch_actions` is the same over a
whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that stateful processors need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

CHANGE = "source_file string, content_hash string, at timestamp, deleted boolean"
ACTION = "source_file string, action string, content_hash string, at timestamp"


class FileStates(StatefulProcessor):
    """added, changed, unchanged, deleted, gone (deleted twice, or never there), late (not after what was seen) and, with `keep`, expired."""

    def __init__(self, keep: timedelta | None = None) -> None:
        self.keep = None if keep is None else keep // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "content_hash string, us long, there boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.seen.get() if self.seen.exists() else None
        was, last, there = old if old is not None else (None, None, False)
        # a batch's rows come in any order; of equal times the smaller hash first, deletions last
        for r in sorted(rows, key=lambda r: (r["us"], bool(r["deleted"]), r["content_hash"] or "")):
            if last is not None and r["us"] < last:
                yield self._row(key, "late", r["content_hash"], r["us"])
                continue
            if r["deleted"]:
                action = "deleted" if there else "gone"
            else:
                action = "added" if not there else "unchanged" if r["content_hash"] == was else "changed"
                was = r["content_hash"]
            there, last = not r["deleted"], r["us"]
            yield self._row(key, action, r["content_hash"], r["us"])
        if last is None:
            return
        self.seen.update((was, last, there))
        if self.keep is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer((last + self.keep) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.seen.exists():
            was, last, there = self.seen.get()
            self.seen.clear()
            if there:
                yield self._row(key, "expired", was, last + self.keep)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, action: str, content_hash: str | None, us: int) -> Row:
        return Row(source_file=key[0], action=action, content_hash=content_hash, us=us)


def actions(changes: DataFrame, keep: timedelta | None = None, late: str = "0 seconds") -> DataFrame:
    """A stream (columns of ACTION) of what each change of a stream (columns of CHANGE) does; rows without a file or a time are left out.

    keep: a file that is not seen for so long, by event time, expires; timers need `late`, how far behind rows may be. The
    session must have the settings of STORE while the query starts.
    """
    # whole numbers of microseconds, which are the same in every time zone
    rows = changes.where("source_file is not null and at is not null").withColumn("us", F.unix_micros(F.col("at")))
    if keep is not None:
        rows = rows.withWatermark("at", late)
    out = rows.groupBy("source_file").transformWithState(FileStates(keep), "source_file string, action string, content_hash string, us long", "append", "eventTime" if keep is not None else "none")
    return out.select("source_file", "action", "content_hash", F.timestamp_micros("us").alias("at"))


def batch_actions(changes: DataFrame) -> DataFrame:
    """The actions of all changes in order of time: what a stream of them in that order gives, whatever its batches."""
    rows = changes.where("source_file is not null and at is not null").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    w = Window.partitionBy("source_file").orderBy("at", "deleted", F.coalesce("content_hash", F.lit("")))
    there = F.coalesce(~F.lag("deleted").over(w), F.lit(False))
    # the hash of the newest row that was no deletion
    was = F.last(F.when(~F.col("deleted"), F.struct("content_hash")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))["content_hash"]
    action = F.when(F.col("deleted"), F.when(there, "deleted").otherwise("gone")).when(~there, "added").when(was.eqNullSafe(F.col("content_hash")), "unchanged").otherwise("changed")
    return rows.select("source_file", action.alias("action"), "content_hash", "at")
