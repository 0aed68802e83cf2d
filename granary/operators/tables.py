"""Writing: upsert, patch and delete as DataFrame transformations, and a versioned Parquet catalog that keeps the results.

A transformation takes the table as it is and returns it as it will be. The catalog keeps a table's rows in buckets by hash
and a log of versions, each of which names the folder of every bucket. `merge` reads and writes the buckets that the changed
rows fall into and takes over the others: a small change costs a bucket, which is the table's share of their fixed number and
grows with it. Notes, which come one by one, are kept as a log of changes instead (`notelog`). A version's log entry is
put in place by a rename that fails where the number is taken: readers see whole versions only, and of two writers that
started from one version the second starts again from the first one's.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import KEYS, conform, empty, latest, row_hash, schema


def upsert(existing: DataFrame, new: DataFrame, keys: tuple[str, ...], keep: tuple[str, ...] = (), order: Column | None = None) -> DataFrame:
    """existing with the rows of new in place of those of equal keys; `keep` names columns whose old value stays.

    Where new holds a key more than once, the first by `order` (greatest hash without one) wins. Columns are matched by
    name. One shuffle of either side by the keys; the same key has one row after it.
    """
    order = order if order is not None else row_hash(new).desc()
    new = latest(new, keys, [order])
    if keep:
        old = existing.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in keep))
        new = new.join(old, list(keys), "left").withColumns({c: F.coalesce(f"_old_{c}", c) for c in keep}).select(*existing.columns)
    rest = existing.join(new.select(*keys), list(keys), "left_anti")
    return rest.unionByName(new)


def patch(existing: DataFrame, patches: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """existing with the non-null values of patches (key, columns) put in; rows without a patch are as they were.

    Of several patches of a key one counts, the greatest hash of a row.
    """
    one = latest(patches.select(key, *columns), (key,), [row_hash(patches, (key, *columns)).desc()])
    p = one.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in columns))
    both = existing.join(p, key, "left")
    return both.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*existing.columns)


def delete_where(existing: DataFrame, condition: Column) -> tuple[DataFrame, Column]:
    """What is left, and the aggregate that counts what goes (to be taken over `existing`)."""
    hit = F.coalesce(condition, F.lit(False))
    return existing.where(~hit), F.count_if(hit)


def stable_id(*parts: Column | str) -> Column:
    """An id that is a function of the natural key: the same however often the plan is evaluated."""
    h = F.sha2(F.concat_ws("\u0001", *parts), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def upsert_chunks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """By (source_file, chunk_index): content, header path, vector, metadata and hash are replaced, id and created_at stay."""
    rows = conform(new, "semantic_chunks").withColumn("id", F.coalesce("id", stable_id("source_file", "chunk_index")))
    return upsert(conform(existing, "semantic_chunks"), rows, KEYS["semantic_chunks"], keep=("id", "created_at"))


def replace_file_chunks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The files of new have its chunks and no others: chunks that a shrunken file no longer has go."""
    files = new.select("source_file").distinct()
    old = existing.join(files, "source_file", "left_anti")
    kept = existing.join(files, "source_file", "left_semi").join(new.select("source_file", "chunk_index"), ["source_file", "chunk_index"], "left_semi")
    return upsert_chunks(old.unionByName(kept), new)


class Conflict(RuntimeError):
    """Another writer has made the version that this one wanted to make."""


#: Table -> columns whose hash says in which bucket a row is; the key elsewhere.
BUCKET_BY = {"semantic_chunks": ("source_file",), "graph_nodes": ("project_id",), "graph_edges": ("project_id",)}


class Catalog:
    """Named tables under a root folder (any file system of Hadoop).

    `<root>/<table>/_log/<n>` is version n: JSON {buckets, parts: {bucket: folder}}; the folders beside it hold the rows.
    buckets: of tables that are written anew; a table keeps its number until `write` replaces it.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda *p: jvm.org.apache.hadoop.fs.Path("/".join([self.root, *p]))
        self._fs = self._path().getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), conf)
        self._jvm = jvm

    def bootstrap(self) -> None:
        """Creates the tables that are missing, and the first checkpoint."""
        from ..schemas import TABLES

        for t in TABLES:
            if self.version(t) is None:
                self.write(t, empty(self.spark, t))
        first = self.spark.range(1).select(stable_id(F.lit("system-init")).alias("id"), F.lit("system-init").alias("checkpoint_name"), F.lit("SYSTEM").alias("created_by"), F.lit("Initial system state").alias("reason"), F.lit("[]").alias("memory_snapshot"), F.lit(True).alias("is_current"))
        if self.read("memory_checkpoints").limit(1).isEmpty():
            self.write("memory_checkpoints", first)

    def version(self, table: str) -> int | None:
        """The number of the newest version."""
        p = self._path(table, "_log")
        if not self._fs.exists(p):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(p)]
        return max((int(n) for n in names if n.isdigit()), default=None)

    def _state(self, table: str, version: int | None) -> dict:
        if version is None:
            return {"buckets": self.buckets, "parts": {}}
        f = self._fs.open(self._path(table, "_log", str(version)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8"))
        finally:
            f.close()

    def _commit(self, table: str, version: int | None, state: dict) -> int:
        """Makes the version after `version`; Conflict if there is one already."""
        new = 0 if version is None else version + 1
        log, temp = self._path(table, "_log", str(new)), self._path(table, "_log", f"_{uuid.uuid4().hex}")
        out = self._fs.create(temp, False)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        fs = self._jvm.org.apache.hadoop.fs
        kind = getattr(fs, "Options$Rename")
        plain = self.spark.sparkContext._gateway.new_array(kind, 1)
        plain[0] = kind.NONE
        try:
            self._files.rename(temp, log, plain)
        except Exception as e:
            self._fs.delete(temp, False)
            if self._fs.exists(log):
                raise Conflict(f"{table} has a version {new} already") from e
            raise
        return new

    def _bucket(self, table: str, n: int) -> Column:
        return F.pmod(F.xxhash64(*BUCKET_BY.get(table, KEYS[table])), F.lit(n)).cast("int")

    def _rows(self, table: str, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(schema(table)).parquet(*(f"{self.root}/{table}/{p}" for p in parts)) if parts else empty(self.spark, table)

    def _store(self, table: str, df: DataFrame, n: int) -> dict[str, str]:
        """Writes rows by bucket into a new folder; the folders that came to be. A bucket is written by several tasks if it is large."""
        folder = f"d{uuid.uuid4().hex}"
        rows = conform(df, table).withColumn("_bucket", self._bucket(table, n))
        spread = F.pmod(F.xxhash64(*KEYS[table]), F.lit(8))
        rows.repartition("_bucket", spread).write.partitionBy("_bucket").parquet(f"{self.root}/{table}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(table, folder)) if s.isDirectory()]
        return {x.removeprefix("_bucket="): f"{folder}/{x}" for x in names if x.startswith("_bucket=")}

    def read(self, table: str) -> DataFrame:
        return self._rows(table, list(self._state(table, self.version(table))["parts"].values()))

    def write(self, table: str, df: DataFrame) -> int:
        """Replaces the table whatever it holds by now; returns the version."""
        parts = self._store(table, df, self.buckets)
        while True:
            try:
                return self._commit(table, self.version(table), {"buckets": self.buckets, "parts": parts})
            except Conflict:
                continue

    def update(self, table: str, change: Callable[[DataFrame], DataFrame], tries: int = 20) -> int:
        """The whole table as `change` makes it from the newest version; once more if another writer was faster."""
        for _ in range(tries):
            now = self.version(table)
            state = self._state(table, now)
            parts = self._store(table, change(self._rows(table, list(state["parts"].values()))), state["buckets"])
            try:
                return self._commit(table, now, state | {"parts": parts})
            except Conflict:
                continue
        raise Conflict(f"{table}: {tries} writers were faster")

    def merge(self, table: str, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], tries: int = 20) -> int:
        """`change(old, rows)` in the buckets that rows (with the bucket columns at least) fall into; the others are taken over.

        change gets the old rows of these buckets and returns them as they will be, in the same buckets. rows are evaluated
        more than once: they must be the same each time.
        """
        for _ in range(tries):
            now = self.version(table)
            state = self._state(table, now)
            hit = {str(r[0]) for r in rows.select(self._bucket(table, state["buckets"])).distinct().collect()}  # buckets at most
            if not hit:
                return now if now is not None else self._commit(table, now, state)
            old = self._rows(table, [p for b, p in state["parts"].items() if b in hit])
            parts = self._store(table, change(old, rows), state["buckets"])
            try:
                return self._commit(table, now, state | {"parts": {b: p for b, p in state["parts"].items() if b not in hit} | parts})
            except Conflict:
                continue
        raise Conflict(f"{table}: {tries} writers were faster")

    def vacuum(self, table: str) -> int:
        """Deletes the folders and log entries that the newest version doesn't need; returns how many folders went. No writer may be at work."""
        now = self.version(table)
        used, n = {p.split("/")[0]: set() for p in self._state(table, now)["parts"].values()}, 0
        for p in self._state(table, now)["parts"].values():
            used[p.split("/")[0]].add(p.split("/")[1])
        for s in self._fs.listStatus(self._path(table)):
            name = s.getPath().getName()
            if name == "_log":
                for x in self._fs.listStatus(s.getPath()):
                    if x.getPath().getName() != str(now):
                        self._fs.delete(x.getPath(), False)
            elif name not in used:
                self._fs.delete(s.getPath(), True)
                n += 1
            else:
                for x in self._fs.listStatus(s.getPath()):
                    if x.isDirectory() and x.getPath().getName() not in used[name]:
                        self._fs.delete(x.getPath(), True)
                        n += 1
        return n

    def clear(self, table: str, confirm: bool = False) -> None:
        if not confirm:
            raise ValueError("confirm=True is needed to clear a table")
        self.write(table, empty(self.spark, table))
