"""What the operators of this subpackage share: tables, checkpoints and connected components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Edges that one task reads at a step; links up to which `merged` joins components on the driver.
EDGES, FEW = 1 << 18, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where the driver found it by its working folder alone."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where a local session names none, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="granary-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
        sc.setCheckpointDir(named)
    return named


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table that was written in the shared folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: it survives lost executors and ends the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(key: str, n: int):
    """crc32 of the key as text, modulo n; null where the key is null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(n)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ids in edges (a, b); component is the smallest id reachable.

    Alternating large-star and small-star steps until every id has one edge, to an id that has none of its own. Each step's
    minimum is a partial aggregate and each join is one that Spark can split when a hub is hot; no component meets in one task.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while (left := _unsettled(e))[0]:
        e = e.coalesce(-(-left[1] // EDGES))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = cut(small.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    e = e.coalesce(max(1, -(-left[1] // EDGES)))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _unsettled(e: DataFrame) -> tuple[int, int]:
    """How many ids of edges (u, v) have more than one v, or one and are a v themselves; and how many edges there are."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    ids = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return tuple(ids.agg(F.count_if(F.expr("out > 1 or out = 1 and into = 1")), F.coalesce(F.sum("out"), F.lit(0))).first())


def merged(known: DataFrame, links: DataFrame, few: int = FEW) -> DataFrame:
    """known (id, component) after links (a, b) have come: (id, component) of all ids in both. links are read several times.

    Only the components that the links join are gone through, not their members: up to `few` links on the driver, more by
    the steps of components.
    """
    n = links.count()
    if n == 0:
        return known
    if n > few:
        name = lambda end: known.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))
        met = links.join(name("a"), "a", "left").join(name("b"), "b", "left")
        roots = components(met.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))).select("id", F.col("component").alias("root"))
        moved = known.join(roots.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
        return moved.unionByName(roots.join(known, "id", "left_anti").select("id", F.col("root").alias("component")))
    pairs = [(r["a"], r["b"]) for r in links.select("a", "b").collect()]
    spark, ends = known.sparkSession, sorted({i for p in pairs for i in p})
    found = known.join(F.broadcast(spark.createDataFrame([(i,) for i in ends], "id long")), "id").select("id", "component")
    of = {i: i for i in ends} | {r["id"]: r["component"] for r in found.collect()}
    up = {c: c for c in of.values()}

    def top(c: int) -> int:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    for a, b in pairs:
        a, b = sorted((top(of[a]), top(of[b])))
        up[b] = a
    roots = F.broadcast(spark.createDataFrame([(c, top(c)) for c in up], "component long, root long"))
    moved = known.join(roots, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    alone = spark.createDataFrame([(i, top(of[i])) for i in ends], "id long, component long")
    return moved.join(F.broadcast(alone.select("id")), "id", "left_anti").unionByName(alone)
