"""The Spark session and the settings that results depend on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: UTC timestamps, later keys win in merged maps, plans adapted at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; `master` only where no cluster manager has set one."""
    builder = SparkSession.builder.appName("granary").config(map=SETTINGS | more)
    return prepare((builder.master(master) if master else builder).getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Sets what may be set in a session that someone else made, and lets Python workers import this package."""
    for k in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy"):
        if spark.conf.get(k) != SETTINGS[k]:
            spark.conf.set(k, SETTINGS[k])
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, by spark.checkpoint.dir; one of our own only where a local session names none, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="granary-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
        sc.setCheckpointDir(named)
    return named
