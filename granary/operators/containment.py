"""Containment over JSON documents and array members, by an index of bitmaps.

A row's keys are hashes of the paths and values in its JSON (array places left out of the path) or of its array's members. The
index has a row for each key and chunk of CHUNK row ids: a bitmap of the rows that have the key, or their places where they
are few. It lies in folders by key, so a question reads the folders of its own keys. Keys that must all be there are met by
`and`, alternatives by `or`, on bitmaps; the rows that are left are then checked, so hashes cannot add any.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType

#: Row ids of a bitmap (as many as its functions take); rows below which places are kept instead; folders.
CHUNK, FEW, BUCKETS = 32_768, 512, 32


# --- what a document has --------------------------------------------------------------------------------------------


def _key(path: str, value: object) -> int:
    """A signed hash of a path and a scalar; numbers are equal by value, whatever their form."""
    if isinstance(value, bool) or value is None:
        text = json.dumps(value)
    elif isinstance(value, (int, float)):
        text = f"n{float(value)!r}" if abs(value) < 2**1000 else f"n{value}"
    else:
        text = f"s{value}"
    b = f"{path}\x00{text}".encode("utf-8", "surrogatepass")
    return (zlib.crc32(b) << 32 | zlib.crc32(b[::-1])) - (1 << 63)


def keys_of(value: object, path: str = "") -> set[int]:
    """Keys of all scalars of a JSON value, in objects and arrays of any depth."""
    out, todo = set(), [(path, value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{at}.{json.dumps(k)}", x) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(f"{at}[]", x) for x in v]
        else:
            out.add(_key(at, v))
    return out


def contains(have: object, wanted: object) -> bool:
    """Whether a JSON value contains another: objects by members, arrays by elements in any order, scalars by equality, null by null."""
    if isinstance(wanted, dict):
        return isinstance(have, dict) and all(k in have and contains(have[k], v) for k, v in wanted.items())
    if isinstance(wanted, list):
        return isinstance(have, list) and all(any(contains(h, w) for h in have) for w in wanted)
    if isinstance(wanted, bool) or isinstance(have, bool):
        return have is wanted
    return not isinstance(have, (dict, list)) and have == wanted


def _parsed(text: str | None) -> tuple[bool, object]:
    try:
        return text is not None, json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return False, None


@F.arrow_udf(ArrayType(LongType()))
def _json_keys(c: pa.Array) -> pa.Array:
    return pa.array([sorted(keys_of(v)) if ok else [] for ok, v in map(_parsed, c.to_pylist())], pa.list_(pa.int64()))


@F.arrow_udf(ArrayType(LongType()))
def _member_keys(c: pa.Array) -> pa.Array:
    return pa.array([sorted({_key("[]", x) for x in m or []}) for m in c.to_pylist()], pa.list_(pa.int64()))


def json_contains(column: Column | str, wanted: object) -> Column:
    """`contains` for a column of JSON texts; null and broken ones contain nothing. The scan that the index replaces."""

    @F.arrow_udf(BooleanType())
    def check(c: pa.Array) -> pa.Array:
        return pa.array([ok and contains(v, wanted) for ok, v in map(_parsed, c.to_pylist())], pa.bool_())

    return check(F.col(column) if isinstance(column, str) else column)


# --- the index ------------------------------------------------------------------------------------------------------


def build(rows: DataFrame, path: str, id: str, column: str, few: int = FEW, mode: str = "error") -> None:
    """Writes the index of a column (JSON texts, or arrays of texts) of rows whose id is a whole number.

    Rows are gathered by (key, chunk), CHUNK ids at most, after a distinct in each task. A null id is in no bitmap.
    """
    made = _member_keys if isinstance(rows.schema[column].dataType, ArrayType) else _json_keys
    n = F.col("id").cast("long")
    flat = rows.select(F.col(id).alias("id"), F.explode(made(F.col(column))).alias("key")).where("id is not null")
    flat = flat.select("key", F.expr(f"floor(id / {CHUNK}D)").cast("long").alias("chunk"), F.pmod(n, F.lit(CHUNK)).cast("int").alias("at"))
    sets = flat.groupBy("key", "chunk").agg(F.array_sort(F.collect_set("at")).alias("places"))
    bucket = F.pmod("key", F.lit(BUCKETS)).cast("int").alias("bucket")
    many = F.size("places") > few
    out = sets.select("key", "chunk", F.size("places").alias("n"), F.when(~many, F.col("places")).alias("places"), F.when(many, _bitmap(F.col("places"))).alias("bits"), bucket)
    out.repartition("bucket", F.pmod("chunk", F.lit(16))).sortWithinPartitions("bucket", "key", "chunk").write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)


@F.arrow_udf(BinaryType())
def _packed(c: pa.Array) -> pa.Array:
    out = []
    for places in c:
        bits = np.zeros(CHUNK, bool)
        bits[places.values.to_numpy()] = True
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return pa.array(out, pa.binary())


def _bitmap(places: Column) -> Column:
    """The bitmap of an array of places, in the layout of the engine's bitmap functions."""
    return _packed(F.coalesce(places, F.array().cast("array<int>")))


@F.arrow_udf(ArrayType(IntegerType()))
def _places(c: pa.Array) -> pa.Array:
    return pa.array([np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")).astype(np.int32) for b in c.to_pylist()], pa.list_(pa.int32()))


def _read(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(key, chunk, bits) of some keys."""
    index = spark.read.schema("key long, chunk long, n int, places array<int>, bits binary, bucket int").parquet(path)
    own = index.where(F.col("bucket").isin(sorted({k % BUCKETS for k in keys})) & F.col("key").isin(keys))
    return own.select("key", "chunk", F.coalesce("bits", _bitmap(F.col("places"))).alias("bits"))


def candidates(spark: SparkSession, path: str, alternatives: list[list[int]]) -> DataFrame:
    """(id) of rows that have all keys of one of the alternatives."""
    every = sorted({k for a in alternatives for k in a})
    own = _read(spark, path, every)
    parts = []
    for a in alternatives:
        met = own.where(F.col("key").isin(a)).groupBy("chunk").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits"))
        parts.append(met.where(F.col("n") == len(set(a))).select("chunk", "bits"))
    both = reduce(DataFrame.unionByName, parts)
    met = both.groupBy("chunk").agg(F.bitmap_or_agg("bits").alias("bits")) if len(parts) > 1 else both
    return met.select("chunk", F.explode(_places(F.col("bits"))).alias("at")).select((F.col("chunk") * CHUNK + F.col("at")).alias("id"))


def json_matches(rows: DataFrame, path: str, wanted: list[object], id: str, column: str) -> DataFrame:
    """The rows whose JSON contains one of `wanted`, found by the index and then checked.

    What holds no scalar (an empty object or array) has no key: then all rows are checked.
    """
    alternatives = [sorted(keys_of(w)) for w in wanted]
    check = reduce(lambda a, b: a | b, (json_contains(column, w) for w in wanted), F.lit(False))
    if not wanted:
        return rows.where("false")
    if all(alternatives):
        rows = rows.join(candidates(rows.sparkSession, path, alternatives).withColumnRenamed("id", "_hit"), F.col(id) == F.col("_hit"), "left_semi")
    return rows.where(check)


def member_matches(rows: DataFrame, path: str, any_of: list[str], id: str, column: str) -> DataFrame:
    """The rows whose array has one of some members, found by the index and then checked."""
    if not any_of:
        return rows.where("false")
    found = candidates(rows.sparkSession, path, [[_key("[]", x)] for x in any_of]).withColumnRenamed("id", "_hit")
    hit = rows.join(found, F.col(id) == F.col("_hit"), "left_semi")
    return hit.where(F.arrays_overlap(column, F.array(*map(F.lit, any_of))))
