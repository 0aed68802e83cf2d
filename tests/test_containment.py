"""Containment by bitmaps against a scan."""

import json
import random

import pytest
from pyspark.sql import functions as F

from granary.operators import containment as C


def made(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 5)
    if kind == 5:
        return {k: made(rng, depth + 1) for k in rng.sample("abcd", rng.randrange(0, 4))}
    if kind == 6:
        return [made(rng, depth + 1) for _ in range(rng.randrange(0, 4))]
    return [None, True, rng.randrange(3), rng.choice([1.0, 1.5]), rng.choice(["x", "1", "true", "ü.\"x"])][kind]


def test_contains_as_defined():
    yes = [({"a": 1, "b": 2}, {"a": 1}), ({"a": {"b": [1, 2, {"c": 3}]}}, {"a": {"b": [{"c": 3}, 1]}}), ([1, 2], []), ({"a": None}, {"a": None}), ({"a": 1}, {"a": 1.0}), ({}, {}), ([[1, 2]], [[2]])]
    no = [({"a": 1}, {"a": "1"}), ({"a": True}, {"a": 1}), ({"a": 1}, {"a": True}), ({}, {"a": None}), ([1, 2], [1, 3]), ([1], {}), ({"a": [1]}, {"a": 1}), (None, {}), ({"a": {"b": 1}}, {"b": 1})]
    assert all(C.contains(a, b) and C.keys_of(b) <= C.keys_of(a) for a, b in yes) and not any(C.contains(a, b) for a, b in no)
    rng = random.Random(2)
    for _ in range(20_000):
        a, b = made(rng), made(rng)
        if C.contains(a, b):
            assert C.keys_of(b) <= C.keys_of(a)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Rows over three chunks, a key that nearly all have, broken and null texts, repeated and negative ids."""
    rng = random.Random(3)
    rows = [(i * 37 - 200, json.dumps({"all": 1, "v": made(rng), "t": rng.sample(["p", "q", "r"], rng.randrange(3))} if i % 50 else made(rng))) for i in range(2500)]
    rows += [(90_000, None), (90_001, "{broken"), (90_002, ""), (None, '{"all": 1}'), (90_003, "[1, [2]]"), (90_003, "[1, [2]]"), (90_004, "null"), (90_005, '"x"')]
    df = spark.createDataFrame(rows, "id long, doc string").withColumns({"key": F.lit(1), "chunk": F.lit(1), "bits": F.lit("x"), "at": F.lit(1), "bucket": F.lit(1)})
    path = f"file://{tmp_path_factory.mktemp('bits')}/i"
    C.build(df, path, "id", "doc", few=100)
    return df, path


WANTED = [[{"all": 1}], [{"all": 1, "t": ["p"]}], [{"v": {"a": 1}}, {"t": ["q", "r"]}], [{"v": None}], [[[2]]], [{"v": [True]}], [{"v": {}}], ["x"], [None], [{"nosuch": 1}], [{"all": 1.0, "v": "1"}], [], [{"v": []}, {"all": 2}], [{"all": "1"}]]


@pytest.mark.parametrize("wanted", WANTED, ids=json.dumps)
def test_as_a_scan(spark, table, wanted):
    df, path = table
    got = sorted((r["id"], r["doc"]) for r in C.json_matches(df, path, wanted, "id", "doc").collect())
    want = []
    for r in df.where("id is not null").collect():
        ok, v = C._parsed(r["doc"])
        if ok and any(C.contains(v, w) for w in wanted):
            want.append((r["id"], r["doc"]))
    if wanted and not all(map(C.keys_of, wanted)):  # nothing to look up: rows without an id are checked too
        got = [x for x in got if x[0] is not None]
    assert sorted(got) == sorted(want)


def test_forms_and_folders(spark, table):
    df, path = table
    index = spark.read.parquet(path)
    assert index.where("bits is not null and n <= 100 or bits is null and n > 100").count() == 0 < index.where("bits is not null").count()
    one = index.where("bits is not null").first()
    held = spark.createDataFrame([(i,) for i in range(100)], "at int").agg(F.bitmap_construct_agg("at").alias("b"))
    assert held.select(C._places(F.col("b")).alias("p")).first()["p"] == list(range(100))
    assert len(spark.createDataFrame([(bytes(one["bits"]),)], "b binary").select(C._places(F.col("b")).alias("p")).first()["p"]) == one["n"]
    key = C._key('."all"', 1)
    assert {r["bucket"] for r in C._read(spark, path, [key]).select(F.regexp_extract(F.input_file_name(), r"bucket=(\d+)", 1).cast("int").alias("bucket")).collect()} == {key % C.BUCKETS}


def test_members(spark, tmp_path):
    rows = [(i, [w for w in ("red", "green", "blü", None) if (i * 7 + len(w or "")) % 3 == 0]) for i in range(3000)] + [(9000, None), (9001, []), (9002, ["red", "red"])]
    df = spark.createDataFrame(rows, "n int, tags array<string>")
    C.build(df, f"file://{tmp_path}/m", "n", "tags")
    for words in (["red"], ["red", "blü"], ["nosuch"], []):
        want = sorted(i for i, t in rows if set(t or []) & set(words))
        assert sorted(r["n"] for r in C.member_matches(df, f"file://{tmp_path}/m", words, "n", "tags").collect()) == want
    C.build(df.where("false"), f"file://{tmp_path}/e", "n", "tags")
    assert C.member_matches(df.where("false"), f"file://{tmp_path}/e", ["red"], "n", "tags").count() == 0
