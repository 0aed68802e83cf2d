"""Expressions that a column holds: what they require, and that they meet what each would match alone."""

import contextlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from granary.functions.literals import START, required
from granary.operators.errors import match_messages


def test_required_trigrams():
    grams = lambda *ts: sorted({t[i : i + 3] for t in ts for i in range(len(t) - 2)})
    assert required("red .*") == [grams(START + "red ")]
    assert required(".*cannot open (file|socket) .+") == [grams("cannot open file "), grams("cannot open socket ")]
    assert required("(abc)+def") == [grams("abc", "def")] and required("(?:abc){2}") == [grams("abc")]
    assert required("ab?cd") == [] == required("x|.*") == required(None) == required("") == required("(") == required("a.b.c")
    assert required("[ab]xyz(?=q)w") == [grams("xyzw")] and required(r"err\.no: \d+") == [grams(START + "err.no: ")]
    assert required("(?i)abc") == required(r"\Qabc\E") == required("[a[bc]]def") == required("[a-z&&[^b]]xyz") == []
    assert required("(abc)?defg*h") == [grams("def")] and required("(abc)*?") == []


WORDS = ["alpha", "beta", "gamma", "file", "error 42", "x", "", "a.b", "line\nbreak", "ERROR"]


def test_meets_what_each_matches_alone(spark):
    rng = random.Random(5)
    parts = ["alpha", "beta", ".*", "(file|gamma)", r"\d+", "x?", "(error )+", "[a-c]", "a\\.b", ".", "line\nbreak", "(?i)error", " ", "(?:beta|)"]
    patterns = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))) for i in range(150)] + [(900, None), (901, ""), (902, "alpha"), (903, "alpha")]
    messages = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "\n"])) for i in range(200)] + [(900, None), (901, ""), (902, "alpha"), (902, "alpha")]
    m = spark.createDataFrame(messages, "message_id int, message string").withColumn("gram", F.lit(1))
    p = spark.createDataFrame([(i, "alpha" if i == 902 else "p", r) for i, r in patterns], "id int, message_pattern string, message_regex string")
    got = {(r["message_id"], r["pattern_id"], r["exact"]) for r in match_messages(m.drop("gram"), p).collect()}
    one = m.crossJoin(p).select("message_id", F.col("id").alias("pattern_id"), (F.col("message") == F.col("message_pattern")).alias("eq"), F.regexp_like("message", F.concat(F.lit("^(?:"), F.col("message_regex"), F.lit(")$"))).alias("rx"))
    want = {(r["message_id"], r["pattern_id"], bool(r["eq"])) for r in one.collect() if r["eq"] or r["rx"]}
    assert got == want and sum(not e for _, _, e in got) > 100
    assert match_messages(m.where("false"), p).count() == match_messages(m, p.where("false")).count() == 0


def test_no_loop_over_all_patterns(spark, sf):
    """Where every expression requires something, messages and expressions meet by key alone."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    p = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("message_pattern"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" .*")).alias("message_regex"))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        match_messages(part.select(F.col("p_partkey").alias("message_id"), F.col("p_name").alias("message")), p).explain()
    assert not re.search("NestedLoop|Cartesian", out.getvalue())


@pytest.mark.parametrize("text", ["", "a", "ab", "abc", "é\n"])
def test_trigrams_of_short_texts(spark, text):
    from granary.operators.errors import _grams

    t = START + text
    got = spark.createDataFrame([(text,)], "t string").select(_grams(F.col("t")).alias("g")).first()["g"]
    assert set(got) >= {t[i : i + 3] for i in range(len(t) - 2)}


def test_messages_are_not_broadcast(spark, sf):
    """However small their file is, messages stay where they are; patterns go to them, or both are shuffled."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    p = part.select(F.col("p_name").alias("id"), F.col("p_name").alias("message_pattern"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" .*")).alias("message_regex")).distinct()
    m = part.select(F.col("p_partkey").alias("message_id"), F.col("p_name").alias("message"))
    plans, rows = [], []
    for few in ({}, {"few": 0}):
        found, out = match_messages(m, p, **few), io.StringIO()
        with contextlib.redirect_stdout(out):
            found.explain()
        plans.append(out.getvalue())
        rows.append(sorted(map(tuple, found.collect())))
        assert "BuildLeft" not in out.getvalue()
    assert "Broadcast" in plans[0] and "Broadcast" not in plans[1] and rows[0] == rows[1]
    assert len(rows[0]) > m.count()
