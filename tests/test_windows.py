"""Windows of words against slices in plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from granary.operators.windows import plain_words, word_windows


def plain(text, size, overlap):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    out, i = [], 0
    while w and (i == 0 or i + overlap < len(w)):
        out.append(" ".join(w[i : i + size]))
        i += size - overlap
    return out


TEXTS = [None, "", " \t\n\x0b\x0c\r ", "one", " one\x0btwo  three ", "é ü x", *(" ".join(f"w{i}" for i in range(n)) for n in (3, 4, 5, 6, 7, 8, 9, 10, 11, 50, 20_000))]


@pytest.mark.parametrize(("size", "overlap"), [(5, 0), (5, 2), (5, 4), (1, 0), (200, 40)])
def test_against_slices(spark, size, overlap):
    base = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    df = base.select("*", *(F.lit(1).alias(c) for c in ("words", "w", "n", "starts")))
    got = {}
    for r in word_windows(df, "text", size, overlap).orderBy("id", "chunk_index").collect():
        assert r["n_words"] == len(r["content"].split(" ")) <= size and r["starts"] == 1
        got.setdefault(r["id"], []).append(r["content"])
    assert got == {i: plain(t, size, overlap) for i, t in enumerate(TEXTS) if plain(t, size, overlap)}
    assert word_windows(df.where("false"), "text", size, overlap).count() == 0
    assert df.select(F.size(plain_words("text")).alias("n")).first()["n"] == 0


def test_bad_overlap(spark):
    with pytest.raises(ValueError, match="overlap"):
        word_windows(spark.createDataFrame([("x",)], "text string"), "text", 5, 5)
