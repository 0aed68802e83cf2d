import numpy as np
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions import vector as V


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_language_and_domains(spark):
    cases = {"a/b.py": "python", "x.PYI": "python", "m.tsx": "typescript", "k.cs": "csharp", "README": None, ".py": None, "a.b/c": None, "x.md": None}
    for path, want in cases.items():
        assert one(spark, T.detect_language("p"), p=path) == want, path
    assert one(spark, T.detect_domains("p"), p="src\\API\\Auth_test.py") == ["backend", "testing", "security"]
    assert one(spark, T.detect_domains("p"), p="guide.md") == ["frontend", "documentation"]
    assert one(spark, T.detect_domains("p"), p="x") == []


def test_knowledge_type(spark):
    kind = lambda p, c="": one(spark, T.knowledge_type("p", "c"), p=p, c=c)
    assert kind("errors/x.py") == "error_fixes"
    assert kind("data.json") == "snippets"
    assert kind("docs/a.md", "The API") == "library_docs"
    assert kind("docs/a.md", "hello") == "guidance"
    assert kind("x") == "guidance"


def test_texts(spark):
    assert one(spark, T.token_estimate("t"), t="é" * 9) == 2
    assert one(spark, T.keywords("t"), t="foo_bar alpha beta alpha x1 Beta9 abc") == ["foo_bar", "alpha", "beta", "Beta9"]
    assert one(spark, T.split_tags("t"), t=" a, ,b ,") == ["a", "b"]
    assert one(spark, T.clean_markdown("t"), t="a  \n\n\n\nb\n[Skip to x](#y)\n") == "a\n\nb"
    assert one(spark, T.is_network_path("t"), t="HTTPS://x") and one(spark, T.is_network_path("t"), t="//s/x") and not one(spark, T.is_network_path("t"), t="/a")
    assert one(spark, T.truncated("t", 3), t="abcd") == "abc..." and one(spark, T.truncated("t", 4), t="abcd") == "abcd"


def test_globs(spark):
    for glob, path, want in [("*.py", "a/b.py", True), ("**/x/**", "a/x/b", True), ("?.md", "ab.md", False), ("[ab].c", "a.c", True), ("[!ab].c", "a.c", False), ("a.c", "abc", False)]:
        assert one(spark, F.col("p").rlike(T.glob_regex(glob)), p=path) is want, glob


def test_trigrams(spark):
    s = lambda a, b: one(spark, T.trigram_similarity(T.trigrams("a"), T.trigrams("b")), a=a, b=b)
    assert s("word", "word") == 1.0
    assert abs(s("word", "two words") - 0.363636) < 1e-5
    assert s("", "") == 0.0


def test_cosine(spark):
    c = lambda a, b: one(spark, V.cosine(F.col("a"), F.col("b")), a=a, b=b)
    assert c([1.0, 0.0], [1.0, 0.0]) == 1.0 and c([1.0, 0.0], [0.0, 1.0]) == 0.0 and c([1.0, 0.0], [-1.0, 0.0]) == -1.0
    assert abs(c([1.0, 0.0], [1.0, 1.0]) - 0.70710678) < 1e-8
    assert c([0.0, 0.0], [1.0, 1.0]) is None and c([1.0], [1.0, 2.0]) is None


def test_embedder():
    e = V.HashingEmbedder(64)
    assert e.embed("a b c") == e.embed("A, b c!") and abs(sum(x * x for x in e.embed("some words"))) - 1 < 1e-12
    assert V.batch_cosine([1.0], []).tolist() == []
    assert len(e.embed_with_hash("x")[1]) == 16


def test_texts_are_embedded_in_blocks(spark):
    """An embedder gets a bounded number of texts at once, however many a batch has; nulls have no vector."""
    from granary.functions import vector

    def model(texts):
        assert len(texts) <= 1024
        return np.array([[len(t), 1.0] for t in texts])

    rows = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("a"), (F.col("id") % 50).cast("int"))).alias("t"))
    got = vector.embed_column(rows, "t", embedder=model).collect()
    assert len(got) == 3000 and all(r["embedding"] == (None if r["t"] is None else [float(len(r["t"])), 1.0]) for r in got)
