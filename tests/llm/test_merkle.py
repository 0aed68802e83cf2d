"""The Merkle manifest against trees built level by level in memory."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from granary.llm import merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(leaves):
    """All levels from the leaves up."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def path(levels, i):
    out = []
    for row in levels[:-1]:
        run = row[i // 3 * 3 : i // 3 * 3 + 3]
        out.append((i % 3, [x for k, x in enumerate(run) if k != i % 3]))
        i //= 3
    return out


def leaf(row, text="text"):
    vals = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row[text]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals))


def brute(rows):
    """Rows of (doc_id, leaf, subroot, root, proof, folded_root) as the contract says."""
    by = {}
    for r in rows:
        r = r.asDict() | {"gone": None if r["text"] is None else r["text"].replace("\n", "")}
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names]
    top = tree([t[-1][0] for t in trees]) if trees else [[]]
    out = []
    for k, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            p = path(trees[k], i) + path(top, k)
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            f = leaf(r, "gone") if bad else own
            for at, others in p:
                f = sha("".join([*others[:at], f, *others[at:]]))
            out.append((r["doc_id"], own, trees[k][-1][0], top[-1][0], sha("".join(x for _, o in p for x in o)), f, f == top[-1][0]))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def manifest(df, **more):
    return merkle.manifest(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, **more)


@pytest.mark.parametrize("levels", range(6))
def test_paths_of_every_size(levels):
    for n in range(1, 3**levels + 1) if levels < 5 else (82, 83, 100, 242, 243):
        leaves = [sha(str(i)) for i in range(n)]
        rows = [leaves]
        for _ in range(levels):
            rows.append([sha("".join(rows[-1][i : i + 3])) for i in range(0, len(rows[-1]), 3)])
        got = list(merkle.paths(leaves.__getitem__, n, levels))
        assert got == [path(rows, i) for i in range(n)]
        assert merkle.root_of(leaves, levels) == rows[-1][0] and all(merkle.fold(x, p) == rows[-1][0] for x, p in zip(leaves, got))
        assert all(merkle.unpack(merkle.pack(p)) == p for p in got)


def test_memory_is_two_subtrees_a_layer():
    """Leaves are asked for in order, layer by layer, and what is held does not follow their number."""
    n, held = 3**6, []
    real = merkle.Subtree

    class Counted(real):
        def __init__(self, *a):
            super().__init__(*a)
            held.append(self)

    merkle.Subtree = Counted
    try:
        for _ in merkle.paths(lambda i: str(i), n, 6):
            assert all(sum(map(len, s.rows)) + sum(map(len, s.open)) <= 9 + 3 + 3 * 6 for s in held)
            del held[: max(0, len(held) - 6)]
    finally:
        merkle.Subtree = real


@pytest.mark.parametrize("height", [1, 2, merkle.HEIGHT])
def test_against_whole_trees(spark, sf, height):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    skew = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("hot")).when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("source")))
    assert rows_of(manifest(skew, height=height)) == brute(skew.collect())


ODD = [(1, "b", "x\ny"), (1, "b", "x\ny"), (1, "b", "other"), (None, "b", "no\nid"), (None, None, None), (20, None, "a\nb"), (20, "", "a\nb"), (40, "é", None), (60, "z", "\n" * 5), (80, "Z", "long " * 60_000 + "\n"), (100, "only", ""), (120, "b", "😀")]


def test_odd_rows(spark):
    """Nulls in every column, repeated rows, keys that are shared, sources of one row, names that clash."""
    base = spark.createDataFrame(ODD, "doc_id long, source string, text string")
    df = base.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), *(F.lit(1).alias(c) for c in ("key", "tree", "pos", "total", "digest", "block", "leaf", "root", "path", "row", "part", "at", "tampered", "subroot")))
    for height in (1, merkle.HEIGHT):
        assert rows_of(manifest(df, height=height)) == brute(df.collect())
    got = manifest(df, with_paths=True).collect()
    assert all(merkle.fold(r["leaf"], merkle.unpack(r["path"])) == r["root"] for r in got)
    assert not [r for r in got if r["doc_id"] in (20, 60) and r["verified"] != (zlib.crc32(str(r["doc_id"]).encode()) % 2 == 1)]
    assert manifest(df.where("false")).count() == 0
    one = manifest(df.where("doc_id = 100")).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["proof_sha256"] == sha("")
    assert all(r["verified"] for r in merkle.manifest(df).collect())


def test_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = merkle.op11_merkle(spark, sf)
    assert rows_of(got) == sorted(c.execute(f"SELECT {', '.join(got.columns)} FROM ({merkle.OP11_SQL})").fetchall(), key=str)
