"""The inverted file against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import ann
from granary.operators.search import batch_topk


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('ann')}/index"
    ann.build(corpus, path)
    return ann.load(spark, path)


def asked(corpus):
    return corpus.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))


def pairs(df):
    return {(r["qid"], r["rank"]): (r["id"], round(r["score"], 9)) for r in df.collect()}


def test_every_row_is_indexed(corpus, index):
    assert index.rows.count() == corpus.count() == sum(n for n, _ in index.cells.values())
    rows = index.rows.limit(50).collect()
    for r in rows:
        x, c = np.frombuffer(r["v"]), np.frombuffer(r["code"], np.uint8)
        cell = index.model.cells[r["cell"]]
        left = ann._parts((x - cell)[None])[0]
        kept = np.stack([index.model.codes[j, v] for j, v in enumerate(c)])
        assert abs(np.linalg.norm(left - kept) - r["err"]) < 1e-6 and r["cell"] == int((index.model.cells @ x).argmax())
        assert all(np.linalg.norm(left[j] - kept[j]) <= np.linalg.norm(left[j] - index.model.codes[j], axis=1).min() + 1e-9 for j in range(len(c)))


def test_recall_and_exact_answers(corpus, index):
    want = pairs(batch_topk(corpus, asked(corpus), 10))
    got = pairs(ann.nearest(index, asked(corpus), 10))
    hits = {(q, i) for (q, _), (i, _) in want.items()} & {(q, i) for (q, _), (i, _) in got.items()}
    assert len(hits) / len(want) >= 0.9
    for visits, part, block in ((1, 7, 3), (index.model.visits, ann.PART, ann.BLOCK)):
        assert pairs(ann.nearest(index, asked(corpus), 10, exact=True, visits=visits, part=part, block=block)) == want
    assert pairs(batch_topk(corpus, asked(corpus), 10, part=11, block=2)) == want


def test_few_cells_are_read_where_vectors_cluster(spark, tmp_path):
    """In clustered data a query visits few cells, and bounds leave nearly all others out of the exact answer."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, 4000)] + 0.05 * rng.normal(size=(4000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    ann.build(df, f"file://{tmp_path}/i")
    index = ann.load(spark, f"file://{tmp_path}/i")
    assert index.model.visits <= len(index.cells) // 4
    q = asked(df)
    want = pairs(batch_topk(df, q, 10))
    assert pairs(ann.nearest(index, q, 10, exact=True)) == want
    got = pairs(ann.nearest(index, q, 10))
    assert len({(q, i) for (q, _), (i, _) in want.items()} & {(q, i) for (q, _), (i, _) in got.items()}) / len(want) >= 0.9
    low = ann.ranked(ann.nearest(index, q, 10), 10).where("rank = 10").select("qid", F.col("score").alias("low"))
    more = ann._asked(ann.packed(q, "qid", "vector", "qid").withColumnRenamed("v", "q").join(low, "qid"), index, index.model.visits, True)
    assert more.count() < 0.5 * q.count() * len(index.cells)


ODD = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [math.nan, 1.0]), (7, [1.0, None]), (8, [1.0, 0.0, 0.0]), (9, []), (10, [-1.0, 0.5]), (None, [0.5, 0.5]), (11, [math.inf, 1.0])]


def test_odd_vectors(spark, tmp_path):
    """What has no direction is left out on both sides; ties go by id, a null id last; copies are rows of their own."""
    df = spark.createDataFrame(ODD, "id long, embedding array<double>")
    ann.build(df, f"file://{tmp_path}/i")
    index = ann.load(spark, f"file://{tmp_path}/i")
    q = spark.createDataFrame([(1, [3.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 1.0, 1.0])], "qid int, vector array<double>")
    for got in (ann.nearest(index, q, 4, exact=True), ann.nearest(index, q, 4, visits=9), batch_topk(df, q.where("qid < 4"), 4)):
        assert [(r["qid"], r["id"], round(r["score"], 9)) for r in got.orderBy("qid", "rank").collect()] == [(1, 1, 1.0), (1, 2, 1.0), (1, 2, 1.0), (1, 3, 1.0)]
    assert index.rows.where("id is null").count() == 1 and index.rows.count() == 6
    none = q.where("false")
    assert ann.nearest(index, none, 3, exact=True).count() == batch_topk(df, none, 3).count() == 0


def test_empty_corpus(spark, tmp_path):
    df = spark.createDataFrame([], "id long, embedding array<double>")
    ann.build(df, f"file://{tmp_path}/i")
    q = spark.createDataFrame([(1, [1.0])], "qid int, vector array<double>")
    index = ann.load(spark, f"file://{tmp_path}/i")
    assert ann.nearest(index, q, 3, exact=True).count() == ann.nearest(index, q, 3).count() == batch_topk(df, q, 3).count() == 0


def test_tables_of_a_task_are_bounded(monkeypatch):
    """Rows meet centres in runs, whose tables do not grow with the rows of a batch or the number of cells; the answers are those of one table."""
    rng = np.random.default_rng(3)
    x, cells, codes = rng.normal(size=(500, 8)), rng.normal(size=(40, 8)), rng.normal(size=(2, 16, 4))
    monkeypatch.setattr(ann, "NUMBERS", 100)
    assert [s.stop - s.start for s in ann._slices(5, 40)] == [2, 2, 2] and ann._slices(0, 40) == []
    assert (ann._cells(x, cells) == (x @ cells.T).argmax(1)).all()
    parts = ann._parts(x)
    want = ((parts[:, :, None] - codes[None]) ** 2).sum(3).argmin(2)
    assert (ann._closest(parts, codes) == want).all()
