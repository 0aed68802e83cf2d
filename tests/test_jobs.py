"""The jobs over growing copies of small tables."""

import hashlib
import json
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import jobs
from jobs import build_index as build
from jobs import ingest_documents as ingest
from jobs.common import configured

ROW = "doc_id long, text string, lang string, source string, n_chars long"


def files(spark, folder, rows, mode="append"):
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], ROW).coalesce(1).write.mode(mode).parquet(folder)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(jobs.queries()))
def test_query_against_sql(name, spark, sf):
    c = duckdb.connect()
    for t in ("documents",):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    before = {k: v for k, v in spark.sparkContext.getConf().getAll()}, spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    got = jobs.queries()[name](spark, sf)
    assert rows_of(got) == sorted(c.execute(f"SELECT {', '.join(got.columns)} FROM ({jobs.oracle_sql()[name]})").fetchall(), key=str)
    assert before == ({k: v for k, v in spark.sparkContext.getConf().getAll()}, spark.conf.get("spark.sql.sources.partitionOverwriteMode"))


# --- ingestion ------------------------------------------------------------------------------------------------------


@pytest.fixture
def folders(tmp_path):
    return [f"file://{tmp_path}/{n}" for n in ("documents.parquet", "out", "mark")]


def run(spark, folders, **more):
    return ingest.run(spark, *folders, window_words=5, overlap_words=2, **more)


def manifest(spark, folders):
    return [tuple(r) for r in ingest._read(spark, f"{folders[1]}/manifest", ingest.MANIFEST).orderBy("batch_id", "doc_id").select("batch_id", "doc_id", "status", "chunk_count").collect()]


def test_only_what_is_new(spark, folders):
    files(spark, folders[0], [(1, "a b c d e f g h", "en", "s"), (2, "x y", "de", "s"), (3, "", "en", "s"), (4, None, None, None), (None, "lost", "en", "s")])
    got = run(spark, folders)
    assert got == {"batches": 1, "read": 5, "completed": 4, "skipped": 0, "failed": 1, "chunks": 3}
    assert manifest(spark, folders) == [(0, None, "failed", 0), (0, 1, "completed", 2), (0, 2, "completed", 1), (0, 3, "completed", 0), (0, 4, "completed", 0)]
    first = rows_of(ingest.current(spark, folders[1]))
    assert run(spark, folders)["batches"] == 0 and rows_of(ingest.current(spark, folders[1])) == first

    # a changed text, an unchanged one, an emptied one, a new one that comes three times
    files(spark, folders[0], [(1, "a b c changed", "en", "s"), (2, "x y", "de", "s"), (5, "new one", None, "t"), (5, "new one", None, "t"), (5, "new one", "en", "t")])
    assert run(spark, folders) == {"batches": 1, "read": 5, "completed": 2, "skipped": 1, "failed": 0, "chunks": 2}
    view = {(r["doc_id"], r["chunk_index"]): (r["content"], r["lang"]) for r in ingest.current(spark, folders[1]).collect()}
    assert view == {(1, 0): ("a b c changed", "en"), (2, 0): ("x y", "de"), (5, 0): ("new one", "en")}
    files(spark, folders[0], [(1, "", "en", "s"), (2, "x z", "de", "s")])
    run(spark, folders)
    assert {(r["doc_id"], r["content"]) for r in ingest.current(spark, folders[1]).collect()} == {(2, "x z"), (5, "new one")}
    # a text that comes back is a change too
    files(spark, folders[0], [(2, "x y", "de", "s")])
    assert run(spark, folders)["completed"] == 1
    assert {(r["doc_id"], r["content"]) for r in ingest.current(spark, folders[1]).collect()} == {(2, "x y"), (5, "new one")}


def test_a_batch_that_runs_again_writes_the_same(spark, folders):
    files(spark, folders[0], [(i, f"text {i} " * 9, "en", "s") for i in range(20)])
    run(spark, folders)
    batch = spark.createDataFrame([(3, "another text", "fr", "s", 1), (21, "one more", "en", "s", 1), (4, "text 4 " * 9, "en", "s", 1)], ROW)
    first = ingest.ingest_batch(batch, 1, folders[1], 5, 2)
    seen = rows_of(ingest.current(spark, folders[1])), manifest(spark, folders)
    assert ingest.ingest_batch(batch, 1, folders[1], 5, 2) == first == {"read": 3, "completed": 2, "skipped": 1, "failed": 0, "chunks": 2}
    assert (rows_of(ingest.current(spark, folders[1])), manifest(spark, folders)) == seen


def test_growing_copies_equal_one_pass(spark, sf, folders, tmp_path):
    """Two runs, over half and over all of a copy, leave what one run over all leaves."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for half in (0, 1):
        docs.where(F.col("doc_id") % 2 == half).repartition(3).write.mode("append").parquet(folders[0])
        got = run(spark, folders, files_per_batch=2)
        assert got["batches"] == 2 and got["read"] == docs.where(F.col("doc_id") % 2 == half).count()
    whole = [f"file://{tmp_path}/{n}" for n in ("whole.parquet", "out2", "mark2")]
    docs.write.parquet(whole[0])
    run(spark, whole)
    at_once, grown = (rows_of(ingest.current(spark, f[1]).drop("batch_id")) for f in (whole, folders))
    assert at_once == grown and len(grown) > docs.count()
    layout = {re.search(r"/chunks/(batch_id=\d+/lang=[^/]+)/", f)[1] for f in spark.read.parquet(f"{folders[1]}/chunks").inputFiles()}
    assert {x.split("/")[0] for x in layout} == {f"batch_id={i}" for i in range(4)} and {x.split("=")[-1] for x in layout} == {r["lang"] for r in docs.select("lang").distinct().collect()}


def test_command_line(tmp_path):
    own = tmp_path / "own.json"
    own.write_text(json.dumps({"documents": "a", "output": "", "window_words": 3}))
    assert configured("x", own, ["--output", "o"]) == {"documents": "a", "output": "o", "window_words": 3}
    assert configured("x", own, ["--output", "o", "--window_words", "7"])["window_words"] == 7
    with pytest.raises(SystemExit):
        configured("x", own, [])


def test_hashes_are_of_the_window(spark, folders):
    files(spark, folders[0], [(1, "a  b\tc", "en", "s")])
    run(spark, folders)
    r = ingest.current(spark, folders[1]).first()
    assert r["content"] == "a b c" and r["content_hash"] == hashlib.sha256(b"a b c").hexdigest()


# --- index ----------------------------------------------------------------------------------------------------------


def test_an_index_built_again_is_the_same(spark, tmp_path):
    """A second run over the same table changes nothing; one over a table that lost documents leaves none of theirs."""
    table, out = f"file://{tmp_path}/documents.parquet", f"file://{tmp_path}/index"
    files(spark, table, [(i, f"searching text number n{i} engines", "en", "s") for i in range(40)] + [(None, "lost", "en", "s"), (99, None, "en", "s")])
    first = build.run(spark, table, out, per_segment=8, buckets=4)
    assert first == {"documents": 42, "lexemes": 44, "postings": 200, "occurrences": 200}
    whole = lambda: (rows_of(build.textindex.load(spark, out).lexicon()), rows_of(build.textindex.load(spark, out).blocks()), rows_of(build.textindex.topk(build.textindex.load(spark, out), "search engine", 5)))
    seen = whole()
    assert build.run(spark, table, out, per_segment=8, buckets=4) == first and whole() == seen and len(seen[2]) == 5
    files(spark, table, [(1, "search", "en", "s")], "overwrite")
    assert build.run(spark, table, out, per_segment=8, buckets=4) == {"documents": 1, "lexemes": 1, "postings": 1, "occurrences": 1}
    assert [r["lexeme"] for r in build.textindex.load(spark, out).lexicon().collect()] == ["search"]


def test_jobs_read_nothing_of_the_operators_apart():
    """Jobs stand without the training-data operators."""
    for f in (Path(jobs.__file__).parent).glob("*.py"):
        assert "llm" not in f.read_text() and "corpus_pipeline" not in f.read_text()


@pytest.mark.parametrize("job", [ingest, build])
def test_runs_as_a_command(spark, job, tmp_path, monkeypatch):
    """The command makes a session and stops it; here it gets one that it cannot stop."""
    files(spark, f"file://{tmp_path}/documents.parquet", [(1, "one text", "en", "s")])
    stopped = []

    class Held:
        def __getattr__(self, name):
            return (lambda: stopped.append(1)) if name == "stop" else getattr(spark, name)

    monkeypatch.setattr(job, "session", Held)
    more = ["--checkpoint", f"file://{tmp_path}/mark"] if job is ingest else []
    got = job.main(["--documents", f"file://{tmp_path}/documents.parquet", "--output", f"file://{tmp_path}/out", *more])
    assert stopped == [1] and got.get("read", got.get("documents")) == 1
