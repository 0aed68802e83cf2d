"""Each stage of the corpus pipeline on its own input, against plain computations."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_brute import base_spans, near_documents, without_repeats  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "minhash", "substring", "pii", "packing"]
    one = steps["toxicity"](spark, docs, sf).cache()
    assert one.columns == names and one.exceptAll(docs).count() == 0 and one.count() > 150
    two = steps["minhash"](spark, one, sf).cache()
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    assert {r["doc_id"] for r in two.collect()} == {i for i, (_, c) in near_documents(texts, 5).items() if c == i}
    three = steps["substring"](spark, two, sf).cache()
    texts = {r["doc_id"]: r["text"] for r in two.collect()}
    want = without_repeats(texts)
    for r in three.collect():
        assert r["text"] == (want[r["doc_id"]][2] if want[r["doc_id"]][1] else texts[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    four = steps["pii"](spark, three, sf).cache()
    texts = {r["doc_id"]: r["text"] for r in three.collect()}
    for r in four.collect():
        assert not base_spans(r["text"]) or base_spans(texts[r["doc_id"]])
        if not base_spans(texts[r["doc_id"]]):
            assert r["text"] == texts[r["doc_id"]]
        assert not any(s.startswith(("email", "ip", "phone")) for s in base_spans(r["text"]))
    assert four.columns == names
    five = steps["packing"](spark, four, sf)
    assert sorted(r["doc_id"] for r in five.collect()) == sorted(r["doc_id"] for r in four.collect())
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(whole.collect()) == sorted(five.collect())


def test_run_of_odd_tables(spark, tmp_path):
    """Nulls, empty and repeated rows, clashing columns, and the texts that the manifest names; then empty tables."""
    from test_edges import ODD, docs

    odd = docs(spark, [*ODD, (20, None), (21, "mail a@b.org " * 30), (21, "mail a@b.org " * 30)])
    labels = spark.createDataFrame([(2, 1), (8, 0), (None, 1), (21, 0), (21, None)], "doc_id long, toxic int")
    odd.write.parquet(f"{tmp_path}/a/documents.parquet")
    labels.write.parquet(f"{tmp_path}/a/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a", f"file://{tmp_path}/run").collect()
    texts = spark.read.parquet(f"file://{tmp_path}/run/pii")
    assert texts.columns == odd.columns and not (tmp_path / "run" / "substring").exists()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in texts.collect())
    # document 5 is a copy of 4; repeated rows of one doc_id stay together, rows without one stay
    assert {r["doc_id"] for r in out} == {1, 2, 3, 4, 6, 7, 8, 20, 21, None} and sum(r["doc_id"] is None for r in out) == 2
    assert texts.where("text like '%@b.org%'").count() == 0 and texts.where("doc_id = 1").first()["text"] is None
    assert len({(r["batch"], r["slot"]) for r in out}) == len(out)
    for name, df in (("documents", odd), ("labels", labels)):
        df.where("false").write.parquet(f"{tmp_path}/b/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
