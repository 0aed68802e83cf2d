"""Nulls, empty and very long texts, repeated rows, ties, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from granary.llm import embed, langid, media, minhash, packing, pieces, pii, substring, toxicity, warc

EXTRA = "key int, id int, n int, a int, b int, c int, g int, band int, hits int, th int, h int, of int, t int, kind string, start int, spans string, runs int, doc int, w int, bucket int, batch int, cuts int, raw int, label2 int, _th2 int, toxic2 int"


def docs(spark, rows):
    """rows (doc_id, text) with lang, source, n_chars and many extra columns."""
    base = spark.createDataFrame(rows, "doc_id long, text string")
    names = [x.split() for x in EXTRA.split(", ")]
    extra = [F.lit(7 if k == "int" else "x").alias(n) for n, k in names]
    return base.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *extra)


LONG = "word" * 50_000 + " " + " ".join(f"w{i}" for i in range(20_000)) + " 1" * 5000 + " a@b" + ".c" * 5000 + " " + "9" * 30_000
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, LONG), (None, "no id here"), (None, None), (6, "same text"), (6, "same text"), (6, "other text"), (7, "😀 ünï ▁ \x00 x".encode("utf-16", "surrogatepass").decode("utf-16")), (8, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def nothing(spark):
    return docs(spark, [])


def ids(df, c="doc_id"):
    return sorted((r[c] for r in df.select(c).collect()), key=str)


def test_pii(odd, nothing):
    out = pii.personal_data(odd)
    assert ids(out) == ids(odd)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[4]["n_email"] == 1 and got[1]["spans"] == "" and got[3]["n_card"] == 0
    assert pii.personal_data(nothing).count() == 0
    red = pii.redact(odd)
    assert red.columns == odd.columns and red.count() == odd.count()
    assert red.where("doc_id = 1").first()["text"] is None and "[EMAIL]" in red.where("doc_id = 4").first()["text"]
    assert red.where("doc_id = 6").groupBy("text").count().count() == 2


def test_minhash(odd, nothing):
    out = minhash.near_duplicates(odd, k=2)
    assert ids(out) == ids(odd)
    got = {(r["doc_id"], r["n_shingles"]): r for r in out.collect()}
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[5]["component_id"] == 4 and not rows[5]["kept"] and rows[4]["kept"]
    assert rows[1]["n_shingles"] == rows[2]["n_shingles"] == rows[3]["n_shingles"] == 0 and all(rows[i]["kept"] for i in (1, 2, 3, 6, 8))
    assert all(r["kept"] and r["component_id"] is None for k, r in got.items() if k[0] is None)
    assert rows[8]["n_shingles"] == 1
    assert minhash.near_duplicates(nothing).count() == 0


def test_substring(odd, nothing):
    out = substring.remove_repeats(odd)
    assert ids(out) == ids(odd)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[5]["n_removed"] == rows[5]["n_words"] > 20_000 and rows[5]["kept"] == ""
    # the run of equal words in document 4 repeats itself
    assert 0 < rows[4]["n_removed"] < 6000 and rows[1]["n_words"] == 0 and rows[None]["n_removed"] == 0
    assert substring.remove_repeats(nothing).count() == 0
    kept = substring.drop_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert kept.where("doc_id = 3").first()["text"] == " \t\n" and kept.where("doc_id = 1").first()["text"] is None and kept.where("doc_id = 5").first()["text"] == ""


def test_media(odd, nothing):
    out = media.media_digest(odd)
    assert ids(out) == ids(odd) and {r["payload_bytes"] for r in out.where("doc_id in (1, 2)").collect()} == {64}
    assert media.media_digest(nothing).count() == 0
    bad = odd.select("doc_id", F.when(F.col("doc_id") == 8, F.encode("text", "UTF-8")).alias("media"))
    assert media.features(bad).where("error is null").count() == 0


def test_packing(odd, nothing):
    out = packing.pack(odd)
    assert ids(out) == ids(odd) and out.select("batch", "slot").distinct().count() == out.count()
    assert out.where("n_tokens > bucket_len").count() == 0 and packing.pack(nothing).count() == 0
    assert {r["doc_id"]: r["n_tokens"] for r in out.where("doc_id in (1, 2, 3, 8)").collect()} == {1: 0, 2: 0, 3: 0, 8: 1}


def test_toxicity(spark, odd, nothing):
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (8, 0), (99, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    out = toxicity.score(odd, model)
    assert ids(out) == ids(odd) and out.where("score is null or score < 0 or score > 1").count() == 0
    empty = toxicity.fit(nothing, labels.where("false"))
    assert toxicity.score(odd, empty).where("predicted = 1").count() == 0 and toxicity.score(nothing, model).count() == 0
    kept = toxicity.drop_toxic(odd, empty)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_language(spark, odd, nothing):
    model = langid.fit(odd)
    out = {(r["doc_id"]): r for r in langid.predict(odd, model).collect()}
    assert out[1]["lang_pred"] == out[2]["lang_pred"] == out[3]["lang_pred"] == "und" and out[8]["lang_pred"] == "en" and out[1]["score"] == 0
    none = langid.fit(nothing)
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"} and langid.predict(nothing, model).count() == 0
    numbers = spark.createDataFrame([(1, "12 34 !?"), (2, "—…"), (3, "é")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.predict(numbers, model).orderBy("doc_id").collect()] == ["und", "und", "en"]


def test_pieces(odd, nothing):
    out = pieces.segmentations(odd).cache()
    assert out.where("doc_id in (4, 5)").count() == 4
    assert out.where("not exact").count() == 0 and out.where("doc_id = 1").first()["ids"] == []
    assert pieces.segmentations(nothing).count() == 0
    again = pieces.segmentations(odd.where("doc_id = 7").repartition(3))
    key = lambda df: sorted((r["rank"], tuple(r["ids"]), r["log_p"]) for r in df.where("doc_id = 7").collect())
    assert key(out) == key(again)


def test_warc(spark, tmp_path):
    big = "<p>" + "z" * 2000
    pages = spark.createDataFrame([(1, "u", big), (2, "u", big), (3, None, big), (3, "dup", big), (None, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u\r\nX: y", "é" * 600), (9, "u", "\r\n\r\n" * 400)], "page_id long, url string, html string")
    pages = pages.select("*", F.lit(1).alias("digest"), F.lit(2).alias("payload"), F.lit(3).alias("of"))
    warc.write_archive(pages, f"file://{tmp_path}/w")
    rows = warc.read_archive(spark.read.parquet(f"file://{tmp_path}/w")).collect()
    assert len(rows) == 11
    kinds = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in rows)
    assert kinds[:3] == [("1", "revisit", "3"), ("2", "revisit", "3"), ("3", "response", "None")] and [k[1] for k in kinds].count("revisit") == 2
    assert {r["page_id"]: r["payload_bytes"] for r in rows}[8] == 1200
    warc.write_archive(pages.where("false"), f"file://{tmp_path}/e")
    assert warc.read_archive(spark.read.schema("bundle_id string, records long, bundle binary").parquet(f"file://{tmp_path}/e")).count() == 0


def test_warc_of_long_payloads(spark, tmp_path):
    """Payloads that are longer than a frame and than a bundle come back whole; every bundle opens with a warcinfo record."""
    sizes = {1: warc.FRAME + 7, 2: warc.BUNDLE + 5, 3: 10, 4: warc.FRAME * 3, 5: 0}
    pages = spark.createDataFrame([(i, "u", (f"{i}-" + "ab" * n)[:n]) for i, n in sizes.items()], "page_id long, url string, html string").coalesce(1)
    warc.write_archive(pages, f"file://{tmp_path}/w", "2024-05-06T07:08:09Z")
    stored = spark.read.parquet(f"file://{tmp_path}/w")
    rows = {r["page_id"]: r for r in warc.read_archive(stored).collect()}
    assert {i: r["payload_bytes"] for i, r in rows.items()} == sizes and all(bytes(r["payload"]).decode() == (f"{i}-" + "ab" * sizes[i])[: sizes[i]] for i, r in rows.items())
    blobs = [bytes(r["bundle"]) for r in stored.collect()]
    assert len(blobs) > 1 and stored.agg(F.sum("records")).first()[0] == 5
    for blob in blobs:
        records = [r for _, r in warc.BundleReader(blob)]
        assert records[0].headers["warc-type"] == "warcinfo" and all(r.headers["warc-date"] == "2024-05-06T07:08:09Z" for r in records)


def test_pii_overlaps_and_neighbours(spark):
    """Candidates that overlap a base match are not added; one right after another still has its words before it."""
    rows = [(i, f"staff badge code zx{i}1q and zx{i}7q end mail me{i}@host.example.org now") for i in range(9)]
    out = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(s.count("email:") == 1 for s in out.values())
    many = " ".join(f"a{i}@b{i}.org +49 30 12345{i:02d}" for i in range(50))
    d = spark.createDataFrame([(1, many)], "doc_id long, text string")
    red = pii.redact(d).first()["text"]
    assert red.count("[EMAIL]") == 50 and red.count("[PHONE]") == 50 and "@" not in red and red.split()[:2] == ["[EMAIL]", "[PHONE]"]


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.1], 0), (4, [1.0, 0.0], 1), (5, [1.0, 0.0], None), (6, None, 0), (7, [], 0), (8, [0.0, 0.0], 0), (9, [nan, 1.0], 0), (10, [inf, 1.0], 0), (11, [1.0, None], 0), (None, [1.0, 0.0], 0), (12, [1.0, 0.0], 0), (12, [1.0, 0.0], 0), (13, [1.0, 0.0, 0.0], 0), (14, [1.0], 0), (15, [-1.0], 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", F.lit(1).alias("id"), F.lit(2).alias("weight"), F.lit(3).alias("raw"), F.lit(4).alias("dim"))
    out = embed.near_vectors(v).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}
    assert len(out) == len(rows)
    assert got[1] == (4, 1) and got[2] == (4, 1) and got[3] == (4, 1) and got[12] == (4, 1)
    assert all(got[i] == (0, i) for i in (4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15)) and got[None] == (0, None)
    assert embed.near_vectors(v.where("false")).count() == 0
