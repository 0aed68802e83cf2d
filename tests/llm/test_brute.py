"""The operators against plain computations over whole small tables."""

import hashlib
import io
import math
import re
import string
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard

from granary.llm import embed, langid, media, minhash, packing, pieces, queries, substring, toxicity, warc
from granary.llm import textkit as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pandas()


class Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# --- text kit -------------------------------------------------------------------------------------------------------


def test_words_and_grams():
    texts = ["a b  c", "", None, " a b", "b\tc a", "ABC", "x"]
    col = pa.array(texts)
    for most in (1, 4, 1 << 20):
        rows, grams = {}, {}
        for i, j, w in tk.words(col, lower=True, most=most):
            for r in range(i, j):
                rows[r] = w.hash[w.first[r - i] : w.first[r - i + 1]].tolist()
            h, at = w.grams(2)
            for x, y in zip(h.tolist(), at.tolist()):
                grams.setdefault(i + int(w.row[y]), []).append(x)
        assert [len(rows[i]) for i in range(7)] == [3, 0, 0, 2, 3, 1, 1]
        assert rows[0][:2] == rows[3] and rows[4] == [rows[0][1], rows[0][2], rows[0][0]]
        assert grams[0][0] == grams[3][0] and grams[0][1] == grams[4][0] and 5 not in grams
    sliced = pa.array(["zz", "a b", "c"]).slice(1)
    assert [w.n for _, _, w in tk.words(sliced)] == [3]
    for _, _, w in tk.words(pa.array(["a  b\tc", "", "d"])):
        assert tk.kept_text(w, np.array([True, False, True, False])).to_pylist() == ["a c", "", ""]


# --- 1 --------------------------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, rule in PLAIN.items():
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 16 <= len(d) <= 19 and luhn) or (kind == "phone" and 8 <= len(d) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, sf):
    texts = dict(zip(table(sf, "documents")["doc_id"], table(sf, "documents")["text"]))
    for r in queries.queries()["op1_pii"](spark, sf).collect():
        want = base_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k) for s in want) for k in PLAIN]
        assert set(want) <= set(r["spans"].split(",")) | {""}


def test_pii_cases_and_discovery(spark):
    from granary.llm import pii

    cases = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (988) 555-2485 +1", "é 😀 x@y.zz", "+49 30 1234567+49 30 7654321"]
    found = pii.personal_data(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, text in zip(found, cases):
        assert r["spans"] == ",".join(base_spans(text)), text
    # the words around addresses lead to one that no expression knows
    rows = [(i, f"please write mail to user{i}@host{i}.example.org for help") for i in range(8)] + [(8, "please write mail to user99[at]hidden.example for help"), (9, "order number user99x for help")]
    out = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[8] == "email:21:45" and out[9] == "" and out[0].startswith("email:21:")


# --- 2 --------------------------------------------------------------------------------------------------------------


def near_by_hand(ids, vectors, labels, least=0.98):
    s, links = Sets(ids), Counter()
    n = np.linalg.norm(vectors, axis=1)
    for i, j in combinations(range(len(ids)), 2):
        if labels[i] == labels[j] and vectors[i] @ vectors[j] / (n[i] * n[j]) >= least:
            s.join(ids[i], ids[j])
            links[ids[i]] += 1
            links[ids[j]] += 1
    return {i: (links[i], s.find(i)) for i in ids}


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 64))
    v = np.concatenate([centres[i % 12] + rng.normal(size=64) * rng.choice([0.02, 0.1, 0.14, 0.2]) for i in range(420)]).reshape(-1, 64).astype(np.float32)
    v[400:] = v[:20]
    labels = [int(i % 3) for i in range(420)]
    df = spark.createDataFrame([(i, x.tolist(), lab) for i, (x, lab) in enumerate(zip(v, labels))], "vec_id long, embedding array<float>, label int")
    want = near_by_hand(list(range(420)), v.astype(float), labels)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed.near_vectors(df).collect()}
    assert sum(n for n, _ in want.values()) > 1000 and got == want


def test_blocks_of_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 8)
    rng = np.random.default_rng(4)
    v = rng.normal(size=64) + rng.normal(size=(60, 64)) * 0.08
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed.near_vectors(df).collect()}
    assert got == near_by_hand(list(range(60)), v, [1] * 60)


def test_keys_of_a_large_table(spark, monkeypatch):
    """Longer keys, and more of them, as a label of a billion vectors has: no pair is lost that short ones find."""
    assert embed.key_sizes(500)[1] == 16 and embed.key_sizes(0)[1] == 16
    keys, bits = embed.key_sizes(10**9)
    assert bits == 25 and (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** keys < embed.MISS * 1.01
    rng = np.random.default_rng(11)
    v = np.repeat(rng.normal(size=(40, 64)), 5, axis=0)
    v += rng.normal(size=v.shape) * 0.09
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    want = near_by_hand(list(range(200)), v, [1] * 200)
    monkeypatch.setattr(embed, "key_sizes", lambda largest, least: (keys, bits))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed.near_vectors(df).collect()}
    n = sum(x for x, _ in want.values())
    assert n > 300 and sum(x for x, _ in got.values()) >= 0.99 * n and all(got[i][0] <= want[i][0] for i in got)


def test_one_id_with_two_vectors(spark):
    """Rows link, not ids: each vector of a repeated id has its own links and component."""
    a, b = np.eye(64)[0], np.eye(64)[1]
    rows = [(1, a.tolist(), 0), (1, b.tolist(), 0), (2, (a + 0.05 * b).tolist(), 0), (3, (b + 0.05 * a).tolist(), 0)]
    out = embed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(2, 3000, 64))
    y = x + 0.15 * y
    x, y = (a / np.linalg.norm(a, axis=1, keepdims=True) for a in (x, y))
    codes, f = embed.encode(x)
    true = (x * y).sum(1)
    est = np.array([embed.estimate(codes[i : i + 1], f[i : i + 1], (y[i : i + 1] @ embed.rotation(64)))[0, 0] for i in range(3000)])
    assert abs((est - true).mean()) < 0.002
    near = true >= 0.98
    assert near.sum() > 500 and (est[near] >= 0.98 - embed.margin(f[near], 64, 0.98)).all()


# --- 3 --------------------------------------------------------------------------------------------------------------

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_documents(texts, k):
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    s = Sets(texts)
    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= 80 * (len(x) + len(y) - both):
                s.join(a, b)
    return {i: (len(sets[i]), s.find(i)) for i in texts}


def noisy_group(n, words=60, seed=1):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    out = {}
    for i in range(n):
        w = list(base)
        for p in rng.choice(words, rng.integers(0, 9), replace=False):
            w[p] = f"x{rng.integers(1000)}"
        out[i] = " ".join(w)
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_minhash(spark, sf, k):
    d = table(sf, "documents")
    want = near_documents(dict(zip(d["doc_id"].tolist(), d["text"])), k)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), k=k).collect()}
    assert got == want


def test_minhash_of_a_loose_group(spark, monkeypatch):
    """Copies of which half are linked only through others; small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "MEMBERS", 8)
    texts = noisy_group(150)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = near_documents(texts, 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, k=2).collect()}
    assert got == want and len({c for _, c in want.values()}) > 1


# --- 4 --------------------------------------------------------------------------------------------------------------


def test_warc_against_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = sorted(tuple(r[n] for n in names) for r in queries.queries()["op4_warc"](spark, sf).collect())
    assert got == sorted(c.execute(f"SELECT {', '.join(names)} FROM ({warc.OP4_SQL})").fetchall())


def test_seekable_bundle(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 4096)
    w = warc.BundleWriter()
    payloads = {f"urn:page:{i}": f"<p>{i}".encode() * (i * 37 % 500) for i in range(100)}
    for k, p in payloads.items():
        w.add(k, warc.record(k, "response", "http://x", p, hashlib.sha1(p).hexdigest(), len(p)))
    blob = w.finish()
    r = warc.BundleReader(blob)
    assert len(r.frames) > 10 and [(k, x.payload) for k, x in r] == list(payloads.items())
    assert r.get("urn:page:57").payload == payloads["urn:page:57"]
    with pytest.raises(KeyError):
        r.get("urn:page:1000")
    # an ordinary decompressor reads the records and skips the tables
    plain = zstandard.ZstdDecompressor().stream_reader(blob, read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == 100
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    warc.write_archive(pages, f"file://{tmp_path}/w")
    (tmp_path / "out").mkdir()
    warc.export(spark.read.parquet(f"file://{tmp_path}/w"), f"file://{tmp_path}/out").collect()
    back = warc.read_archive(warc.load([f"file://{tmp_path}/out"], spark))
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in back.where("record_type = 'response'").collect()} <= {(r["page_id"], r["html"]) for r in pages.collect()}
    assert back.count() == pages.count()


# --- 5 --------------------------------------------------------------------------------------------------------------


def without_repeats(texts, k=20):
    words, first = {i: WORD.findall(t or "") for i, t in sorted(texts.items())}, {}
    for i, w in words.items():
        for s in range(len(w) - k + 1):
            first.setdefault(tuple(w[s : s + k]), (i, s))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < (i, s):
                gone[s : s + k] = [True] * k
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_substring(spark, sf):
    d = table(sf, "documents")
    want = without_repeats(dict(zip(d["doc_id"].tolist(), d["text"])))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == want and any(x[1] for x in want.values())


def test_substring_of_periodic_text_and_a_full_sketch(spark):
    texts = {0: "a " * 50, 1: "a b c " * 30, 2: " ".join(f"u{i}" for i in range(90)), 3: "x " + " ".join(f"u{i}" for i in range(20, 70)) + " y", 4: "a b c " * 5}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for k in (3, 20):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(df, k, cells_log=6, shard_log=4).collect()}
        assert got == without_repeats(texts, k)


# --- 6 --------------------------------------------------------------------------------------------------------------


def test_media_digest(spark, sf):
    texts = dict(zip(table(sf, "documents")["doc_id"], table(sf, "documents")["text"]))
    for r in queries.queries()["op6_media"](spark, sf).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        m = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(m))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(m).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])


def test_codecs_and_resize():
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (13, 7), dtype=np.uint8), rng.integers(0, 256, (5, 9, 3), dtype=np.uint8)
    for a in (grey, colour):
        assert (media.decode(media.encode_bmp(a)) == a).all()
    assert (media.decode(media.encode_pgm(grey)) == grey).all() and (media.decode(media.encode_ppm(colour)) == colour).all()
    assert media.decode(b"P2 # c\n2 1\n3\n0 3").tolist() == [[0, 255]] and media.decode(b"P1\n2 2\n10\n01").tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]] and media.decode(b"P5\n1 1\n65535\n\xff\xff").tolist() == [[255]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3").tolist() == [[[1, 2, 3]]]
    for bad in (b"", b"P5", b"P5\n9 9\n255\nx", b"BM123", b"P5\n0 1\n255\n", b"GIF"):
        with pytest.raises(media.MediaError):
            media.decode(bad)
    a = rng.normal(size=(12, 20))
    small = media.resize_area(a, 3, 5)
    assert np.allclose(small, a.reshape(3, 4, 5, 4).mean((1, 3)))
    odd = media.resize_area(a, 5, 7)
    assert np.isclose(odd.mean(), a.mean()) and np.allclose(media.resize_area(np.full((3, 4), 2.5), 8, 9), 2.5)
    assert np.load(io.BytesIO(media.tile(grey))).shape == (16, 16) and len(media.dhash(colour)) == 16
    ramp = np.tile(np.arange(18), (8, 1))
    assert media.dhash(ramp) == "f" * 16 and media.dhash(ramp[:, ::-1]) == "0" * 16


def area_mean(a, y0, y1, x0, x1):
    """Mean of a over a box with real borders, sample by sample."""
    total = sum(
        float(a[i, j]) * (min(i + 1, y1) - max(i, y0)) * (min(j + 1, x1) - max(j, x0))
        for i in range(int(y0), min(a.shape[0], math.ceil(y1))) for j in range(int(x0), min(a.shape[1], math.ceil(x1)))
    )
    return total / ((y1 - y0) * (x1 - x0))


def plain_feature(text):
    raw = (text or "").encode()
    a = np.frombuffer(raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)), np.uint8).reshape(-1, 64)
    h, w = a.shape
    small = [[round(area_mean(a, i * h / 8, (i + 1) * h / 8, j * w / 9, (j + 1) * w / 9), 6) for j in range(9)] for i in range(8)]
    bits = "".join("1" if small[i][j] < small[i][j + 1] else "0" for i in range(8) for j in range(8))
    tile = np.array([[round(area_mean(a, i * h / 16, (i + 1) * h / 16, j * w / 16, (j + 1) * w / 16)) for j in range(16)] for i in range(16)], np.uint8)
    npy = io.BytesIO()
    np.lib.format.write_array(npy, tile, version=(1, 0))
    return f"{int(bits, 2):016x}:{hashlib.sha256(npy.getvalue()).hexdigest()[:16]}"


def test_media_features_by_hand(spark):
    texts = ["", None, "short", "the quick brown fox " * 40, "".join(chr(33 + i % 90) for i in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.media_digest(df).collect():
        assert r["feature"] == plain_feature(texts[r["doc_id"]]), r["doc_id"]


def test_broken_rasters_do_not_end_the_job(spark):
    bad = [b"P2 1 1 255 99999999999999999999", b"P2\n1 1\n10\n200", b"P2 1 1 255 -4", b"P2 1 1 255 x", b"P1 2 1 1 7", b"P5\n1 1\n10\n\xff"]
    for x in bad:
        with pytest.raises(media.MediaError):
            media.decode(x)
    assert media.decode(b"P1\n2 2\n1# 0 0 0\n0 0 1").tolist() == [[0, 255], [255, 0]]
    out = media.features(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(bad)], "doc_id int, media binary")).collect()
    assert len(out) == len(bad) and all(r["error"] and r["payload"] is None for r in out)


# --- 7 --------------------------------------------------------------------------------------------------------------


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


def test_optimal_bounds():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n, k = int(rng.integers(1, 9)), int(rng.integers(1, 5))
        lengths = np.sort(rng.choice(50, n, replace=False))
        counts = rng.integers(1, 20, n)
        got = packing.optimal_bounds(lengths, counts, k)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for r in range(min(k, n)) for c in combinations(lengths[:-1].tolist(), r))
        assert padding(lengths, counts, got) == best and len(got) <= k and got == sorted(got)


def test_optimal_bounds_of_long_lengths():
    """Exact at any length: against the plain dynamic programme."""
    rng = np.random.default_rng(8)
    lengths = np.unique(rng.integers(1, 300_000, 220))
    counts = rng.integers(1, 50, len(lengths))
    n, k = len(lengths), 7
    cost = lambda i, j: int((counts[i:j] * (lengths[j - 1] - lengths[i:j])).sum())
    best = [0] + [math.inf] * n
    for _ in range(k):
        best = [math.inf] + [min(best[i] + cost(i, j) for i in range(j)) for j in range(1, n + 1)]
    got = packing.optimal_bounds(lengths, counts, k)
    assert padding(lengths.tolist(), counts.tolist(), got) == best[n] and len(got) == k


def test_rows_without_key_are_dealt_out(spark, monkeypatch):
    """No shard holds all rows of one length and no key; slots stay distinct."""
    monkeypatch.setattr(packing, "SHARD", 400)
    rows = spark.range(4000).selectExpr("cast(null as long) as doc_id", "3L as n").unionAll(spark.range(500).selectExpr("id as doc_id", "3L as n")).repartition(3)
    out = packing.pack(rows, tokens=rows["n"], budget=30).toPandas()
    shard = out["batch"].str.split("-").str[1]
    assert len(out) == 4500 and shard.value_counts().max() < 800 and not out.duplicated(["batch", "slot"]).any()


def test_packing(spark, sf):
    d = table(sf, "documents")
    words = {i: len(WORD.findall(t or "")) for i, t in zip(d["doc_id"], d["text"])}
    rows = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), buckets=5, budget=2000).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == words
    batches = {}
    for r in rows:
        assert r["n_tokens"] <= r["bucket_len"]
        batches.setdefault(r["batch"], []).append(r)
    for b in batches.values():
        assert len({r["bucket"] for r in b}) == 1 and sorted(r["slot"] for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0]["bucket_len"] <= 2000


# --- 8, 10 ----------------------------------------------------------------------------------------------------------


def test_bounds_are_lengths_of_rows(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([3, 700, 1001, 1001, 5003, 5003])], "doc_id long, n long")
    out = packing.pack(df, tokens=df["n"]).collect()
    assert all(r["bucket_len"] == r["n_tokens"] for r in out)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.queries()["op8_toxicity"](spark, sf).toPandas().merge(table(sf, "labels"), on="doc_id")
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]).all()
    h = out[out["held_out"]]
    caught, clean = h[h["toxic"] == 1]["predicted"].mean(), h[h["toxic"] == 0]["predicted"].mean()
    assert caught > 0.85 and clean < 0.005, (caught, clean)


def plain_models(texts, r):
    """Kneser-Ney by dictionaries from (text, toxic) and the ratios of sizes: the words, and p(class, before, word) for any words."""
    seqs = [([w for w in re.split(r"[^a-z0-9']+", t.lower()) if w], c) for t, c in texts]
    triples, holds = set(), Counter()
    for s, c in seqs:
        for g, h, w in zip([None, None, *s], [None, *s], s):
            triples.add((c, g, h, w))
        holds.update((c, w) for w in set(s))
    pairs = Counter((c, h, w) for c, g, h, w in triples)
    followed = Counter((c, w) for c, h, w in pairs)
    uni = {k: min(n, holds[k]) for k, n in followed.items()}
    words = {w for _, w in uni}

    def excess(n, other, c):
        return max(n - (toxicity.DISCOUNT * max(r[c], 1) + toxicity.EXCESS * other * math.sqrt(r[c])), 0)

    both = {w: uni.get((0, w), 0) + uni.get((1, w), 0) for w in words}
    n = sum(both.values())
    shared = lambda w: max(both.get(w, 0) - toxicity.SHARED, 0) / n + toxicity.SHARED * len(words) / n / (len(words) + 1)
    tops = [{w: excess(uni.get((c, w), 0), uni.get((1 - c, w), 0), c) / sum(v for (k, _), v in uni.items() if k == c) for w in words} for c in (0, 1)]
    one = lambda c, w: tops[c].get(w, 0) + (1 - sum(tops[c].values())) * shared(w)
    total = Counter()
    for (c, h, w), k in pairs.items():
        total[c, h] += k
    own = {k: excess(v, pairs.get((1 - k[0], *k[1:]), 0), k[0]) / total[k[0], k[1]] for k, v in pairs.items()}
    lost = Counter()
    for (c, h, w), x in own.items():
        lost[c, h] += x
    return words, lambda c, h, w: own.get((c, h, w), 0) + (1 - lost[c, h]) * one(c, w)


def toxic_corpus():
    rng = np.random.default_rng(6)
    rows = []
    for i in range(240):
        w = [f"w{rng.integers(40)}" for _ in range(rng.integers(0, 30))]
        if i % 3 == 0:
            w = [x for y in w for x in ([y, "you", "clown"] if rng.random() < 0.2 else [y, "scum"] if rng.random() < 0.1 else [y])]
        rows.append((i, " ".join(w) + (". Kind words" if i % 3 and rng.random() < 0.6 else ""), int(i % 3 == 0)))
    return rows


def hashed(word):
    return np.uint64(0) if word is None else toxicity._ids(next(tk.words(pa.array([word]), lower=True, apart=tk.PLAIN))[2])[1][0]


@pytest.mark.parametrize("shards", [1, 5])
def test_toxicity_models_against_plain_ones(spark, shards):
    """Every conditional probability, whose sum over all words and one unknown is 1; and texts' mean log ratios."""
    rows = toxic_corpus()
    df = spark.createDataFrame(rows, "id long, text string, toxic int").repartition(3)
    size = [sum(len(t) for _, t, c in rows if c == k) for k in (0, 1)]
    ratio = toxicity.ratios(dict(enumerate(size)))
    words, p = plain_models([(t, c) for _, t, c in rows], ratio)
    m = toxicity.Model(*toxicity.gather(df, ratio, shards), ratio)
    assert len(m.word) > 3 and len(m.pair) >= 1 and {hashed("clown"), hashed("scum"), hashed("kind")} <= set(m.word)
    for h in [None, "you", "clown", "w3", "never seen"]:
        for c in (0, 1):
            assert math.isclose(sum(p(c, h, w) for w in words) + p(c, h, "unseen"), 1, abs_tol=1e-9)
        for w in [*sorted(words), "unseen"]:
            got = m.probabilities(np.array([hashed(h)]), np.array([hashed(w)]))[0]
            assert math.isclose(got[1] / got[0], p(1, h, w) / p(0, h, w), rel_tol=1e-9), (h, w)
            if hashed(w) in m.word:
                assert np.allclose(got, [p(0, h, w), p(1, h, w)])
    texts = ["you clown of w3 w9", "w1 w2, w3", "", None, "kind WORDS scum", "?"]
    got = np.concatenate([m.features(w, j - i) for i, j, w in tk.words(pa.array(texts), lower=True, apart=tk.PLAIN)])
    for t, x in zip(texts, got):
        s = [w for w in re.split(r"[^a-z0-9']+", (t or "").lower()) if w]
        want = [math.log(p(1, h, w) / p(0, h, w)) for h, w in zip([None, *s], s)]
        assert math.isclose(x, sum(want) / len(want) if want else m.base, abs_tol=1e-9)


def test_toxicity_curve():
    m = toxicity.Model.__new__(toxicity.Model)
    m.calibrate(np.array([0.0, 0, 1, 2, 3, 4]), np.array([0.0, 0, 1, 0, 1, 1]), np.ones(6))
    assert m.score(np.array([-9.0, 0, 1, 1.5, 2, 3, 9])).tolist() == [0, 0, 0.5, 0.5, 0.5, 1, 1]
    m.calibrate(np.zeros(3), np.ones(3), np.ones(3))
    assert m.score(np.array([0.0, 5])).tolist() == [1, 1]


def test_toxicity_learns_from_all_labelled_rows(spark):
    """Also beyond the sample for the curve; a passage copied through one class is one witness."""
    rows = [(i, f"w{i % 97} v{i % 89} " + (f"u{i % 83} zounds x{i % 7}" if i % 20 == 1 else f"u{i % 83} x{i % 7}") + (" once upon a hill" if i % 4 == 1 else ""), i % 2) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.fit(docs.drop("toxic"), docs.drop("text"), bound=40)
    assert hashed("zounds") in m.word and hashed("hill") not in m.word


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.queries()["op10_language"](spark, sf).toPandas().merge(table(sf, "documents")[["doc_id", "lang"]], on="doc_id")
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out["doc_id"]]).all()
    h = out[out["held_out"]]
    assert (h["lang"] == h["lang_pred"]).mean() > 0.97 and h["score"].between(0, 1).all()


def plain_grams(text):
    """Hashed byte n-grams by hand: (order, bucket) of every one."""
    out, last = [], None
    folded = []
    for b in text.encode():
        b = b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32
        if not (b == 32 and last == 32):
            folded.append(b)
        last = b
    for k, n in enumerate(langid.ORDERS):
        for i in range(len(folded) - n + 1):
            h = 0
            for b in folded[i : i + n]:
                h = (h * 0x01000193 + b) % 2**32
            out.append(k * langid.BUCKETS + (((h ^ (h >> 15)) * 0x2C1B3C6D) % 2**32 >> 19))
    return out


def test_language_by_hand(spark):
    """Counts, bits, weights and decoding against plain sums."""
    train = [("the cat and the dog", "en"), ("that is the one", "en"), ("der hund und die katze", "de"), ("das ist für dich", "de"), ("le chat et le chien", "fr"), ("c'est très bien", "fr")]
    ask = ["the dog is one", "die katze ist das", "le chien est bien", "der the le", "x"]
    langs, size = ["de", "en", "fr"], len(langid.ORDERS) * langid.BUCKETS
    c = np.zeros((3, size))
    for t, lang in train:
        for g in plain_grams(t):
            c[langs.index(lang), g] += 1
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(train)], "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(df)
    got = langid.counts(df, "text", "lang").collect()
    assert sorted((r["lang"], r["bucket"], r["n"]) for r in got) == sorted((langs[i], int(g), int(c[i, g])) for i, g in zip(*np.nonzero(c)))
    p = np.zeros_like(c)
    for k in range(len(langid.ORDERS)):
        part = slice(k * langid.BUCKETS, (k + 1) * langid.BUCKETS)
        p[:, part] = (c[:, part] + 0.5) / (c[:, part].sum(1, keepdims=True) + 0.5 * langid.BUCKETS)
    code = langid.codewords(3)
    bits = [[langs.index(x) for x in langs if code[langs.index(x), b] > 0] for b in range(code.shape[1])]
    sure = []
    odds = []
    for b, plus in enumerate(bits):
        minus = [i for i in range(3) if i not in plus]
        o = np.log(p[plus].mean(0)) - np.log(p[minus].mean(0))
        odds.append(o)
        sure.append(max(min((p[i] @ o) * code[i, b] for i in range(3)), 1e-3))
    for r in langid.predict(spark.createDataFrame(list(enumerate(ask)), "doc_id long, text string"), model).collect():
        g = plain_grams(ask[r["doc_id"]])
        margin = [sum(np.float32(o[x]) for x in g) / max(len(g), 1) for o in odds]
        loss = [sum(w / sum(sure) * math.log1p(math.exp(-4 * m * code[i, b])) for b, (w, m) in enumerate(zip(sure, margin))) for i in range(3)]
        share = np.exp(-4 * (np.array(loss) - min(loss)))
        share /= share.sum()
        best = int(np.argmax(share))
        assert r["lang_pred"] == langs[best] and math.isclose(r["score"], share[best], rel_tol=1e-4)
        assert r["ambiguous"] == bool(share[best] - np.sort(share)[-2] < 0.15)


def test_codewords():
    for n in (2, 3, 4, 6, 7, 20):
        c = langid.codewords(n)
        apart = [(c[i] != c[j]).sum() for i, j in combinations(range(n), 2)]
        assert min(apart) >= (1 if n == 2 else 2) and (c.min(0) != c.max(0)).all()


# --- 9 --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattices(pieces.Vocabulary(pieces.MODEL))


def all_paths(lat, text):
    """(ids, log p) of every segmentation, by recursion over the vocabulary."""
    v = lat.v
    by_text = {p.decode(): i for i, p in enumerate(v.piece) if p and i not in v.byte.values()}
    unit = pieces.normalise(text)

    def go(i):
        if i == len(unit):
            return [((), 0.0)]
        out = []
        for j in range(i + 1, len(unit) + 1):
            if (x := by_text.get(unit[i:j])) is not None:
                out += [((x, *r), v.weight[x] + w) for r, w in go(j)]
            elif j == i + 1:
                ids = v.spell(unit[i])
                out += [((*ids, *r), v.rare * len(ids) + w) for r, w in go(j)]
        return out

    paths = go(0)
    total = np.logaddexp.reduce([w for _, w in paths])
    return {p: w - total for p, w in paths}


def test_samples_are_exact(lattice):
    text = "theen"
    want = all_paths(lattice, text)
    seen, first, weight, k = Counter(), Counter(), 0.0, 3
    start = lattice.states(pieces.units_of(text))
    n = 4000
    for seed in range(n):
        got = pieces.Walks(lattice, start, np.zeros(len(start), np.int64), tk.mix(np.array([seed], np.uint64)), k).sample(0)
        ids = [tuple(pieces.path_ids(lattice, e).tolist()) for e, _, _ in got]
        assert len(set(ids)) == len(ids) == min(k, len(want))
        for i, (_, lp, _) in zip(ids, got):
            assert math.isclose(lp, want[i], abs_tol=1e-4)
        first[ids[0]] += 1
        seen.update(ids)
        weight += sum(math.exp(lp - li) for _, lp, li in got)
    for ids, lp in want.items():
        p = math.exp(lp)
        assert abs(first[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
    # importance weights of samples without replacement sum to one on average
    assert abs(weight / n - 1) < 0.03


def test_few_segmentations_and_decoding(lattice):
    for text in ("", "q", "日本\n\n x  y ☃ \U0001f600", "a\nb", " lead", "trail "):
        us = pieces.units_of(text)
        assert "".join(us) == pieces.normalise(text)
        if us:
            got = pieces.Walks(lattice, lattice.states(us), np.zeros(len(us), np.int64), np.array([9], np.uint64), 4).sample(0)
            assert {pieces.decode_ids(lattice.v, pieces.path_ids(lattice, e)) for e, _, _ in got} == {text}
    one = pieces.Walks(lattice, lattice.states(["\n"]), np.zeros(1, np.int64), np.array([1], np.uint64), 4).sample(0)
    assert len(one) == 1 and one[0][2] == 0.0


def test_pieces_query(spark, sf):
    out = queries.queries()["op9_sentencepiece"](spark, sf).toPandas()
    assert out["exact"].all() and (out.groupby("doc_id")["ids_hash"].nunique() == out.groupby("doc_id").size()).all()
    assert (out["log_inclusion"] <= 1e-9).all() and len(out) > 300
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    back = pieces.decode(pieces.segmentations(docs), "ids").join(docs.select("doc_id", "text"), "doc_id")
    assert back.where("decoded <> text").count() == 0
