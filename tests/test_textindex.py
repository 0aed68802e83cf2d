"""English lexemes against published pairs; the index against scans and plain computations."""

import contextlib
import io
import math
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.functions.english import STOP_WORDS, _STEP_2, _STEP_3, _STEP_4, stem, stem_sql, stemmed
from granary.operators import textindex as T
from granary.operators.search import bm25, parse_query

# Pairs from the stemmer's published sample vocabulary and rules.
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol
consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consols consol consonant conson consort consort
consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir
conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel
kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight
knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker
knocking knock knocks knock knopp knopp knot knot knots knot
searching search searches search searched search running run hopping hop hoped hope falling fall hissing hiss filing file skies sky dying die news news
sky sky generously generous generate generat communism communism arsenal arsenal proceed proceed proceeds proceed exceeding exceed inning inning
gas gas this this kiwis kiwi gaps gap ties tie cries cri by by say say cry cri luxuriated luxuri hop hop hoping hope relational relat conditional condit
rationalization ration vietnamization vietnam sensational sensat happily happili agreed agre feed feed plastered plaster bled bled yellow yellow enjoy enjoy boyish boyish
adoption adopt revival reviv effective effect bowdlerize bowdler probate probat controlling control roll roll rate rate cease ceas be be a a x2s x2s 42 42""".split()


def test_stems(spark):
    pairs = dict(zip(SAMPLE[::2], SAMPLE[1::2]))
    got = {r["word"]: r["lexeme"] for r in stemmed(spark.createDataFrame([(w,) for w in pairs], "word string")).collect()}
    assert {w: got[w] for w in pairs if got[w] != pairs[w]} == {} == {w: stem(w) for w in pairs if stem(w) != pairs[w]}
    c = duckdb.connect()
    c.execute("CREATE TABLE v AS SELECT unnest($1) AS word", [list(pairs)])
    assert dict(c.execute(f"SELECT * FROM {stem_sql('v')}").fetchall()) == got
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 127


def test_both_forms_of_the_stemmer(spark):
    """Every suffix on every kind of beginning, and made words."""
    rng = random.Random(8)
    ends = ["", "s", "sses", "ies", "ied", "us", "ss", "eed", "eedly", "ed", "edly", "ing", "ingly", "y", "e", "l", "ll", "li", "ogi", "logi", "ion", "sion", "ative", *_STEP_2, *_STEP_3, *_STEP_4]
    heads = ["", "a", "b", "be", "hop", "tr", "gener", "commun", "arsen", "by", "yy", "sky", "relat", "hopp", "bl", "organiz", "activat", "ay", "ski", "inn"]
    made = {h + e for h in heads for e in ends} | {"".join(rng.choice("aeiouybdlnrstgz") for _ in range(rng.randrange(1, 12))) + rng.choice(ends) for _ in range(4000)} - {""}
    c = duckdb.connect()
    c.execute("CREATE TABLE v AS SELECT unnest($1) AS word", [sorted(made)])
    want = dict(c.execute(f"SELECT * FROM {stem_sql('v')}").fetchall())
    assert {w: (stem(w), x) for w, x in want.items() if stem(w) != x} == {}
    some = sorted(made)[::7]
    assert {r["word"]: r["lexeme"] for r in stemmed(spark.createDataFrame([(w,) for w in some], "word string")).collect()} == {w: want[w] for w in some}


def lexemes(spark, docs):
    """id -> [(position, lexeme)] in plain Python, stems from the stemmer."""
    found = {r["id"]: [(p, w) for p, w in enumerate(re.findall("[a-z0-9]+", (r["content"] or "").lower()), 1) if w not in STOP_WORDS] for r in docs.collect()}
    return {i: [(p, stem(w)) for p, w in ws] for i, ws in found.items()}


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with words that stem together, phrases, and one word in every text."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    more = [(9000 + i, t) for i, t in enumerate(["Searching for the hidden search engine", "He searched engines, and the engine searched him", "search the engine", "engine of search engines searching", "", None, "the of and", "a search an engine " * 400, "SEARCH-engine x", "engine search"])]
    return base.unionByName(spark.createDataFrame(more, "id long, content string"))


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('text')}/i"
    T.build(docs, path, per_segment=8)
    return T.load(spark, path)


def test_blocks_hold_every_position(spark, docs, index):
    want = {(x, i): [p for p, y in ws if y == x] for i, ws in lexemes(spark, docs).items() for x in {y for _, y in ws}}
    blocks = index.blocks()
    got = {(r["lexeme"], r["id"]): (r["at"], r["tf"], r["len"]) for r in T._postings(index, blocks, True).collect()}
    sizes = {i: len(ws) for i, ws in lexemes(spark, docs).items()}
    assert got == {k: (at, len(at), sizes[k[1]]) for k, at in want.items()}
    assert blocks.groupBy("lexeme", "segment").count().where("count > 1").count() == 0 and blocks.agg(F.max("docs")).first()[0] <= 8
    lexicon = {r["lexeme"]: (r["df"], r["cf"]) for r in index.lexicon().collect()}
    df, cf = Counter(x for x, _ in want), Counter()
    for (x, _), at in want.items():
        cf[x] += len(at)
    assert lexicon == {x: (df[x], cf[x]) for x in df}
    part = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / index.avg_len))
    for r in blocks.orderBy(F.desc("docs")).limit(20).collect():
        assert r["best"] == pytest.approx(max(part(t, n) for t, n in zip(r["tfs"], r["lens"])))
    assert all(g > 0 for r in blocks.select(F.flatten("gaps").alias("g")).collect() for g in r["g"])


def holds(words, p):
    """Whether a phrase of lexemes, at distances from the first, stands among (position, lexeme)."""
    at = {}
    for q, x in words:
        at.setdefault(x, set()).add(q)
    return any(all(q + d in at.get(x, ()) for d, x in p) for q in at.get(p[0][1], ()))


QUERIES = ["search engine", "searching", "engines or license", '"search engine"', '"searching for the hidden" engine', '"search the engine"', "search -hidden", '-"search engine" engine', "the", "", "-search", "nosuchword", "engine nosuchword", "the search", 'licence or "engine searched"']


@pytest.mark.parametrize("q", QUERIES)
def test_matches_and_scores(spark, docs, index, q):
    words, alternatives = lexemes(spark, docs), T.lexical(index, q)
    hits = [i for i, ws in words.items() if any(all(holds(ws, p) for p in must) and not any(holds(ws, p) for p in never) for must, never in alternatives)]
    terms = sorted({x for must, _ in alternatives for p in must for _, x in p})
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    df = {t: sum(any(x == t for _, x in ws) for ws in words.values()) for t in terms}

    def score(ws):
        tf = Counter(x for _, x in ws)
        return sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ws) / avg)) for t in terms if tf[t])

    want = sorted(((i, round(score(words[i]), 9)) for i in hits), key=lambda r: (-r[1], r[0]))
    got = sorted(((r["id"], round(r["score"], 9)) for r in T.match(index, q).collect()), key=lambda r: (-r[1], r[0]))
    assert got == want
    for limit in (1, 3, 20):
        assert [(r["id"], round(r["score"], 9)) for r in T.topk(index, q, limit).collect()] == want[:limit]
    if q in ("search engine", '"search engine"', "searching"):
        assert want


def plain_rank(ws, alternatives):
    every = sorted({x for must, never in alternatives for p in [*must, *never] for _, x in p})
    at = {x: [q for q, y in ws if y == x][: T.RANKED_POSITIONS] for x in every}
    if len(alternatives) > 1 or len(every) < 2:
        return sum(sum(0.1 / (j * j) for j in range(1, len(a) + 1)) / 1.64493406685 for a in at.values()) / len(every)
    res = -1.0
    for i, x in enumerate(every):
        for y in every[:i]:
            for p in at[x]:
                for q in at[y]:
                    if d := abs(p - q):
                        w = math.sqrt(0.1 * 0.1 * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))
                        res = w if res < 0 else 1 - (1 - res) * (1 - w)
    return res


@pytest.mark.parametrize("q", ["search engine", "searching", "engines or license", '"search engine"', "search -hidden", "search hidden engine"])
def test_rank_by_positions(spark, docs, index, q):
    words, alternatives = lexemes(spark, docs), T.lexical(index, q)
    got = {r["id"]: r["score"] for r in T.rank(index, q).collect()}
    assert set(got) == {r["id"] for r in T.match(index, q).collect()} and got
    for i, s in got.items():
        assert s == pytest.approx(max(plain_rank(words[i], alternatives), 0), abs=1e-12)


def test_simple_configuration_equals_the_scan(spark, docs, tmp_path):
    T.build(docs, f"file://{tmp_path}/i", english=False, per_segment=16, buckets=4)
    index = T.load(spark, f"file://{tmp_path}/i")
    # the scan counts a text of nothing as a length, and a null one as none
    for q in ("the search", '"search the engine"', "moron or clown", "license -the"):
        scan = {r["id"]: round(r["score"], 9) for r in bm25(docs.where("content is not null"), q).collect()}
        assert {r["id"] for r in T.match(index, q).collect()} == set(scan)
    assert parse_query("a").terms == ["a"]


def test_only_the_querys_folders_are_read(spark, index):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        T.match(index, "search").explain("formatted")
    p = out.getvalue()
    assert re.search(r"PartitionFilters: \[isnotnull\(bucket#\d+\), \(bucket#\d+ = \d+\)\]|PartitionFilters: \[.*bucket#\d+ (IN|= )", p), p
    assert "EqualTo(lexeme,search)" in p or "In(lexeme, [search])" in p
    assert "gaps" not in re.search(r"ReadSchema: (.*)", p)[1]
    read = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    files = read(index.of(index.blocks(), ["search"]))
    assert len({re.search(r"bucket=\d+", f)[0] for f in files}) == 1 < len(read(index.blocks()))


def test_bounds_leave_segments_out(spark, tmp_path):
    """One document in fifty has the word often: its segments alone are scored."""
    rows = [(i, "lorem ipsum dolor amet " * 5 + ("engine " * 30 if i % 50 == 0 else "engine")) for i in range(2000)]
    T.build(spark.createDataFrame(rows, "id long, content string"), f"file://{tmp_path}/i", per_segment=4)
    index = T.load(spark, f"file://{tmp_path}/i")
    alternatives = T.lexical(index, "engine")
    heads = T.segment_bounds(index, alternatives, T._frequencies(index, ["engin"]), {"engin": 0})
    top = T.topk(index, "engine", 5)
    assert [r["id"] for r in top.collect()] == [0, 50, 100, 150, 200]
    sure = min(r["score"] for r in top.collect())
    assert heads.where(F.col("bound") >= sure - 1e-9).count() <= 40 < 0.2 * heads.count()


def test_odd_tables(spark, tmp_path):
    """No rows; ids that are null or texts; clashing names; a very long text of one word."""
    df = spark.createDataFrame([("b", "fox foxes fox", 1), (None, "fox", 1), ("a", None, 1), ("ü", "fox " * 60_000, 1)], "key string, body string, lexeme int")
    for name, rows, want in (("i", df, {"b": 3, "ü": 60_000}), ("j", df.where("false"), {})):
        T.build(rows, f"file://{tmp_path}/{name}", "key", "body")
        index = T.load(spark, f"file://{tmp_path}/{name}")
        assert {r["id"]: r["tf"] for r in T._postings(index, index.blocks(), True).collect()} == want
        assert {r["id"] for r in T.match(index, "fox").collect()} == set(want) == {r["id"] for r in T.topk(index, "foxes", 9).collect()}
        assert T.rank(index, "fox").count() == len(want)


def test_segment_of_more_words_than_a_task_keeps():
    """The numbers of a segment's words hold until its blocks are made, however many words it has."""
    made = T._Segment(english=False, avg=1.0)
    n = 600_000  # a word and its lexeme are two entries
    texts = ["first", " ".join(f"w{i}" for i in range(n)), "w0 first last"]
    for i, t in enumerate(texts):
        made.add(i, t)
    rows = made.blocks(pa.array([7, 8, 9], pa.int64()), True, 0)
    assert sorted(rows.column("lexeme").to_pylist()) == sorted({w for t in texts for w in t.split()})
    found = {x: i for i, x in enumerate(rows.column("lexeme").to_pylist())}
    assert [(rows.column("ids")[found[x]].as_py(), rows.column("docs")[found[x]].as_py()) for x in ("first", "w0", "last", "w1")] == [([7, 2], 2), ([8, 1], 2), ([9], 1), ([8], 1)]
    made.clear()
    assert made.number == {} == dict.fromkeys(made.lexemes)  # emptied between segments
