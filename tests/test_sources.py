import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.sources import code, guards, html, markdown
from granary.sources import files as src
from granary.sources.chunks import ChunkConfig, chunk_sections, pack, paragraphs


def test_sections_and_breadcrumbs():
    parts = markdown.sections("intro\n# A\nx\n## B\ny\n### C\n## D\nz")
    assert [(s.header_path, s.header_level, s.start_line, s.end_line, s.content) for s in parts] == [
        ("", 0, 0, 0, "intro"), ("A", 1, 1, 2, "x"), ("A > B", 2, 3, 4, "y"), ("A > B > C", 3, 5, 5, ""), ("A > D", 2, 6, 7, "z"),
    ]
    fenced = "# A\n```\n# not\n```\n"
    assert len(markdown.sections(fenced)) == 2 and len(markdown.sections(fenced, respect_fences=True)) == 1
    assert markdown.front_matter("---\ntitle: T\n---\nx") == ({"title": "T"}, "x")
    assert markdown.front_matter("---\n: [\n---\nx")[0] == {}
    assert markdown.rst_to_markdown("Top\n===\n\ntext\n\nSub\n---\n") == "# Top\n\ntext\n\n## Sub\n"


def test_clean_keeps_its_order():
    assert markdown.clean("a\n \n \n \nb  \n[Back to top](#t)") == "a\n\n\n\nb"


def test_paragraphs():
    text = "a\nb\n\n```\nx\n\ny\n```\n\n| t |\nrow\n\nend"
    assert paragraphs(text) == ["a\nb", "```\nx\n\ny\n```", "| t |\nrow", "end"]


def test_chunks():
    config = ChunkConfig(max_tokens=10, min_tokens=2, overlap_tokens=3)
    p = ["aaaa " * 4, "bbbb " * 2, "cccc " * 5, "d"]
    out = pack("\n\n".join(x.strip() for x in p), config)
    assert out[0].startswith("aaaa") and "bbbb" in out[0] and out[1].startswith("bbbb") and "cccc" in out[1]
    long = " ".join(f"Sentence number {i}." for i in range(12))
    pieces = pack(long, config)
    assert len(pieces) > 1 and all(x.split()[-1].endswith(".") for x in pieces)
    parts = markdown.sections("# T\n\nshort")
    assert chunk_sections(parts, "") == [] and len(chunk_sections(parts, "", ChunkConfig(min_tokens=0))) == 1
    assert chunk_sections(parts, "", ChunkConfig(min_tokens=0))[0].content == "# T\n\nshort"
    assert [c.chunk_index for c in chunk_sections([], "word " * 3000)] == list(range(len(chunk_sections([], "word " * 3000))))


def test_html():
    body = "<p>" + "real text " * 30 + "</p>"
    page = f"<html><head><title>T</title><script>x</script></head><body><nav>menu</nav><div class='ad'>buy</div><div class='loading'>keep me</div><main><h2>H</h2>{body}<p style='display:none'>no</p><a href='/u'>link</a><img src='i.png'></main><footer>f</footer></body></html>"
    d = src.parse_document("a.html", page, "html")
    assert d["title"] == "T" and "## H" in d["content"] and "[link](/u)" in d["content"] and "i.png" in d["content"]
    assert not any(x in d["content"] for x in ("menu", "buy", "no\n", "script"))
    root, archive = html.parse("<!-- Page saved with SingleFile --><p>x")
    assert archive and root.text() == "x"
    root, _ = html.parse("<div class='shadow'>a</div><div id='x-ad'>b</div>")
    html.tidy(root, False)
    assert root.text() == "a"
    root, _ = html.parse("<div class='shadow'>a</div>")
    html.tidy(root, False, exact_names=False)
    assert root.text() == ""


def test_python_code():
    source = "import os\nfrom a.b import c\n\n@dec\nclass A(B, x.C):\n    '''Doc.'''\n\n    async def m(self, n: int = 1) -> str:\n        return self.f(g(n))\n\ndef top():\n    def inner():\n        h()\n    return inner\n"
    e, r = code.index(source, "p.py", "python")
    assert [(x.id, x.entity_type, x.start_line, x.end_line) for x in e] == [("p.py:A", "class", 5, 9), ("p.py:A.m", "method", 8, 9), ("p.py:top", "function", 11, 14)]
    assert e[0].signature == "class A(B, x.C)" and e[0].docstring == "Doc." and e[0].modifiers == ["dec"] and "-> str" in e[1].signature
    rel = {(x.source, x.target, x.relation) for x in r}
    assert rel == {("p.py", "os", "IMPORTS"), ("p.py", "a.b", "IMPORTS"), ("p.py:A", "B", "INHERITS"), ("p.py:A.m", "self.f", "CALLS"), ("p.py:A.m", "g", "CALLS"), ("p.py:top", "h", "CALLS")}
    with pytest.raises(SyntaxError):
        code.index("def (", "p.py", "python")


def test_other_languages():
    js = "class A {\n  run(x) { return 1 }\n}\nfunction f() {}\nexport const g = async (x) => { return x }\n// function no() {}\n"
    assert [x.id for x in code.index(js, "a.js", "javascript")[0]] == ["a.js:A", "a.js:A.run", "a.js:f", "a.js:g"]
    go = "package p\ntype T struct {\n}\nfunc F(a int) {\n}\nfunc (t *T) M() {\n}\n"
    assert [x.id for x in code.index(go, "a.go", "go")[0]] == ["a.go:T", "a.go:F", "a.go:(t *T).M"]
    rs = "pub struct S { a: i32 }\nimpl S {\n    pub fn new() -> S { S { a: 1 } }\n}\nfn free() {}\nenum E { A }\n"
    assert [(x.id, x.entity_type) for x in code.index(rs, "a.rs", "rust")[0]] == [("a.rs:S", "class"), ("a.rs:S.new", "method"), ("a.rs:free", "function")]
    assert code.index("x", "a.zz", None) == ([], [])


def test_guards(tmp_path):
    f = tmp_path / "a.pdf"
    f.write_bytes(b"x" * 10)
    assert guards.validate(f) == f
    for bad, why in [("//host/a.pdf", "Network"), (tmp_path / "no.pdf", "exist"), (tmp_path, "regular")]:
        with pytest.raises(guards.SecurityError, match=why):
            guards.validate(bad)
    with pytest.raises(guards.SecurityError, match="large"):
        guards.validate(f, guards.Guard(max_size=5))
    with pytest.raises(TimeoutError):
        guards.with_timeout(0.05)(lambda: __import__("time").sleep(1))()

    def deep(n):
        return n and deep(n - 1)

    with pytest.raises(RecursionError):
        guards.with_recursion_limit(30)(deep)(500)
    assert guards.guarded(lambda p: p.name)(f) == "a.pdf"


def test_scan_parse_and_errors(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("---\nk: v\n---\n# Title\n\n" + "word " * 300)
    (tmp_path / "sub" / "b.txt").write_bytes(b"first line\nbad \xff byte")
    (tmp_path / "sub" / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "skip.tmp").write_text("x")
    files = src.scan(spark, str(tmp_path), exclude=("*.tmp",))
    docs = {r["source_file"].rsplit("/", 1)[-1]: r for r in src.parse(files).collect()}
    assert set(docs) == {"a.md", "b.txt", "c.pdf"}
    assert docs["a.md"]["title"] == "Title" and docs["a.md"]["metadata"] == {"k": "v"}
    assert docs["b.txt"]["title"] == "first line" and "�" in docs["b.txt"]["content"]
    assert docs["c.pdf"]["metadata"]["error"] and docs["c.pdf"]["content_hash"] == ""
    assert src.scan(spark, str(tmp_path), recursive=False).count() == 2
    assert src.chunk(src.parse(files)).count() == 1


def test_document_type(spark):
    rows = [("a.HTM", "", "html"), ("a.rst", "", "rst"), ("x", "<!DOCTYPE html>", "html"), ("x", "# Head", "markdown"), ("x", "text\n# later", "text"), ("x.zz", "", "text")]
    df = spark.createDataFrame(rows, "p string, c string, want string")
    assert df.where(src.document_type("p", "c") != df["want"]).collect() == []


def test_cut_references_in_titles():
    """A title that ends in the middle of a reference keeps what is left of it; whole references are read."""
    title = lambda t: html.title(html.parse(f"<html><head><title>{t}</title></head><body>x &amp y</body></html>")[0])
    assert [title(t) for t in ("a &amp; b&amp", "R&amp;amp; &lt", "&ampx &lt;p&gt; &#65;&#x42;", "AT&T &nosuch; &")] == ["a & b&amp", "R&amp; &lt", "&ampx <p> AB", "AT&T &nosuch; &"]


def test_batches_are_taken_in_blocks():
    """A batch is taken up in runs of rows bounded by their bytes, so memory does not follow its number of rows; nothing is lost."""
    texts = ["a" * 300, "b" * 4000, None, "", "é" * 200] + ["c" * 100] * 50
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["source_file", "text"])
    for batch in (b, b.slice(1), b.slice(len(texts)), b.slice(2, 1)):
        blocks = list(src._blocks(batch, 1000))
        assert [x for y in blocks for x in y.column(0).to_pylist()] == batch.column(0).to_pylist()
        assert all(y.num_rows == 1 or sum(64 + len((t or "").encode()) for t in y.column(1).to_pylist()) <= 1000 for y in blocks)


def test_code_of_one_partition_is_indexed_by_many_tasks(spark):
    """A small table of many files is dealt over tasks; texts of nodes are those that ast gives."""
    files = spark.range(0, 400, 1, 1).select(F.concat(F.lit("f"), "id", F.lit(".py")).alias("file_path"), F.lit("@d(\n 1)\ndef é(a, *, b=1):\n    return q('é')(\n2)\r\nclass K(x.Y): pass\n").alias("text"))
    indexed = src.index_code(files)
    of = src.entities(indexed).select("file_path", "signature", "modifiers", F.spark_partition_id().alias("p")).collect()
    assert len(of) == 800 and len({r["p"] for r in of}) > 1
    assert {(r["signature"], tuple(r["modifiers"])) for r in of} == {("def é(a, *, b=1)", ("d(\n 1)",)), ("class K(x.Y)", ())}
