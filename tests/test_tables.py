import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from granary.operators import graph, manifest, memory, tables
from granary.operators.search import batch_topk, bm25, bm25_postings, corpus_stats, parse_query, postings, ranked_whole, reciprocal_rank_fusion, search
from granary.plans import ingest, retrieval
from granary.plans.tools import MemoryTools, SearchTools
from granary.schemas import checked, conform, delete_parents, empty, parse_member
from granary.streaming.ingest import ingest_stream


@pytest.fixture
def catalog(spark, tmp_path):
    c = tables.Catalog(spark, f"file://{tmp_path}/catalog")
    c.bootstrap()
    return c


def rows(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


def test_upsert_keeps_ids(spark):
    a = tables.upsert_chunks(empty(spark, "semantic_chunks"), rows(spark, [("f", 0, "one", "H"), ("f", 1, "two", "H")], "source_file string, chunk_index int, content string, header_path string"))
    b = tables.upsert_chunks(a, rows(spark, [("f", 0, "new", "H2")], "source_file string, chunk_index int, content string, header_path string"))
    got = {r["chunk_index"]: r for r in b.collect()}
    assert len(got) == 2 and got[0]["content"] == "new" and got[0]["header_path"] == "H2" and got[1]["content"] == "two"
    assert got[0]["id"] == a.where("chunk_index = 0").first()["id"]
    assert sorted(tables.upsert_chunks(b, b).collect(), key=str) == sorted(b.collect(), key=str)
    c = tables.replace_file_chunks(b, rows(spark, [("f", 0, "only", "H")], "source_file string, chunk_index int, content string, header_path string"))
    assert [(r["chunk_index"], r["content"]) for r in c.collect()] == [(0, "only")]


def test_checks_and_cascades(spark):
    bad = conform(rows(spark, [("i", "wrong")], "id string, memory_type string"), "memory_notes")
    with pytest.raises(PySparkException, match="wrong"):
        checked(bad, "memory_notes").collect()
    with pytest.raises(ValueError, match="episodic, semantic"):
        parse_member("x", ("episodic", "semantic"), "memory_type")
    t = {
        "libraries": rows(spark, [("l1",), ("l2",)], "id string"), "api_elements": rows(spark, [("a1", "l1"), ("a2", "l2")], "id string, library_id string"),
        "error_patterns": rows(spark, [("e1", "l2", "a2"), ("e2", "l1", "a1")], "id string, library_id string, api_element_id string"), "error_fixes": rows(spark, [("f1", "e2"), ("f2", "e1")], "id string, error_pattern_id string"),
    }
    left = delete_parents(t, "libraries", rows(spark, [("l1",)], "id string"))
    assert {k: sorted(r["id"] for r in v.collect()) for k, v in left.items()} == {"libraries": ["l2"], "api_elements": ["a2"], "error_patterns": ["e1"], "error_fixes": ["f2"]}
    left = delete_parents(t, "api_elements", rows(spark, [("a2",)], "id string"))
    assert left["error_patterns"].where("id = 'e1'").first()["api_element_id"] is None and left["error_fixes"].count() == 2


def test_manifest(spark):
    now = F.lit("2024-05-01 00:00:00").cast("timestamp")
    m = manifest.upsert_manifest(empty(spark, "ingestion_manifest"), rows(spark, [("a", "completed", "h1"), ("b", "pending", "h2"), ("c", "completed", "h3")], "source_file string, status string, content_hash string"), now)
    files = rows(spark, [("a", "h1"), ("b", "h2"), ("c", "new"), ("d", "h4")], "source_file string, content_hash string")
    assert sorted(r["source_file"] for r in manifest.needs_reingestion(files, m).collect()) == ["b", "c", "d"]
    later = F.lit("2024-06-01 00:00:00").cast("timestamp")
    f = manifest.upsert_manifest(m, rows(spark, [("a", "failed")], "source_file string, status string"), later).where("source_file = 'a'").first()
    assert f["status"] == "failed" and f["content_hash"] is None and f["ingested_at"].month == 5 and f["updated_at"].month == 6
    u = manifest.update_status(m, rows(spark, [("b", "completed", 3, None, "h2"), ("zz", "failed", 0, "x", None)], "source_file string, status string, chunk_count int, error_message string, content_hash string"), later)
    assert u.count() == 3 and u.where("source_file = 'b'").first()["chunk_count"] == 3
    assert manifest.tallies(u).first().asDict() == {"total": 3, "successful": 3, "failed": 0}


def test_rollback_is_idempotent(spark):
    now = F.lit("2024-05-01 00:00:00").cast("timestamp")
    notes = memory.insert(empty(spark, "memory_notes"), rows(spark, [("1", "x", "episodic", "one"), ("2", "x", "semantic", "two"), ("3", "y", "episodic", "other")], "id string, agent_id string, memory_type string, content string"), now)
    cps = memory.checkpoint(empty(spark, "memory_checkpoints"), notes, "cp", "x", "why", now)
    cid = cps.first()["id"]
    more = memory.insert(notes, rows(spark, [("4", "x", "episodic", "late")], "id string, agent_id string, memory_type string, content string"), now)
    once = memory.rollback(more, memory.snapshot_rows(cps, cid), cid, "cp", "x", now)
    twice = memory.rollback(once, memory.snapshot_rows(cps, cid), cid, "cp", "x", now)
    for t in (once, twice):
        assert sorted(r["content"] for r in t.where("is_active and agent_id = 'x'").collect()) == ["one", "two"]
        assert t.where("is_active and agent_id = 'y'").count() == 1
    assert once.count() == twice.count() == 6
    assert once.where("id = '4'").first()["deleted_reason"].endswith("cp")
    assert memory.touch(notes, notes.where("id = '1'"), now).where("id = '1'").first()["usage_count"] == 1
    assert memory.history(cps, "y").count() == 0


def brute_trails(edges, start, depth):
    best, out = {}, []

    def go(at, used, d):
        for k, (a, b) in enumerate(edges):
            if k in used or at not in (a, b):
                continue
            to = b if at == a else a
            out.append((to, d))
            best[to] = min(best.get(to, 9), d)
            if d < depth:
                go(to, used | {k}, d + 1)

    go(start, frozenset(), 1)
    return best, out


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (3, 1), (3, 4)], [(1, 2), (2, 1), (2, 5)], [(1, 1), (1, 2)], [(1, 2), (3, 4)]])
def test_trails_against_brute_force(spark, edges):
    e = rows(spark, [(f"n{a}", f"n{b}", f"R{i}") for i, (a, b) in enumerate(edges)], "src string, dst string, relation string")
    best, all_trails = brute_trails(edges, 1, 3)
    got = {r["id"]: r["score"] for r in graph.proximity(e, ["n1"]).collect()}
    assert got == {f"n{k}": 1 / (d + 1) for k, d in best.items()}
    seeds = rows(spark, [("n1",)], "seed string")
    n = [t.count() for t in graph.trails(e, seeds, 3)]
    assert n == [sum(d == k for _, d in all_trails) for k in (1, 2, 3)]


def test_graph_resolution(spark):
    nodes = rows(spark, [("a.py:f", "f", "a.py"), ("b.py:f", "f", "b.py"), ("b.py:A.g", "g", "b.py")], "id string, name string, file_path string")
    edges = rows(spark, [("a.py:A.x", "self.f", "CALLS"), ("a.py:y", "mod.g", "CALLS"), ("a.py:y", "print", "CALLS")], "src string, dst string, relation string")
    ok, rest = graph.resolve_targets(edges, nodes)
    assert sorted((r["src"], r["dst"]) for r in ok.collect()) == [("a.py:A.x", "a.py:f"), ("a.py:y", "b.py:A.g")]
    assert [r["dst"] for r in rest.collect()] == ["print"]


def test_search(spark):
    corpus = rows(spark, [("1", "the quick fox", "a", [1.0, 0.0], {"c": "x"}), ("2", "a lazy dog and a fox", "b", [0.0, 1.0], {"c": "y"}), ("3", "nothing", "c", None, {"c": "x"})], "id string, content string, source_file string, embedding array<double>, metadata map<string,string>")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(search(corpus, "fox", alpha=0.0))[0] == "1" and set(ids(search(corpus, "fox"))) == {"1", "2"}
    assert ids(search(corpus, "fox", [0.0, 1.0], filters={"c": "y"})) == ["2"]
    assert ids(search(corpus, "zebra")) == [] and ids(search(corpus, "")) == []
    assert all(r["sparse_score"] == 0 and r["combined_score"] == r["dense_score"] for r in search(corpus, "fox", [1.0, 0.0], alpha=1.0).collect())
    assert parse_query('a "b c" or -d e').any_of == [([["a"], ["b", "c"]], []), ([["e"]], [["d"]])]
    fused = reciprocal_rank_fusion([rows(spark, [("1", 1), ("2", 2)], "id string, rank long"), rows(spark, [("2", 1)], "id string, rank long")])
    assert ids(fused) == ["2", "1"]


def test_postings_agree_with_texts(spark):
    corpus = rows(spark, [(1, "a b c"), (2, "a a d"), (3, "c d"), (4, ""), (5, "b")], "id long, content string")
    index, stats = postings(corpus).cache(), corpus_stats(corpus)
    for q in ("a", "a c", "a or d", "d -a", "b -c or d", "zz", "a zz", ""):
        want, got = ({r["id"]: round(r["score"], 9) for r in x.collect()} for x in (bm25(corpus, q), bm25_postings(index, stats, q)))
        assert got == want, q
    with pytest.raises(ValueError):
        bm25_postings(index, stats, '"a b"')


def test_plan():
    p = retrieval.plan("how does load_graph work and what does HybridSearcher return?")
    assert p.complexity == "complex" and len(p.sub_questions) == 2 and {"load_graph", "HybridSearcher"} <= set(p.anchors)
    assert retrieval.plan("simple question").sub_questions == ["simple question"]


def test_ingest_tools_and_stream(spark, catalog, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# Guide\n\n" + "The cache keeps pages warm. " * 20)
    (docs / "b.txt").write_text("tiny")
    assert ingest.ingest_directory(catalog, str(docs)) == {"total": 2, "successful": 2, "failed": 0}
    assert ingest.ingest_directory(catalog, str(docs)) == {"total": 0, "successful": 0, "failed": 0}
    assert catalog.read("ingestion_manifest").where("chunk_count = 0").count() == 1
    (docs / "a.md").write_text("# Guide\n\n" + "The cache is cold now. " * 20)
    one = ingest.ingest_file(catalog, str(docs / "a.md"))
    assert one["status"] == "completed" and one["chunk_count"] == 1 and one["elapsed_ms"] > 0
    assert one["content_hash"] == hashlib.sha256((docs / "a.md").read_bytes()).hexdigest()
    assert ingest.ingest_file(catalog, str(docs / "a.md"))["status"] == "skipped"
    assert catalog.read("semantic_chunks").count() == 1
    s = SearchTools(catalog)
    assert "1. [" in s.search_codebase("cache cold", advanced=False)
    assert s.search_codebase("cache cold").startswith("Answer: ") and "Total Chunks: 1" in s.get_file_context(str(docs / "a.md"))
    assert s.get_file_context("nope") == "No context found for nope"
    m = MemoryTools(catalog)
    assert m.memory_add("x", "bad").startswith("Error: Invalid memory_type 'bad'. Must be: episodic")
    made = m.remember("the cache must be warmed", "ops", "a, b").rsplit(" ", 1)[-1]
    assert "the cache must be warmed" in m.recall("cache must be warmed") and m.recall("unrelated zebra") == "No relevant memories found."
    cid = m.memory_checkpoint("first", "test").rsplit(" ", 1)[-1].rstrip(")")
    assert m.memory_update(made, content="the cache must be cold").endswith("updated.") and m.memory_delete(made).endswith("deleted.")
    assert m.memory_rollback("x") == "Invalid UUID format." and "not found" in m.memory_rollback("00000000-0000-0000-0000-000000000000")
    assert m.memory_rollback(cid) == f"Successfully rolled back to checkpoint {cid}"
    assert "the cache must be warmed" in m.recall("cache must be warmed") and "first" in m.memory_history()
    (docs / "c.txt").write_text("A new file arrives. " * 30)
    for _ in range(2):
        ingest_stream(catalog, f"file://{docs}", f"file://{tmp_path}/cp").awaitTermination()
    assert catalog.read("semantic_chunks").where("source_file like '%c.txt'").count() == 1
    with pytest.raises(ValueError):
        catalog.clear("semantic_chunks")
    catalog.clear("semantic_chunks", confirm=True)
    assert catalog.read("semantic_chunks").isEmpty() and catalog.vacuum("semantic_chunks") > 0


def test_code_index_into_catalog(spark, catalog, tmp_path):
    src = tmp_path / "src"
    (src / "node_modules").mkdir(parents=True)
    (src / "a.py").write_text("def f():\n    return g()\n\ndef g():\n    return 1\n")
    (src / "bad.py").write_text("def (")
    (src / "node_modules" / "x.js").write_text("function no() {}")
    assert ingest.index_code(catalog, str(src), "p") == {"files": 2, "entities": 2, "relationships": 1, "errors": 1}
    n, e = catalog.read("graph_nodes"), catalog.read("graph_edges")
    assert [r["id"] for r in graph.callers(n, e, "a.py:g").collect()] == ["a.py:f"] and n.first()["label"] == "Function"
    assert ingest.index_code(catalog, str(src), "p")["entities"] == 2 and catalog.read("graph_nodes").count() == 2


def test_repeated_patches_and_ids(spark):
    """An id has one row, however often a patch, a deletion or an insertion names it."""
    ddl = "id string, agent_id string, memory_type string, content string"
    notes = memory.insert(empty(spark, "memory_notes"), rows(spark, [("1", "x", "episodic", "one"), ("2", "x", "semantic", "two"), ("2", "x", "semantic", "also two")], ddl))
    assert notes.count() == 2
    again = memory.insert(notes, rows(spark, [("1", "x", "episodic", "new one")], ddl))
    assert sorted(r["id"] for r in again.collect()) == ["1", "2"] and again.where("id = '1'").first()["content"] == "new one"
    patched = memory.update(notes, rows(spark, [("1", "a"), ("1", "b")], "id string, content string"))
    assert patched.count() == 2 and patched.where("id = '1'").first()["content"] in ("a", "b")
    gone = memory.soft_delete(notes, rows(spark, [("1",), ("1",)], "id string"))
    assert gone.count() == 2 and gone.where("not is_active").count() == 1
    m = manifest.upsert_manifest(empty(spark, "ingestion_manifest"), rows(spark, [("a", "pending")], "source_file string, status string"))
    u = rows(spark, [("a", "failed", 0, "x", None), ("a", "completed", 1, None, "h")], "source_file string, status string, chunk_count int, error_message string, content_hash string")
    assert manifest.update_status(m, u).count() == 1
    assert tables.patch(notes, rows(spark, [("1", "p"), ("1", "q")], "id string, content string"), "id", ("content",)).count() == 2


def folder_bytes(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_merge_writes_what_changed(spark, tmp_path):
    """A note added to a large table costs what it costs on a small one; the others are taken over as they are."""
    cost = []
    for n in (100, 20_000):
        c = tables.Catalog(spark, f"file://{tmp_path}/{n}", buckets=256)
        c.write("memory_notes", spark.range(n).selectExpr("concat('n', id) as id", "'x' as agent_id", "'episodic' as memory_type", "repeat(cast(id as string), 20) as content"))
        before = folder_bytes(tmp_path / str(n))
        c.merge("memory_notes", rows(spark, [("new", "x", "episodic", "hello")], "id string, agent_id string, memory_type string, content string"), lambda old, new: memory.insert(old, new))
        cost.append(folder_bytes(tmp_path / str(n)) - before)
        assert c.read("memory_notes").count() == n + 1 and c.vacuum("memory_notes") >= 0 and c.read("memory_notes").where("id = 'new'").count() == 1
    assert cost[1] < 0.05 * folder_bytes(tmp_path / "20000") and cost[1] < 4 * cost[0]


def test_writers_at_once(spark, tmp_path):
    """Of writers that start from one version none loses its rows."""
    from concurrent.futures import ThreadPoolExecutor

    c = tables.Catalog(spark, f"file://{tmp_path}/c", buckets=2)
    c.bootstrap()
    add = lambda i: c.merge("memory_notes", rows(spark, [(f"n{i}", "x", "episodic", "t")], "id string, agent_id string, memory_type string, content string"), lambda old, new: memory.insert(old, new))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(6)))
    assert sorted(r["id"] for r in c.read("memory_notes").collect()) == [f"n{i}" for i in range(6)]
    now = c.version("memory_notes")
    with pytest.raises(tables.Conflict):
        c._commit("memory_notes", now - 1, {"buckets": 2, "parts": {}})


def test_anchors_reach_the_graph(spark):
    nodes = rows(spark, [("a.py:load_graph", "load_graph"), ("a.py:g", "g"), ("b.py:h", "h")], "id string, name string")
    edges = rows(spark, [("a.py:load_graph", "a.py:g", "CALLS")], "src string, dst string, relation string")
    got = retrieval.expand_anchors(nodes, edges, retrieval.plan("what does load_graph call")).collect()
    assert [(r["id"], r["score"]) for r in got] == [("a.py:g", 0.5)]
    corpus = rows(spark, [("1", "load_graph calls g", "a.py")], "id string, content string, source_file string")
    assert retrieval.answer(corpus, "what load_graph calls", nodes=nodes, edges=edges)["related"] == ["a.py:g"]
    assert retrieval.expand_anchors(nodes, edges, retrieval.plan("no anchor here")).count() == 0


def test_command_line_and_graph_files(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# A\n\n" + "Some words of a guide. " * 30)
    (docs / "b.md").write_text("# B\n\n" + "Other words of a guide. " * 30)
    (docs / "m.py").write_text("def f():\n    return g()\n\ndef g():\n    return 1\n")
    at = ["--catalog", f"file://{tmp_path}/cat"]
    assert ingest.main([*at, "--files", str(docs / "a.md"), str(docs / "b.md"), "--type", "guidance", "--skip-embedding"], spark)["successful"] == 2
    c = tables.Catalog(spark, f"file://{tmp_path}/cat")
    assert c.read("semantic_chunks").where("embedding is null").count() == 2
    assert ingest.main([*at, "--directory", str(docs), "--pattern", "*.md", "--type", "guidance"], spark)["total"] == 0
    assert ingest.main([*at, "--code", str(docs), "--output", f"file://{tmp_path}/g"], spark)["entities"] == 2
    from granary.sources.files import read_graph_json

    nodes, links = read_graph_json(spark, f"file://{tmp_path}/g")
    assert sorted(r["id"] for r in nodes.collect()) == ["m.py:f", "m.py:g"] and [(r["src"], r["dst"]) for r in links.collect()] == [("m.py:f", "m.py:g")]
    with pytest.raises(SystemExit):
        ingest.main([*at], spark)


def test_queries_in_blocks(spark):
    v = rows(spark, [(i, [float(i % 7), float(i % 5 + 1)]) for i in range(40)], "id long, embedding array<double>")
    q = v.selectExpr("id as qid", "embedding as vector")
    one, many = batch_topk(v, q, 3), batch_topk(v, q, 3, block=7)
    assert many.count() == 120 and sorted(one.select("qid", "id", "rank").collect()) == sorted(many.select("qid", "id", "rank").collect())


def test_whole_lists_are_ranked(spark):
    """An id at rank 55 of both lists is before one that is first in one only."""
    a = rows(spark, [(i, float(-i)) for i in range(1, 200)], "id long, score double")
    b = rows(spark, [(i if i == 55 else i + 1000, float(-i)) for i in range(1, 200)], "id long, score double")
    ranks = ranked_whole(a.repartition(5))
    assert all(r["id"] == r["rank"] for r in ranks.collect()) and ranks.count() == 199
    assert reciprocal_rank_fusion([ranks, ranked_whole(b)], 1).first()["id"] == 55
