import pytest

from granary.operators import graph, knowledge, tables
from granary.plans import sql
from granary.plans.chat import ChatClient, TransportError
from granary.schemas import empty


def test_libraries_elements_and_errors(spark):
    lib = knowledge.add_libraries(empty(spark, "libraries"), spark.createDataFrame([("pypi", "x", "1"), ("npm", "y", "2")], "ecosystem string, name string, version string"))
    assert sorted(r["id"] for r in lib.collect()) == ["npm:y:2", "pypi:x:1"] and knowledge.library_id("npm", "y", "2") == "npm:y:2"
    again = knowledge.add_libraries(lib, spark.createDataFrame([("pypi:x:1", "pypi", "x", "1", "MIT")], "id string, ecosystem string, name string, version string, license string"))
    assert again.count() == 2 and knowledge.get(again, "pypi:x:1").first()["license"] == "MIT"
    new = spark.createDataFrame([("a1", "pypi:x:1", "f"), ("a2", "gone", "g")], "id string, library_id string, name string")
    el, edges = knowledge.add_api_elements(empty(spark, "api_elements"), empty(spark, "graph_edges"), new, lib)
    el, edges = knowledge.add_api_elements(el, edges, new, lib)
    assert el.count() == 2 and [(r["src"], r["dst"], r["relation"]) for r in edges.collect()] == [("pypi:x:1", "a1", "CONTAINS")]
    err = spark.createDataFrame([("e1", "a1"), ("e2", None), ("e3", "zz")], "id string, api_element_id string")
    pat, edges = knowledge.add_error_patterns(empty(spark, "error_patterns"), edges, err, el)
    assert pat.count() == 3 and {r["relation"]: r["n"] for r in graph.edge_stats(edges).collect()} == {"CONTAINS": 1, "RAISES": 1}


def test_sql_functions(spark, tmp_path):
    c = tables.Catalog(spark, f"file://{tmp_path}/c")
    c.write("error_patterns", spark.createDataFrame([("1", "connection refused by host", "E", "python"), ("2", "file not found", "F", "python"), ("3", "connection refused", "E", "go")], "id string, message_pattern string, exception_type string, language string"))
    c.write("semantic_chunks", spark.createDataFrame([("1", "the fox", [1.0, 0.0]), ("2", "a dog", [0.0, 1.0]), ("3", "fox and dog", None)], "id string, content string, embedding array<double>"))
    sql.register(spark, c)
    got = spark.sql("SELECT error_id FROM lookup_error('connection was refused', NULL, 'python') ORDER BY similarity DESC").collect()
    assert [r[0] for r in got] == ["1"]
    top = lambda a: [r[0] for r in spark.sql(f"SELECT id FROM hybrid_search('fox', array(0D, 1D), {a}D) ORDER BY combined_score DESC, id").collect()]
    assert top(0.0) == ["1", "3"] and top(1.0) == ["2"] and top(0.7)[0] == "2"


def test_repo_map(spark):
    n = spark.createDataFrame([("p", "a.py", "f", "Function", 5, None), ("p", "a.py", "A", "Class", 1, "class A"), ("q", "b.py", "g", "Function", 1, None)], "project_id string, file_path string, name string, label string, start_line int, signature string")
    assert [(r["file_path"], r["entities"]) for r in knowledge.repo_map(n, "p").collect()] == [("a.py", ["class A (Class, 1)", "f (Function, 5)"])]


def test_chat_retries():
    calls, waits = [], []

    def transport(body):
        calls.append(body)
        if len(calls) < 3:
            raise TransportError("busy", 429)
        return '[{"index": 1, "score": 0.9}, {"index": 0, "score": 0.1}, {"index": 9, "score": 1}]'

    c = ChatClient(transport, wait=waits.append)
    assert c.filter_relevance("q", ["a", "b"]) == [(1, "b", 0.9)] and waits == [1.0, 2.0]
    assert c.filter_relevance("q", []) == []

    def refuse(body):
        raise TransportError("no", 400)

    assert ChatClient(refuse).filter_relevance("q", ["a"]) == [(0, "a", 0.5)]
    with pytest.raises(TransportError):
        ChatClient(refuse).complete("x")
