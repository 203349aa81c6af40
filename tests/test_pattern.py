"""The pattern language."""

import pytest

from graphloom import render
from graphloom.plans import pattern

from .graphs import query_graph


@pytest.fixture(scope="module")
def graph(spark):
    return query_graph(spark)


def rows(graph, text):
    return [tuple(r) for r in pattern.run(text, graph).collect()]


def test_hop(graph):
    assert rows(graph, "MATCH (a:Function)-[:CALLS]->(b:Function) RETURN a.name, b.name") == [("main", "ValidateToken"), ("ValidateToken", "parseHeader")]


def test_conditions_ignore_case_and_labels_do_not(graph):
    assert rows(graph, "match (n) where n.name = 'validatetoken' return n.id") == [("validate",)]
    assert rows(graph, "MATCH (n:function) RETURN n.id") == []
    assert rows(graph, "MATCH (n) WHERE n.name CONTAINS 'VALID' AND n.type <> 'Method' RETURN n.id") == [("validate",)]
    assert rows(graph, "MATCH (n) WHERE n.file STARTS WITH 'internal/auth/t' RETURN n.name") == [("Config",), ("Validate",), ("Authenticator",)]


def test_missing_property_is_empty_text(graph):
    assert len(rows(graph, "MATCH (n) WHERE n.receiver <> 'Config' RETURN n.id")) == 8
    assert rows(graph, "MATCH (n:Class) RETURN n.community AS c, n.exported, n.startLine LIMIT 1") == [("", "true", "1")]


def test_target_seed_and_any_edge(graph):
    assert rows(graph, "MATCH (a)-[]->(b) WHERE b.name = 'Animal' RETURN a.name") == [("Dog",)]
    assert len(rows(graph, "MATCH (a)-[]->(b) RETURN a.id")) == 5


def test_whole_node_and_alias(graph):
    assert rows(graph, "MATCH (n:Struct) RETURN n AS s") == [("Config (Struct) @ internal/auth/types.go:5",)]
    assert pattern.run("MATCH (n:Struct) RETURN n AS s, n.name", graph).columns == ["s", "n.name"]


def test_one_variable_for_both_ends_is_the_target(graph):
    assert rows(graph, "MATCH (a)-[:EXTENDS]->(a) RETURN a.name") == [("Animal",)]


def test_limit_and_truncation(graph):
    q = pattern.parse("MATCH (n) RETURN n.id LIMIT 3")
    found = pattern.compile_query(q, graph)
    assert found.count() == 3 and pattern.is_truncated(found, q)
    assert pattern.parse("MATCH (n) RETURN n LIMIT 10abc").limit == 10
    assert "_Results truncated at 3 rows._" in render.query("MATCH (n) RETURN n.id LIMIT 3", graph)


def test_quotes_may_hold_keywords(graph):
    assert rows(graph, "MATCH (n) WHERE n.name = 'a AND b LIMIT 3' RETURN n.id") == []


@pytest.mark.parametrize(
    "text",
    [
        "", "RETURN n", "MATCH (n)", "MATCH (n) WHERE m.name = 'x' RETURN n", "MATCH (n) RETURN m", "MATCH n RETURN n",
        "MATCH (n) WHERE n.name > 'x' RETURN n", "MATCH (n) WHERE n.startLine = 5 RETURN n", "MATCH (n) RETURN n LIMIT 0",
        "MATCH (a)<-[:CALLS]-(b) RETURN a", "MATCH (a)-[:CALLS]->(b)-[:CALLS]->(c) RETURN a", "MATCH (a)-[:CALLS*2]->(b) RETURN a",
    ],
)
def test_errors(text):
    with pytest.raises(pattern.PatternError):
        pattern.parse(text)


def test_markdown(graph):
    text = render.query("MATCH (n:Class) RETURN n.name", graph)
    assert text.splitlines()[:3] == ["| n.name |", "| --- |", "| Animal |"]
    assert render.query("MATCH (n:Enum) RETURN n.name", graph) == "_No results._"
