"""Operators on graphs with known answers."""

import pytest

from graphloom.engine import Engine
from graphloom.errors import AmbiguousSymbol, EmptyGraph, InvalidParameter, SymbolNotFound
from graphloom.operators import community, export, lookup, process, rename, review, rules, search, traversal
from graphloom import render

from .graphs import make, query_graph, tool_graph


def ids(df, column="id"):
    return {r[column] for r in df.collect()}


@pytest.mark.parametrize(
    ("query", "way"),
    [("getUser", "exact"), ("get*", "pattern"), ("unused exports", "structural"), ("unused", "exact"), ("auth login flow", "fulltext"), ("exported functions with no callers", "structural")],
)
def test_classify(query, way):
    assert lookup.classify(query) == way


def test_find(spark):
    g = tool_graph(spark)
    assert ids(lookup.find(g, "loginhandler")) == {"login"}
    assert ids(lookup.find(g, "Login*")) == {"login", "page", "form"}
    assert ids(lookup.find(g, "oginfor")) == {"form"}  # the wildcard fallback
    assert ids(lookup.find(g, "exported with no callers")) == {"mid", "user", "page"}
    top = lookup.find(g, "login form", limit=1).first()
    assert (top["id"], top["callers"], top["callees"]) == ("form", 1, 1)
    assert ids(lookup.find(g, "Login*", language="TypeScript", limit=1)) == {"page"}


def test_resolve(spark):
    g = query_graph(spark)
    assert lookup.resolve(g, "validate")["id"] == "vmethod"
    with pytest.raises(SymbolNotFound) as e:
        lookup.resolve(g, "Valid")
    assert e.value.details["suggestions"] == ["ValidateToken", "Validate"]
    two = make(spark, [{"id": "a", "name": "X"}, {"id": "b", "name": "X", "file": "b.go"}], [])
    with pytest.raises(AmbiguousSymbol):
        lookup.resolve(two, "X")
    assert lookup.resolve(two, "X", "b.")["id"] == "b"


def test_explain_and_stats(spark):
    g = tool_graph(spark)
    got = {(r["section"], r["name"]) for r in lookup.explain(g, "login").collect()}
    assert got == {("callers", "UserService"), ("callers", "LoginForm"), ("callees", "ValidateToken")}
    assert {(r["key"], r["n"]) for r in lookup.stats(g).where("kind = 'edge_type'").collect()} == {("CALLS", 4), ("CALLS_API", 1), ("USES_COMPONENT", 1), ("IMPORTS", 1)}
    assert [r["importers"] for r in lookup.imported_by(g).collect()] == [["auth"]]


def test_impact(spark):
    g = tool_graph(spark)
    found = traversal.impact(g, "jwt")
    assert {(r["depth"], r["id"]) for r in found.collect()} == {(1, "val"), (2, "mid"), (2, "login"), (3, "user"), (3, "form")}
    summary = traversal.impact_summary(found).first()
    assert (summary["direct"], summary["total"], summary["apps"], summary["risk"]) == (1, 5, 2, "CRITICAL")
    assert ids(traversal.impact(g, "user", "downstream", 2)) == {"login", "val"}
    assert "d=1: WILL BREAK" in Engine(g).report("impact", "DecodeJWT")


def test_impact_takes_the_first_edge(spark):
    g = make(spark, [{"id": x} for x in "abcd"], [("b", "CALLS", "a"), ("c", "USES_TYPE", "a", 0.8), ("d", "IMPORTS", "c"), ("d", "CALLS", "b", 0.4), ("gone", "CALLS", "a"), ("a", "CALLS", "a")])
    got = {r["id"]: (r["depth"], r["edge_type"]) for r in traversal.impact(g, "a").collect()}
    assert got == {"b": (1, "CALLS"), "c": (1, "USES_TYPE"), "d": (2, "CALLS")}


def test_ego_and_export(spark):
    g = tool_graph(spark)
    assert {(r["id"], r["depth"]) for r in traversal.ego(g, "decodejwt", 2).collect()} == {("jwt", 0), ("val", 1), ("mid", 2), ("login", 2)}
    part = export.subgraph(g, symbol="DecodeJWT", depth=1)
    assert ids(part.nodes) == {"jwt", "val"} and ids(part.edges) == {"val-CALLS-jwt"}
    text = render.mermaid(part)
    assert text.startswith("graph TD") and "val -->|CALLS| jwt" in text and 'subgraph internal_auth["internal/auth"]' in text
    assert "No nodes match" in render.mermaid(export.subgraph(g, package="none"))


def test_rules(spark):
    g = make(
        spark,
        [{"id": "used"}, {"id": "self"}, {"id": "lib", "file": "b.go"}, {"id": "test", "is_test": True}, {"id": "hidden", "exported": False}, {"id": "f", "type": "File"}, {"id": "g", "type": "File"}],
        [("lib", "CALLS", "used"), ("self", "CALLS", "self"), ("hidden", "EXTENDS", "lib"), ("f", "DEFINES", "used")],
    )
    assert ids(rules.dead_code(g)) == {"self", "lib"}
    assert {(r["id"], r["detail"]) for r in rules.unused_exports(g).collect()} == {("self", "exported but only referenced within the same file"), ("test", "exported with no incoming references")}
    assert ids(rules.orphan_files(g)) == {"g"}
    assert ids(rules.unconnected(g)) == {"test"}
    assert [(r["name"], r["detail"]) for r in rules.large_files(g, 3).collect()] == [("a.go", "4 symbols (threshold: 3)")]
    assert ids(rules.uncalled_functions(g)) == {"lib", "test"}
    assert "## dead_code (2)" in render.rules(rules.run_all(g))


@pytest.mark.parametrize(
    ("edges", "want"),
    [(["AB", "BC", "CA"], [["A", "B", "C"]]), (["AB", "BC"], []), (["AA"], [["A"]]), (["AB", "BA", "AC", "CB"], [["A", "B"]])],
)
def test_cycles(spark, edges, want):
    g = make(spark, [{"id": x, "type": "Package", "package": x} for x in "ABC"], [(a, "IMPORTS", b) for a, b in edges])
    assert traversal.cycles(g) == want
    assert ids(rules.packages_on_cycles(g)) == ({x for c in want for x in c} | ({"C"} if "CB" in edges else set()))


def test_tokenizers(spark):
    from pyspark.sql import functions as F

    from graphloom.functions.columns import index_tokens, name_tokens, search_tokens

    want = {
        "getUserById": "get,user,by,id", "validate_token": "validate,token", "Handler.GetGuild": "handler,get,guild",
        "internal/auth/token.go": "internal,auth,token,go", "parseHTTPResponse": "parse,http,response", "base64Decode": "base,64,decode", "": "",
    }
    df = spark.createDataFrame([(k,) for k in want], "t string")
    got = {r["t"]: r["x"] for r in df.select("t", F.array_join(search_tokens("t"), ",").alias("x")).collect()}
    assert got == want
    row = spark.range(1).select(index_tokens(F.lit("get_userByID2-x")).alias("i"), name_tokens(F.lit("my_name-x.YZ")).alias("n")).first()
    assert row["i"] == ["get", "user", "by", "id2", "x"] and row["n"] == ["my", "name-x", "yz"]


def test_bm25_and_fusion(spark):
    g = tool_graph(spark)
    docs = search.node_documents(g)
    index, stats = search.postings(docs), search.index_stats(docs)
    got = search.bm25(index, stats, "login handler", 3).collect()
    assert got[0]["id"] == "login" and got[0]["score"] > got[1]["score"] > 0
    scan, indexed = (f.collect() for f in (search.bm25_scan(docs, "login handler login", 4), search.bm25(index, stats, "login handler login", 4)))
    assert [r["id"] for r in scan] == [r["id"] for r in indexed]
    assert [r["score"] for r in scan] == pytest.approx([r["score"] for r in indexed])
    assert search.bm25_scan(docs, "").count() == 0
    assert search.bm25(index, stats, "zzz").count() == 0 and search.bm25(index, stats, "").count() == 0
    a = spark.createDataFrame([("shared", 10.0), ("bm", 15.0)], "id string, score double")
    b = spark.createDataFrame([("shared", 0.9), ("sem", 0.95)], "id string, score double")
    fused = search.fuse(a, b).collect()
    assert fused[0]["id"] == "shared" and fused[0]["sources"] == ["bm25", "semantic"]
    assert fused[0]["score"] == pytest.approx(2 / 62)
    assert search.hybrid(a, None, None).first()["id"] == "bm"


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("c", [0.0, 1.0, 0.0]), ("z", [0.0, 0.0, 0.0])], "id string, embedding array<float>")
    assert [(r["id"], r["score"]) for r in search.nearest(v, [1, 0, 0]).collect()] == [("a", 1.0), ("c", 0.0), ("z", 0.0)]
    with pytest.raises(Exception, match="dimensions differ"):
        search.nearest(v, [1, 0]).collect()
    texts = search.embedding_text(query_graph(spark).nodes)
    assert "Receiver: Config" in texts.where("id = 'vmethod'").first()["text"]
    first, again = (search.embed(texts, 32).orderBy("id").collect() for _ in range(2))
    assert first == again and len(first[0]["embedding"]) == 32


def test_prefix_and_like(spark):
    g = tool_graph(spark)
    assert ids(search.prefix_search(g, "decod")) == {"jwt"}
    assert ids(search.like_search(g, "LOGINf")) == {"form"}


def test_communities(spark):
    ring = lambda p: [(f"{p}{i}", "CALLS", f"{p}{i % 3 + 1}") for i in (1, 2, 3)]
    g = make(spark, [{"id": f"{p}{i}", "package": p} for p in "ab" for i in (1, 2, 3)], [*ring("a"), *ring("b"), ("a1", "CALLS", "b1")])
    named = {r["id"]: r["community"] for r in community.name_communities(g, community.label_propagation(g)).collect()}
    assert named["a1"] == named["a2"] == named["a3"] and named["b1"] == named["b2"] == named["b3"]
    chain = make(spark, [{"id": f"n{i}"} for i in range(5)], [(f"n{i}", "CALLS", f"n{i + 1}") for i in range(4)])
    labels = community.label_propagation(chain)
    assert 1 <= len(ids(labels, "label")) <= 3 and labels.count() == 5
    assert community.community_stats(community.name_communities(g, community.label_propagation(g))).first()["largest_size"] >= 3


def flows(g, **kw):
    return process.detect_processes(g, **kw).collect()


def test_processes(spark):
    g = make(spark, [{"id": x, "name": x} for x in ("HandleRequest", "ProcessData", "SaveToDB")], [("HandleRequest", "CALLS", "ProcessData"), ("ProcessData", "CALLS", "SaveToDB")])
    (p,) = flows(g)
    assert (p["name"], p["label"], p["depth"], p["complexity"]) == ("HandleRequest", "HandleRequest → SaveToDB", 2, 2.8)
    assert [(s["name"], s["depth"]) for s in p["steps"]] == [("ProcessData", 1), ("SaveToDB", 2)]
    fan = make(spark, [{"id": "Init"}] + [{"id": f"Setup{i}"} for i in range(5)], [("Init", "CALLS", f"Setup{i}") for i in range(5)])
    (p,) = flows(fan)
    assert len(p["steps"]) == 4 and p["label"] == "Init (4 branches)"
    ring = make(spark, [{"id": x} for x in "ABC"], [("A", "CALLS", "B"), ("B", "CALLS", "C"), ("C", "CALLS", "A")])
    assert all(r["entry"] not in {s["id"] for s in r["steps"]} for r in flows(ring))
    many = make(spark, [{"id": f"{k}{i}"} for i in range(6) for k in ("HandlerX", "ServiceX")], [(f"HandlerX{i}", "CALLS", f"ServiceX{i}") for i in range(6)])
    assert len(flows(many, limit=3)) == 3 and len(flows(many, text="x4")) == 1
    api = make(spark, [{"id": "fetchUser"}, {"id": "GetUser"}], [("fetchUser", "CALLS_API", "GetUser")])
    assert flows(api)[0]["steps"][0]["name"] == "GetUser"
    weak = make(spark, [{"id": "a"}, {"id": "b"}], [("a", "CALLS", "b", 0.4)])
    assert flows(weak) == []
    assert process.get_process(many, "handlerx2").first()["name"] == "HandlerX2"


def test_review(spark):
    g = tool_graph(spark)
    hunks = spark.createDataFrame([("internal/auth/token.go", 10, 2), ("internal/jwt/decode.go", 30, 1), ("internal/auth/middleware.go", 12, 0), ("new.go", 1, 1)], review.HUNKS)
    parts = review.review(g, hunks)
    assert {(r["id"], r["reason"]) for r in parts["changed"].collect()} == {("val", "modified"), ("jwt", "in_changed_file"), ("mid", "modified")}
    assert {(r["id"], r["depth"], r["via"]) for r in parts["affected"].collect()} == {("login", 1, "ValidateToken"), ("user", 2, "ValidateToken"), ("form", 2, "ValidateToken")}
    risk = parts["risk"].first()
    assert (risk["score"], risk["risk"]) == (3 + 6, "LOW")
    assert {r["file"]: r["risk"] for r in parts["files"].collect()}["new.go"] == "NEW"
    text = render.review_report(parts, "x")
    assert review.read_report(text) == {"risk": "LOW", "changed": ("4", "2"), "blast": "3"}


def test_diff_lines(spark):
    lines = ["diff --git a/x b/x", "+++ b/src/x.ts", "@@ -1,2 +3,4 @@ f()", "+a", "@@ -9 +12 @@", "+++ b/y.go", "@@ -1,3 +0,0 @@"]
    got = review.hunks_of_diff(spark.createDataFrame(list(enumerate(lines)), "n long, line string")).collect()
    assert [tuple(r) for r in got] == [("src/x.ts", 3, 4), ("src/x.ts", 12, 1), ("y.go", 0, 0)]


def test_rename(spark):
    g = make(
        spark,
        [{"id": "u", "type": "Struct", "name": "User", "file": "m.go", "start_line": 5}, {"id": "s", "type": "Method", "name": "Save", "file": "m.go", "start_line": 20}, {"id": "c", "name": "Make", "file": "a.go", "start_line": 7}, {"id": "o", "type": "Struct", "name": "User", "file": "z.go", "exported": False, "package": "old"}],
        [("u", "HAS_METHOD", "s"), ("c", "CALLS", "u"), ("c", "USES_TYPE", "u")],
    )
    got = [(r["file"], r["line"], r["confidence"], r["context"]) for r in rename.plan_rename(g, "User", "Account").collect()]
    assert got == [("m.go", 5, "graph", "definition"), ("a.go", 7, "graph", "called by Make"), ("m.go", 20, "graph", "method Save on User"), ("z.go", 1, "text_search", "same-name symbol in old")]
    with pytest.raises(InvalidParameter):
        rename.plan_rename(g, "User", "User")
    assert "**Total edits:** 4 (3 graph, 1 text_search)" in Engine(g).report("rename", "User", "Account")


def test_engine(spark):
    e = Engine(tool_graph(spark))
    assert "**9 symbols, 7 relationships**" in e.report("map")
    assert "**Found 1 result**" in e.report("find", "DecodeJWT")
    assert "Callers (2)" in e.report("explain", "ValidateToken")
    with pytest.raises(InvalidParameter):
        e.impact("DecodeJWT", "sideways")
    with pytest.raises(EmptyGraph):
        Engine(make(spark, [], [])).report("map")
    assert SymbolNotFound("x", []).to_json() == '{"error": "symbol_not_found", "message": "Symbol \'x\' not found", "symbol": "x", "suggestions": []}'


def test_nodes_on_cycles_by_brute_force(spark):
    import random

    rnd = random.Random(8)
    pairs = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(45)} | {(i, i + 1) for i in range(50, 60)} | {(60, 57), (70, 70)}
    reach = set(pairs)
    while more := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
        reach |= more
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "source_id string, target_id string")
    assert sorted(r.id for r in traversal.nodes_on_cycles(edges).collect()) == sorted(f"n{a}" for a, b in reach if a == b)


def test_paths_by_brute_force(spark):
    """The first paths of an entry, against a queue that takes one path at a time."""
    import random

    rnd = random.Random(4)
    names = [f"n{i}" for i in range(12)]
    calls = [(rnd.choice(names), "CALLS", rnd.choice(names)) for _ in range(40)]
    g = make(spark, [{"id": n} for n in names], calls)
    nexts = {}
    for r in process.calls(g).orderBy("edge_seq", "id").collect():
        nexts.setdefault(r.source_id, []).append(r.target_id)
    want = {}
    for start in names[:6]:
        queue, done = [[start]], []
        while queue and len(done) < process.PATHS_AN_ENTRY:
            path = queue.pop(0)
            on = [c for c in nexts.get(path[-1], [])[: process.BRANCHING] if c not in path] if len(path) < process.MAX_NODES else []
            if on:
                queue += [[*path, c] for c in on]
            elif len(path) >= process.LEAST_NODES:
                done.append(path)
        want[start] = done
    entries = spark.createDataFrame([(n, i) for i, n in enumerate(names[:6])], "id string, place int")
    got = {n: [] for n in names[:6]}
    for r in process.trace_paths(g, entries).orderBy("entry", "nth").collect():
        got[r.entry].append(r.path)
    assert got == want
    flow = process.detect_processes(g)
    inside = flow.first()["trace"][1]
    assert {(r.name, r.step) for r in process.participation(flow, inside).collect()} >= {(flow.first()["name"], 1)}
