"""Storage, scanning, extraction, linking and streams."""

import json
import random
import time

from pyspark.sql import functions as F

from graphloom import config
from graphloom.operators import linking, search
from graphloom.sources import extract, graph_store, index_store, scan
from graphloom.streaming import watch

from .graphs import make, query_graph, tool_graph

MODELS = '''import os
from typing import List

class Animal:
    def speak(self):
        return helper()

class Dog(Animal):
    @property
    def kind(self):
        return os.name

def create_dog():
    return Dog()

def _private_helper(): pass
'''
MAIN = "from models import Dog\n\ndef run():\n    create_dog()\n"
APP = "import { Button } from './button';\nexport function App() {\n  return <Button />;\n}\n"
BUTTON = "export const Button = (p: any) => {\n  return p;\n};\nexport interface Props {}\n"


def tree(tmp_path):
    for name, text in {"models.py": MODELS, "main.py": MAIN, "src/app.tsx": APP, "src/button.tsx": BUTTON, "bad.py": "def (", "node_modules/x.ts": "x", ".git/y.py": "y", "notes.md": "z"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    return str(tmp_path)


def test_scan_and_extract(spark, tmp_path):
    files = scan.scan_sources(spark, tree(tmp_path))
    assert {(r["file"], r["language"]) for r in files.collect()} == {("models.py", "python"), ("main.py", "python"), ("bad.py", "python"), ("src/app.tsx", "typescript"), ("src/button.tsx", "typescript")}
    rows = extract.extract(files)
    names = {(r["file"], r["name"], r["type"], r["exported"]) for r in rows.where("kind = 'symbol'").collect()}
    assert {("models.py", "Animal", "Class", True), ("models.py", "speak", "Method", True), ("models.py", "_private_helper", "Function", False), ("src/app.tsx", "App", "Component", True), ("src/button.tsx", "Props", "Interface", True)} <= names
    assert [r["file"] for r in rows.where("kind = 'error'").collect()] == ["bad.py"]
    assert {r["language"]: r["failed"] for r in extract.extraction_stats(rows).collect()} == {"python": 1, "typescript": 0}


def test_build_graph(spark, tmp_path):
    g = extract.build_graph(scan.scan_sources(spark, tree(tmp_path)))
    by_id = {r["id"]: r["name"] for r in g.nodes.collect()}
    got = {(r["type"], by_id.get(r["source_id"]), by_id.get(r["target_id"]), r["confidence"]) for r in g.edges.where("type <> 'DEFINES'").collect()}
    assert ("EXTENDS", "Dog", "Animal", 0.9) in got
    assert ("HAS_METHOD", "Animal", "speak", 1.0) in got and ("HAS_METHOD", "Dog", "kind", 1.0) in got
    assert ("CALLS", "run", "create_dog", 0.4) in got
    assert ("USES_COMPONENT", "App", "Button", 0.9) in got
    assert ("IMPORTS", "src/app.tsx", "src/button.tsx", 1.0) in got


def test_links_of_a_web_tree(spark, tmp_path):
    """Confidences, re-exports, barrels, type arguments, routes and aliases, from files to edges."""
    sources = {
        "tsconfig.json": '{"extends": "./base", "compilerOptions": {"strict": true}}',
        "base.json": '{"compilerOptions": {"paths": {"~/*": ["web/*"]}}}',
        "web/user.ts": "interface User {\n}\nfunction helper() {\n  return 1;\n}\nfunction local() {\n  return helper();\n}\nexport { User, helper as aid };\n",
        "web/index.ts": "export { User } from './user';\nexport * from './other';\n",
        "web/other.ts": "export function other() {\n  return 2;\n}\n",
        "web/api.ts": 'export const API = {\n  one: (id: string) => `/api/v1/users/${id}`,\n};\n',
        "app.ts": "import { User } from '~/index';\nimport { other } from './web/other';\nexport function load() {\n  other();\n  return api.get<Promise<User>>(API.one(id));\n}\n",
        "server.go": 'package main\nfunc Setup(app) {\n\tv1.Get("/users/:id", h.GetUser)\n}\nfunc GetUser() {\n}\n',
        "skip/no.ts": "export function no() {\n}\n",
    }
    for name, text in sources.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    aliases = config.tsconfig_aliases(str(tmp_path))
    assert aliases == {"~/": "web/"}
    g = extract.build_graph(scan.scan_sources(spark, str(tmp_path), ignore=("skip",)), aliases)
    nodes = {r["id"]: r for r in g.nodes.collect()}
    got = {(r["type"], nodes[r["source_id"]]["name"], nodes[r["target_id"]]["name"], r["confidence"]) for r in g.edges.where("type <> 'DEFINES'").collect()}
    assert ("CALLS", "local", "helper", 0.7) in got and ("CALLS", "load", "other", 1.0) in got
    assert ("IMPORTS", "web/index.ts", "web/user.ts", 1.0) in got and ("IMPORTS", "web/index.ts", "web/other.ts", 1.0) in got
    assert ("IMPORTS", "app.ts", "web/index.ts", 1.0) in got and ("IMPORTS", "app.ts", "web/user.ts", 0.9) in got
    assert ("USES_TYPE", "load", "User", 0.8) in got
    assert ("CALLS_API", "load", "GetUser", 0.6) in got and ("CALLS_API", "web/api.ts", "GetUser", 0.6) in got
    assert {n["name"] for n in nodes.values() if n["exported"]} >= {"User", "helper", "load"} and "no" not in {n["name"] for n in nodes.values()}
    (api,) = g.edges.where("type = 'CALLS_API' AND source_id LIKE 'ts:%'").collect()
    assert (api["metadata"]["http_method"], api["metadata"]["url_pattern"]) == ("GET", "/api/v1/users/:id")


def test_block_of_a_long_declaration():
    lines = ["function f() {", *["  x();"] * 6000, "}", "y();"]
    assert extract._block_end(lines, 0) == 6002


def test_enclosing_narrowest_and_first(spark):
    s = spark.createDataFrame([(1, "outer", "f", 1, 100), (2, "inner", "f", 10, 20), (3, "other", "g", 1, 100)], "seq long, id string, file string, start_line int, end_line int")
    points = spark.createDataFrame([("f", 15), ("f", 50), ("f", 200)], "file string, line int")
    assert {(r["line"], r["source_id"]) for r in linking.enclosing(points, s).collect()} == {(15, "inner"), (50, "outer")}
    assert {(r["line"], r["source_id"]) for r in linking.enclosing(points, s, narrowest=False).collect()} == {(15, "outer"), (50, "outer")}


def test_imports_and_barrels(spark):
    imports = spark.createDataFrame([("src/a/x.ts", "./y", ["y"]), ("src/a/x.ts", "../lib", ["Z"]), ("src/a/x.ts", "@/util", []), ("src/a/x.ts", "react", [])], "file string, source string, names array<string>")
    files = spark.createDataFrame([("src/a/y.tsx",), ("src/lib/index.ts",), ("src/util.ts",), ("src/lib/z.ts",)], "file string")
    got = linking.resolve_imports(imports, files)
    assert {(r["source"], r["target"]) for r in got.collect()} == {("./y", "src/a/y.tsx"), ("../lib", "src/lib/index.ts"), ("@/util", "src/util.ts")}
    out = spark.createDataFrame([("src/lib/index.ts", "src/lib/z.ts", ["Z"])], "file string, target string, names array<string>")
    assert [(r["file"], r["target"], r["confidence"]) for r in linking.expand_barrels(got, out).collect()] == [("src/a/x.ts", "src/lib/z.ts", 0.9)]


def test_routes(spark):
    lines = ["func Setup(app) {", 'v1.Get("/users/:id", h.GetUser)', "}", "func registerAdminRoutes(a) {", 'a.Delete("/users/:id", mw, h.DropUser)', "}"]
    routes = extract.go_routes(spark.createDataFrame([("router.go", i, x) for i, x in enumerate(lines)], "file string, n int, line string"))
    assert {(r["method"], r["normalized"], r["handler"]) for r in routes.collect()} == {("GET", "users/*", "GetUser"), ("DELETE", "admin/users/*", "DropUser")}
    text = 'export const API = { list: "/api/v1/users", one: (id: string) => `/api/v1/users/${id}` }'
    constants = extract.api_constants(spark.createDataFrame([("api.ts", text)], "file string, content string"))
    assert {(r["key"], r["normalized"]) for r in constants.collect()} == {("list", "users"), ("one", "users/*")}
    calls = constants.select(F.lit("hook").alias("caller_id"), F.lit(None).cast("string").alias("method"), "pattern")
    handlers = spark.createDataFrame([(1, "f1", "GetUser", "Function"), (2, "m1", "GetUser", "Method")], "seq long, id string, name string, type string")
    (edge,) = linking.link_routes(routes, calls, handlers).collect()
    assert (edge["source_id"], edge["target_id"], edge["confidence"], edge["metadata"]["http_method"]) == ("hook", "m1", 0.6, "GET")


def test_parquet_and_json_round_trip(spark, tmp_path):
    g = query_graph(spark)
    graph_store.save(g, str(tmp_path / "g"))
    back = graph_store.load(spark, str(tmp_path / "g"))
    assert sorted(back.nodes.collect()) == sorted(g.nodes.collect())
    assert back.edges.count() == 5
    doc = {"nodes": [{"id": "a", "type": "Function", "name": "f", "file": "x.ts", "startLine": 3, "endLine": 9, "exported": True}], "relationships": [{"id": "e", "type": "CALLS_API", "sourceId": "a", "targetId": "b", "confidence": 0.9, "metadata": {"httpMethod": "GET", "urlPattern": "/u"}}]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    j = graph_store.load_json(spark, str(tmp_path / "g.json"), "r")
    assert (j.nodes.first()["start_line"], j.nodes.first()["repo"], j.edges.first()["metadata"]["url_pattern"]) == (3, "r", "/u")
    graph_store.save_json(j, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/relationships")).first()["sourceId"] == "a"


def test_upsert_delete_merge(spark):
    g = tool_graph(spark)
    new = g.nodes.where("id = 'jwt'").withColumn("name", F.lit("Decode"))
    merged = graph_store.upsert(g.nodes, new)
    assert merged.count() == 9 and merged.where("id = 'jwt'").first()["name"] == "Decode"
    gone = spark.createDataFrame([("internal/auth/token.go",)], "file string")
    left = graph_store.remove_files(g, gone)
    assert left.nodes.count() == 8 and {r["id"] for r in left.edges.collect()} == {"user-CALLS-login", "page-USES_COMPONENT-form", "form-CALLS_API-login", "pkg:auth-IMPORTS-pkg:jwt"}
    both = graph_store.merge_repos({"a": g, "b": g})
    assert both.nodes.select("id").distinct().count() == 18
    assert {(r["repo"], r["nodes"], r["edges"]) for r in graph_store.repo_catalog(both).collect()} == {("a", 9, 7), ("b", 9, 7)}
    meta = graph_store.set_meta(spark, graph_store.set_meta(spark, None, a="1", b="2"), b="3")
    assert {(r["key"], r["value"]) for r in meta.collect()} == {("a", "1"), ("b", "3")}


def test_compare_and_carry_over(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "file string, hash string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "file string, hash string")
    status = scan.compare(old, now)
    assert {(r["file"], r["status"]) for r in status.collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "deleted"), ("d", "new")}
    previous = make(spark, [{"id": "a1", "file": "a"}, {"id": "b1", "file": "b"}, {"id": "c1", "file": "c"}], [("a1", "CALLS", "b1"), ("a1", "CALLS", "c1")])
    new = make(spark, [{"id": "b1", "file": "b", "name": "fresh"}], [])
    g = scan.carry_over(previous, new, status)
    assert {r["id"] for r in g.nodes.collect()} == {"a1", "b1"} and [r["id"] for r in g.edges.collect()] == ["a1-CALLS-b1"]


def test_tech_stack(spark):
    files = spark.createDataFrame([("x/package.json", '{"dependencies": {"react": "1"}}'), ("Dockerfile", "FROM x")], "file string, content string")
    assert [r["name"] for r in scan.tech_stack(files).collect()] == ["Docker", "React"]
    more = spark.createDataFrame([("requirements.txt", "Flask==3"), ("pyproject.toml", "django"), (".github/workflows/ci.yml", "x")], "file string, content string")
    assert [r["name"] for r in scan.tech_stack(more).collect()] == ["Flask", "GitHub Actions"]


def test_file_functions(spark):
    from graphloom.functions import columns as c

    files = ["src/a/b.ts", "src/x.tsx", "lib/y.py", "src/z.test.ts", "src/q.d.ts", "a/test/b.go", "m.kts"]
    df = spark.createDataFrame([(f,) for f in files], "file string")
    got = {r["file"]: tuple(r)[1:] for r in df.select("file", c.ts_package("file"), c.is_watched("file"), c.is_test_file("file", "extractor"), c.file_language("file")).collect()}
    assert got["src/a/b.ts"] == ("a", True, False, "typescript") and got["src/x.tsx"][0] == "root" and got["lib/y.py"] == ("root", True, False, "python")
    assert got["src/z.test.ts"][1:3] == (False, True) and not got["src/q.d.ts"][1] and got["a/test/b.go"][2] and got["m.kts"][1:] == (False, False, "kotlin")


def test_visibility_by_language():
    def names(language, text):
        return {r["name"]: r["exported"] for r in extract.pattern_rows(language, "f", text) if r["kind"] == "symbol"}

    assert names("java", "public class A {\n  private void b() {\n  }\n}\nclass C {\n}") == {"A": True, "b": False, "C": True}
    assert names("rust", "pub fn a() {}\nfn b() {}\npub(crate) struct C {}") == {"a": True, "b": False, "C": True}
    assert names("go", "func Do() {\n}\nfunc (s *S) run() {\n}") == {"Do": True, "run": False}
    assert names("kotlin", "private fun a() {}\nfun b() {}") == {"a": False, "b": True}
    assert names("ruby", "class A < B\n  def _x\n  end\nend") == {"A": True, "_x": False}
    assert names("php", "class A {\n    private function b() {\n    }\n}") == {"A": True, "b": False}


def test_watcher_stream(spark, tmp_path):
    g = make(spark, [{"id": "caller", "file": "main.py"}, {"id": "old", "name": "work", "file": "lib.py"}, {"id": "x", "file": "gone.py"}], [("caller", "CALLS", "old"), ("caller", "CALLS", "x")])
    fresh = make(spark, [{"id": "new", "name": "work", "file": "lib.py"}, {"id": "helper", "file": "lib.py"}], [("new", "CALLS", "helper")])
    saved = []
    watcher = watch.Watcher(g, lambda files: fresh, saved.append)
    events = [("2024-01-01 00:00:00", "lib.py", "add"), ("2024-01-01 00:00:01", "lib.py", "change"), ("2024-01-01 00:00:00", "gone.py", "unlink"), ("2024-01-01 01:00:00", "flush.py", "unlink")]
    source = str(tmp_path / "events")
    spark.createDataFrame(events, "ts string, file string, event string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(watch.EVENTS).parquet(source)
    query = watcher.start(stream, str(tmp_path / "cp"), every="0 seconds")
    query.processAllAvailable()
    query.stop()
    assert {r["id"] for r in watcher.graph.nodes.collect()} == {"caller", "new", "helper"}
    assert {(r["source_id"], r["target_id"], r["confidence"]) for r in watcher.graph.edges.collect()} == {("caller", "new", 0.7), ("new", "helper", 1.0)}
    assert watcher.status.updates == 2 and not saved


def test_debounce_on_a_table(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00", "add"), ("a", "2024-01-01 00:00:01", "change"), ("a", "2024-01-01 00:00:05", "unlink")], "file string, ts string, event string")
    got = watch.debounce(rows.withColumn("ts", F.col("ts").cast("timestamp"))).orderBy("start").collect()
    assert [(r["events"], r["last_event"]) for r in got] == [(2, "change"), (1, "unlink")]


def test_saved_index_and_vectors(spark, tmp_path):
    docs = spark.createDataFrame([("a", 1, ["red", "bolt"]), ("b", 2, ["red", "red", "nut"]), ("c", 3, ["blue"])], "id string, seq long, tokens array<string>")
    index_store.save_index(docs, str(tmp_path / "index"))
    index, stats = index_store.load_index(spark, str(tmp_path / "index"))
    assert search.bm25(index, stats, "red nut").collect() == search.bm25_scan(docs, "red nut").collect()
    empty = index_store.Vectors(spark, str(tmp_path / "vectors"))
    assert empty.size() == 0 and not empty.has("a")
    rows = lambda *r: spark.createDataFrame(r, "id string, embedding array<double>")
    one = empty.add(rows(("a", [1.0, 0.0]), ("b", [0.0, 1.0])))
    two = one.add(rows(("b", [1.0, 0.0]), ("c", [0.0, 1.0])))
    assert one.size() == 2 and two.size() == 3 and two.has("c") and not one.has("c")
    assert sorted(r.id for r in two.ids().collect()) == ["a", "b", "c"]
    assert [r.id for r in two.nearest([1.0, 0.1], 2).collect()] == ["a", "b"]


def test_embedding_of_a_batch_is_that_of_each():
    texts = ["a b a", "", None, "B c"]
    both = search.hashed_vectors(texts, 16)
    assert all((both[i] == search.hashed_vectors([t], 16)[0]).all() for i, t in enumerate(texts))
    assert abs((both[0] ** 2).sum() - 1) < 1e-12 and not both[1].any()


def test_watcher_saves_by_count_or_time(spark, monkeypatch):
    g, saved = tool_graph(spark), []
    w = watch.Watcher(g, lambda files: g, saved.append)
    monkeypatch.setattr(watch, "apply_changes", lambda graph, changes, extracted: graph)
    batch = lambda n: spark.createDataFrame([(f"f{i}", "change") for i in range(n)], "file string, last_event string")
    w.on_batch(batch(2))
    assert not saved and w.status.unsaved == 2
    monkeypatch.setattr(w, "SAVE_SECONDS", 0)
    w.on_batch(batch(0))
    assert len(saved) == 1 and w.status.unsaved == 0
    w.on_batch(batch(0))
    assert len(saved) == 1


def test_enclosing_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, f"s{i}", f"f{rng.randrange(3)}", a := rng.choice([rng.randrange(-80, 900), 8 ** rng.randrange(4)]), a + rng.choice([-1, 0, 7, 8, 63, 64, rng.randrange(700), 10**6])) for i in range(300)]
    points = [(f"f{rng.randrange(4)}", rng.randrange(-100, 1200)) for _ in range(600)] + [("f0", 2**31 - 1), ("f0", -(2**31)), (None, 5), ("f0", None)]
    s = spark.createDataFrame([*rows, (300, "whole", "f0", -(2**31), 2**31 - 1), (301, "none", "f1", None, 9)], "seq long, id string, file string, start_line int, end_line int")
    rows.append((300, "whole", "f0", -(2**31), 2**31 - 1))
    p = spark.createDataFrame(points, "file string, line int")
    for narrowest in (True, False):
        want = {}
        for file, line in points:
            around = [((e - a, n) if narrowest else n, i) for n, i, f, a, e in rows if f == file and line is not None and a <= line <= e]
            if around:
                want[file, line] = min(around)[1]
        got = [((r["file"], r["line"]), r["source_id"]) for r in linking.enclosing(p, s, narrowest).collect()]
        assert len(got) == len(want) and dict(got) == want


def test_enclosing_of_a_large_file_takes_no_time_by_its_square(spark):
    n = 300_000
    s = spark.range(n).selectExpr("id AS seq", "concat('s', id) AS id", "'f' AS file", "CAST(10 * id AS INT) AS start_line", "CAST(10 * id + 8 AS INT) AS end_line")
    points = spark.range(3 * n).selectExpr("'f' AS file", "CAST(4 * id AS INT) AS line")
    plan = linking.enclosing(points, s)
    began = time.time()
    got = plan.agg(F.count("*").alias("n"), F.sum((F.concat(F.lit("s"), (F.col("line") / 10).cast("long")) == F.col("source_id")).cast("long")).alias("right")).first()
    want = sum(4 * i % 10 <= 8 and 4 * i < 10 * n for i in range(3 * n))
    assert (got["n"], got["right"]) == (want, want) and time.time() - began < 60
