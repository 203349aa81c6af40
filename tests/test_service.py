"""HTTP and JSON-RPC front ends."""

import io
import json
import threading
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pytest

from graphloom.engine import Engine
from graphloom.service import Service, http_server, stdio_server

from .graphs import tool_graph


@pytest.fixture(scope="module")
def service(spark):
    return Service(Engine(tool_graph(spark)))


def test_tools(service):
    assert "**Found 1 result**" in service.call("find", {"query": "DecodeJWT"})
    assert json.loads(service.call("impact", {}))["error"] == "invalid_parameter"
    assert json.loads(service.call("impact", {"target": "nope"}))["error"] == "symbol_not_found"
    assert json.loads(service.call("dance"))["parameter"] == "tool"
    assert json.loads(service.call("find", {"query": "x", "colour": 1}))["parameter"] == "colour"
    assert "node_type:" in service.read("graph://stats")
    assert "LoginHandler" in service.read("graph://symbol/Login%48andler")
    assert "scope staged" in service.prompt("pre_commit", {"scope": "staged"})


def test_http(service):
    server = http_server(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    get = lambda path: json.load(urlopen(base + path))
    assert get("/api/health") == {"status": "ok", "nodes": 9, "relationships": 7, "tools": 9}
    assert len(get("/api/tools")["tools"]) == 9
    view = get("/api/graph?limit=3")
    assert view["stats"] == {"totalNodes": 9, "totalEdges": 7, "shownNodes": 3, "shownEdges": 2}
    assert {n["label"] for n in view["nodes"]} == {"ValidateToken", "LoginHandler", "LoginForm"}
    assert get("/api/graph?package=jwt")["stats"]["shownNodes"] == 2
    assert "language:" in get("/api/resources/read?uri=graph://stats")["content"]
    post = Request(base + "/api/tools/find", json.dumps({"query": "Login*", "limit": 2}).encode(), method="POST")
    assert "**Found 2 results**" in json.load(urlopen(post))["result"]
    for path, status in (("/api/nothing", 404), ("/api/resources/read", 400), ("/api/resources/read?uri=graph://x", 404)):
        with pytest.raises(HTTPError) as e:
            get(path)
        assert e.value.code == status
    server.shutdown()


def test_stdio(service):
    ask = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "explain", "arguments": {"name": "DecodeJWT"}}}, {"id": 4, "method": "nothing"},
        {"id": 5, "method": "prompts/get", "params": {"name": "onboard"}},
    ]
    out = io.StringIO()
    stdio_server(service, [json.dumps(m) for m in ask], out)
    got = {m["id"]: m for m in map(json.loads, out.getvalue().splitlines())}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert len(got[2]["result"]["tools"]) == 9 and "Callers (1)" in got[3]["result"]["content"][0]["text"]
    assert got[4]["error"]["code"] == -32601
