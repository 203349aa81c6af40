"""Thin front ends of the engine: JSON over HTTP, and JSON-RPC over standard streams."""

from __future__ import annotations

import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

from . import render
from .engine import Engine
from .errors import GraphError, InvalidParameter
from .operators import lookup, review

#: Tools: name, what it answers, required and optional parameters.
TOOLS = {
    "map": ("Overview of languages, packages and critical symbols", (), ()),
    "find": ("Symbols by name, wildcard, property or words", ("query",), ("limit", "node_type", "language", "package")),
    "explain": ("A symbol's callers, callees and other neighbours", ("name",), ("file",)),
    "impact": ("What a change of a symbol reaches", ("target",), ("direction", "max_depth", "file")),
    "changes": ("Review of uncommitted or branch changes", (), ("scope", "base", "include_tests")),
    "rename": ("Edits that a new name needs", ("name", "new_name"), ("file",)),
    "export": ("Mermaid diagram of a part of the graph", (), ("symbol", "depth", "package", "types", "edge_types", "limit", "skip_files")),
    "rules": ("Dead code, unused exports, import cycles, large files, orphans", (), ("rule", "threshold")),
    "query": ("A graph pattern", ("text",), ()),
}
PROMPTS = {
    "pre_commit": ("Review my uncommitted changes before I commit", "Call changes with scope {scope}. Explain each modified symbol, follow the risky ones with impact, and report changes, reach, risk and what to test."),
    "architecture": ("Describe this code base's architecture", "Start from map and the stats resource, read rules for weak spots, explain the main entry points, and write an overview with a Mermaid diagram."),
    "onboard": ("Introduce a new developer to this code base", "Use map, then find 'entry point symbols' and explain the main ones; write what the project does, its parts, its main flows and a reading order."),
}


class Service:
    def __init__(self, engine: Engine, root: str = "."):
        self.engine, self.root = engine, root

    def tools(self) -> list[dict]:
        schema = lambda need, may: {"type": "object", "properties": {p: {} for p in (*need, *may)}, "required": list(need)}
        return [{"name": n, "description": what, "inputSchema": schema(need, may)} for n, (what, need, may) in TOOLS.items()]

    def call(self, name: str, args: dict | None = None) -> str:
        """A tool's text; an error a caller can act on is its JSON."""
        args = dict(args or {})
        try:
            if name not in TOOLS:
                raise InvalidParameter("tool", name, sorted(TOOLS))
            _, need, may = TOOLS[name]
            for p in need:
                if not args.get(p):
                    raise InvalidParameter(p, args.get(p, ""), [f"<{p}>"])
            if unknown := set(args) - {*need, *may}:
                raise InvalidParameter(sorted(unknown)[0], "", [*need, *may])
            if name == "changes":
                spark, scope = self.engine.graph.nodes.sparkSession, {k: args[k] for k in ("scope", "base") if k in args}
                hunks, files = review.git_diff(spark, self.root, **scope), review.changed_files(spark, self.root, **scope)
                return self.engine.report("changes", hunks, files, bool(args.get("include_tests")))
            return self.engine.report(name, *[args.pop(p) for p in need], **args)
        except GraphError as e:
            return e.to_json()

    def resources(self) -> dict:
        return {
            "resources": [{"uri": "graph://stats", "name": "Counts by type and language"}],
            "templates": [{"uriTemplate": "graph://symbol/{name}"}, {"uriTemplate": "graph://file/{path}"}],
        }

    def read(self, uri: str) -> str:
        """A resource's text; the part after the kind is percent-decoded."""
        kind, _, rest = uri.removeprefix("graph://").partition("/")
        rest, graph = unquote(rest), self.engine.graph
        if kind == "stats":
            return render.stats_yaml(graph)
        if kind == "symbol" and rest:
            node = lookup.resolve(graph, rest)
            return render.explain(node, lookup.explain(graph, node["id"]))
        if kind == "file" and rest:
            return render.table(lookup.file_symbols(graph, rest))
        raise KeyError(f"Unknown resource: {uri}")

    def prompt(self, name: str, args: dict | None = None) -> str:
        return PROMPTS[name][1].format(**{"scope": "unstaged"} | (args or {}))

    def graph_view(self, limit: int = 300, node_type: str | None = None, package: str | None = None) -> dict:
        part = lookup.top_degree(self.engine.graph, limit, node_type, package)
        nodes = part.nodes.select("id", "name", "type", "degree", "language", "file", "start_line", "end_line", "package", "exported", "community").collect()
        edges = part.edges.select("source_id", "target_id", "type").collect()
        totals = {r["what"]: r["n"] for r in self.engine.graph.counts().collect()}
        return {
            "nodes": [{"id": r["id"], "label": r["name"], "group": r["type"], "value": r["degree"] or 1} | {k: r[k] for k in ("language", "file", "package", "exported", "community")} | {"startLine": r["start_line"], "endLine": r["end_line"]} for r in nodes],
            "edges": [{"from": r["source_id"], "to": r["target_id"], "label": r["type"]} for r in edges],
            "stats": {"totalNodes": totals["nodes"], "totalEdges": totals["edges"], "shownNodes": len(nodes), "shownEdges": len(edges)},
        }


def http_server(service: Service, port: int = 3100, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server to run with serve_forever(); it listens on the local machine only."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            url = urlparse(self.path)
            given = {k: v[0] for k, v in parse_qs(url.query).items()}
            if url.path == "/api/health":
                totals = {r["what"]: r["n"] for r in service.engine.graph.counts().collect()}
                self.answer(200, {"status": "ok", "nodes": totals["nodes"], "relationships": totals["edges"], "tools": len(TOOLS)})
            elif url.path == "/api/tools":
                self.answer(200, {"tools": service.tools()})
            elif url.path == "/api/resources":
                self.answer(200, service.resources())
            elif url.path == "/api/resources/read":
                if "uri" not in given:
                    return self.answer(400, {"error": "Missing ?uri= query parameter"})
                try:
                    self.answer(200, {"uri": given["uri"], "content": service.read(given["uri"])})
                except (KeyError, GraphError) as e:
                    self.answer(404, {"error": str(e)})
            elif url.path == "/api/graph":
                limit = given.get("limit", "")
                self.answer(200, service.graph_view(int(limit) if limit.isdigit() and int(limit) else 300, given.get("type"), given.get("package")))
            else:
                self.answer(404, {"error": "Not found"})

        def do_POST(self) -> None:
            name = urlparse(self.path).path.removeprefix("/api/tools/")
            try:
                args = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                self.answer(200, {"result": service.call(name, args)})
            except Exception as e:  # a caller's mistake is its own answer
                self.answer(400, {"error": str(e)[:500]})

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def _rpc(service: Service, method: str, params: dict) -> dict:
    if method == "initialize":
        return {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}, "resources": {}, "prompts": {}}, "serverInfo": {"name": "graphloom", "version": "0.1.0"}}
    if method == "tools/list":
        return {"tools": service.tools()}
    if method == "tools/call":
        return {"content": [{"type": "text", "text": service.call(params["name"], params.get("arguments"))}]}
    if method == "resources/list":
        return {"resources": service.resources()["resources"]}
    if method == "resources/templates/list":
        return {"resourceTemplates": service.resources()["templates"]}
    if method == "resources/read":
        return {"contents": [{"uri": params["uri"], "text": service.read(params["uri"])}]}
    if method == "prompts/list":
        return {"prompts": [{"name": n, "description": d} for n, (d, _) in PROMPTS.items()]}
    if method == "prompts/get":
        return {"messages": [{"role": "user", "content": {"type": "text", "text": service.prompt(params["name"], params.get("arguments"))}}]}
    raise LookupError(method)


def stdio_server(service: Service, lines=sys.stdin, out=sys.stdout) -> None:
    """JSON-RPC 2.0, a message a line; notifications get no answer."""
    for line in lines:
        if not line.strip():
            continue
        message = json.loads(line)
        if "id" not in message:
            continue
        reply = {"jsonrpc": "2.0", "id": message["id"]}
        try:
            reply["result"] = _rpc(service, message["method"], message.get("params") or {})
        except LookupError as e:
            reply["error"] = {"code": -32601, "message": f"Unknown: {e}"}
        except Exception as e:
            reply["error"] = {"code": -32000, "message": str(e)[:500]}
        print(json.dumps(reply), file=out, flush=True)
