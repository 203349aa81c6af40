"""Small graphs with known answers."""

from __future__ import annotations

from graphloom.graph import CodeGraph

N = "node_seq long, id string, type string, name string, file string, start_line int, end_line int, language string, package string, exported boolean, is_test boolean, receiver string, community string"
E = "edge_seq long, id string, type string, source_id string, target_id string, confidence double"


def make(spark, nodes, edges) -> CodeGraph:
    """nodes: dicts with id; edges: (source, type, target[, confidence])."""
    rows = []
    for k, n in enumerate(nodes):
        d = {"type": "Function", "name": n["id"], "file": "a.go", "start_line": 1, "end_line": 10, "language": "go", "package": "p", "exported": True, "is_test": False, "receiver": None, "community": None} | n
        rows.append((k, d["id"], d["type"], d["name"], d["file"], d["start_line"], d["end_line"], d["language"], d["package"], d["exported"], d["is_test"], d["receiver"], d["community"]))
    links = [(k, f"{e[0]}-{e[1]}-{e[2]}", e[1], e[0], e[2], e[3] if len(e) > 3 else 1.0) for k, e in enumerate(edges)]
    return CodeGraph.of(spark.createDataFrame(rows, N), spark.createDataFrame(links, E))


def query_graph(spark):
    auth = {"package": "internal/auth", "file": "internal/auth/handler.go"}
    types = {"package": "internal/auth", "file": "internal/auth/types.go"}
    nodes = [
        {"id": "pkg", "type": "Package", "name": "auth", "file": "internal/auth", "start_line": 0, "end_line": 0, "package": "internal/auth"},
        {"id": "validate", "name": "ValidateToken", "start_line": 10, "end_line": 30} | auth,
        {"id": "parse", "name": "parseHeader", "start_line": 35, "end_line": 50, "exported": False} | auth,
        {"id": "main", "name": "main", "file": "cmd/server/main.go", "start_line": 5, "end_line": 20, "package": "cmd/server", "exported": False},
        {"id": "config", "type": "Struct", "name": "Config", "start_line": 5, "end_line": 15} | types,
        {"id": "vmethod", "type": "Method", "name": "Validate", "start_line": 20, "end_line": 30, "receiver": "Config"} | types,
        {"id": "animal", "type": "Class", "name": "Animal", "file": "models.py", "language": "python", "package": ""},
        {"id": "dog", "type": "Class", "name": "Dog", "file": "models.py", "start_line": 12, "end_line": 20, "language": "python", "package": ""},
        {"id": "iface", "type": "Interface", "name": "Authenticator", "start_line": 35, "end_line": 45} | types,
    ]
    edges = [("main", "CALLS", "validate"), ("validate", "CALLS", "parse"), ("config", "HAS_METHOD", "vmethod"), ("config", "IMPLEMENTS", "iface", 0.9), ("dog", "EXTENDS", "animal", 0.9)]
    return make(spark, nodes, edges)


def tool_graph(spark):
    nodes = [
        {"id": "pkg:auth", "type": "Package", "name": "auth", "file": "", "start_line": 0, "package": "internal/auth"},
        {"id": "pkg:jwt", "type": "Package", "name": "jwt", "file": "", "start_line": 0, "package": "internal/jwt"},
        {"id": "mid", "name": "AuthMiddleware", "file": "internal/auth/middleware.go", "start_line": 10, "end_line": 30, "package": "internal/auth"},
        {"id": "val", "name": "ValidateToken", "file": "internal/auth/token.go", "start_line": 5, "end_line": 25, "package": "internal/auth"},
        {"id": "jwt", "name": "DecodeJWT", "file": "internal/jwt/decode.go", "end_line": 20, "package": "internal/jwt"},
        {"id": "login", "name": "LoginHandler", "file": "apps/api/handler/login.go", "start_line": 15, "end_line": 45, "package": "apps/api/handler"},
        {"id": "user", "name": "UserService", "file": "apps/api/service/user.go", "start_line": 10, "end_line": 50, "package": "apps/api/service"},
        {"id": "page", "type": "Component", "name": "LoginPage", "file": "apps/web/src/pages/LoginPage.tsx", "start_line": 5, "end_line": 40, "language": "typescript", "package": "web"},
        {"id": "form", "type": "Component", "name": "LoginForm", "file": "apps/web/src/components/LoginForm.tsx", "end_line": 60, "language": "typescript", "package": "web"},
    ]
    edges = [
        ("mid", "CALLS", "val"), ("val", "CALLS", "jwt"), ("login", "CALLS", "val"), ("user", "CALLS", "login"),
        ("page", "USES_COMPONENT", "form"), ("form", "CALLS_API", "login"), ("pkg:auth", "IMPORTS", "pkg:jwt"),
    ]
    return make(spark, nodes, edges)
