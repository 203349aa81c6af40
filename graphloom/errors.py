"""Errors that a caller can act on; each renders as JSON."""

from __future__ import annotations

import json


class GraphError(Exception):
    code = "error"

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.message, self.details = message, details

    def to_json(self) -> str:
        return json.dumps({"error": self.code, "message": self.message} | self.details)


class SymbolNotFound(GraphError):
    code = "symbol_not_found"

    def __init__(self, name: str, suggestions: list[str]):
        super().__init__(f"Symbol '{name}' not found", symbol=name, suggestions=suggestions)


class AmbiguousSymbol(GraphError):
    code = "ambiguous_symbol"

    def __init__(self, name: str, found: list[tuple[str, str]]):
        super().__init__(f"Symbol '{name}' is ambiguous", symbol=name, candidates=[{"name": n, "file": f} for n, f in found])


class InvalidParameter(GraphError):
    code = "invalid_parameter"

    def __init__(self, name: str, value, allowed: list[str]):
        super().__init__(f"Invalid {name}: {value!r}", parameter=name, allowed=allowed)


class IndexStale(GraphError):
    code = "index_stale"

    def __init__(self, indexed: str, current: str):
        super().__init__("The index is older than the sources", indexed=indexed, current=current)


class EmptyGraph(GraphError):
    code = "empty_graph"

    def __init__(self):
        super().__init__("The graph has no nodes; index the sources first")
