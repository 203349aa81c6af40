"""The tools of the engine on one graph: map, find, explain, impact, changes, rename, export, rules, query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import render
from .errors import EmptyGraph, InvalidParameter
from .graph import CodeGraph
from .operators import export, lookup, process, rename, review, rules, traversal
from .plans import pattern
from .sources import graph_store
from .storage import staged


class Engine:
    """Each tool returns DataFrames; `report(tool, …)` gives its text."""

    TOOLS = ("map", "find", "explain", "impact", "changes", "rename", "export", "rules", "query", "processes")

    def __init__(self, graph: CodeGraph):
        self.graph = graph
        self._flows: DataFrame | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Engine:
        return cls(graph_store.load(spark, path))

    def check(self) -> None:
        if self.graph.nodes.isEmpty():
            raise EmptyGraph()

    def query(self, text: str, default_limit: int = pattern.DEFAULT_LIMIT) -> DataFrame:
        return pattern.run(text, self.graph, default_limit)

    def find(self, query: str, **options) -> DataFrame:
        return lookup.find(self.graph, query, **options)

    def flows(self) -> DataFrame:
        """All flows of the graph, traced once and written down."""
        if self._flows is None:
            self._flows = staged(process.detect_processes(self.graph))
        return self._flows

    def explain(self, name: str, file: str | None = None) -> DataFrame:
        return lookup.explain(self.graph, lookup.resolve(self.graph, name, file)["id"])

    def impact(self, target: str, direction: str = "upstream", max_depth: int = 3, file: str | None = None) -> DataFrame:
        if direction not in ("upstream", "downstream"):
            raise InvalidParameter("direction", direction, ["upstream", "downstream"])
        node = lookup.resolve(self.graph, target, file)
        return traversal.impact(self.graph, node["id"], direction, max_depth or 3)

    def changes(self, hunks: DataFrame, files: DataFrame | None = None, include_tests: bool = False) -> dict[str, DataFrame]:
        return review.review(self.graph, hunks, files, include_tests)

    def rename(self, name: str, new_name: str, file: str | None = None) -> DataFrame:
        return rename.plan_rename(self.graph, name, new_name, file)

    def export(self, **options) -> CodeGraph:
        return export.subgraph(self.graph, **options)

    def rules(self, rule: str | None = None, threshold: int = 30) -> DataFrame:
        if rule is None:
            return rules.run_all(self.graph, threshold)
        if rule not in rules.RULES:
            raise InvalidParameter("rule", rule, sorted(rules.RULES))
        return rules.RULES[rule](self.graph, threshold) if rule == "large_files" else rules.RULES[rule](self.graph)

    def processes(self, limit: int = 75, text: str | None = None) -> DataFrame:
        return process.detect_processes(self.graph, limit, text)

    def report(self, tool: str, *args, **options) -> str:
        self.check()
        if tool == "map":
            return render.overview(self.graph)
        if tool == "query":
            return render.query(args[0], self.graph)
        if tool == "find":
            return render.found(self.find(*args, **options))
        if tool == "explain":
            node = lookup.resolve(self.graph, *args)
            return render.explain(node, lookup.explain(self.graph, node["id"]), process.participation(self.flows(), node["id"]))
        if tool == "impact":
            node = lookup.resolve(self.graph, args[0], options.get("file"))
            direction = options.get("direction", "upstream")
            return render.impact(node, direction, self.impact(*args, **options))
        if tool == "changes":
            return render.review_report(self.changes(*args, **options))
        if tool == "rename":
            return render.rename(self.rename(*args, **options))
        if tool == "export":
            return render.mermaid(self.export(**options))
        if tool == "rules":
            return render.rules(self.rules(**options) if not args else self.rules(*args, **options))
        raise InvalidParameter("tool", tool, list(self.TOOLS))
