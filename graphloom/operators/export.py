"""Subgraphs for export and their Mermaid text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import mermaid_id
from ..graph import CodeGraph
from .traversal import ego

STRUCTURAL = ("CONTAINS", "DEFINES")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    own = nodes.select(F.col("id").alias("source_id"))
    return edges.join(own, "source_id", "left_semi").join(own.select(F.col("source_id").alias("target_id")), "target_id", "left_semi")


def subgraph(
    graph: CodeGraph,
    *,
    symbol: str | None = None,
    depth: int = 2,
    package: str | None = None,
    types: list[str] | None = None,
    edge_types: list[str] | None = None,
    limit: int = 50,
    skip_files: bool = True,
) -> CodeGraph:
    """Filtered nodes, nearest to the symbol first, then in graph order; edges among them, structural ones on request."""
    if symbol:
        nodes = graph.nodes.join(ego(graph, symbol, depth), "id")
    else:
        nodes = graph.nodes.withColumn("depth", F.lit(0))
    nodes = nodes.where("type <> 'Package'")
    nodes = nodes.where("type <> 'File'") if skip_files else nodes
    nodes = nodes.where(F.lower("package").contains(package.lower())) if package else nodes
    nodes = nodes.where(F.col("type").isin(*types)) if types else nodes
    nodes = nodes.orderBy("depth", "node_seq", "id").limit(limit)
    edges = graph.edges.where(F.col("type").isin(*edge_types)) if edge_types else graph.edges.where(~F.col("type").isin(*STRUCTURAL))
    return CodeGraph(nodes, induced(edges, nodes))


def mermaid_lines(graph: CodeGraph) -> DataFrame:
    """(part, seq, id, line): one line a node and an edge, as the renderer joins them."""
    label = {"CALLS": "-->|CALLS|", "CALLS_API": "-->|CALLS_API|", "EXTENDS": "-.->|EXTENDS|", "IMPLEMENTS": "-.->|IMPLEMENTS|", "IMPORTS": "-->|imports|", "HAS_METHOD": "-->|has|"}
    arrow = F.lit("-->")
    for t, text in label.items():
        arrow = F.when(F.col("type") == t, F.lit(text)).otherwise(arrow)
    nodes = graph.nodes.select(
        F.lit("node").alias("part"), F.col("node_seq").alias("seq"), "id",
        F.concat(mermaid_id("id"), F.lit('["'), "name", F.lit('"]')).alias("line"),
    )
    edges = graph.edges.select(
        F.lit("edge").alias("part"), F.col("edge_seq").alias("seq"), "id",
        F.concat_ws(" ", mermaid_id("source_id"), arrow, mermaid_id("target_id")).alias("line"),
    )
    return nodes.unionByName(edges)
