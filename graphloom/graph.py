"""The graph container: a vertex and an edge table, and the lookups on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import EDGE_SCHEMA, NODE_SCHEMA
from .storage import staged


def _conformed(df: DataFrame, schema) -> DataFrame:
    """df with all columns of schema; those it lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


@dataclass(frozen=True)
class CodeGraph:
    """nodes and edges; ids are unique in each, and (seq, id) is the order that limits follow."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame) -> CodeGraph:
        return CodeGraph(_conformed(nodes, NODE_SCHEMA), _conformed(edges, EDGE_SCHEMA))

    def staged(self) -> CodeGraph:
        """The graph written down, for algorithms that read it again and again."""
        return CodeGraph(staged(self.nodes), staged(self.edges))

    # Lookups: filters that reach the scan.

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def by_name(self, name: str) -> DataFrame:
        return self.nodes.where(F.lower("name") == name.lower())

    def select(self, **equals) -> DataFrame:
        """Nodes that equal all given columns, None being no condition: type, language, exported, file, repo, package."""
        found = self.nodes
        for column, value in equals.items():
            if value is not None:
                found = found.where(F.col(column) == value)
        return found

    def incoming(self, of: Column | str, edge_type: str | None = None) -> DataFrame:
        return self._ends("target_id", of, edge_type)

    def outgoing(self, of: Column | str, edge_type: str | None = None) -> DataFrame:
        return self._ends("source_id", of, edge_type)

    def _ends(self, column: str, node_id, edge_type: str | None) -> DataFrame:
        found = self.edges.where(F.col(column) == node_id)
        return found.where(F.col("type") == edge_type) if edge_type else found

    def counts(self) -> DataFrame:
        nodes = self.nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "n")
        return nodes.unionByName(self.edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n"))
