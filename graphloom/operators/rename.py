"""Rename planning: all places that a symbol's new name has to reach."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.columns import relation_word
from ..graph import CodeGraph
from .lookup import resolve


def plan_rename(graph: CodeGraph, name: str, new_name: str, file: str | None = None) -> DataFrame:
    """Edits (file, line, old_name, new_name, confidence, context), one a place, the definition first.

    Of several reasons for one place the first counts: definition, incoming edges, methods of a Struct or
    Interface, implementors of an Interface, then symbols of the same name.
    """
    target = resolve(graph, name, file)
    if target["name"] == new_name:
        raise InvalidParameter("new_name", new_name, ["a name other than the current one"])
    edges, nodes = graph.edges, graph.nodes.select("id", "node_seq", F.col("name").alias("other"), "type", "file", "start_line", "package")

    def edits(rows: DataFrame, part: int, order, context, confidence: str = "graph") -> DataFrame:
        return rows.select(F.lit(part).alias("part"), order.alias("order"), F.col("file"), F.col("start_line").alias("line"), F.lit(confidence).alias("confidence"), context.alias("context"))

    around = lambda where, end: edges.where(where).select(F.col(end).alias("id"), "edge_seq", F.col("type").alias("edge_type")).join(nodes, "id").where("coalesce(file, '') <> ''")
    to, out = F.col("target_id") == target["id"], F.col("source_id") == target["id"]
    parts = [edits(nodes.where((F.col("id") == target["id"]) & (F.col("file") != "") & (F.col("start_line") > 0)), 0, F.lit(0).cast("long"), F.lit("definition"))]
    parts.append(edits(around(to, "source_id"), 1, F.col("edge_seq"), F.concat(relation_word("edge_type"), F.lit(" by "), "other")))
    if target["type"] in ("Struct", "Interface"):
        own = around(out & (F.col("type") == "HAS_METHOD"), "target_id")
        parts.append(edits(own, 2, F.col("edge_seq"), F.concat(F.lit("method "), "other", F.lit(f" on {target['name']}"))))
    if target["type"] == "Interface":
        own = around(to & (F.col("type") == "IMPLEMENTS"), "source_id")
        parts.append(edits(own, 3, F.col("edge_seq"), F.lit(f"implements {target['name']}")))
    same = nodes.where((F.col("other") == target["name"]) & (F.col("id") != target["id"]) & ~F.col("type").isin("File", "Package") & (F.col("file") != "") & (F.col("start_line") > 0))
    parts.append(edits(same, 4, F.col("node_seq"), F.concat(F.lit("same-name symbol in "), "package"), "text_search"))
    rows = reduce(DataFrame.unionByName, parts)
    first = Window.partitionBy("file", "line").orderBy("part", "order", "context")
    rows = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    rows = rows.orderBy(F.desc(F.col("part") == 0), "file", "line")
    return rows.select("file", "line", F.lit(target["name"]).alias("old_name"), F.lit(new_name).alias("new_name"), "confidence", "context")


def rename_totals(edits: DataFrame) -> DataFrame:
    return edits.agg(
        F.count_distinct("file").alias("files"),
        F.count_if(F.col("confidence") == "graph").alias("graph_edits"),
        F.count_if(F.col("confidence") == "text_search").alias("text_edits"),
    )
