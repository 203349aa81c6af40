"""Communities by label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..storage import staged


def label_propagation(graph: CodeGraph, rounds: int = 10) -> DataFrame:
    """(id, label) of all but Package and File nodes.

    Every round has two halves: nodes of even, then of odd id digest adopt the label most of their neighbours
    have (edges count both ways, each for itself). A tie keeps the current label if it is among the most
    frequent, else takes the smallest. Halving stops the flipping of synchronous updates; unlike a
    shuffled asynchronous run the outcome is the same each time.
    """
    nodes = graph.nodes.where(~F.col("type").isin("Package", "File")).select("id").distinct()
    edges = graph.edges.select("source_id", "target_id")
    own = nodes.select(F.col("id").alias("source_id"))
    edges = edges.join(own, "source_id", "left_semi").join(own.select(F.col("source_id").alias("target_id")), "target_id", "left_semi")
    both = edges.unionByName(edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")))
    both = staged(both.groupBy("source_id", "target_id").agg(F.count("*").alias("w")))
    labels = staged(nodes.withColumn("label", F.col("id")).withColumn("half", F.conv(F.substring(F.md5("id"), 1, 1), 16, 10).cast("int") % 2))
    for _ in range(rounds):
        before = labels
        for half in (0, 1):
            votes = both.join(labels.where(F.col("half") == half).select(F.col("id").alias("source_id"), F.col("label").alias("now")), "source_id")
            votes = votes.join(labels.select(F.col("id").alias("target_id"), "label"), "target_id")
            votes = votes.groupBy("source_id", "now", "label").agg(F.sum("w").alias("n"))
            # Most votes first, then the current label, then the smallest.
            rank = F.struct(-F.col("n"), F.col("label") != F.col("now"), "label")
            chosen = votes.groupBy(F.col("source_id").alias("id")).agg(F.min_by("label", rank).alias("new"))
            labels = staged(labels.join(chosen, "id", "left").select("id", F.coalesce("new", "label").alias("label"), "half"))
        changed = labels.join(before.select("id", F.col("label").alias("was")), "id").where("label <> was")
        if changed.isEmpty():
            break
    return labels.select("id", "label")


def name_communities(graph: CodeGraph, labels: DataFrame) -> DataFrame:
    """(id, label, community): the most common package of a community, numbered where several share it."""
    rows = labels.join(graph.nodes.select("id", "node_seq", F.when(F.coalesce("package", F.lit("")) == "", "unknown").otherwise(F.col("package")).alias("package")), "id")
    by = rows.groupBy("label", "package").agg(F.count("*").alias("n"), F.min("node_seq").alias("first"))
    top = by.groupBy("label").agg(F.max_by("package", F.struct("n", -F.col("first"))).alias("package"), F.min("first").alias("first"))
    nth = F.row_number().over(Window.partitionBy("package").orderBy("first", "label"))
    name = F.when(nth == 1, F.col("package")).otherwise(F.concat("package", F.lit(" #"), nth.cast("string")))
    return labels.join(top.select("label", name.alias("community")), "label").select("id", "label", "community")


def community_stats(named: DataFrame) -> DataFrame:
    """One row (communities, largest, largest_size)."""
    sizes = named.groupBy("community").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("communities"),
        F.min_by("community", F.struct(-F.col("n"), "community")).alias("largest"),
        F.max("n").alias("largest_size"),
    )


def with_communities(graph: CodeGraph, rounds: int = 10) -> CodeGraph:
    """The graph with its community column filled."""
    named = name_communities(graph, label_propagation(graph, rounds)).select("id", F.col("community").alias("__own"))
    nodes = graph.nodes.join(named, "id", "left").withColumn("community", F.coalesce("__own", "community")).drop("__own")
    return CodeGraph.of(nodes, graph.edges)
