"""Breadth-first traversals: one Spark job a level, each level written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..functions.columns import is_test_file
from ..storage import staged

#: Texts of the first depths (fixed values).
DEPTH_LABELS = {
    1: "WILL BREAK -- direct callers/importers",
    2: "LIKELY AFFECTED -- indirect dependents",
    3: "MAY NEED TESTING -- transitive",
}


def impact(graph: CodeGraph, node_id: str, direction: str = "upstream", max_depth: int = 3) -> DataFrame:
    """Nodes reached within max_depth edges, each by the first edge in (frontier order, edge order).

    Columns: depth, rank (order within the depth), id, name, type, file, line, edge_type, confidence, is_test.
    """
    here, there = ("target_id", "source_id") if direction == "upstream" else ("source_id", "target_id")
    spark = graph.nodes.sparkSession
    edges = graph.edges.select(F.col(here).alias("here"), F.col(there).alias("id"), "edge_seq", F.col("id").alias("edge_id"), "type", "confidence")
    frontier = spark.createDataFrame([(node_id, 0)], "here string, at long")
    visited = frontier.select(F.col("here").alias("id"))
    known = graph.nodes.select("id")
    levels = []
    for depth in range(1, max_depth + 1):
        order = F.struct("at", "edge_seq", "edge_id", "type", "confidence")
        step = edges.join(frontier, "here").join(visited, "id", "left_anti").groupBy("id").agg(F.min(order).alias("by"))
        step = step.join(known, "id", "left_semi").select("id", "by.*")
        # Ids of a range-sorted table rise with its order; no task has to number a whole level.
        step = staged(step.orderBy("at", "edge_seq", "edge_id").withColumn("rank", F.monotonically_increasing_id()))
        if step.isEmpty():
            break
        levels.append(step.select(F.lit(depth).alias("depth"), "rank", "id", F.col("type").alias("edge_type"), "confidence"))
        frontier = step.select(F.col("id").alias("here"), F.col("rank").alias("at"))
        visited = visited.unionByName(step.select("id"))
    schema = "depth int, rank long, id string, edge_type string, confidence double"
    out = spark.createDataFrame([], schema)
    for level in levels:
        out = out.unionByName(level)
    nodes = graph.nodes.select("id", "name", F.col("type").alias("type"), "file", F.col("start_line").alias("line"), "is_test")
    out = out.join(nodes, "id")
    test = F.coalesce("is_test", F.lit(False)) | is_test_file("file")
    return out.select("depth", "rank", "id", "name", "type", "file", "line", "edge_type", "confidence", test.alias("is_test"))


def impact_summary(found: DataFrame) -> DataFrame:
    """(direct, total, apps, tests, risk) without test symbols."""
    app = F.regexp_extract("file", "^apps/([^/]+)", 1)
    own = ~F.col("is_test")
    row = found.agg(
        F.count_if(own & (F.col("depth") == 1)).alias("direct"),
        F.count_if(own).alias("total"),
        F.count_distinct(F.when(own & (app != ""), app)).alias("apps"),
        F.count_if("is_test").alias("tests"),
    )
    risk = (
        F.when((F.col("direct") >= 20) | (F.col("apps") > 1), "CRITICAL")
        .when(F.col("direct") >= 10, "HIGH")
        .when(F.col("direct") >= 3, "MEDIUM")
        .otherwise("LOW")
    )
    return row.withColumn("risk", risk)


def depth_label(depth):
    out = F.concat(F.lit("Depth "), depth.cast("string"))
    for d, text in DEPTH_LABELS.items():
        out = F.when(depth == d, F.lit(text)).otherwise(out)
    return out


def ego(graph: CodeGraph, name_part: str, depth: int = 2) -> DataFrame:
    """(id, depth) around all symbols whose name contains a text, edges taken both ways."""
    seeds = graph.nodes.where(F.lower("name").contains(name_part.lower())).select("id").distinct()
    both = graph.edges.select("source_id", "target_id")
    both = both.unionByName(both.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")))
    reached = staged(seeds.withColumn("depth", F.lit(0)))
    frontier = reached
    for d in range(1, depth + 1):
        step = both.join(frontier.select(F.col("id").alias("source_id")), "source_id").select(F.col("target_id").alias("id")).distinct()
        frontier = staged(step.join(reached, "id", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached.join(graph.nodes.select("id"), "id", "left_semi")


def blast_radius(graph: CodeGraph, seeds: DataFrame, exclude: DataFrame, depth: int = 2, include_tests: bool = False) -> DataFrame:
    """Upstream of several seeds (id, seed_seq, via): each node once, for the first seed that reaches it.

    Columns: id, seed_seq, depth, rank (the edges of the way, an order within seed and depth), edge_type, confidence, via.
    Nodes in `exclude` (changed themselves) are passed through but not reported, nodes in test files neither
    reported nor passed.

    A node's first seed is the least that starts a walk to it, and every step of the least walk starts from a
    neighbour whose own least walk of that length has the same seed. So one row a node and level is enough.
    """
    edges = graph.edges.select(F.col("target_id").alias("here"), F.col("source_id").alias("id"), F.struct("edge_seq", F.col("id").alias("edge_id")).alias("by"), "type", "confidence")
    nodes = graph.nodes if include_tests else graph.nodes.where(~is_test_file("file"))
    edges = edges.join(nodes.select("id"), "id", "left_semi")
    way = seeds.groupBy(F.col("id").alias("here")).agg(F.min("seed_seq").alias("seed_seq")).withColumn("rank", F.array().cast("array<struct<edge_seq:long,edge_id:string>>"))
    levels = []
    for d in range(1, depth + 1):
        step = edges.join(way, "here").select("id", "seed_seq", F.concat("rank", F.array("by")).alias("rank"), F.col("type").alias("edge_type"), "confidence")
        least = F.struct("seed_seq", "rank", "edge_type", "confidence")
        step = staged(step.groupBy("id").agg(F.min(least).alias("w")).select("id", "w.*"))
        levels.append(step.select("id", "seed_seq", F.lit(d).alias("depth"), "rank", "edge_type", "confidence"))
        way = step.select(F.col("id").alias("here"), "seed_seq", "rank")
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    found = found.join(exclude.select("id"), "id", "left_anti")
    first = found.groupBy("id").agg(F.min(F.struct("seed_seq", "depth", "rank", "edge_type", "confidence")).alias("f")).select("id", "f.*")
    return first.join(seeds.select("seed_seq", "via"), "seed_seq")


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges without those that lead from a node that nothing reaches or to one that leads nowhere, again and again."""
    n = edges.count()
    while True:
        heads, tails = edges.select(F.col("target_id").alias("source_id")).distinct(), edges.select(F.col("source_id").alias("target_id")).distinct()
        edges = staged(edges.join(heads, "source_id", "left_semi").join(tails, "target_id", "left_semi"))
        if (left := edges.count()) == n:
            return edges
        n = left


def nodes_on_cycles(edges: DataFrame) -> DataFrame:
    """(id) of nodes that reach themselves, over (source_id, target_id).

    Strongly connected parts by colours: the least id that reaches a node is its colour, and what reaches the
    node of that id within the colour is its part. Parts found are taken out and the rest is coloured anew, until
    no edge is left. Every table has a row a node or an edge; rounds follow the longest of the shortest ways.
    """
    edges = staged(edges.select("source_id", "target_id").distinct())
    found = staged(edges.where("source_id = target_id").select(F.col("source_id").alias("id")))
    edges = _trimmed(edges.where("source_id <> target_id"))
    while not edges.isEmpty():
        labels = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct().withColumn("label", F.col("id"))
        labels = staged(labels.withColumn("changed", F.lit(True)))
        while not labels.where("changed").isEmpty():
            sent = labels.where("changed").join(edges, F.col("id") == F.col("source_id")).groupBy("target_id").agg(F.min("label").alias("sent"))
            labels = labels.drop("changed").join(sent, F.col("id") == F.col("target_id"), "left")
            labels = staged(labels.select("id", F.least("label", "sent").alias("label"), F.coalesce(F.col("sent") < F.col("label"), F.lit(False)).alias("changed")))
        colour = lambda end: labels.select(F.col("id").alias(f"{end}_id"), F.col("label").alias(f"{end}_label"))
        inner = edges.join(colour("source"), "source_id").join(colour("target"), "target_id").where("source_label = target_label")
        inner = staged(inner.select("source_id", "target_id"))
        front = staged(labels.where("id = label").select("id"))
        part = front
        while not front.isEmpty():
            front = inner.join(front, F.col("target_id") == F.col("id")).select(F.col("source_id").alias("id")).distinct()
            front = staged(front.join(part, "id", "left_anti"))
            part = part.unionByName(front)
        part = staged(part.join(labels.select("id", "label"), "id"))
        many = part.groupBy("label").count().where("count > 1").select("label")
        found = found.unionByName(part.join(many, "label", "left_semi").select("id"))
        gone = part.select("id")
        for end in ("source_id", "target_id"):
            edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
        edges = _trimmed(staged(edges.select("source_id", "target_id")))
    return found.distinct()


#: Packages that the driver may search depth first; more are refused, for nodes_on_cycles to answer.
MOST_PACKAGES = 20_000


def cycles(graph: CodeGraph) -> list[list[str]]:
    """Package cycles in the order a depth-first search closes them; the package graph is small, and its size is checked."""
    packages = graph.nodes.where("type = 'Package'").orderBy("node_seq", "id")
    packages = packages.select("id", F.when(F.coalesce("package", F.lit("")) != "", F.col("package")).otherwise(F.col("name")).alias("label"))
    named = {r["id"]: r["label"] for r in packages.limit(MOST_PACKAGES + 1).collect()}
    if len(named) > MOST_PACKAGES:
        raise ValueError(f"more than {MOST_PACKAGES} packages: use nodes_on_cycles")
    imports = graph.edges.where("type = 'IMPORTS'").join(F.broadcast(packages.select(F.col("id").alias("source_id"))), "source_id", "left_semi")
    nexts: dict[str, list[str]] = {i: [] for i in named}
    for r in imports.orderBy("edge_seq", "id").select("source_id", "target_id").toLocalIterator():
        if r["target_id"] in named and r["target_id"] not in nexts[r["source_id"]]:
            nexts[r["source_id"]].append(r["target_id"])
    done: set[str] = set()
    found: list[list[str]] = []
    for start in named:
        if start in done:
            continue
        path, turns = [start], [iter(nexts[start])]
        while path:
            node = next(turns[-1], None)
            if node is None:
                done.add(path.pop())
                turns.pop()
            elif node in path:
                found.append([named[i] for i in path[path.index(node) :]])
            elif node not in done:
                path.append(node)
                turns.append(iter(nexts[node]))
    return found
