"""Graphs on disk: Parquet tables and JSON exchange files, upserts, deletions, repositories and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import CodeGraph

#: JSON names of the columns whose names differ there.
JSON_NAMES = {
    "start_line": "startLine", "end_line": "endLine", "is_test": "isTest", "return_type": "returnType",
    "method_signatures": "methodSignatures", "is_default": "isDefault", "import_path": "importPath",
    "source_id": "sourceId", "target_id": "targetId",
}


def save(graph: CodeGraph, path: str) -> None:
    """Parquet tables; edges are laid out by type, so a type's edges are a partition."""
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def load(spark: SparkSession, path: str) -> CodeGraph:
    return CodeGraph.of(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def load_json(spark: SparkSession, path: str, repo: str = "") -> CodeGraph:
    """{nodes: […], relationships: […]} documents; order in the arrays becomes the sequence."""
    doc = spark.read.json(path, multiLine=True)

    def table(column: str, seq: str) -> DataFrame:
        rows = doc.select(F.posexplode(column).alias(seq, "r")).select(F.col(seq).cast("long"), "r.*")
        for ours, theirs in JSON_NAMES.items():
            rows = rows.withColumnRenamed(theirs, ours)
        return rows

    nodes, edges = table("nodes", "node_seq"), table("relationships", "edge_seq")
    if "repo" not in nodes.columns:
        nodes = nodes.withColumn("repo", F.lit(None).cast("string"))
    nodes = nodes.withColumn("repo", F.coalesce("repo", F.lit(repo)))
    if "metadata" in edges.columns:
        m = edges.schema["metadata"].dataType.names
        pick = lambda n: F.col(f"metadata.{n}") if n in m else F.lit(None).cast("string")
        edges = edges.withColumn("metadata", F.struct(pick("httpMethod").alias("http_method"), pick("urlPattern").alias("url_pattern")))
    return CodeGraph.of(nodes, edges)


def save_json(graph: CodeGraph, path: str) -> None:
    """JSON lines of nodes and relationships, in folders of those names."""
    nodes, edges = graph.nodes, graph.edges
    for ours, theirs in JSON_NAMES.items():
        nodes, edges = nodes.withColumnRenamed(ours, theirs), edges.withColumnRenamed(ours, theirs)
    nodes.orderBy("node_seq").drop("node_seq").write.mode("overwrite").json(f"{path}/nodes")
    edges.orderBy("edge_seq").drop("edge_seq").write.mode("overwrite").json(f"{path}/relationships")


def latest_by_id(rows: DataFrame, version: str) -> DataFrame:
    """One row an id, of the highest version."""
    last = Window.partitionBy("id").orderBy(F.desc(version))
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", version)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union by id, the new row winning."""
    return latest_by_id(old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True), "__v")


def remove_files(graph: CodeGraph, files: DataFrame) -> CodeGraph:
    """Without the nodes of files (file) and all edges at them."""
    gone = graph.nodes.join(files.select("file"), "file", "left_semi").select("id")
    return remove_nodes(graph, gone)


def remove_nodes(graph: CodeGraph, ids: DataFrame) -> CodeGraph:
    edges = graph.edges
    for end in ("source_id", "target_id"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_anti")
    return CodeGraph.of(graph.nodes.join(ids.select("id"), "id", "left_anti"), edges)


def without_dangling(graph: CodeGraph) -> CodeGraph:
    """Only edges with both ends present, as a foreign key would have it."""
    from ..operators.export import induced

    return CodeGraph.of(graph.nodes, induced(graph.edges, graph.nodes))


def merge_repos(graphs: dict[str, CodeGraph]) -> CodeGraph:
    """All repositories as one graph; ids get the repository's name in front, so none collide."""
    nodes = edges = None
    for repo, g in sorted(graphs.items()):
        mine = lambda c: F.concat(F.lit(repo + "/"), F.col(c)).alias(c)
        n = g.nodes.select(*[mine(c) if c == "id" else F.coalesce("repo", F.lit(repo)).alias(c) if c == "repo" else F.col(c) for c in g.nodes.columns])
        e = g.edges.select(*[mine(c) if c in ("id", "source_id", "target_id") else F.col(c) for c in g.edges.columns])
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    return CodeGraph(nodes, edges)


def union_repos(parts: DataFrame) -> DataFrame:
    """Nodes of several repositories by plain id: of equal ids the last repository by name wins."""
    return latest_by_id(parts.withColumn("__v", F.struct("repo", "node_seq")), "__v")


def repo_catalog(graph: CodeGraph) -> DataFrame:
    """(repo, nodes, edges); an edge belongs to its source's repository."""
    nodes = graph.nodes.groupBy("repo").agg(F.count("*").alias("nodes"))
    at = graph.edges.join(graph.nodes.select(F.col("id").alias("source_id"), "repo"), "source_id")
    edges = at.groupBy("repo").agg(F.count("*").alias("edges"))
    return nodes.join(edges, "repo", "left").select("repo", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


def set_meta(spark: SparkSession, old: DataFrame | None, **values: str) -> DataFrame:
    """The (key, value) table with values set."""
    new = spark.createDataFrame(sorted(values.items()), "key string, value string")
    return new if old is None else old.join(new, "key", "left_anti").unionByName(new)


def pack_sparse(nodes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Sparse columns as one JSON text column, meta, without nulls."""
    return nodes.withColumn("meta", F.to_json(F.struct(*columns))).drop(*columns)


def unpack_sparse(nodes: DataFrame, schema: str) -> DataFrame:
    """The columns of meta again; unreadable text gives nulls."""
    return nodes.withColumn("__m", F.from_json("meta", schema)).select("*", "__m.*").drop("meta", "__m")
