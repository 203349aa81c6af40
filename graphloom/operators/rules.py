"""Static-analysis rules over the graph; each returns (name, file, line, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import CodeGraph
from .traversal import cycles, nodes_on_cycles

OUTSIDE = ("Package", "File", "Module")
USES = ("CALLS", "IMPORTS", "USES_COMPONENT")


def _items(rows: DataFrame, detail: Column) -> DataFrame:
    line = F.when(F.col("start_line") > 0, F.col("start_line"))
    return rows.orderBy("node_seq", "id").select("id", "name", "file", line.alias("line"), detail.alias("detail"))


def dead_code(graph: CodeGraph) -> DataFrame:
    """Exported symbols outside tests that nothing but themselves calls, imports or uses."""
    rows = graph.nodes.where(F.col("exported") & ~F.col("type").isin(*OUTSIDE) & ~F.coalesce("is_test", F.lit(False)))
    used = graph.edges.where(F.col("type").isin(*USES) & (F.col("source_id") != F.col("target_id"))).select(F.col("target_id").alias("id"))
    return _items(rows.join(used, "id", "left_anti"), F.concat(F.lit("exported "), "type", F.lit(" with no callers")))


def unused_exports(graph: CodeGraph) -> DataFrame:
    """Exported symbols without a reference from another file."""
    rows = graph.nodes.where(F.col("exported") & ~F.col("type").isin(*OUTSIDE))
    sources = graph.nodes.select(F.col("id").alias("source_id"), F.col("file").alias("from_file"))
    targets = graph.nodes.select(F.col("id").alias("target_id"), F.col("file").alias("to_file"))
    refs = graph.edges.select("source_id", "target_id").join(sources, "source_id", "left").join(targets, "target_id")
    across = F.max(F.coalesce(F.col("from_file") != F.col("to_file"), F.lit(False)))
    refs = refs.groupBy(F.col("target_id").alias("id")).agg(across.alias("across"))
    rows = rows.join(refs, "id", "left").where(~F.coalesce("across", F.lit(False)))
    detail = F.when(F.col("across").isNull(), "exported with no incoming references").otherwise("exported but only referenced within the same file")
    return _items(rows, detail)


def circular_deps(graph: CodeGraph) -> DataFrame:
    """Import cycles of packages as a depth-first search in node order closes them."""
    spark = graph.nodes.sparkSession
    rows = [(None, " → ".join(c), None, None, f"cycle: {' → '.join(c)} → {c[0]}") for c in cycles(graph)]
    return spark.createDataFrame(rows, "id string, name string, file string, line int, detail string")


def packages_on_cycles(graph: CodeGraph) -> DataFrame:
    """(id) of packages on an import cycle, by distributed reachability."""
    packages = graph.nodes.where("type = 'Package'").select("id")
    imports = graph.edges.where("type = 'IMPORTS'").select("source_id", "target_id")
    imports = imports.join(packages.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return nodes_on_cycles(imports.join(packages.withColumnRenamed("id", "target_id"), "target_id", "left_semi"))


def large_files(graph: CodeGraph, threshold: int = 30) -> DataFrame:
    rows = graph.nodes.where(~F.col("type").isin(*OUTSIDE) & (F.coalesce("file", F.lit("")) != ""))
    rows = rows.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") > threshold).orderBy(F.desc("n"), "file")
    detail = F.format_string(f"%d symbols (threshold: {threshold})", "n")
    return rows.select(F.lit(None).cast("string").alias("id"), F.col("file").alias("name"), "file", F.lit(None).cast("int").alias("line"), detail.alias("detail"))


def orphan_files(graph: CodeGraph) -> DataFrame:
    """File nodes without an edge."""
    return _items(graph.nodes.where("type = 'File'").join(_touched(graph), "id", "left_anti"), F.lit("file with no relationships"))


def _touched(graph: CodeGraph) -> DataFrame:
    return graph.edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))


# The four stricter questions of the relational store.


def uncalled_functions(graph: CodeGraph) -> DataFrame:
    rows = graph.nodes.where("exported AND type IN ('Function', 'Method')")
    return rows.join(graph.edges.where("type = 'CALLS'").select(F.col("target_id").alias("id")), "id", "left_anti")


def unconnected(graph: CodeGraph) -> DataFrame:
    return graph.nodes.where(~F.col("type").isin(*OUTSIDE)).join(_touched(graph), "id", "left_anti")


def crowded_files(graph: CodeGraph, threshold: int = 20) -> DataFrame:
    rows = graph.nodes.where("file IS NOT NULL").groupBy("file").agg(F.count("*").alias("n"))
    return rows.where(F.col("n") > threshold).orderBy(F.desc("n"), "file")


def unused_symbols(graph: CodeGraph) -> DataFrame:
    used = graph.edges.where(F.col("type").isin(*USES)).select(F.col("target_id").alias("id"))
    return graph.nodes.where(F.col("exported") & ~F.col("type").isin(*OUTSIDE)).join(used, "id", "left_anti")


RULES = {
    "dead_code": dead_code,
    "unused_exports": unused_exports,
    "circular_deps": circular_deps,
    "large_files": large_files,
    "orphans": orphan_files,
}


def run_all(graph: CodeGraph, threshold: int = 30) -> DataFrame:
    """All rules' items, with the rule's name."""
    out = None
    for name, rule in RULES.items():
        rows = rule(graph, threshold) if name == "large_files" else rule(graph)
        rows = rows.select(F.lit(name).alias("rule"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out
