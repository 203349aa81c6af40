"""Change review: diff hunks to symbols, their blast radius and its risk."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import is_test_file
from ..graph import CodeGraph
from ..storage import staged
from .process import detect_processes
from .traversal import blast_radius

HUNKS = "file string, start_line int, line_count int"


def hunks_of_diff(lines: DataFrame) -> DataFrame:
    """HUNKS from (n, line) rows of a unified diff without context: the file line above, then @@ -a,b +start,count @@."""
    file = F.regexp_extract("line", r"^\+\+\+ b/(.+)$", 1)
    above = Window.orderBy("n")  # one diff
    rows = lines.withColumn("file", F.last(F.when(file != "", file), ignorenulls=True).over(above))
    at = r"^@@ [^+]*\+(\d+)(?:,(\d+))? @@"
    rows = rows.where(F.col("line").rlike(at) & F.col("file").isNotNull())
    count = F.regexp_extract("line", at, 2)
    return rows.select("file", F.regexp_extract("line", at, 1).cast("int").alias("start_line"), F.when(count == "", 1).otherwise(count.try_cast("int")).alias("line_count"))


DIFF_ARGS = {"all": ["HEAD"], "staged": ["--cached"], "unstaged": [], "branch": ["{base}...HEAD"]}


def git_diff(spark: SparkSession, root: str, scope: str = "all", base: str = "main") -> DataFrame:
    """HUNKS of a working tree, by git on the driver."""
    args = [a.format(base=base) for a in DIFF_ARGS.get(scope, DIFF_ARGS["all"])]
    done = subprocess.run(["git", "diff", "--unified=0", *args], cwd=root, capture_output=True, text=True, check=False)
    lines = list(enumerate(done.stdout.splitlines())) if done.returncode == 0 else []
    return hunks_of_diff(spark.createDataFrame(lines, "n long, line string"))


def changed_files(spark: SparkSession, root: str, scope: str = "all", base: str = "main") -> DataFrame:
    args = [a.format(base=base) for a in DIFF_ARGS.get(scope, DIFF_ARGS["all"])]
    done = subprocess.run(["git", "diff", "--name-only", *args], cwd=root, capture_output=True, text=True, check=False)
    names = [(x,) for x in done.stdout.splitlines() if x] if done.returncode == 0 else []
    return spark.createDataFrame(names, "file string")


def changed_symbols(graph: CodeGraph, hunks: DataFrame, files: DataFrame | None = None, include_tests: bool = False) -> DataFrame:
    """Symbols of changed files; reason modified where a hunk overlaps their lines, else in_changed_file."""
    files = (files if files is not None else hunks.select("file")).distinct()
    nodes = graph.nodes.where(~F.col("type").isin("Package", "File"))
    nodes = nodes if include_tests else nodes.where(~is_test_file("file"))
    nodes = nodes.join(files, "file", "left_semi")
    h = hunks.select(F.col("file").alias("h_file"), F.col("start_line").alias("h_start"), (F.col("start_line") + F.col("line_count") - 1).alias("h_end"))
    spot = nodes.where("start_line > 0 AND end_line > 0")
    touch = (F.col("file") == F.col("h_file")) & (F.col("h_start") <= F.col("end_line")) & (F.col("h_end") >= F.col("start_line"))
    hit = spot.join(h, touch, "left_semi").select(F.col("id").alias("hit_id")).distinct()
    rows = nodes.join(hit, F.col("id") == F.col("hit_id"), "left")
    reason = F.when(F.col("hit_id").isNotNull(), "modified").otherwise("in_changed_file")
    return rows.select("node_seq", "id", "name", "type", "file", "start_line", "community", reason.alias("reason"))


def affected_symbols(graph: CodeGraph, changed: DataFrame, include_tests: bool = False) -> DataFrame:
    """(id, depth, edge_type, confidence, via, name, file, …) within two edges upstream of modified symbols."""
    seeds = changed.where("reason = 'modified'").select("id", F.col("node_seq").alias("seed_seq"), F.col("name").alias("via"))
    found = blast_radius(graph, seeds, changed, 2, include_tests)
    nodes = graph.nodes.select("id", "name", F.col("type").alias("type"), "file", F.col("start_line").alias("line"), "community")
    return found.join(nodes, "id")


def overall_risk(affected: DataFrame) -> DataFrame:
    """One row (direct, confident, files, score, risk)."""
    row = affected.agg(
        F.count_if(F.col("depth") == 1).alias("direct"),
        F.count_if(F.col("confidence") >= 0.9).alias("confident"),
        F.count_distinct("file").alias("files"),
    )
    row = row.withColumn("score", 3 * F.col("direct") + 2 * F.col("confident") + F.when(F.col("files") > 5, 20).otherwise(0))
    s = F.col("score")
    return row.withColumn("risk", F.when(s >= 50, "CRITICAL").when(s >= 20, "HIGH").when(s >= 10, "MEDIUM").otherwise("LOW"))


def file_risks(graph: CodeGraph, files: DataFrame, changed: DataFrame, affected: DataFrame) -> DataFrame:
    """(file, modified, symbols, direct, affected, risk); affected symbols count for a file by the name they came through."""
    files = files.select("file").distinct()
    own = changed.groupBy("file").agg(F.count_if(F.col("reason") == "modified").alias("modified"), F.count("*").alias("symbols"))
    names = changed.where("reason = 'modified'").select(F.col("file").alias("via_file"), F.col("name").alias("via")).distinct()
    hits = affected.select("id", "depth", "via").join(names, "via").groupBy(F.col("via_file").alias("file"))
    hits = hits.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("affected"))
    known = graph.nodes.select("file").distinct().withColumn("known", F.lit(True))
    rows = files.join(own, "file", "left").join(hits, "file", "left").join(known, "file", "left").na.fill(0, ["modified", "symbols", "direct", "affected"])
    risk = (
        F.when(F.col("known").isNull(), "NEW")
        .when(F.col("direct") >= 10, "HIGH")
        .when(F.col("direct") >= 3, "MEDIUM")
        .when(F.col("modified") == 0, "LOW (unchanged symbols)")
        .otherwise("LOW")
    )
    weight = F.when(F.col("direct") >= 10, 3).when(F.col("direct") >= 3, 2).otherwise(1)
    return rows.withColumn("risk", risk).orderBy(F.desc(weight), "file").drop("known")


def touched_communities(changed: DataFrame, affected: DataFrame) -> DataFrame:
    both = changed.select("community").unionByName(affected.select("community"))
    return both.where("community IS NOT NULL AND community <> ''").distinct()


def broken_flows(flows: DataFrame, changed: DataFrame) -> DataFrame:
    """(name, step, total): the first modified node of each flow; step 0 is its entry."""
    ids = F.concat(F.array("entry"), F.transform("steps", lambda s: s["id"]))
    at = flows.select("entry", "name", F.size("steps").alias("total"), F.posexplode(ids).alias("step", "id"))
    hit = at.join(changed.where("reason = 'modified'").select("id"), "id", "left_semi")
    return hit.groupBy("entry", "name", "total").agg(F.min("step").alias("step")).select("name", "step", "total")


def priorities(graph: CodeGraph, changed: DataFrame, limit: int = 5) -> DataFrame:
    """Modified symbols by the number of CALLS they get."""
    callers = graph.edges.where("type = 'CALLS'").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("callers"))
    rows = changed.where("reason = 'modified'").join(callers, "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)).cast("long"))
    return rows.orderBy(F.desc("callers"), "node_seq", "id").limit(limit).select("id", "name", "file", "callers")


def review(graph: CodeGraph, hunks: DataFrame, files: DataFrame | None = None, include_tests: bool = False) -> dict[str, DataFrame]:
    """All parts of a review."""
    files = files if files is not None else hunks.select("file").distinct()
    changed = staged(changed_symbols(graph, hunks, files, include_tests))
    affected = staged(affected_symbols(graph, changed, include_tests))
    return {
        "changed": changed,
        "affected": affected,
        "files": file_risks(graph, files, changed, affected),
        "risk": overall_risk(affected),
        "communities": touched_communities(changed, affected),
        "flows": broken_flows(detect_processes(graph, 50), changed),
        "priorities": priorities(graph, changed),
    }


#: What a review script reads back from a rendered report.
REPORT = {
    "risk": re.compile(r"^- \*\*Risk:\*\* (.+)$", re.MULTILINE),
    "changed": re.compile(r"^- \*\*Changed:\*\* (\d+) files, (\d+) symbols", re.MULTILINE),
    "blast": re.compile(r"^- \*\*Blast radius:\*\* (\d+) ", re.MULTILINE),
}


def read_report(text: str) -> dict:
    found = {k: p.search(text) for k, p in REPORT.items()}
    return {k: (m.groups() if m.lastindex > 1 else m[1]) for k, m in found.items() if m}
