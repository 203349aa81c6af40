"""Execution flows: entry points, call paths, and the flows built from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import capitalized, framework, half_up, is_entry_name, is_helper_name, is_test_file
from ..graph import CodeGraph
from ..storage import staged

#: Fixed limits of the tracer.
MAX_NODES, BRANCHING, LEAST_NODES, LEAST_CONFIDENCE = 10, 4, 2, 0.5
PATHS_AN_ENTRY, MOST_TRACES, MOST_ENTRIES, LEAST_SCORE = 12, 150, 200, 0.1


def calls(graph: CodeGraph) -> DataFrame:
    rows = graph.edges.where(F.col("type").isin("CALLS", "CALLS_API") & (F.col("confidence") >= LEAST_CONFIDENCE))
    return rows.select("source_id", "target_id", "edge_seq", "id", "type")


def entry_points(graph: CodeGraph) -> DataFrame:
    """(id, node_seq, score): what calls much and is called little, by name, export and framework."""
    edges = calls(graph)
    out = edges.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("callees"))
    inward = edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("callers"))
    rows = graph.nodes.where(~F.col("type").isin("Package", "File", "Enum", "Trait", "Type", "Interface"))
    rows = rows.where(~is_test_file("file", "process")).join(out, "id").join(inward, "id", "left")
    callers = F.coalesce("callers", F.lit(0))
    score = (
        F.col("callees") / (callers + 1)
        * F.when(F.col("exported"), 1.5).otherwise(0.8)
        * F.when(is_entry_name("name", F.coalesce("language", F.lit("*"))), 2.0).otherwise(1.0)
        * F.when(is_helper_name("name"), 0.3).otherwise(1.0)
        * F.when(callers == 0, 1.5).otherwise(1.0)
        * framework("file", "name")[1]
    )
    rows = rows.select("id", "node_seq", score.alias("score")).where(F.col("score") > LEAST_SCORE)
    return rows.orderBy(F.desc(F.round("score", 9)), "node_seq", "id").limit(MOST_ENTRIES)


def trace_paths(graph: CodeGraph, entries: DataFrame) -> DataFrame:
    """(entry, place, nth, path): up to PATHS_AN_ENTRY call paths of each entry (id, place), breadth first.

    A path ends at a node without calls, at MAX_NODES nodes, or where its first BRANCHING callees would all
    close a cycle. Order within an entry is by length, then by the branches taken. The calls around each entry
    are gathered level by level; an entry's paths are then enumerated in one task, BRANCHING ** (MAX_NODES - 1)
    at most.
    """
    edges = calls(graph)
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("edge_seq", "id"))
    edges = edges.withColumn("nth", nth).where(F.col("nth") <= BRANCHING)
    nexts = edges.groupBy(F.col("source_id").alias("node")).agg(F.array_sort(F.collect_list(F.struct("nth", "target_id"))).alias("callees"))
    nexts = staged(nexts.select("node", F.transform("callees", lambda c: c["target_id"]).alias("callees")))
    level = staged(entries.select(F.col("id").alias("entry"), "place", F.col("id").alias("node")))
    around = level
    for _ in range(MAX_NODES - 2):
        step = level.join(nexts, "node").select("entry", "place", F.explode("callees").alias("node")).distinct()
        level = staged(step.join(around, ["entry", "place", "node"], "left_anti"))
        if level.isEmpty():
            break
        around = around.unionByName(level)
    around = around.join(nexts, "node").select("entry", "place", "node", "callees")
    schema = f"entry string, place {entries.schema['place'].dataType.simpleString()}, nth int, path array<string>"
    around = around.repartition(graph.nodes.sparkSession.sparkContext.defaultParallelism, "entry")  # few rows, much work
    return around.groupBy("entry", "place").applyInArrow(_first_paths, schema)


def _first_paths(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The first paths of one entry, all paths of a length grown at once."""
    entry, place = key
    nodes = table.column("node").to_pylist()
    lists = table.column("callees").to_pylist()
    number: dict[str, int] = {entry.as_py(): 0}
    for name in [*nodes, *(c for own in lists for c in own)]:
        number.setdefault(name, len(number))
    callees = np.full((len(number), BRANCHING), -1, np.int64)
    for node, own in zip(nodes, lists, strict=True):
        callees[number[node], : len(own)] = [number[c] for c in own]
    paths, found = np.zeros((1, 1), np.int64), []
    for length in range(1, MAX_NODES + 1):
        onward = callees[paths[:, -1]]
        fresh = (onward >= 0) & ~(paths[:, :, None] == onward[:, None, :]).any(axis=1)
        ended = ~fresh.any(axis=1) | (length == MAX_NODES)
        if length >= LEAST_NODES:
            found.extend(paths[ended][: PATHS_AN_ENTRY - len(found)].tolist())
        if length == MAX_NODES or len(found) >= PATHS_AN_ENTRY:
            break
        path, branch = np.nonzero(fresh)
        if length + 1 == MAX_NODES:  # all of these end next
            path, branch = path[:PATHS_AN_ENTRY], branch[:PATHS_AN_ENTRY]
        paths = np.concatenate((paths[path], onward[path, branch][:, None]), axis=1)
    names = list(number)
    columns = [[entry.as_py()] * len(found), [place.as_py()] * len(found), range(1, len(found) + 1), [[names[i] for i in p] for p in found]]
    kinds = [pa.string(), place.type, pa.int32(), pa.list_(pa.string())]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["entry", "place", "nth", "path"])


def capped(traces: DataFrame, most: int = MOST_TRACES) -> DataFrame:
    """Traces of the entries, in order, until `most` are reached; the entry that reaches it comes whole."""
    counts = traces.groupBy("entry", "place").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # MOST_ENTRIES rows
    return traces.join(counts.withColumn("before", before).where(F.col("before") < most).select("entry"), "entry", "left_semi")


def without_subsets(traces: DataFrame) -> DataFrame:
    """Traces that are not, as text, inside a longer one, or inside an equally long earlier one."""
    own = traces.select("*", F.array_join("path", "->").alias("text"), F.size("path").alias("len"), F.struct("place", "nth").alias("at"))
    others = own.select(F.col("text").alias("o_text"), F.col("len").alias("o_len"), F.col("at").alias("o_at"))
    inside = F.col("o_text").contains(F.col("text")) & ((F.col("o_len") > F.col("len")) | ((F.col("o_len") == F.col("len")) & (F.col("o_at") < F.col("at"))))
    return own.join(F.broadcast(others), inside, "left_anti").drop("text", "len", "at")  # a few hundred traces


def by_endpoints(traces: DataFrame) -> DataFrame:
    """The longest trace of each (first, last), the earliest of equal ones."""
    ends = Window.partitionBy(F.element_at("path", 1), F.element_at("path", -1)).orderBy(F.desc(F.size("path")), "place", "nth")
    return traces.withColumn("__n", F.row_number().over(ends)).where("__n = 1").drop("__n")


STEP = "struct<id:string,name:string,type:string,file:string,line:int,depth:int,community:string>"


def build(graph: CodeGraph, traces: DataFrame) -> DataFrame:
    """A flow for each trace: steps with their depth below the nearest caller on the path."""
    node = graph.nodes.select("id", "name", "type", "file", F.col("start_line").alias("line"), "community", "receiver", "language", "package")
    at = traces.select("entry", "place", "nth", F.posexplode("path").alias("i", "id"), "path")
    direct = graph.edges.where("type = 'CALLS'").select(F.col("source_id").alias("parent"), F.col("target_id").alias("id")).distinct()
    parents = at.select("entry", "nth", F.col("i").alias("j"), F.col("id").alias("parent"))
    nearest = at.join(parents, ["entry", "nth"]).where("j < i").join(direct, ["parent", "id"], "left_semi")
    nearest = nearest.groupBy("entry", "nth", "i").agg(F.max("j").alias("j"))
    at = at.join(nearest, ["entry", "nth", "i"], "left").join(node, "id", "left")
    rows = at.groupBy("entry", "place", "nth").agg(F.array_sort(F.collect_list(F.struct("i", "j", "id", "name", "type", "file", "line", "community", "receiver", "language", "package"))).alias("all"))
    # Depths in path order: one more than the parent's, 0 without a direct caller.
    depths = F.aggregate("all", F.array().cast("array<int>"), lambda d, s: F.concat(d, F.array(F.coalesce(F.get(d, s["j"]) + 1, F.lit(0)))))
    rows = staged(rows.withColumn("depths", depths))
    steps = F.transform(
        F.filter("all", lambda s: (s["i"] > 0) & s["name"].isNotNull()),
        lambda s: F.struct(*[s[c].alias(c) for c in ("id", "name", "type", "file", "line")], F.get("depths", s["i"]).alias("depth"), s["community"].alias("community")),
    )
    head, last = F.col("all")[0], F.element_at("all", -1)
    rows = rows.withColumn("steps", steps.cast(f"array<{STEP}>")).where(F.size("steps") > 0)
    name = F.when(F.coalesce(head["receiver"], F.lit("")) != "", F.concat(head["receiver"], F.lit("."), head["name"])).otherwise(head["name"])
    first, end = capitalized(head["name"]), capitalized(last["name"])
    label = F.when(end.isNotNull() & (end != "") & (end != first), F.concat(first, F.lit(" → "), end)).otherwise(first)
    communities = F.array_distinct(F.filter(F.transform("all", lambda s: s["community"]), lambda c: c.isNotNull() & (c != "")))
    return _weighed(staged(
        rows.select("entry", "place", "nth", name.alias("name"), label.alias("label"), head.alias("entry_point"), "steps", F.transform("all", lambda s: s["id"]).alias("trace"), communities.alias("communities"))
    ))


def _weighed(rows: DataFrame) -> DataFrame:
    deep = F.coalesce(F.array_max(F.transform("steps", lambda s: s["depth"])), F.lit(0))
    cross = F.size("communities") > 1
    rows = rows.withColumn("depth", deep).withColumn("process_type", F.when(cross, "cross_community").otherwise("intra_community"))
    return rows.withColumn("complexity", half_up(F.size("steps") * (1 + F.col("depth") / 5) * F.when(cross, 1.3).otherwise(1.0)))


def merged(flows: DataFrame) -> DataFrame:
    """One flow an entry: the longest with the others' further steps."""
    order = F.struct(-F.size("steps"), F.col("place"), F.col("nth"))
    rows = flows.groupBy("entry", "place").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "name", "label", "entry_point", "steps", "trace", "communities"))).alias("g"))
    place = lambda s: F.concat(s["name"], F.lit("@"), s["file"], F.lit(":"), s["line"].cast("string"))
    rows = staged(rows.withColumn("all", F.flatten(F.transform("g", lambda p: p["steps"]))))
    keys = F.transform("all", place)
    first = F.filter("all", lambda s, i: F.array_position(keys, place(s)) == i + 1)
    base = F.col("g")[0]
    ends = F.array_distinct(F.transform("g", lambda p: F.element_at(p["trace"], -1)))
    rows = rows.select(
        "entry", "place", base["name"].alias("name"), base["label"].alias("label"), base["entry_point"].alias("entry_point"),
        F.when(F.size("g") > 1, first).otherwise(base["steps"]).alias("steps"),
        F.array_distinct(F.flatten(F.transform("g", lambda p: p["trace"]))).alias("trace"),
        F.array_distinct(F.flatten(F.transform("g", lambda p: p["communities"]))).alias("communities"),
        ((F.size("g") > 2) & (F.size(ends) > 1)).alias("fans"),
    )
    fan = F.format_string("%s (%d branches)", "name", F.size("steps"))
    return _weighed(staged(rows.withColumn("label", F.when(F.col("fans"), fan).otherwise(F.col("label"))).drop("fans")))


def detect_processes(graph: CodeGraph, limit: int = 75, text: str | None = None) -> DataFrame:
    """Flows, most complex first."""
    entries = entry_points(graph)
    place = F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "node_seq", "id"))  # MOST_ENTRIES rows
    entries = staged(entries.withColumn("place", place))
    traces = staged(by_endpoints(without_subsets(staged(capped(trace_paths(graph, entries))))))
    flows = merged(build(graph, traces))
    if text:
        flows = flows.where(F.lower("name").contains(text.lower()) | F.lower("label").contains(text.lower()))
    return flows.orderBy(F.desc("complexity"), "place").limit(limit)


def get_process(graph: CodeGraph, name: str) -> DataFrame:
    """The flow of that name, else the first whose name contains it."""
    flows = detect_processes(graph, 100).withColumn("__exact", F.lower("name") == name.lower())
    flows = flows.where(F.lower("name").contains(name.lower()))
    return flows.orderBy(F.desc("__exact"), F.desc("complexity"), "place").limit(1).drop("__exact")


def participation(flows: DataFrame, node_id: str) -> DataFrame:
    """(name, label, step, total) of the flows that a node is part of; step 0 is the entry."""
    at = flows.select("name", "label", F.size("trace").alias("total"), F.posexplode("trace").alias("step", "id"))
    return at.where(F.col("id") == node_id).select("name", "label", "step", "total").orderBy("name", "step")
