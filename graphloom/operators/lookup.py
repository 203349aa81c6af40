"""Degrees, symbol search, resolution and neighbourhoods."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AmbiguousSymbol, SymbolNotFound
from ..functions.columns import is_test_file, name_tokens, wildcard_regex
from ..graph import CodeGraph

CALL_TYPES = ("CALLS", "CALLS_API", "USES_COMPONENT")
KEYWORDS = (
    "exported", "unexported", "no callers", "no callees", "unused", "implements", "extends", "orphan", "dead", "circular", "test", "entry point",
)
FIND_COLUMNS = ("id", "name", "type", "file", "line", "package", "exported", "callers", "callees")


def call_degrees(graph: CodeGraph) -> DataFrame:
    """(id, callers, callees) of nodes with any: edges of CALL_TYPES at both ends, in one aggregate."""
    calls = graph.edges.where(F.col("type").isin(*CALL_TYPES))
    ends = calls.select(F.explode(F.array(
        F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
    )).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("callers"), F.sum("e.o").alias("callees"))


def degree(graph: CodeGraph) -> DataFrame:
    """(id, degree) over all edges but CONTAINS, both ends; a self-loop counts twice."""
    ends = graph.edges.where("type <> 'CONTAINS'").select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def with_degrees(graph: CodeGraph, nodes: DataFrame) -> DataFrame:
    found = nodes.join(call_degrees(graph), "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select("node_seq", "id", "name", "type", "file", F.col("start_line").alias("line"), "package", "exported", "language", "is_test", zero("callers"), zero("callees"))


def classify(query: str) -> str:
    """pattern with a wildcard, exact with one word, structural with a keyword, else fulltext."""
    if re.search(r"[*?]", query):
        return "pattern"
    if len(query.split()) <= 1:
        return "exact"
    return "structural" if any(k in query.lower() for k in KEYWORDS) else "fulltext"


def classify_column(query):
    """classify as a column."""
    text = F.trim(query)
    some = reduce(lambda a, b: a | b, [F.lower(text).contains(k) for k in KEYWORDS])
    return (
        F.when(text.rlike(r"[*?]"), "pattern")
        .when(~text.rlike(r"\s"), "exact")
        .when(some, "structural")
        .otherwise("fulltext")
    )


def find_exact(graph: CodeGraph, query: str) -> DataFrame:
    return with_degrees(graph, graph.by_name(query))


def find_pattern(graph: CodeGraph, query: str) -> DataFrame:
    return with_degrees(graph, graph.nodes.where(F.col("name").rlike(wildcard_regex(query))))


def find_structural(graph: CodeGraph, query: str) -> DataFrame:
    """All conditions that the query names; File and Package nodes are left out."""
    low = query.lower()
    rows = with_degrees(graph, graph.nodes.where(~F.col("type").isin("File", "Package")))
    if "unexported" in low:
        rows = rows.where(~F.col("exported"))
    elif "exported" in low:
        rows = rows.where("exported")
    if any(k in low for k in ("no callers", "unused", "orphan", "dead", "entry point")):
        rows = rows.where("callers = 0")
    if "no callees" in low:
        rows = rows.where("callees = 0")
    if "test" in low:
        rows = rows.where(F.coalesce("is_test", F.lit(False)))
    for word in ("implements", "extends"):
        if word in low:
            own = graph.edges.where(F.col("type") == word.upper()).select(F.explode(F.array("source_id", "target_id")).alias("id"))
            rows = rows.join(own.distinct(), "id", "left_semi")
    return rows


def find_fulltext(graph: CodeGraph, query: str) -> DataFrame:
    """By token score: 2 for an equal token, 1 for one that contains or is contained, summed over all pairs."""
    asked = [t for t in re.split(r"\s+", _spaced(re.sub(r"[^\w\s]", " ", query, flags=re.ASCII)).lower()) if t]
    if not asked:
        return with_degrees(graph, graph.nodes.limit(0)).withColumn("score", F.lit(0))
    own = F.concat(name_tokens("name"), name_tokens(F.regexp_replace(F.coalesce("file", F.lit("")), r"[/\\.]", " ")))
    def score(t):
        each = [F.when(t == q, 2).when(t.contains(q) | F.lit(q).contains(t), 1).otherwise(0) for q in asked]
        return reduce(lambda a, b: a + b, each)

    scored = graph.nodes.withColumn("score", F.aggregate(F.transform(own, score), F.lit(0), lambda a, b: a + b))
    scored = scored.where("score > 0")
    return with_degrees(graph, scored).join(scored.select("id", "score"), "id")


def _spaced(text: str) -> str:
    text = re.sub(r"([a-z])([A-Z])", r"\1 \2", re.sub(r"[_.]", " ", text))
    return re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", text)


def find(
    graph: CodeGraph, query: str, *, limit: int = 20, node_type: str | None = None, language: str | None = None, package: str | None = None
) -> DataFrame:
    """Symbols for a query by the strategy it calls for; without result an exact query is tried as *query*.

    All filters apply before the limit, so the limit never hides a match.
    """
    def run(text: str) -> DataFrame:
        way = {"exact": find_exact, "pattern": find_pattern, "structural": find_structural, "fulltext": find_fulltext}[classify(text)]
        rows = way(graph, text)
        rows = rows.where(F.col("type") == node_type) if node_type else rows
        rows = rows.where(F.lower("language") == language.lower()) if language else rows
        rows = rows.where(F.col("package").contains(package)) if package else rows
        order = ([F.desc("score")] if "score" in rows.columns else []) + [F.col("node_seq"), F.col("id")]
        return rows.orderBy(*order).limit(limit) if limit > 0 else rows.orderBy(*order)

    query = query.strip()
    rows = run(query)
    if not re.search(r"[*?]", query) and rows.isEmpty():
        rows = run(f"*{query}*")
    return rows.select(*FIND_COLUMNS)


def candidates(graph: CodeGraph, name: str, file: str | None = None) -> DataFrame:
    """Nodes a name can mean: exact case before others, then exported before others."""
    rows = graph.by_name(name)
    rows = rows.where(F.col("file").contains(file)) if file else rows
    every = Window.partitionBy(F.lower("name"))
    exact = F.col("name") == name
    rows = rows.withColumn("__exact", exact).withColumn("__some", F.max("__exact").over(every))
    rows = rows.where(F.col("__exact") | ~F.col("__some"))
    rows = rows.withColumn("__out", F.max("exported").over(every)).where(F.col("exported") | ~F.col("__out"))
    return rows.drop("__exact", "__some", "__out")


def resolve(graph: CodeGraph, name: str, file: str | None = None):
    """The one node a name means, as a Row; SymbolNotFound or AmbiguousSymbol otherwise."""
    found = candidates(graph, name, file).orderBy("node_seq", "id").limit(50).collect()
    if not found:
        raise SymbolNotFound(name, [r["name"] for r in similar_names(graph, name).collect()])
    if len(found) > 1:
        raise AmbiguousSymbol(name, [(r["name"], r["file"]) for r in found])
    return found[0]


def similar_names(graph: CodeGraph, name: str, limit: int = 5) -> DataFrame:
    """First names, one per spelling, that contain the name or are contained in it."""
    low = name.lower()
    rows = graph.nodes.where(~F.col("type").isin("Package", "File")).withColumn("low", F.lower("name"))
    rows = rows.where(F.col("low").contains(low) | F.lit(low).contains(F.col("low")))
    first = rows.groupBy("low").agg(F.min(F.struct("node_seq", "id", "name")).alias("f")).select("f.*")
    return first.orderBy("node_seq", "id").limit(limit).select("name")


def references(graph: CodeGraph, side: str) -> DataFrame:
    """Edges with the node at the other end; a missing node shows its id."""
    other = "source_id" if side == "source" else "target_id"
    nodes = graph.nodes.select(F.col("id").alias(other), "name", "file", "start_line")
    rows = graph.edges.join(nodes, other, "left")
    return rows.select(
        "edge_seq", "source_id", "target_id", "type", "confidence", F.coalesce("name", other).alias("name"),
        F.coalesce("file", F.lit("")).alias("file"), F.coalesce("start_line", F.lit(0)).alias("line"),
    )


#: Sections of explain by edge type: (at an incoming edge, at an outgoing edge).
SECTIONS = {
    "CALLS": ("callers", "callees"), "CALLS_API": ("callers", "callees"), "IMPORTS": ("imported_by", "imports"),
    "HAS_METHOD": (None, "methods"), "IMPLEMENTS": ("implemented_by", None), "USES_COMPONENT": ("used_by", None),
}


def explain(graph: CodeGraph, node_id: str) -> DataFrame:
    """(section, name, file, line, edge_type) of a node's neighbours; references from tests have a section of their own."""
    incoming = references(graph, "source").where(F.col("target_id") == node_id).withColumn("out", F.lit(False))
    outgoing = references(graph, "target").where(F.col("source_id") == node_id).withColumn("out", F.lit(True))
    section = F.lit(None).cast("string")
    for t, (inward, outward) in SECTIONS.items():
        section = F.when((F.col("type") == t) & F.col("out"), F.lit(outward)).when(F.col("type") == t, F.lit(inward)).otherwise(section)
    rows = incoming.unionByName(outgoing)
    section = F.when(~F.col("out") & is_test_file("file") & (F.col("type") == "CALLS"), "tests").otherwise(section)
    rows = rows.withColumn("section", section).where("section IS NOT NULL")
    return rows.orderBy("section", "edge_seq").select("section", "name", "file", "line", F.col("type").alias("edge_type"))


def file_symbols(graph: CodeGraph, part: str) -> DataFrame:
    """Symbols of files whose path contains a text."""
    rows = graph.nodes.where(F.col("file").contains(part) & ~F.col("type").isin("File", "Package"))
    return rows.orderBy("file", "start_line", "id").select("file", "name", "type", F.col("start_line").alias("line"), "exported")


def stats(graph: CodeGraph) -> DataFrame:
    """(kind, key, n): nodes by type and language, edges by type, totals."""
    by = lambda rows, kind, c: rows.groupBy(c).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.col(c).alias("key"), "n")
    parts = [by(graph.nodes, "node_type", "type"), by(graph.nodes, "language", "language"), by(graph.edges, "edge_type", "type")]
    parts += [graph.counts().select(F.lit("total").alias("kind"), F.col("what").alias("key"), "n")]
    return reduce(DataFrame.unionByName, parts)


def language_counts(graph: CodeGraph) -> DataFrame:
    rows = graph.nodes.where(~F.col("type").isin("Package", "File"))
    return rows.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")


def package_summary(graph: CodeGraph, limit: int = 15) -> DataFrame:
    rows = graph.nodes.where("package <> '' AND type NOT IN ('Package', 'File')").groupBy("package")
    rows = rows.agg(F.count("*").alias("symbols"), F.count_if("exported").alias("exported"), F.array_sort(F.collect_set("language")).alias("languages"))
    return rows.orderBy(F.desc("symbols"), "package").limit(limit)


def critical_symbols(graph: CodeGraph, least: int = 3, limit: int = 10) -> DataFrame:
    """Exported symbols with the most CALLS and CALLS_API callers."""
    calls = graph.edges.where(F.col("type").isin("CALLS", "CALLS_API")).groupBy(F.col("target_id").alias("id"))
    calls = calls.agg(F.count("*").alias("callers")).where(F.col("callers") >= least)
    rows = graph.nodes.where("exported").join(calls, "id")
    return rows.orderBy(F.desc("callers"), "node_seq", "id").limit(limit).select("id", "name", "type", "file", "callers")


def imported_by(graph: CodeGraph) -> DataFrame:
    """(package, importers) from IMPORTS edges between packages."""
    packages = graph.nodes.where("type = 'Package'")
    rows = graph.edges.where("type = 'IMPORTS'").join(packages.select(F.col("id").alias("source_id"), F.col("name").alias("importer")), "source_id")
    rows = rows.join(packages.select(F.col("id").alias("target_id"), F.col("name").alias("package")), "target_id")
    return rows.groupBy("package").agg(F.array_sort(F.collect_set("importer")).alias("importers"))


def top_degree(graph: CodeGraph, limit: int = 300, node_type: str | None = None, package: str | None = None) -> CodeGraph:
    """The most connected nodes, 2000 at most, and the edges among them but CONTAINS."""
    rows = graph.select(type=node_type)
    rows = rows.where(F.col("package").contains(package)) if package else rows
    rows = rows.join(degree(graph), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    rows = rows.orderBy(F.desc("degree"), "node_seq", "id").limit(min(limit, 2000))
    from .export import induced

    return CodeGraph(rows, induced(graph.edges.where("type <> 'CONTAINS'"), rows))
