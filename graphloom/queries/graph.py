"""Queries over the derived code graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..operators import community, export, linking, lookup, process, rename, review, rules, traversal
from ..plans import pattern
from ..sources import graph_store
from ..sources.derived import GRAPH_CTE, HUNKS_CTE, derived_graph, derived_hunks
from ..storage import staged
from . import register

FLAGSHIP = "impact_upstream"
TARGET = "sym:part:7"


def sql(body: str, *more: str) -> str:
    return f"WITH RECURSIVE {', '.join([GRAPH_CTE, *more])} {body}"


def on_graph(name: str, oracle: str | None = None, *more: str, again: bool = False):
    """Registers a function of the graph; the oracle's text follows the graph's common table expressions.

    again: the operator reads the graph level by level, so the derivation is written down first.
    """

    def add(f):
        def run(spark, sf_dir):
            g = derived_graph(spark, sf_dir)
            return f(g.staged() if again else g)

        register(name, sql(oracle, *more) if oracle else None)(run)
        return f

    return add


def on_review(name: str, oracle: str | None = None, *more: str):
    def add(f):
        full = sql(oracle, HUNKS_CTE, *more) if oracle else None
        register(name, full)(lambda spark, sf_dir: f(derived_graph(spark, sf_dir).staged(), derived_hunks(spark, sf_dir)))
        return f

    return add


def on_nodes(name: str, oracle: str, *more: str):
    """As on_review, of the nodes alone: the edges are neither derived nor written, and the nodes are read where they are."""

    def add(f):
        register(name, sql(oracle, HUNKS_CTE, *more))(lambda spark, sf_dir: f(derived_graph(spark, sf_dir).nodes, derived_hunks(spark, sf_dir)))
        return f

    return add


NODE = "id, type, name, file, start_line, end_line, language, package, exported, is_test"


@on_graph("graph_nodes", f"SELECT node_seq, {NODE} FROM nodes")
def graph_nodes(g):
    return g.nodes.select("node_seq", *NODE.split(", "))


@on_graph("graph_edges", "SELECT edge_seq, id, type, source_id, target_id, confidence FROM edges")
def graph_edges(g):
    return g.edges.drop("metadata")


@on_graph("graph_counts", "SELECT 'nodes' AS what, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges")
def graph_counts(g):
    return g.counts()


# The pattern language.

HOP = "MATCH (a:Function)-[:CALLS]->(b:Function) WHERE a.name CONTAINS 'Widget' RETURN a.name AS caller, b.name AS callee, a, b.startLine AS line LIMIT 50"


@on_graph(
    "pattern_hop",
    """SELECT a.name AS caller, b.name AS callee, a.name || ' (' || a.type || ') @ ' || a.file || ':' || a.start_line AS a, CAST(b.start_line AS STRING) AS line
    FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id
    WHERE a.type = 'Function' AND b.type = 'Function' AND e.type = 'CALLS' AND contains(lower(a.name), 'widget')
    ORDER BY a.node_seq, a.id, e.edge_seq, e.id LIMIT 50""",
)
def pattern_hop(g):
    return pattern.run(HOP, g)


@on_graph(
    "pattern_hop_target",
    """SELECT a.id AS a_id, b.id AS b_id, b.receiver AS r FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id
    WHERE b.type = 'Method' AND lower(b.language) = 'typescript' ORDER BY b.node_seq, b.id, e.edge_seq, e.id LIMIT 40""",
)
def pattern_hop_target(g):
    return pattern.run("MATCH (a)-[]->(b:Method) WHERE b.language = 'TypeScript' RETURN a.id AS a_id, b.id AS b_id, b.receiver AS r LIMIT 40", g)


@on_graph(
    "pattern_hop_edges",
    """SELECT a.name AS a, b.name AS b FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id
    WHERE e.type = 'HAS_METHOD' ORDER BY e.edge_seq, e.id LIMIT 50""",
)
def pattern_hop_edges(g):
    return pattern.run("MATCH (a)-[:HAS_METHOD]->(b) RETURN a.name AS a, b.name AS b", g)


@on_graph(
    "pattern_node",
    """SELECT name, package AS pkg, CAST(exported AS STRING) AS exported, '' AS nothing FROM nodes
    WHERE coalesce(receiver, '') <> 'brand#3' AND lower(coalesce(receiver, '')) <> 'brand#3' AND starts_with(lower(file), 'src/brand_1')
    ORDER BY node_seq, id LIMIT 60""",
)
def pattern_node(g):
    return pattern.run(
        "MATCH (n) WHERE n.receiver <> 'BRAND#3' AND n.file STARTS WITH 'SRC/brand_1' RETURN n.name AS name, n.package AS pkg, n.exported AS exported, n.community AS nothing LIMIT 60", g
    )


# Lookups and search.

DEGREES = """deg AS (SELECT id, CAST(sum(i) AS BIGINT) AS callers, CAST(sum(o) AS BIGINT) AS callees FROM (
    SELECT target_id AS id, 1 AS i, 0 AS o FROM edges WHERE type IN ('CALLS', 'CALLS_API', 'USES_COMPONENT')
    UNION ALL SELECT source_id, 0, 1 FROM edges WHERE type IN ('CALLS', 'CALLS_API', 'USES_COMPONENT')) x GROUP BY id)"""
FOUND = """SELECT n.id, n.name, n.type, n.file, n.start_line AS line, n.package, n.exported, coalesce(d.callers, 0) AS callers, coalesce(d.callees, 0) AS callees
    FROM nodes n LEFT JOIN deg d ON d.id = n.id WHERE """


@on_graph("call_degrees", "SELECT * FROM deg", DEGREES)
def call_degrees(g):
    return lookup.call_degrees(g)


@on_graph("degrees", "SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges WHERE type <> 'CONTAINS' UNION ALL SELECT target_id FROM edges WHERE type <> 'CONTAINS') x GROUP BY id")
def degrees(g):
    return lookup.degree(g)


@on_graph("find_exact", FOUND + "lower(n.name) = 'redwidget'", DEGREES)
def find_exact(g):
    return lookup.find_exact(g, "RedWidget").select(*lookup.FIND_COLUMNS)


@on_graph("find_wildcard", FOUND + "regexp_matches(n.name, '(?i)^.*bo.t$') ORDER BY n.node_seq, n.id LIMIT 25", DEGREES)
def find_wildcard(g):
    return lookup.find(g, "*bo?t", limit=25)


@on_graph("find_fallback", FOUND + "regexp_matches(n.name, '(?i)^.*edwidg.*$') AND lower(n.language) = 'go' ORDER BY n.node_seq, n.id LIMIT 20", DEGREES)
def find_fallback(g):
    return lookup.find(g, "edwidg", language="Go")


@on_graph("find_structural", FOUND + "n.type NOT IN ('File', 'Package') AND n.exported AND coalesce(d.callers, 0) = 0", DEGREES)
def find_structural(g):
    return lookup.find_structural(g, "exported with no callers").select(*lookup.FIND_COLUMNS)


@on_graph(
    "find_structural_edges",
    FOUND + "n.type NOT IN ('File', 'Package') AND NOT n.exported AND n.is_test AND n.id IN (SELECT source_id FROM edges WHERE type = 'EXTENDS' UNION SELECT target_id FROM edges WHERE type = 'EXTENDS')",
    DEGREES,
)
def find_structural_edges(g):
    return lookup.find_structural(g, "unexported test extends").select(*lookup.FIND_COLUMNS)


@on_graph(
    "find_fulltext",
    """SELECT id, CAST(score AS INT) AS score FROM (
        SELECT id, sum(CASE WHEN t = q THEN 2 WHEN contains(t, q) OR contains(q, t) THEN 1 ELSE 0 END) AS score
        FROM (SELECT id, unnest(list_filter(list_concat(
                regexp_split_to_array(lower(regexp_replace(regexp_replace(replace(replace(name, '_', ' '), '.', ' '), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '\\s+'),
                regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(file, '[/\\\\.]', ' ', 'g'), '[_.]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '\\s+')), lambda x: x <> '')) AS t FROM nodes) w,
             (SELECT unnest(['red', 'widget', 'promo']) AS q) asked GROUP BY id) s WHERE score > 0""",
)
def find_fulltext(g):
    return lookup.find_fulltext(g, "red widget promo").select("id", "score")


@on_graph(
    "resolve_candidates",
    "SELECT id, name, file FROM (SELECT *, max(CAST(exported AS INT)) OVER () AS any_out FROM nodes WHERE lower(name) = 'bluebolt') x WHERE exported OR any_out = 0",
)
def resolve_candidates(g):
    return lookup.candidates(g, "blueBolt").select("id", "name", "file")


@on_graph(
    "similar_names",
    """SELECT arg_min(name, node_seq) AS name FROM nodes WHERE type NOT IN ('Package', 'File') AND (contains(lower(name), 'widget') OR contains('widget', lower(name)))
    GROUP BY lower(name) ORDER BY min(node_seq) LIMIT 5""",
)
def similar_names(g):
    return lookup.similar_names(g, "Widget")


@on_graph(
    "references",
    """SELECT e.edge_seq, e.source_id, e.target_id, e.type, e.confidence, coalesce(n.name, e.source_id) AS name, coalesce(n.file, '') AS file, coalesce(n.start_line, 0) AS line
    FROM edges e LEFT JOIN nodes n ON n.id = e.source_id""",
)
def references(g):
    return lookup.references(g, "source")


@on_graph(
    "explain",
    f"""SELECT section, name, file, line, edge_type FROM (
        SELECT CASE WHEN e.type = 'CALLS' AND regexp_matches(n.file, '(?i)[._]test\\.|[._]spec\\.|__tests__|test/|tests/|_test\\.go$') THEN 'tests'
                    WHEN e.type IN ('CALLS', 'CALLS_API') THEN 'callers' WHEN e.type = 'IMPORTS' THEN 'imported_by'
                    WHEN e.type = 'IMPLEMENTS' THEN 'implemented_by' WHEN e.type = 'USES_COMPONENT' THEN 'used_by' END AS section,
               n.name, n.file, n.start_line AS line, e.type AS edge_type FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.target_id = '{TARGET}'
        UNION ALL
        SELECT CASE WHEN e.type IN ('CALLS', 'CALLS_API') THEN 'callees' WHEN e.type = 'IMPORTS' THEN 'imports' WHEN e.type = 'HAS_METHOD' THEN 'methods' END,
               n.name, n.file, n.start_line, e.type FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.source_id = '{TARGET}') x WHERE section IS NOT NULL""",
)
def explain(g):
    return lookup.explain(g, TARGET)


@on_graph("file_symbols", "SELECT file, name, type, start_line AS line, exported FROM nodes WHERE contains(file, 'Brand_2') AND type NOT IN ('File', 'Package')")
def file_symbols(g):
    return lookup.file_symbols(g, "Brand_2")


@on_graph(
    "graph_stats",
    """SELECT 'node_type' AS kind, type AS key, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'language', language, count(*) FROM nodes GROUP BY language
    UNION ALL SELECT 'edge_type', type, count(*) FROM edges GROUP BY type UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges""",
)
def graph_stats(g):
    return lookup.stats(g)


@on_graph("language_counts", "SELECT language, count(*) AS n FROM nodes WHERE type NOT IN ('Package', 'File') GROUP BY language")
def language_counts(g):
    return lookup.language_counts(g)


@on_graph(
    "package_summary",
    """SELECT package, count(*) AS symbols, count(*) FILTER (exported) AS exported, array_to_string(list_sort(list_distinct(list(language))), ',') AS languages
    FROM nodes WHERE package <> '' AND type NOT IN ('Package', 'File') GROUP BY package ORDER BY symbols DESC, package LIMIT 15""",
)
def package_summary(g):
    return lookup.package_summary(g).withColumn("languages", F.array_join("languages", ","))


@on_graph(
    "critical_symbols",
    """SELECT n.id, n.name, n.type, n.file, c.callers FROM nodes n JOIN (SELECT target_id, count(*) AS callers FROM edges WHERE type IN ('CALLS', 'CALLS_API') GROUP BY 1 HAVING count(*) >= 3) c
    ON c.target_id = n.id WHERE n.exported ORDER BY c.callers DESC, n.node_seq, n.id LIMIT 10""",
)
def critical_symbols(g):
    return lookup.critical_symbols(g)


@on_graph(
    "imported_by",
    """SELECT b.name AS package, array_to_string(list_sort(list_distinct(list(a.name))), ',') AS importers FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id
    WHERE e.type = 'IMPORTS' AND a.type = 'Package' AND b.type = 'Package' GROUP BY b.name""",
)
def imported_by(g):
    return lookup.imported_by(g).withColumn("importers", F.array_join("importers", ","))


@on_graph(
    "top_degree_edges",
    """SELECT e.id FROM edges e WHERE type <> 'CONTAINS' AND source_id IN (SELECT id FROM top) AND target_id IN (SELECT id FROM top)""",
    """top AS (SELECT n.id FROM nodes n LEFT JOIN (SELECT id, count(*) AS d FROM (SELECT source_id AS id FROM edges WHERE type <> 'CONTAINS' UNION ALL SELECT target_id FROM edges WHERE type <> 'CONTAINS') x GROUP BY id) d
       ON d.id = n.id ORDER BY coalesce(d.d, 0) DESC, n.node_seq, n.id LIMIT 300)""",
)
def top_degree_edges(g):
    return lookup.top_degree(g).edges.select("id")


# Rules.

USED = "SELECT target_id FROM edges WHERE type IN ('CALLS', 'IMPORTS', 'USES_COMPONENT')"


@on_graph(
    "rule_dead_code",
    f"""SELECT id, name, file, CASE WHEN start_line > 0 THEN start_line END AS line, 'exported ' || type || ' with no callers' AS detail FROM nodes
    WHERE exported AND type NOT IN ('Package', 'File', 'Module') AND NOT is_test AND id NOT IN ({USED} AND source_id <> target_id)""",
)
def rule_dead_code(g):
    return rules.dead_code(g)


@on_graph(
    "rule_unused_exports",
    """SELECT n.id, n.name, n.file, CASE WHEN n.start_line > 0 THEN n.start_line END AS line,
        CASE WHEN r.id IS NULL THEN 'exported with no incoming references' ELSE 'exported but only referenced within the same file' END AS detail
    FROM nodes n LEFT JOIN (SELECT e.target_id AS id, max(CASE WHEN s.file <> t.file THEN 1 ELSE 0 END) AS across FROM edges e JOIN nodes t ON t.id = e.target_id LEFT JOIN nodes s ON s.id = e.source_id GROUP BY 1) r
    ON r.id = n.id WHERE n.exported AND n.type NOT IN ('Package', 'File', 'Module') AND coalesce(r.across, 0) = 0""",
)
def rule_unused_exports(g):
    return rules.unused_exports(g)


@on_graph("rule_circular_deps", again=True)
def rule_circular_deps(g):
    return rules.circular_deps(g)


@on_graph(
    "packages_on_cycles",
    "SELECT DISTINCT a AS id FROM reach WHERE a = b",
    "reach AS (SELECT source_id AS a, target_id AS b FROM edges WHERE type = 'IMPORTS' UNION SELECT r.a, e.target_id FROM reach r JOIN edges e ON e.source_id = r.b AND e.type = 'IMPORTS')",
    again=True,
)
def packages_on_cycles(g):
    return rules.packages_on_cycles(g)


@on_graph(
    "rule_large_files",
    """SELECT file AS name, file, count(*) || ' symbols (threshold: 15)' AS detail FROM nodes WHERE type NOT IN ('Package', 'File', 'Module') AND file <> '' GROUP BY file HAVING count(*) > 15""",
)
def rule_large_files(g):
    return rules.large_files(g, 15).select("name", "file", "detail")


@on_graph("rule_orphans", "SELECT id, name, file FROM nodes WHERE type = 'File' AND id NOT IN (SELECT source_id FROM edges UNION SELECT target_id FROM edges)")
def rule_orphans(g):
    return rules.orphan_files(CodeGraph(g.nodes, g.edges)).select("id", "name", "file")


@on_graph("uncalled_functions", "SELECT id FROM nodes WHERE exported AND type IN ('Function', 'Method') AND id NOT IN (SELECT target_id FROM edges WHERE type = 'CALLS')")
def uncalled_functions(g):
    return rules.uncalled_functions(g).select("id")


@on_graph("unconnected", "SELECT id FROM nodes WHERE type NOT IN ('Package', 'Module', 'File') AND id NOT IN (SELECT source_id FROM edges UNION SELECT target_id FROM edges)")
def unconnected(g):
    return rules.unconnected(g).select("id")


@on_graph("crowded_files", "SELECT file, count(*) AS n FROM nodes WHERE file IS NOT NULL GROUP BY file HAVING count(*) > 15")
def crowded_files(g):
    return rules.crowded_files(g, 15)


@on_graph("unused_symbols", f"SELECT id FROM nodes WHERE exported AND type NOT IN ('Package', 'Module', 'File') AND id NOT IN ({USED})")
def unused_symbols(g):
    return rules.unused_symbols(g).select("id")


# Traversals.

UP = f"""up AS (SELECT '{TARGET}' AS id, 0 AS depth UNION SELECT e.source_id, u.depth + 1 FROM up u JOIN edges e ON e.target_id = u.id WHERE u.depth < 3),
    reached AS (SELECT id, min(depth) AS depth FROM up GROUP BY id)"""
TEST_FILE = "regexp_matches(n.file, '(?i)[._]test\\.|[._]spec\\.|__tests__|test/|tests/|_test\\.go$')"


@on_graph("impact_upstream", f"SELECT r.depth, n.id, n.name, n.type, n.file, n.start_line AS line, n.is_test OR {TEST_FILE} AS is_test FROM reached r JOIN nodes n ON n.id = r.id WHERE r.depth > 0", UP, again=True)
def impact_upstream(g):
    return traversal.impact(g, TARGET).select("depth", "id", "name", "type", "file", "line", "is_test")


@on_graph(
    "impact_first_edges",
    f"""SELECT source_id AS id, arg_min(type, (edge_seq, id)) AS edge_type, arg_min(confidence, (edge_seq, id)) AS confidence FROM edges
    WHERE target_id = '{TARGET}' AND source_id <> target_id AND source_id IN (SELECT id FROM nodes) GROUP BY source_id""",
    again=True,
)
def impact_first_edges(g):
    return traversal.impact(g, TARGET, max_depth=1).select("id", "edge_type", "confidence")


@on_graph(
    "impact_downstream",
    "SELECT r.depth, n.id FROM reached r JOIN nodes n ON n.id = r.id WHERE r.depth > 0",
    UP.replace("e.source_id, u.depth", "e.target_id, u.depth").replace("e.target_id = u.id", "e.source_id = u.id").replace("u.depth < 3", "u.depth < 2"),
    again=True,
)
def impact_downstream(g):
    return traversal.impact(g, TARGET, "downstream", 2).select("depth", "id")


@on_graph(
    "impact_summary",
    f"""SELECT *, CASE WHEN direct >= 20 OR apps > 1 THEN 'CRITICAL' WHEN direct >= 10 THEN 'HIGH' WHEN direct >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM (
        SELECT count(*) FILTER (NOT t AND depth = 1) AS direct, count(*) FILTER (NOT t) AS total,
               count(DISTINCT CASE WHEN NOT t AND app <> '' THEN app END) AS apps, count(*) FILTER (t) AS tests
        FROM (SELECT r.depth, n.is_test OR {TEST_FILE} AS t, regexp_extract(n.file, '^apps/([^/]+)', 1) AS app FROM reached r JOIN nodes n ON n.id = r.id WHERE r.depth > 0) x) y""",
    UP,
    again=True,
)
def impact_summary(g):
    return traversal.impact_summary(traversal.impact(g, TARGET))


@on_graph(
    "ego_graph",
    "SELECT id, min(depth) AS depth FROM ego WHERE id IN (SELECT id FROM nodes) GROUP BY id",
    """both_ways AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges),
    ego AS (SELECT id, 0 AS depth FROM nodes WHERE contains(lower(name), 'nation_1') UNION SELECT w.b, e.depth + 1 FROM ego e JOIN both_ways w ON w.a = e.id WHERE e.depth < 2)""",
    again=True,
)
def ego_graph(g):
    return traversal.ego(g, "NATION_1", 2)


EXPORT = """shown AS (SELECT id FROM nodes WHERE type NOT IN ('Package', 'File') AND contains(lower(package), 'brand#1') AND type IN ('Function', 'Class') ORDER BY node_seq, id LIMIT 50)"""


@on_graph("export_edges", "SELECT id, type FROM edges WHERE type NOT IN ('CONTAINS', 'DEFINES') AND source_id IN (SELECT id FROM shown) AND target_id IN (SELECT id FROM shown)", EXPORT)
def export_edges(g):
    return export.subgraph(g, package="Brand#1", types=["Function", "Class"]).edges.select("id", "type")


@on_graph(
    "export_mermaid",
    """SELECT 'node' AS part, n.id, regexp_replace(n.id, '[^a-zA-Z0-9_]', '_', 'g') || '["' || n.name || '"]' AS line FROM nodes n WHERE n.id IN (SELECT id FROM shown)
    UNION ALL SELECT 'edge', e.id, regexp_replace(source_id, '[^a-zA-Z0-9_]', '_', 'g') || CASE WHEN type IN ('CALLS', 'CALLS_API') THEN ' -->|' || type || '| ' WHEN type IN ('EXTENDS', 'IMPLEMENTS') THEN ' -.->|' || type || '| '
        WHEN type = 'IMPORTS' THEN ' -->|imports| ' WHEN type = 'HAS_METHOD' THEN ' -->|has| ' ELSE ' --> ' END || regexp_replace(target_id, '[^a-zA-Z0-9_]', '_', 'g')
    FROM edges e WHERE type NOT IN ('CONTAINS', 'DEFINES') AND source_id IN (SELECT id FROM shown) AND target_id IN (SELECT id FROM shown)""",
    EXPORT,
)
def export_mermaid(g):
    return export.mermaid_lines(export.subgraph(g, package="Brand#1", types=["Function", "Class"])).select("part", "id", "line")


# Review.

CHANGED = f"""changed AS (SELECT n.*, CASE WHEN EXISTS (SELECT 1 FROM hunks h WHERE h.file = n.file AND n.start_line > 0 AND n.end_line > 0 AND h.start_line <= n.end_line AND h.start_line + h.line_count - 1 >= n.start_line)
    THEN 'modified' ELSE 'in_changed_file' END AS reason FROM nodes n WHERE n.type NOT IN ('Package', 'File') AND NOT {TEST_FILE} AND n.file IN (SELECT file FROM hunks))"""


@on_review("changed_symbols", "SELECT id, name, reason FROM changed", CHANGED)
def changed_symbols(g, hunks):
    return review.changed_symbols(g, hunks).select("id", "name", "reason")


SOUND = f"SELECT id FROM nodes n WHERE NOT {TEST_FILE}"
AFFECTED = f"""hit AS (SELECT c.node_seq AS seed_seq, c.id AS seed, c.id AS id, 0 AS depth FROM changed c WHERE reason = 'modified'
        UNION SELECT h.seed_seq, h.seed, e.source_id, h.depth + 1 FROM hit h JOIN edges e ON e.target_id = h.id WHERE h.depth < 2 AND e.source_id IN ({SOUND}) AND e.source_id <> h.seed),
    affected AS (SELECT id, arg_min(depth, (seed_seq, depth)) AS depth, min(seed_seq) AS seed_seq FROM hit WHERE depth > 0 AND id NOT IN (SELECT id FROM changed) GROUP BY id)"""


@on_review("blast_radius", "SELECT a.id, a.depth, a.seed_seq, c.name AS via FROM affected a JOIN changed c ON c.node_seq = a.seed_seq", CHANGED, AFFECTED)
def blast_radius(g, hunks):
    changed = staged(review.changed_symbols(g, hunks))
    return review.affected_symbols(g, changed).select("id", "depth", "seed_seq", "via")


@on_review(
    "review_file_risks",
    """SELECT f.file, coalesce(o.modified, 0) AS modified, coalesce(h.direct, 0) AS direct, coalesce(h.affected, 0) AS affected,
        CASE WHEN f.file NOT IN (SELECT file FROM nodes) THEN 'NEW' WHEN coalesce(h.direct, 0) >= 10 THEN 'HIGH' WHEN coalesce(h.direct, 0) >= 3 THEN 'MEDIUM' WHEN coalesce(o.modified, 0) = 0 THEN 'LOW (unchanged symbols)' ELSE 'LOW' END AS risk
    FROM (SELECT DISTINCT file FROM hunks) f LEFT JOIN (SELECT file, count(*) FILTER (reason = 'modified') AS modified FROM changed GROUP BY file) o ON o.file = f.file
    LEFT JOIN (SELECT m.file, count(*) FILTER (a.depth = 1) AS direct, count(*) AS affected FROM affected a JOIN changed c ON c.node_seq = a.seed_seq
               JOIN (SELECT DISTINCT file, name FROM changed WHERE reason = 'modified') m ON m.name = c.name GROUP BY m.file) h ON h.file = f.file""",
    CHANGED,
    AFFECTED,
)
def review_file_risks(g, hunks):
    changed = staged(review.changed_symbols(g, hunks))
    risks = review.file_risks(g, hunks.select("file"), changed, review.affected_symbols(g, changed))
    return risks.select("file", "modified", "direct", "affected", "risk")


def _ways(before: str, seed: str, order: str, k: int) -> str:
    """The least way of k edges to each node that takes part: its seed and the edges it takes."""
    return f"""way{k} AS (SELECT * FROM (SELECT e.source_id AS id, {seed} AS seed_seq, {order}e.edge_seq AS k{k}, e.id AS i{k}, e.confidence,
        row_number() OVER (PARTITION BY e.source_id ORDER BY {seed}, {order}e.edge_seq, e.id, e.type, e.confidence) AS n
        FROM {before} JOIN edges e ON e.target_id = w.id WHERE e.source_id IN ({SOUND})) x WHERE n = 1)"""


RISK = f"""{_ways("(SELECT * FROM changed WHERE reason = 'modified') w", "w.node_seq", "", 1)}, {_ways("way1 w", "w.seed_seq", "w.k1, w.i1, ", 2)},
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seed_seq, depth) AS nth FROM (
        SELECT id, seed_seq, 1 AS depth, confidence FROM way1 UNION ALL SELECT id, seed_seq, 2, confidence FROM way2) x WHERE id NOT IN (SELECT id FROM changed)) y WHERE nth = 1),
    tally AS (SELECT count(*) FILTER (depth = 1) AS direct, count(*) FILTER (confidence >= 0.9) AS confident, count(DISTINCT file) AS files FROM firsts JOIN nodes USING (id)),
    scored AS (SELECT *, 3 * direct + 2 * confident + CASE WHEN files > 5 THEN 20 ELSE 0 END AS score FROM tally)"""


@on_review("review_risk", "SELECT direct, confident, files, score, CASE WHEN score >= 50 THEN 'CRITICAL' WHEN score >= 20 THEN 'HIGH' WHEN score >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM scored", CHANGED, RISK)
def review_risk(g, hunks):
    return review.overall_risk(review.affected_symbols(g, staged(review.changed_symbols(g, hunks))))


@on_review(
    "review_priorities",
    """SELECT c.id, c.name, c.file, coalesce(n, 0) AS callers FROM changed c LEFT JOIN (SELECT target_id, count(*) AS n FROM edges WHERE type = 'CALLS' GROUP BY 1) k ON k.target_id = c.id
    WHERE reason = 'modified' ORDER BY callers DESC, c.node_seq, c.id LIMIT 5""",
    CHANGED,
)
def review_priorities(g, hunks):
    return review.priorities(g, review.changed_symbols(g, hunks))


@on_review("broken_flows")
def broken_flows(g, hunks):
    return review.broken_flows(process.detect_processes(g, 50), review.changed_symbols(g, hunks))


@on_nodes(
    "enclosing_symbol",
    """SELECT file, line, source_id FROM (SELECT h.file, h.start_line AS line, n.id AS source_id, row_number() OVER (PARTITION BY h.file, h.start_line ORDER BY n.end_line - n.start_line, n.node_seq) AS k
        FROM (SELECT DISTINCT file, start_line FROM hunks) h JOIN nodes n ON n.file = h.file AND h.start_line BETWEEN n.start_line AND n.end_line AND n.type <> 'File') x WHERE k = 1""",
)
def enclosing_symbol(nodes, hunks):
    points = hunks.select("file", F.col("start_line").alias("line")).distinct()
    return linking.enclosing(points, nodes.where("type <> 'File'").withColumnRenamed("node_seq", "seq")).select("file", "line", "source_id")


RENAMED = f"""SELECT file, line, confidence, context FROM (SELECT *, row_number() OVER (PARTITION BY file, line ORDER BY part, o, context) AS k FROM (
        SELECT 0 AS part, 0 AS o, file, start_line AS line, 'graph' AS confidence, 'definition' AS context FROM nodes WHERE id = 'struct:supplier:3'
        UNION ALL SELECT 1, e.edge_seq, n.file, n.start_line, 'graph', CASE e.type WHEN 'CALLS' THEN 'called' WHEN 'HAS_METHOD' THEN 'has method' ELSE 'referenced' END || ' by ' || n.name FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.target_id = 'struct:supplier:3' AND n.file <> ''
        UNION ALL SELECT 2, e.edge_seq, n.file, n.start_line, 'graph', 'method ' || n.name || ' on Supplier#000000003' FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.source_id = 'struct:supplier:3' AND e.type = 'HAS_METHOD' AND n.file <> '') x) y WHERE k = 1"""


@on_graph(
    "rename_plan",
    RENAMED,
    again=True,
)
def rename_plan(g):
    return rename.plan_rename(g, "Supplier#000000003", "Vendor").select("file", "line", "confidence", "context")


@on_graph(
    "rename_totals",
    f"SELECT count(DISTINCT file) AS files, count(*) FILTER (confidence = 'graph') AS graph_edits, count(*) FILTER (confidence = 'text_search') AS text_edits FROM ({RENAMED}) r",
    again=True,
)
def rename_totals(g):
    return rename.rename_totals(rename.plan_rename(g, "Supplier#000000003", "Vendor"))


# Communities and flows.


def _rounds(n: int) -> str:
    """Label propagation unrolled; the last table is lab<2n>."""
    own = "SELECT id FROM nodes WHERE type NOT IN ('Package', 'File')"
    parts = [
        f"""both_ways AS MATERIALIZED (SELECT s, t, CAST(count(*) AS BIGINT) AS w FROM (SELECT source_id AS s, target_id AS t FROM edges UNION ALL SELECT target_id, source_id FROM edges) x
            WHERE s IN ({own}) AND t IN ({own}) GROUP BY s, t)""",
        f"lab0 AS MATERIALIZED (SELECT id, id AS label, CAST('0x' || substr(md5(id), 1, 1) AS INT) % 2 AS half FROM ({own}) x)",
    ]
    for k in range(2 * n):
        parts.append(f"""lab{k + 1} AS MATERIALIZED (SELECT l.id, coalesce(c.new, l.label) AS label, l.half FROM lab{k} l LEFT JOIN (
            SELECT s, arg_min(label, (-n, CAST(label <> now AS INT), label)) AS new FROM (
                SELECT b.s, m.label AS now, o.label, CAST(sum(w) AS BIGINT) AS n FROM both_ways b JOIN lab{k} m ON m.id = b.s AND m.half = {k % 2} JOIN lab{k} o ON o.id = b.t GROUP BY b.s, m.label, o.label) v GROUP BY s) c ON c.s = l.id)""")
    return ", ".join(parts)


@on_graph("label_propagation", "SELECT id, label FROM lab20", _rounds(10), again=True)
def label_propagation(g):
    return community.label_propagation(g)


@on_graph(
    "community_stats",
    """SELECT count(*) AS communities, arg_min(community, (-n, community)) AS largest, max(n) AS largest_size FROM (SELECT community, count(*) AS n FROM lab20 JOIN named USING (label) GROUP BY community) x""",
    _rounds(10),
    """by_package AS (SELECT label, CASE WHEN coalesce(package, '') = '' THEN 'unknown' ELSE package END AS package, count(*) AS n, min(node_seq) AS first FROM lab20 JOIN nodes USING (id) GROUP BY 1, 2),
    top AS (SELECT label, arg_max(package, (n, -first)) AS package, min(first) AS first FROM by_package GROUP BY label),
    named AS (SELECT label, CASE WHEN k = 1 THEN package ELSE package || ' #' || k END AS community FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY first, label) AS k FROM top) x)""",
    again=True,
)
def community_stats(g):
    return community.community_stats(community.name_communities(g, community.label_propagation(g)))


ENTRY = """calls AS (SELECT * FROM edges WHERE type IN ('CALLS', 'CALLS_API') AND confidence >= 0.5),
    score AS (SELECT n.id, n.node_seq, CAST(o.n AS DOUBLE) / (coalesce(i.n, 0) + 1) * CASE WHEN exported THEN 1.5 ELSE 0.8 END * CASE WHEN coalesce(i.n, 0) = 0 THEN 1.5 ELSE 1.0 END AS score
    FROM nodes n JOIN (SELECT source_id, count(*) AS n FROM calls GROUP BY 1) o ON o.source_id = n.id LEFT JOIN (SELECT target_id, count(*) AS n FROM calls GROUP BY 1) i ON i.target_id = n.id
    WHERE n.type NOT IN ('Package', 'File', 'Enum', 'Trait', 'Type', 'Interface'))"""


@on_graph("entry_points", "SELECT id, round(score, 6) AS score FROM score WHERE score > 0.1 ORDER BY round(score.score, 9) DESC, node_seq, id LIMIT 200", ENTRY)
def entry_points(g):
    return process.entry_points(g).select("id", F.round("score", 6).alias("score"))


@on_graph("processes", again=True)
def processes(g):
    flows = process.detect_processes(g)
    return flows.select("entry", "name", "label", "complexity", "depth", "process_type", F.array_join("trace", ",").alias("trace"), F.size("steps").alias("steps"))


# Storage.


@on_graph("repo_catalog", "SELECT n.repo, n.n AS nodes, e.n AS edges FROM (SELECT repo, count(*) AS n FROM nodes GROUP BY repo) n JOIN (SELECT s.repo, count(*) AS n FROM edges e JOIN nodes s ON s.id = e.source_id GROUP BY s.repo) e ON e.repo = n.repo")
def repo_catalog(g):
    return graph_store.repo_catalog(g)


@on_graph("upsert_nodes", "SELECT id, CASE WHEN type = 'Package' THEN upper(name) || '!' ELSE name END AS name FROM nodes")
def upsert_nodes(g):
    new = g.nodes.where("type = 'Package'").withColumn("name", F.concat(F.upper("name"), F.lit("!")))
    return graph_store.upsert(g.nodes, new).select("id", "name")


GONE = "SELECT id FROM nodes WHERE file IN (SELECT file FROM nodes WHERE type = 'File' AND contains(file, 'promo'))"


@on_graph("remove_files", f"SELECT id, type FROM edges WHERE source_id NOT IN ({GONE}) AND target_id NOT IN ({GONE})")
def remove_files(g):
    return graph_store.remove_files(g, g.nodes.where("type = 'File' AND contains(file, 'promo')").select("file")).edges.select("id", "type")


@on_graph("merge_repos", "SELECT repo, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT 'a' AS repo, id FROM nodes UNION ALL SELECT 'b', id FROM nodes) x GROUP BY repo")
def merge_repos(g):
    bare = CodeGraph.of(g.nodes.drop("repo"), g.edges)
    both = graph_store.merge_repos({"a": bare, "b": bare}).nodes
    return both.groupBy("repo").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@on_graph("select_nodes", "SELECT id FROM nodes WHERE type = 'Class' AND language = 'python' AND exported")
def select_nodes(g):
    return g.select(type="Class", language="python", exported=True).select("id")


@on_graph("edge_lookup", f"SELECT id, 'in' AS way FROM edges WHERE target_id = '{TARGET}' AND type = 'CALLS' UNION ALL SELECT id, 'out' FROM edges WHERE source_id = '{TARGET}'")
def edge_lookup(g):
    return g.incoming(TARGET, "CALLS").select("id", F.lit("in").alias("way")).unionByName(g.outgoing(TARGET).select("id", F.lit("out").alias("way")))


@on_graph("sparse_round_trip", "SELECT id, receiver, is_test FROM nodes")
def sparse_round_trip(g):
    packed = graph_store.pack_sparse(g.nodes.select("id", "receiver", "is_test"), ("receiver", "is_test"))
    return graph_store.unpack_sparse(packed, "receiver string, is_test boolean")
