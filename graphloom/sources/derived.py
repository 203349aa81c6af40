"""A code graph derived from the driver's star-schema tables, for tests, checks and the benchmark.

The statements below are written in the dialect that Spark and DuckDB share, so that the same rows feed the
Spark queries and their oracles; {name} stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..graph import CodeGraph

#: Sequence numbers place the kinds of nodes one after the other.
_KIND = 1_000_000_000_000

PARTS = """
    SELECT p_partkey, p_size, p_brand, p_type,
           split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS name,
           'src/' || replace(p_brand, '#', '_') || '/' || lower(p_type) || '.ts' AS file
    FROM {part}
"""

NODES = f"""
    SELECT CAST(r_regionkey AS BIGINT) AS node_seq, 'mod:region:' || CAST(r_regionkey AS STRING) AS id, 'Module' AS type,
           r_name AS name, '' AS file, 0 AS start_line, 0 AS end_line, 'go' AS language, r_name AS package,
           false AS exported, 'tpch' AS repo, CAST(NULL AS STRING) AS community, false AS is_test, CAST(NULL AS STRING) AS receiver
    FROM {{region}}
    UNION ALL
    SELECT {_KIND} + n_nationkey, 'pkg:nation:' || CAST(n_nationkey AS STRING), 'Package', n_name, '', 0, 0, 'go', n_name,
           true, 'tpch', NULL, false, NULL
    FROM {{nation}}
    UNION ALL
    SELECT 2 * {_KIND} + s_suppkey, 'struct:supplier:' || CAST(s_suppkey AS STRING), 'Struct', s_name,
           'apps/' || lower(r_name) || '/' || lower(n_name) || '/suppliers.go',
           CAST(20 * s_suppkey + 1 AS INT), CAST(20 * s_suppkey + 16 AS INT), 'go', n_name, s_acctbal >= 0, 'tpch', NULL, false, NULL
    FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
    UNION ALL
    SELECT 3 * {_KIND} + p_partkey, 'sym:part:' || CAST(p_partkey AS STRING),
           CASE p_partkey % 4 WHEN 0 THEN 'Function' WHEN 1 THEN 'Method' WHEN 2 THEN 'Class' ELSE 'Interface' END,
           name, file, CAST(10 * p_partkey + 1 AS INT), CAST(10 * p_partkey + p_size AS INT),
           CASE p_partkey % 12 WHEN 0 THEN 'go' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' WHEN 3 THEN 'rust' WHEN 4 THEN 'java'
                WHEN 5 THEN 'c' WHEN 6 THEN 'cpp' WHEN 7 THEN 'ruby' WHEN 8 THEN 'php' WHEN 9 THEN 'csharp' WHEN 10 THEN 'kotlin' ELSE 'swift' END,
           p_brand, p_size > 10, 'tpch', NULL, p_type = 'PROMO', CASE WHEN p_partkey % 4 = 1 THEN p_brand END
    FROM ({PARTS}) p
    UNION ALL
    SELECT 4 * {_KIND} + min(p_partkey), 'file:' || file, 'File', file, file, 0, 0, 'typescript', min(p_brand), false, 'tpch', NULL, false, NULL
    FROM ({PARTS}) p GROUP BY file
    UNION ALL
    SELECT 5 * {_KIND} + min(c_custkey), 'file:data/' || lower(c_mktsegment) || '.ts', 'File', lower(c_mktsegment), 'data/' || lower(c_mktsegment) || '.ts',
           0, 0, 'typescript', c_mktsegment, false, 'tpch', NULL, false, NULL
    FROM {{customer}} GROUP BY c_mktsegment
    UNION ALL
    SELECT 6 * {_KIND} + n_nationkey, 'enum:nation:' || CAST(n_nationkey AS STRING), 'Enum', n_name || 'Code', 'data/codes.ts',
           CAST(4 * n_nationkey + 1 AS INT), CAST(4 * n_nationkey + 3 AS INT), 'typescript', 'data', false, 'tpch', NULL, false, NULL
    FROM {{nation}}
"""


#: The relation of consecutive parts of an order follows from the order's number.
EDGES = f"""
    SELECT CAST(e.seq AS BIGINT) AS edge_seq, e.type || ':' || e.source_id || ':' || e.target_id AS id, e.type, e.source_id, e.target_id, e.confidence
    FROM (
        SELECT type, source_id, target_id, {_KIND} * 100 * min(rank) + min(seq * 4 + flag) AS seq,
               CASE min(seq * 4 + flag) % 4 WHEN 0 THEN 0.4 WHEN 1 THEN 0.7 ELSE 1.0 END AS confidence
        FROM (
            SELECT CASE l_orderkey % 40 WHEN 1 THEN 'CALLS_API' WHEN 2 THEN 'USES_COMPONENT' WHEN 3 THEN 'EXTENDS'
                        WHEN 4 THEN 'IMPLEMENTS' WHEN 5 THEN 'USES_TYPE' ELSE 'CALLS' END AS type,
                   CASE WHEN l_orderkey % 40 BETWEEN 1 AND 5 THEN l_orderkey % 40 ELSE 0 END AS rank,
                   l_orderkey * 10 + l_linenumber AS seq,
                   CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag,
                   'sym:part:' || CAST(l_partkey AS STRING) AS source_id,
                   'sym:part:' || CAST(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS STRING) AS target_id
            FROM {{lineitem}}
        ) calls WHERE target_id IS NOT NULL AND source_id <> target_id
        GROUP BY type, source_id, target_id
        UNION ALL
        SELECT 'DEFINES', 'file:' || file, 'sym:part:' || CAST(p_partkey AS STRING), {_KIND} * 600 + p_partkey, 1.0 FROM ({PARTS}) p
        UNION ALL
        SELECT 'CONTAINS', 'mod:region:' || CAST(n_regionkey AS STRING), 'pkg:nation:' || CAST(n_nationkey AS STRING), {_KIND} * 700 + n_nationkey, 1.0
        FROM {{nation}}
        UNION ALL
        SELECT DISTINCT 'HAS_METHOD', 'struct:supplier:' || CAST(l_suppkey AS STRING), 'sym:part:' || CAST(l_partkey AS STRING),
               {_KIND} * 800 + l_suppkey * 1000000 + l_partkey, 1.0
        FROM {{lineitem}} WHERE l_linenumber = 1
        UNION ALL
        SELECT 'IMPORTS', 'pkg:nation:' || CAST(a AS STRING), 'pkg:nation:' || CAST(b AS STRING), {_KIND} * 900 + min(k), 1.0
        FROM (SELECT s_suppkey AS k, s_nationkey AS a, lead(s_nationkey) OVER (ORDER BY s_suppkey) AS b FROM {{supplier}}) s
        WHERE b IS NOT NULL GROUP BY a, b
    ) e
"""

#: A hunk of each order.
HUNKS = f"""
    SELECT file, CAST(10 * p_partkey + o_orderkey % 7 AS INT) AS start_line, CAST(o_orderkey % 4 AS INT) AS line_count
    FROM {{orders}} JOIN ({PARTS}) p ON p_partkey = o_orderkey % (SELECT count(*) FROM {{part}})
"""

TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")

#: The graph as common table expressions for an oracle.
GRAPH_CTE = "nodes AS (" + NODES.format(**{t: t for t in TABLES}) + "), edges AS (" + EDGES.format(**{t: t for t in TABLES}) + ")"
HUNKS_CTE = "hunks AS (" + HUNKS.format(**{t: t for t in TABLES}) + ")"


def _run(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in statement}
    return spark.sql(statement, **tables)


def derived_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    return CodeGraph.of(_run(spark, sf_dir, NODES), _run(spark, sf_dir, EDGES))


def derived_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, HUNKS)
