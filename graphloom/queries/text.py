"""Scalar functions, stream windows and incremental comparison over the other tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import lookup
from ..sources import scan
from ..sources.derived import GRAPH_CTE, derived_graph
from ..streaming import watch
from . import register


@register(
    "normalize_pattern",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^/api/v1/', ''), ':[^/]+', '*', 'g'), '\$\{[^}]+\}', '*', 'g'), '\?.*$', ''), '^/+|/+$', '', 'g') AS path FROM pages""",
)
def normalize_pattern(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", columns.normalize_pattern("url").alias("path"))


@register(
    "symbol_functions",
    f"""WITH {GRAPH_CTE} SELECT id, regexp_replace(id, '[^a-zA-Z0-9_]', '_', 'g') AS mermaid, upper(substr(name, 1, 1)) || substr(name, 2) AS label,
        regexp_extract(file, '^(.*)/', 1) AS folder, CASE WHEN ends_with(file, '.go') THEN 'go' WHEN ends_with(file, '.ts') THEN 'typescript' END AS file_language,
        regexp_matches(file, '(?i)[._]test\\.|[._]spec\\.|__tests__|test/|tests/|_test\\.go$') AS in_test FROM nodes""",
)
def symbol_functions(spark, sf_dir):
    nodes = derived_graph(spark, sf_dir).nodes
    return nodes.select(
        "id", columns.mermaid_id("id").alias("mermaid"), columns.capitalized("name").alias("label"), columns.package_of("file").alias("folder"),
        columns.file_language("file").alias("file_language"), columns.is_test_file("file").alias("in_test"),
    )


def _first(text: str, patterns, field: int) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p[0]}') THEN {quote(p[field])}" for p in patterns) + " END"


PATHS, NAMES = columns.PATH_FRAMEWORKS, columns.NAME_FRAMEWORKS


@register(
    "framework_multipliers",
    f"""WITH {GRAPH_CTE}, hint AS (SELECT id, {_first("'/' || file", PATHS, 2)} AS pm, {_first("'/' || file", PATHS, 1)} AS pf, {_first("name", NAMES, 2)} AS nm, {_first("name", NAMES, 1)} AS nf FROM nodes)
    SELECT id, CASE WHEN pm IS NOT NULL AND (nm IS NULL OR pm >= nm) THEN pf ELSE coalesce(nf, 'unknown') END AS framework,
        CAST(CASE WHEN pm IS NOT NULL AND (nm IS NULL OR pm >= nm) THEN pm ELSE coalesce(nm, 1.0) END AS DOUBLE) AS multiplier FROM hint""",
)
def framework_multipliers(spark, sf_dir):
    nodes = derived_graph(spark, sf_dir).nodes
    name, multiplier = columns.framework(F.concat(F.lit("/"), "file"), "name")
    return nodes.select("id", name.alias("framework"), multiplier.alias("multiplier"))


@register(
    "classify_queries",
    """SELECT text, CASE WHEN regexp_matches(text, '[*?]') THEN 'pattern' WHEN NOT regexp_matches(text, '\\s') THEN 'exact'
        WHEN regexp_matches(lower(text), 'exported|no callers|no callees|unused|implements|extends|orphan|dead|circular|test|entry point') THEN 'structural' ELSE 'fulltext' END AS strategy
    FROM (SELECT DISTINCT trim(text) AS text FROM conversations) x""",
)
def classify_queries(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.trim("text").alias("text")).distinct()
    return texts.select("text", lookup.classify_column(F.col("text")).alias("strategy"))


@register(
    "last_user_turn",
    """SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS asked FROM conversations""",
)
def last_user_turn(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    asked = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.select("conv_id", "turn", F.coalesce(asked, F.lit(-1)).alias("asked"))


@register(
    "debounce_events",
    """SELECT user_id, min(ts) AS start, count(*) AS events, arg_max(event_type, (ts, event_type)) AS last_event, max(ts) AS last_ts FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (
            SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) x) y GROUP BY user_id, burst""",
)
def debounce_events(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return watch.debounce(rows, "30 minutes", key="user_id", event="event_type").select("user_id", "start", "events", "last_event", "last_ts")


@register(
    "compare_hashes",
    """SELECT file, CASE WHEN k = 2 THEN 'new' WHEN k = 1 THEN 'deleted' WHEN k = 0 THEN 'changed' ELSE 'unchanged' END AS status
    FROM (SELECT CAST(doc_id AS STRING) AS file, CASE WHEN doc_id % 10 < 3 THEN doc_id % 10 ELSE 3 END AS k FROM documents) x""",
)
def compare_hashes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("file"), F.col("doc_id") % 10, "text").toDF("file", "k", "content")
    old = docs.where("k <> 2").select("file", scan.content_hash().alias("hash"))
    new = docs.where("k <> 1").withColumn("content", F.when(F.col("k") == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return scan.compare(old, new.select("file", scan.content_hash().alias("hash")))
