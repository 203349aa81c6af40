"""Ranked search over documents, symbols and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search
from ..functions.columns import search_tokens
from ..sources import index_store
from ..sources.derived import GRAPH_CTE, derived_graph
from ..storage import scratch_path, staged
from . import register

TOKENS = r"""list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c},
    '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-zA-Z])(\d)', '\1 \2', 'g'), '(\d)([a-zA-Z])', '\1 \2', 'g'),
    '[^a-zA-Z0-9]+'), lambda x: x <> ''), lambda x: lower(x))"""


def tokens(c: str) -> str:
    return TOKENS.replace("{c}", c)


BM25 = """post AS (SELECT token, id, seq, len(tokens) AS dl, count(*) AS tf FROM (SELECT *, unnest(tokens) AS token FROM docs) x GROUP BY token, id, seq, dl, tokens),
    scored AS (SELECT id, seq, sum(ln(1 + ((SELECT count(*) FROM docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len(tokens)) FROM docs)))) AS score
        FROM post JOIN (SELECT token, count(*) AS df FROM post GROUP BY token) d USING (token) WHERE token IN ({asked}) GROUP BY id, seq)"""


def _docs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("seq"), search_tokens("text").alias("tokens"))


DOCS = f"docs AS (SELECT CAST(doc_id AS STRING) AS id, doc_id AS seq, {tokens('text')} AS tokens FROM documents)"


def _bm25_docs(spark, sf_dir, limit=20):
    return search.bm25_scan(_docs(spark, sf_dir), "the heart of anon", limit)


@register("bm25_documents", f"WITH {DOCS}, {BM25.format(asked=chr(39) + (chr(39) + ', ' + chr(39)).join(['the', 'heart', 'of', 'anon']) + chr(39))} SELECT id, round(score, 6) AS score FROM scored ORDER BY round(scored.score, 9) DESC, seq, id LIMIT 20")
def bm25_documents(spark, sf_dir):
    return _bm25_docs(spark, sf_dir).withColumn("score", F.round("score", 6))


NODE_DOCS = f"""docs AS (SELECT id, node_seq AS seq, list_concat(list_concat(list_concat({tokens('name')}, {tokens('name')}), {tokens('name')}), list_concat({tokens('file')}, {tokens('package')})) AS tokens
    FROM nodes WHERE type <> 'File')"""


@register("bm25_symbols", f"WITH {GRAPH_CTE}, {NODE_DOCS}, {BM25.format(asked=chr(39) + 'red' + chr(39) + ', ' + chr(39) + 'widget' + chr(39))} SELECT id, round(score, 6) AS score FROM scored ORDER BY round(scored.score, 9) DESC, seq, id LIMIT 20")
def bm25_symbols(spark, sf_dir):
    docs = search.node_documents(derived_graph(spark, sf_dir))
    return search.bm25_scan(docs, "redWidget").withColumn("score", F.round("score", 6))


@register("bm25_index", f"WITH {GRAPH_CTE}, {NODE_DOCS}, {BM25.format(asked=chr(39) + 'blue' + chr(39) + ', ' + chr(39) + 'bolt' + chr(39))} SELECT id, round(score, 6) AS score FROM scored ORDER BY round(scored.score, 9) DESC, seq, id LIMIT 20")
def bm25_index(spark, sf_dir):
    docs = staged(search.node_documents(derived_graph(spark, sf_dir)))
    index = staged(search.postings(docs))
    return search.bm25(index, search.index_stats(docs), "blueBolt").withColumn("score", F.round("score", 6))


@register("bm25_saved", f"WITH {DOCS}, {BM25.format(asked=chr(39) + 'heart' + chr(39) + ', ' + chr(39) + 'anon' + chr(39))} SELECT id, round(score, 6) AS score FROM scored ORDER BY round(scored.score, 9) DESC, seq, id LIMIT 20")
def bm25_saved(spark, sf_dir):
    path = scratch_path(spark)
    index_store.save_index(_docs(spark, sf_dir), path)
    return search.bm25(*index_store.load_index(spark, path), "heart anon").withColumn("score", F.round("score", 6))


@register("document_frequency", f"WITH {DOCS} SELECT token, count(*) AS df FROM (SELECT DISTINCT id, unnest(tokens) AS token FROM docs) x GROUP BY token")
def document_frequency(spark, sf_dir):
    return search.document_frequency(search.postings(_docs(spark, sf_dir)))


@register("index_stats", f"WITH {DOCS} SELECT count(*) AS n_docs, round(avg(len(tokens)), 6) AS avgdl FROM docs")
def index_stats(spark, sf_dir):
    return search.index_stats(_docs(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 6))


PREFIX = r"""list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace({c}, '[_\-./\\]+', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '\s+'), lambda x: x <> '')"""


@register(
    "prefix_search",
    f"""WITH {GRAPH_CTE} SELECT id FROM nodes WHERE len(list_filter(list_concat(list_concat({PREFIX.replace('{c}', 'name')}, {PREFIX.replace('{c}', 'package')}), {PREFIX.replace('{c}', 'file')}),
    lambda x: starts_with(x, 'giz') OR starts_with(x, 'promo'))) > 0 ORDER BY node_seq, id LIMIT 50""",
)
def prefix_search(spark, sf_dir):
    return search.prefix_search(derived_graph(spark, sf_dir), "giz_promo").select("id")


@register("like_search", f"WITH {GRAPH_CTE} SELECT id FROM nodes WHERE name ILIKE '%BOLT%' OR package ILIKE '%BOLT%' OR file ILIKE '%BOLT%' ORDER BY node_seq, id LIMIT 50")
def like_search(spark, sf_dir):
    return search.like_search(derived_graph(spark, sf_dir), "BOLT").select("id")


NEAR = """near AS (SELECT CAST(vec_id AS STRING) AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score,
    list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS exact FROM embeddings)"""


def _vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    query = rows.where("vec_id = 0").first()["embedding"]
    return rows.select(F.col("vec_id").cast("string").alias("id"), "embedding"), query


@register("cosine_nearest", f"WITH {NEAR} SELECT id, score FROM near ORDER BY round(exact, 9) DESC, id LIMIT 10")
def cosine_nearest(spark, sf_dir):
    vectors, query = _vectors(spark, sf_dir)
    return search.nearest(vectors, query).withColumn("score", F.round("score", 6))


FUSED = f"""WITH {DOCS}, {BM25.format(asked=chr(39) + (chr(39) + ', ' + chr(39)).join(['the', 'heart', 'of', 'anon']) + chr(39))}, {NEAR},
    a AS (SELECT id, score, 1.0 / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, id)) AS part FROM (SELECT id, score FROM scored ORDER BY round(scored.score, 9) DESC, seq, id LIMIT 20) x),
    b AS (SELECT id, exact, 1.0 / (60 + row_number() OVER (ORDER BY round(exact, 9) DESC, id)) AS part FROM (SELECT id, exact FROM near ORDER BY round(exact, 9) DESC, id LIMIT 40) y)
    SELECT coalesce(a.id, b.id) AS id, round(coalesce(a.part, 0) + coalesce(b.part, 0), 9) AS score,
        CASE WHEN b.id IS NULL THEN 'bm25' WHEN a.id IS NULL THEN 'semantic' ELSE 'bm25,semantic' END AS sources
    FROM a FULL JOIN b ON a.id = b.id ORDER BY round(coalesce(a.part, 0) + coalesce(b.part, 0), 12) DESC, coalesce(a.id, b.id) LIMIT 20"""


@register("hybrid_search", FUSED)
def hybrid_search(spark, sf_dir):
    vectors, query = _vectors(spark, sf_dir)
    fused = search.hybrid(_bm25_docs(spark, sf_dir), vectors, query)
    return fused.select("id", F.round("score", 9).alias("score"), F.array_join("sources", ",").alias("sources"))


@register(
    "embedding_text",
    f"""WITH {GRAPH_CTE} SELECT id, concat_ws(chr(10), type || ': ' || name, CASE WHEN package <> '' THEN 'Package: ' || package END, CASE WHEN file <> '' THEN 'File: ' || file END,
    'Language: ' || language, CASE WHEN exported THEN 'Exported: true' END, 'Receiver: ' || receiver) AS text FROM nodes WHERE type NOT IN ('Package', 'File')""",
)
def embedding_text(spark, sf_dir):
    return search.embedding_text(derived_graph(spark, sf_dir).nodes)


@register("embed_symbols")
def embed_symbols(spark, sf_dir):
    found = search.embed(search.embedding_text(derived_graph(spark, sf_dir).nodes))
    return found.select("id", F.size("embedding").alias("dims"), "embedding")


@register(
    "embedding_signs",
    f"""WITH {GRAPH_CTE}, texts AS (SELECT id, concat_ws(' ', type || ': ' || name, CASE WHEN package <> '' THEN 'Package: ' || package END, CASE WHEN file <> '' THEN 'File: ' || file END,
        'Language: ' || language, CASE WHEN exported THEN 'Exported: true' END, 'Receiver: ' || receiver) AS text FROM nodes WHERE type IN ({', '.join(repr(t) for t in search.EMBEDDABLE)})),
    words AS (SELECT id, md5(unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''))) AS h FROM texts),
    cells AS (SELECT id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 384 AS place, sum(1 - 2 * (CAST('0x' || substr(h, 9, 1) AS BIGINT) % 2)) AS n FROM words GROUP BY 1, 2)
    SELECT id, CAST(384 AS INT) AS dims, count(*) FILTER (n <> 0) AS filled, CAST(coalesce(sum((place + 1) * sign(n)), 0) AS BIGINT) AS signs FROM cells GROUP BY id""",
)
def embedding_signs(spark, sf_dir):
    """How many places of each symbol's embedding are filled, and with which signs."""
    found = search.embed(search.embedding_text(derived_graph(spark, sf_dir).nodes))
    signs = F.aggregate(F.transform("embedding", lambda x, i: F.signum(x).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, b: a + b)
    filled = F.size(F.filter("embedding", lambda x: x != 0)).cast("long")
    return found.select("id", F.size("embedding").alias("dims"), filled.alias("filled"), signs.alias("signs"))
