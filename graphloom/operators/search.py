"""Ranked search: BM25 over postings, prefix search, cosine neighbours and reciprocal-rank fusion."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cosine, index_tokens, search_tokens
from ..graph import CodeGraph
from ..storage import staged

K1, B = 1.5, 0.75
RRF_K = 60
EMBEDDABLE = ("Function", "Method", "Struct", "Interface", "Component", "Type", "Class", "Enum", "Trait", "Module")


def node_documents(graph: CodeGraph) -> DataFrame:
    """(id, seq, tokens) of all but File nodes: the name three times, the file and the package."""
    name = search_tokens("name")
    tokens = F.concat(name, name, name, search_tokens("file"), search_tokens("package"))
    return graph.nodes.where("type <> 'File'").select("id", F.col("node_seq").alias("seq"), tokens.alias("tokens"))


def postings(docs: DataFrame) -> DataFrame:
    """(token, id, seq, tf, dl): the inverted index of (id, seq, tokens)."""
    rows = docs.select("id", "seq", F.size("tokens").alias("dl"), F.explode("tokens").alias("token"))
    return rows.groupBy("token", "id", "seq", "dl").agg(F.count("*").alias("tf"))


def index_stats(docs: DataFrame) -> DataFrame:
    """One row (n_docs, avgdl)."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("avgdl"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count("*").alias("df"))


def bm25(index: DataFrame, stats: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, score) of the best documents; only postings of the query's tokens are read."""
    spark = index.sparkSession
    asked = spark.range(1).select(F.explode(search_tokens(F.lit(query))).alias("token")).groupBy("token").agg(F.count("*").alias("times"))
    n_docs, avgdl = stats.first()
    hits = index.join(F.broadcast(asked), "token")  # as many rows as the query has words
    frequency = document_frequency(hits)
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl or 1.0)))
    scored = hits.join(F.broadcast(frequency), "token").groupBy("id", "seq").agg(F.sum(F.col("times") * idf * gain).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), "seq", "id").limit(limit).select("id", "score")


def bm25_scan(docs: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """bm25 without an index: one pass over (id, seq, tokens) that keeps lengths and the query's counts only."""
    spark = docs.sparkSession
    asked = spark.range(1).select(F.explode(search_tokens(F.lit(query))).alias("t")).groupBy("t").count().orderBy("t").collect()
    if not asked:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    occurrences = lambda word: F.size(F.filter("tokens", lambda t: t == word))
    tf = [occurrences(a["t"]).alias(f"tf{k}") for k, a in enumerate(asked)]
    counts = staged(docs.select("id", "seq", F.size("tokens").alias("dl"), *tf))
    has = [F.count_if(F.col(f"tf{k}") > 0) for k in range(len(asked))]
    n_docs, avgdl, *df = counts.agg(F.count("*"), F.avg("dl"), *has).first()
    score = F.lit(0.0)
    for k, a in enumerate(asked):
        idf = math.log(1 + (n_docs - df[k] + 0.5) / (df[k] + 0.5))
        tf = F.col(f"tf{k}")
        score = score + a["count"] * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl or 1.0)))
    scored = counts.select("id", "seq", score.alias("score")).where("score > 0")
    return scored.orderBy(F.desc(F.round("score", 9)), "seq", "id").limit(limit).select("id", "score")


def prefix_search(graph: CodeGraph, query: str, limit: int = 50) -> DataFrame:
    """Nodes with a token, in name, package or file, that starts with one of the query's."""
    spark = graph.nodes.sparkSession
    asked = [r[0] for r in spark.range(1).select(F.explode(index_tokens(F.lit(query)))).collect()]
    if not asked:
        return graph.nodes.limit(0)
    own = F.concat(index_tokens("name"), index_tokens("package"), index_tokens("file"))
    starts = F.exists(own, lambda t: F.array_max(F.array(*[t.startswith(a) for a in asked])))
    return graph.nodes.where(starts).orderBy("node_seq", "id").limit(limit)


def like_search(graph: CodeGraph, query: str, limit: int = 50) -> DataFrame:
    text = "%" + query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    where = F.col("name").ilike(text) | F.col("package").ilike(text) | F.col("file").ilike(text)
    return graph.nodes.where(where).orderBy("node_seq", "id").limit(limit)


def nearest(vectors: DataFrame, query: list[float], limit: int = 10) -> DataFrame:
    """(id, score) by exact cosine over (id, embedding); a vector of another length is an error."""
    q = F.array(*[F.lit(float(x)) for x in query])
    fits = F.assert_true(F.size("embedding") == len(query), F.lit("vector dimensions differ"))
    rows = vectors.select("id", F.when(fits.isNull(), cosine("embedding", q)).alias("score"))
    return rows.orderBy(F.desc(F.round("score", 9)), "id").limit(limit)


def fuse(ranked: DataFrame, semantic: DataFrame, limit: int = 20) -> DataFrame:
    """Reciprocal-rank fusion of two (id, score) lists: id, score, sources, bm25_score, semantic_score."""
    def places(rows, name):
        place = F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id"))  # bounded lists
        return rows.select("id", F.col("score").alias(f"{name}_score"), (1 / (RRF_K + place)).alias(f"{name}_part"))

    both = places(ranked, "bm25").join(places(semantic, "semantic"), "id", "full")
    parts = [F.coalesce(f"{n}_part", F.lit(0.0)) for n in ("bm25", "semantic")]
    names = F.array_compact(F.array(*[F.when(F.col(f"{n}_part").isNotNull(), n) for n in ("bm25", "semantic")]))
    both = both.select("id", (parts[0] + parts[1]).alias("score"), names.alias("sources"), "bm25_score", "semantic_score")
    return both.orderBy(F.desc(F.round("score", 12)), "id").limit(limit)


def hybrid(ranked: DataFrame, vectors: DataFrame | None, query: list[float] | None, limit: int = 20) -> DataFrame:
    """Fusion with the 2 x limit nearest vectors; without vectors the ranked list alone."""
    spark = ranked.sparkSession
    if vectors is None or query is None or vectors.isEmpty():
        return fuse(ranked, spark.createDataFrame([], "id string, score double"), limit)
    return fuse(ranked, nearest(vectors, query, 2 * limit), limit)


def embedding_text(nodes: DataFrame) -> DataFrame:
    """(id, text) of nodes worth embedding: labelled lines, empty ones left out."""
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    many = lambda label, c: line(label, F.array_join(c, ", "))
    text = F.concat_ws(
        "\n",
        F.concat("type", F.lit(": "), "name"),
        line("Package", F.col("package")),
        line("File", F.col("file")),
        F.concat(F.lit("Language: "), F.col("language")),
        F.when(F.col("exported"), F.lit("Exported: true")),
        line("Receiver", F.col("receiver")),
        many("Params", F.col("params")),
        line("Returns", F.col("return_type")),
        many("Fields", F.col("fields")),
        many("Methods", F.col("method_signatures")),
        many("Props", F.col("props")),
    )
    return nodes.where(F.col("type").isin(*EMBEDDABLE)).select("id", text.alias("text"))


def hashed_vectors(texts: list[str], dims: int) -> np.ndarray:
    """A deterministic stand-in for a sentence model, a batch at once: signed feature hashing of words, unit length.

    The first eight hex digits of a word's MD5 give its place, an even ninth its sign. Each distinct word is hashed once.
    """
    lists = [(t or "").lower().split() for t in texts]
    owner = np.repeat(np.arange(len(lists)), [len(w) for w in lists])
    number = {w: k for k, w in enumerate(dict.fromkeys(w for own in lists for w in own))}
    digests = [hashlib.md5(w.encode(), usedforsecurity=False).hexdigest() for w in number]
    place = np.array([int(d[:8], 16) % dims for d in digests], np.int64)
    sign = np.array([1.0 if int(d[8], 16) % 2 == 0 else -1.0 for d in digests])
    word = np.array([number[w] for own in lists for w in own], np.int64)
    out = np.zeros((len(lists), dims))
    if len(word):
        np.add.at(out, (owner, place[word]), sign[word])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def embed(texts: DataFrame, dims: int = 384, encode=None) -> DataFrame:
    """(id, embedding) of (id, text), in Arrow batches; `encode(texts, dims)` may be a real model's and gives a row a text."""
    encode = encode or hashed_vectors

    @F.pandas_udf("array<float>")
    def vectors(batch: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encode(batch.tolist(), dims), np.float32)))

    return texts.select("id", vectors("text").alias("embedding"))
