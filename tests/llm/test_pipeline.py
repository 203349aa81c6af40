"""The pipeline stage by stage on a small folder, and the registered queries."""

import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from graphloom.llm import oracles, packing, toxicity
from graphloom.llm.queries import ORACLE_SQL, QUERIES

from .helpers import frame, near_components, shingles, words
from .test_filters import talk, toxic_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(9)
    rows, labels = toxic_rows(200)
    base = talk(rnd, 90) + [f"u{i}" for i in range(60)]
    rows += [(1000 + i, rows[1][1], "en", "b") for i in range(5)]  # exact copies of document 1
    rows += [(2000 + i, " ".join(base[:-1] + [f"v{i}"]), "en", "c") for i in range(6)]  # near copies
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages(spark, folder, tmp_path):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], path).write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
    for out in seen[1:-1]:
        assert out.columns == docs.columns
    before, clean, exact, near, mixed, packed = ([r.asDict() for r in d.collect()] for d in seen)
    severity = {r["id"]: r["expected_severity"] for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{path}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in clean} == {i for i, s in severity.items() if s < toxicity.LIMIT}
    assert len(clean) > 0.7 * len(before)
    best = {}
    for r in clean:
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"] for r in exact} == set(best.values())
    found = near_components([(r["doc_id"], r["text"]) for r in exact], 5)
    assert {r["doc_id"] for r in near} == {c for _, c in found.values()}
    assert {r["doc_id"] for r in near if r["doc_id"] >= 2000} == {2000}
    sizes = {r["doc_id"]: len(words(r["text"])) for r in near}
    taken = dict.fromkeys(sizes, 0)
    for r in mixed:
        taken[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert all(taken[i] <= 2 * sizes[i] for i in sizes)
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 32 * 8
    assert sum(r["n_words"] for r in packed) == sum(taken.values())
    plan = duckdb.connect()
    plan.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/2/*.parquet')")
    found = plan.execute(oracles.MIXING)
    at = [c[0] for c in found.description]
    assert taken == {r[at.index("doc_id")]: r[at.index("taken")] for r in found.fetchall()}
    rows_of = Counter((r["doc_id"], r["source"], r["text"]) for r in mixed)
    assert len(rows_of) and packs_tightest(packed, mixed)


def packs_tightest(packed, mixed):
    """Each shard's pieces, largest first, are where the tightest compatible bin of a plain search is."""
    source = {r["doc_id"]: r["source"] for r in mixed}
    clusters = {}
    for r in mixed:
        clusters.setdefault(r["doc_id"], set()).add(r["text"])
    shards = {}
    for r in packed:
        shards.setdefault(r["shard"], []).append(r)
    for rows in shards.values():
        bins = {}
        # A piece's turn: all larger pieces are placed, and those of its size that share its bin's earlier positions.
        for r in sorted(rows, key=lambda r: (-r["n_words"], r["bin"], r["position"])):
            if r["n_words"] and r["bin"] >= 0:
                own = bins.setdefault(r["bin"], {"used": 0, "sources": Counter()})
                assert own["used"] == r["offset"]
                own["used"] += r["n_words"]
                own["sources"][source[r["doc_id"]]] += 1
                assert own["used"] <= packing.CAPACITY and max(own["sources"].values()) <= packing.PER_SOURCE
        sizes = {}
        for r in rows:
            sizes.setdefault(r["bin"], []).append(r["n_words"])
        # No bin's first piece fits a bin opened before it that has room and neither conflict.
        for r in rows:
            if r["position"] == 0 and r["bin"] > 0:
                for k in range(r["bin"]):
                    before = [x for x in rows if x["bin"] == k and x["n_words"] >= r["n_words"] and x is not r]
                    larger = [x for x in before if x["n_words"] > r["n_words"]]
                    room = packing.CAPACITY - sum(x["n_words"] for x in before) >= r["n_words"]
                    sources = [source[x["doc_id"]] for x in larger].count(source[r["doc_id"]]) < packing.PER_SOURCE
                    conflict = any(clusters[x["doc_id"]] & clusters[r["doc_id"]] for x in before)
                    full = [source[x["doc_id"]] for x in before].count(source[r["doc_id"]]) >= packing.PER_SOURCE
                    assert not (room and sources and not conflict and not full)
    return True


def test_edges_of_the_pipeline(spark, tmp_path):
    """Nulls, empty and repeated rows, ties, clashing names; then an empty table."""
    names = "doc_id long, text string, lang string, source string, n_chars long, row long, size string, kept string, c0 string"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "one two three", None, "a", 13), (2, "one two three", None, "a", 13), (3, "one two three", "en", None, 13), (4, "x", "en", "b", 1)]
    for at, own in (("full", rows), ("none", [])):
        path = str(tmp_path / at)
        spark.createDataFrame([(*r, 7, "s", "k", "c") for r in own], names).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, path)
            assert after.columns == docs.columns
            assert all((r["row"], r["size"], r["kept"], r["c0"]) == (7, "s", "k", "c") for r in after.collect())
        packed = corpus_pipeline.run(spark, path).collect()
        # The largest id of the copies stays; what has no words is never taken by the mixture.
        assert {r["doc_id"] for r in packed} <= {3, 4} and bool(packed) == bool(own)


def test_run_is_the_stages(spark, folder):
    path, _ = folder
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert corpus_pipeline.run(spark, path).count() > 0


def test_registry():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert shingles("A b", 4) == {("a", "b")}
