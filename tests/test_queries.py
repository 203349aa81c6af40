"""Registered queries against brute force."""

from graphloom.operators import community
from graphloom.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_classify_queries_reads_whole_texts(spark, tmp_path):
    texts = [" find all the circular imports ", "which of these names match*", "one_word_of_more_than_twelve_letters", "where is the widget made", "where is the gizmo made", "where is the widget made"]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, QUERIES["classify_queries"](spark, str(tmp_path)).select("text", "strategy").collect()))
    assert got == sorted([
        ("find all the circular imports", "structural"), ("which of these names match*", "pattern"), ("one_word_of_more_than_twelve_letters", "exact"),
        ("where is the widget made", "fulltext"), ("where is the gizmo made", "fulltext"),
    ])


def test_label_propagation_runs_to_its_default_of_ten_rounds(spark, monkeypatch):
    asked, run = [], community.label_propagation

    def recorded(g, rounds=10):
        asked.append(rounds)
        return run(g, rounds)

    monkeypatch.setattr(community, "label_propagation", recorded)
    labels = {r.id: r.label for r in QUERIES["label_propagation"](spark, SF).collect()}
    stats = QUERIES["community_stats"](spark, SF).first()
    assert asked == [10, 10]
    assert stats.communities == len(set(labels.values()))


def test_embed_symbols_returns_the_default_embedding(spark):
    rows = QUERIES["embed_symbols"](spark, SF).limit(5).collect()
    assert rows and all(r.dims == len(r.embedding) == 384 and any(r.embedding) for r in rows)


def test_enclosing_symbol_reads_tables_and_no_edges(spark):
    read = QUERIES["enclosing_symbol"](spark, SF).inputFiles()
    assert {f.rsplit("/", 1)[1] for f in read} >= {"part.parquet", "orders.parquet", "supplier.parquet"}
    assert all(f.endswith(".parquet") and "/testdata/sf0.001/" in f for f in read) and not any("lineitem" in f for f in read)
