"""The derived graph against brute force over the tables."""

from collections import defaultdict

from graphloom.sources import derived

SF = "/root/testdata/sf0.001"
TYPES = {1: "CALLS_API", 2: "USES_COMPONENT", 3: "EXTENDS", 4: "IMPLEMENTS", 5: "USES_TYPE"}


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_edges_of_all_rows(spark):
    orders, methods = defaultdict(list), set()
    for r in table(spark, "lineitem"):
        orders[r.l_orderkey].append((r.l_linenumber, r.l_partkey, r.l_suppkey))
        if r.l_linenumber == 1:
            methods.add(("HAS_METHOD", f"struct:supplier:{r.l_suppkey}", f"sym:part:{r.l_partkey}"))
    calls = {
        (TYPES.get(k % 40, "CALLS"), f"sym:part:{a[1]}", f"sym:part:{b[1]}")
        for k, rows in orders.items() for a, b in zip(sorted(rows), sorted(rows)[1:]) if a[1] != b[1]
    }
    edges = derived.derived_graph(spark, SF).edges.collect()
    got = [(e.type, e.source_id, e.target_id) for e in edges if e.type in {"CALLS", "HAS_METHOD", *TYPES.values()}]
    assert len(got) == len(set(got)) and set(got) == calls | methods


def test_hunks_of_all_orders(spark):
    parts = {r.p_partkey for r in table(spark, "part")}
    want = sorted((10 * p + k % 7, k % 4) for k in (r.o_orderkey for r in table(spark, "orders")) if (p := k % len(parts)) in parts)
    got = derived.derived_hunks(spark, SF).collect()
    assert sorted((r.start_line, r.line_count) for r in got) == want
