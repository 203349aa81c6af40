"""Mixing, sharding and packing against the definitions."""

import zlib
from collections import Counter, defaultdict

import pytest

from graphloom.llm import mixing, packing, sharding

from .helpers import frame, make_rows, water_fill, words


def sainte_lague(votes, seats):
    """One seat at a time by highest quotient; ties to the smaller key."""
    held = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = min((k for k in votes if votes[k] > 0), key=lambda k: (-votes[k] / (2 * held[k] + 1), k))
        held[best] += 1
    return held


@pytest.mark.parametrize("seats", [0, 1, 7, 50, 333])
def test_sainte_lague(spark, seats):
    import random

    rnd = random.Random(seats)
    parties = {f"p{i:02}": rnd.choice([0, 1, 1, 5, 40, 900, 77.5]) for i in range(23)}
    df = spark.createDataFrame([(k, float(v), seats) for k, v in parties.items()], "key string, votes double, seats long")
    got = {r.key: r.quota for r in mixing.sainte_lague(df, "key").collect()}
    assert got == sainte_lague(parties, seats)


def test_water_fill(spark):
    rows = make_rows(11)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = water_fill(sizes)
    plan = mixing.mix_plan(frame(spark, rows))
    got = {r.id: (r.source_size, r.target, r["size"]) for r in plan.collect()}
    for i, text, _, source in rows:
        assert got[i][0] == sizes[source] and got[i][2] == len(words(text))
        assert got[i][1] == pytest.approx(want[source])


@pytest.mark.parametrize("shard_words", [200, 65_536])
def test_mix_plan(spark, shard_words):
    rows = make_rows(12)
    docs = frame(spark, rows)
    run = lambda d: sorted(tuple(r) for r in mixing.mix_plan(d, block_words=8, shard_words=shard_words).select("id", "size", "taken", "target").collect())
    got = run(docs)
    assert got == run(docs.repartition(5))  # reruns agree
    assert len(got) == len(rows)
    assert all(0 <= taken <= 2 * size for _, size, taken, _ in got)
    source = {r[0]: r[3] for r in rows}
    taken, target = Counter(), {}
    for i, _, t, goal in got:
        taken[source[i]] += t
        target[source[i]] = goal
    shards = sum(len(words(r[1])) for r in rows) // shard_words + 1
    for s, goal in target.items():
        assert abs(taken[s] - goal) <= 8 * (2 + shards)


def test_mix_sources_texts(spark):
    rows = make_rows(13)
    docs = frame(spark, rows)
    out = mixing.mix_sources(docs, block_words=8)
    assert out.columns == docs.columns
    plan = mixing.mix_plan(docs, block_words=8).groupBy("id").sum("taken").collect()
    want = {r[0]: r[1] for r in plan if r[1]}
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
        assert r.size == 5 and r.kept == "kept"
    assert got == want


def test_hilbert_curve():
    table = sharding.hilbert_table()
    at = {i: (p >> 8, p >> 4 & 15, p & 15) for p, i in enumerate(table)}
    assert sorted(at) == list(range(4096))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1])) == 1 for i in range(4095))


def test_shard_plan(spark):
    rows = make_rows(14, n=900) + [(None, None, None, None), (None, "q", "en", "b")] + [(5000 + i, "hot copy", "en", "a") for i in range(300)]
    got = sharding.shard_plan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {(r[0], (r[1] or "")) for r in rows}
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for r in got:
        if r.id is not None:
            text = by_id[r.id].encode()
            assert (r["size"], r.text_crc32) == (len(text) + 8, zlib.crc32(text))
    target = sum(size.values()) / 24
    largest = max(len(t.encode()) for _, t in texts) + 8
    assert max(size.values()) <= target * 1.25 + largest
    shards = defaultdict(set)
    for r in got:
        shards[r.digest].add(r.shard)
    for digest, own in shards.items():
        n = sum(r["size"] for r in got if r.digest == digest)
        assert len(own) == 1 or n > sharding.WHOLE_SHARE * target


def test_write_shards(spark, tmp_path):
    rows = make_rows(15, n=200)
    docs = frame(spark, rows)
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == [*docs.columns, "shard_"]
    back = back.collect()
    assert sorted(r.doc_id for r in back) == sorted(r[0] for r in rows)
    assert {r.shard for r in back} == {"shard"} and {r.shard_ for r in back} <= set(range(4))


def test_repeated_rows_are_cut_and_dealt(spark):
    """One row a thousand times, and a thousand rows without an id, spread over shards, bins and blocks."""
    rows = [(7, "the same text over and over", "en", "a")] * 900 + [(None, "no id at all here", "en", "a")] * 900 + make_rows(21, n=50)
    docs = frame(spark, rows)
    got = sharding.shard_plan(docs, shards=6).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    mean = sum(size.values()) / 6
    assert len(got) == len(rows) and max(size.values()) < 1.25 * mean + max(r["size"] for r in got)
    packed = packing.pack(docs, shard_rows=100).collect()
    in_shard = Counter(r.shard for r in packed)
    assert len(packed) >= len(rows) and max(in_shard.values()) < 250
    assert Counter(r.id for r in packed if r.piece == 0)[7] == 900 + sum(r[0] == 7 for r in rows[1800:])
    mixed = mixing.mix_sources(docs, block_words=8)
    assert mixed.columns == docs.columns and mixed.where("doc_id = 7").count() > 900


@pytest.mark.parametrize("name", ["key", "row", "shard", "c0"])
def test_clashing_columns(spark, tmp_path, name):
    docs = spark.createDataFrame([(i, f"some words {i % 3} here", "en", "ab"[i % 2], f"own{i}") for i in range(12)], f"doc_id long, text string, lang string, source string, {name} string")
    mixed = mixing.mix_sources(docs, block_words=2)
    assert mixed.columns == docs.columns and all(r[name] == f"own{r.doc_id}" for r in mixed.collect())
    sharding.write_shards(docs, str(tmp_path / "o"), shards=2)
    assert all(r[name] == f"own{r.doc_id}" for r in spark.read.parquet(str(tmp_path / "o")).collect())


def test_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("", "a b c d", "en", "a"), ("x", "a b c d", "en", "a"), (None, "e f", "en", "b"), ("y", None, None, None)], "doc_id string, text string, lang string, source string")
    assert sorted(r.id or "" for r in packing.pack(docs).collect()) == ["", "", "x", "y"]
    assert mixing.mix_plan(docs).count() == sharding.shard_plan(docs, shards=2).count() == 4


def test_tightest_compatible_bin_by_brute_force():
    rnd = __import__("random").Random(4)
    sizes = sorted((rnd.randint(1, 60) for _ in range(300)), reverse=True)
    sources, clusters = [rnd.choice("aaaab") for _ in sizes], [rnd.choice([1, 1, 2, *range(3, 200)]) for _ in sizes]
    bins, want = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        fits = [k for k, b in enumerate(bins) if b["room"] >= size and b["sources"].count(source) < 2 and cluster not in b["clusters"]]
        k = min(fits, key=lambda k: (bins[k]["room"], k), default=len(bins))
        if k == len(bins):
            bins.append({"room": 100, "sources": [], "clusters": []})
        want.append((k, len(bins[k]["sources"]), 100 - bins[k]["room"]))
        bins[k]["room"] -= size
        bins[k]["sources"].append(source)
        bins[k]["clusters"].append(cluster)
    assert packing.pack_shard(sizes, sources, clusters, 100, 2) == want


def test_pack_shard_best_fit():
    # 60 + 40 fill a bin; the second 40 of the same cluster must not join the first bin.
    places = packing.pack_shard([60, 40, 40, 55], ["a", "b", "b", "c"], [1, 2, 2, 3], 100, 1)
    bins = [p[0] for p in places]
    assert bins[0] == bins[1] and bins[2] == bins[3]
    # the tightest bin has the source already, so the successor takes the piece
    places = packing.pack_shard([70, 60, 30], ["a", "b", "a"], [1, 2, 3], 100, 1)
    assert places[2][0] == places[1][0]


def test_pack(spark):
    rows = make_rows(16)
    docs = frame(spark, rows)
    got = packing.pack(docs, capacity=100, per_source=2, shard_rows=40).collect()
    sizes, spans = Counter(), defaultdict(list)
    for r in got:
        if r.bin >= 0:
            spans[r.shard, r.bin].append((r.position, r.offset, r.n_words, r.id))
        sizes[r.id] += r.n_words
    want = Counter()
    for r in rows:
        want[r[0]] += len(words(r[1]))
    assert sizes == want
    text, source = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    for pieces in spans.values():
        pieces.sort()
        at = 0
        for position, (p, offset, n, _) in enumerate(pieces):
            assert (p, offset) == (position, at)
            at += n
        assert at <= 100
        assert max(Counter(source[i] for *_, i in pieces).values()) <= 2
        assert max(Counter(text[i] for *_, i in pieces).values()) == 1


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert mixing.mix_plan(docs).count() == 0
    assert mixing.mix_sources(docs).count() == 0
    assert sharding.shard_plan(docs).count() == 0
    assert packing.pack(docs).count() == 0
