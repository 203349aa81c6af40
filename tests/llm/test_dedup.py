"""Exact, near and substring deduplication against brute force."""

import hashlib

import pytest

from graphloom.llm import components, exact_dedup, minhash, substring

from .helpers import frame, make_rows, near_components, removed_words, shingles


@pytest.mark.parametrize("counters", [2, 256])
def test_exact_groups(spark, counters):
    rows = make_rows(1) + [(None, "only null ids", "en", "a"), (None, "x", "en", "a"), (500, "x", None, None)]
    got = exact_dedup.digest_groups(frame(spark, rows), counters=counters).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(text or "", []).append(i)
    for text, ids in groups.items():
        digest = hashlib.sha256(text.encode()).digest()
        own = [r for r in got if bytes(r.digest) == digest]
        best = max((i for i in ids if i is not None), default=None)
        assert len(own) == len(ids)
        assert {(r.keep_id, r.group_size) for r in own} == {(best, len(ids))}
        assert [r.id for r in own if r.kept] == [best]


def test_exact_dedup_keeps_columns(spark):
    rows = make_rows(2)
    docs = frame(spark, rows)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    out = kept.collect()
    assert sorted((r.text or "") for r in out) == sorted({r[1] or "" for r in rows})
    best = {}
    for r in rows:
        best[r[1] or ""] = max(best.get(r[1] or "", -1), r[0])
    assert {r.doc_id for r in out} == set(best.values())


def test_misra_gries_bound(spark):
    values = ["hot"] * 500 + [f"v{i}" for i in range(700)] + ["warm"] * 200
    df = spark.createDataFrame([(v.encode(),) for v in values], "digest binary").repartition(3)
    low = {}
    for r in exact_dedup.misra_gries(df, "digest", 8).collect():
        low[bytes(r.digest)] = low.get(bytes(r.digest), 0) + r.low
    assert 500 - len(values) / 9 <= low[b"hot"] <= 500
    assert low[b"warm"] <= 200


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates(spark, seed):
    rows = make_rows(seed)
    want = near_components(rows)
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.id]
        assert r.kept == (r.id == want[r.id][1])


@pytest.mark.parametrize("block", [3, 1024])
def test_near_duplicates_long_lists(spark, monkeypatch, block):
    """A group of near copies longer than SHORT is compared in blocks, here of three."""
    monkeypatch.setattr(minhash, "SHORT", 4)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "COLUMNS", 50)
    rows = [r for r in make_rows(5) if r[0] < 60]
    base = " ".join(f"w{i}" for i in range(100)).split()
    for i in range(24):  # a chain: neighbours are near, the ends are not
        rows.append((100 + i, " ".join(base[: 100 - 2 * i] + [f"y{j}" for j in range(2 * i)]), "en", "a"))
    got = {r.id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {d: c for d, (_, c) in near_components(rows).items()}


def test_near_null_ids_and_stage(spark):
    rows = [(None, "a b c d e", "en", "a"), (1, "a b c d e", "en", "a"), (2, "a b c d e", "en", "a"), (3, None, "en", "a")]
    docs = frame(spark, rows)
    got = {(r.id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(None, None, True), (1, 1, True), (2, 1, False), (3, 3, True)}
    kept = minhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (True, 0)]


def test_short_texts_are_one_shingle():
    assert len(shingles("x y", 4)) == 1


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (3, 2), (20, 21)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 8, 20: 20, 21: 20} | {100 + i: 100 for i in range(41)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", [6, 7])
def test_substring_dedup(spark, seed):
    rows = make_rows(seed)
    want = removed_words(rows)
    got = substring.substring_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, gone, kept = want[r.id]
        assert (r.n_words, r.n_removed, r.kept_text) == (n, gone, kept), r.id
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_substring_spread_bins(spark, monkeypatch):
    """Frequent passages are dealt over several bins, small automata split a bin."""
    monkeypatch.setattr(substring, "SPREAD", 2)
    monkeypatch.setattr(substring, "AUTOMATON_WORDS", 60)
    monkeypatch.setattr(substring, "BIN_WORDS", 40)
    rows = make_rows(8)
    want = removed_words(rows)
    for r in substring.substring_dedup(frame(spark, rows)).collect():
        assert (r.n_removed, r.kept_text) == want[r.id][1:]


def test_substring_null_id_removes_nothing(spark):
    text = " ".join(f"w{i}" for i in range(80))
    got = substring.substring_dedup(frame(spark, [(None, text, "en", "a"), (5, text, "en", "a"), (6, text, "en", "a")]))
    assert sorted((r.id or 0, r.n_removed) for r in got.collect()) == [(0, 0), (5, 0), (6, 80)]


def test_substring_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    """With a first hash that takes all windows for equal, the second still decides."""
    plain_windows = substring.Words.windows

    def blind(self, hashes, k, nth=0):
        found, ok = plain_windows(self, hashes, k, nth)
        return (found * 0 if k == 50 and nth == 0 else found), ok

    monkeypatch.setattr(substring.Words, "windows", blind)
    w = [f"w{i}" for i in range(60)]
    book = substring.Automaton(25, 50)
    def coded(words):
        text = " ".join(words).encode()
        own = substring.Words(__import__("numpy").frombuffer(text, "u1"), __import__("numpy").array([0, len(text)]))
        h = own.hashes()
        return h, own.windows(h, 50)[0], own.windows(own.hashes(1), 50, 1)[0]
    book.add(1, *coded(w))
    gone = __import__("numpy").zeros(11, bool)
    book.locate(5, *coded(w), gone)
    assert gone.all()
    gone[:] = False
    book.locate(5, *coded(w[:30] + ["x"] + w[31:]), gone)
    assert not gone.any()


@pytest.mark.parametrize("name", ["key", "row", "gone", "c0"])
def test_stages_keep_clashing_columns(spark, name):
    docs = spark.createDataFrame([(i, f"some words {i // 2} here and more of them", f"own{i}") for i in range(8)], f"doc_id long, text string, {name} string")
    for out in (exact_dedup.exact_dedup(docs), minhash.near_dedup(docs)):
        assert out.columns == docs.columns and all(r[name] == f"own{r.doc_id}" for r in out.collect())


def test_ids_that_are_no_numbers(spark):
    long = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([("b", long), ("", "x " + long), ("c", long + " y"), (None, long), ("d", None)], "doc_id string, text string")
    near = {(r.id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert near == {("", "", True), ("b", "", False), ("c", "", False), (None, None, True), ("d", "d", True)}
    assert {r.doc_id for r in minhash.near_dedup(docs).collect()} == {"", None, "d"}
    gone = {r.id: r.n_removed for r in substring.substring_dedup(docs).collect()}
    assert gone == {"": 0, "b": 70, "c": 70, None: 0, "d": 0}
    kept = exact_dedup.exact_dedup(docs).collect()
    assert {r.doc_id for r in kept} == {"b", "", "c", "d"}


def test_two_texts_of_one_id_join_their_copies(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = spark.createDataFrame([(5, a), (5, b), (6, a), (7, b)], "doc_id long, text string")
    assert {(r.id, r.component_id) for r in minhash.near_duplicates(docs).collect()} == {(5, 5), (6, 5), (7, 5)}


def test_repeated_row_is_a_heavy_digest(spark):
    rows = [(3, "hot", "en", "a")] * 400 + [(9, "hot", "en", "a")] * 300 + make_rows(5, n=20)
    assert [r.doc_id for r in exact_dedup.exact_dedup(frame(spark, rows), counters=4).where("text = 'hot'").collect()] == [9]


@pytest.mark.parametrize("matches", [24, 46])
def test_one_rule_for_lists_of_all_lengths(spark, monkeypatch, matches):
    """The threshold on collisions holds in long lists as in short ones."""
    rows = make_rows(9)
    run = lambda: sorted((r.id, r.component_id) for r in minhash.near_duplicates(frame(spark, rows), matches=matches).collect())
    short = run()
    monkeypatch.setattr(minhash, "SHORT", 1)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    assert run() == short


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert exact_dedup.digest_groups(docs).count() == 0
    assert exact_dedup.exact_dedup(docs).count() == 0
    assert minhash.near_duplicates(docs).count() == 0
    assert substring.substring_dedup(docs).count() == 0
