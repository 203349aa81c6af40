"""Near-duplicate detection: MinHash signatures joined through an inverted index of their coordinates.

A document is the set of its distinct word shingles. Documents of equal sets collapse into one class; the
rest of the work is on classes.

1. Post each class under its COORDINATES (coordinate, value) pairs. Values held by one class only can never
   collide, and a class with fewer than MATCHES others cannot reach the match threshold: both drop out.
2. Count in how many of the remaining sets each shingle is. Only shared shingles can be in an intersection,
   so a class needs `percent` of its shingles shared, and a pair a bound that follows from both counts. This
   parts texts that have nothing in common but a frequent passage.
3. Prefix: two classes that share MATCHES pairs share one among the rarest (count - MATCHES + 1) of each,
   in one order by frequency, so only those are posted again. Very frequent values end up outside.
4. Merge with skips: the most central class of a posting list stands for it, and only its collisions with
   the others are counted; pairs with MATCHES or more are confirmed on the full sets. Members that are then
   in one component need no comparison. What stays apart in a list is compared across components only, by the
   same rule at any length: count collisions, keep MATCHES or more, confirm. Lists up to SHORT do so by joins,
   longer ones in blocks, whose collisions and intersections are matrix products; a block hands on one link
   for each two components. SHORT and BLOCK change the cost, not the links.

With 48 coordinates and 24 matches a pair at similarity 0.8 is missed with a chance under one in a million.
Links are exact: 100 x intersection >= percent x union of the full sets.

Defined results: null or wordless text has no shingles and links to nothing, itself being its component;
fewer words than a shingle count as one shingle; a null id has a null component and is kept; ids of any
orderable type keep it. Rows that repeat an id are one document: they share its component, so an id with two
texts joins the copies of both. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, mixed, named, numbered, plain, signed, staged, steps
from .components import components

SHINGLE = 4
PERCENT = 80
COORDINATES = 48
MATCHES = 24
#: Lists up to this long are compared pair by pair; longer ones in blocks of so many classes.
SHORT = 32
BLOCK = 1024
#: Shingles that one matrix product takes.
COLUMNS = 4096
#: Ids that may be broadcast to pick texts; with more, the join shuffles them.
BROADCAST_IDS = 500_000


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for i, _, data, offsets in steps(batch, "text"):
        words = Words(data, offsets, lower=True)
        hashes = words.hashes()
        whole, _ = words.windows(hashes, k)
        for d, (a, n) in enumerate(zip(words.first[:-1], words.counts, strict=True)):
            if n >= k:
                yield i + d, np.unique(whole[a : a + n - k + 1])
            elif n:
                part = mixed(hashes[a : a + n] + np.arange(1, n + 1, dtype=np.uint64))
                yield i + d, mixed(np.array([part.sum() + np.uint64(n)], np.uint64))
            else:
                yield i + d, np.zeros(0, np.uint64)


def _sketches(k: int, coordinates: int):
    rng = np.random.default_rng(7)
    flips = rng.integers(0, 1 << 63, coordinates, np.uint64)[:, None]
    factors = rng.integers(0, 1 << 63, coordinates, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
    names = np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, tokens = [], [], [], []
            for _, s in _sets(batch, k):
                sizes.append(len(s))
                first.append(s.sum(dtype=np.uint64))
                second.append(np.bitwise_xor.reduce(mixed(s)) if len(s) else np.uint64(0))
                if len(s):
                    low = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
                    for at in range(0, len(s), 4096):
                        low = np.minimum(low, ((s[at : at + 4096] ^ flips) * factors).min(axis=1))
                    tokens.append(signed(mixed(low + names)))
            if not sizes:
                continue
            lengths = np.where(np.array(sizes) > 0, coordinates, 0)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(signed(np.array(first, np.uint64))),
                    pa.array(signed(np.array(second, np.uint64))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["id", "n", "set_a", "set_b", "tokens"],
            )

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for _, s in _sets(batch, k)]
            if found:
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in found]))).astype(np.int32)
                flat = pa.array(signed(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["id", "shingles"])

    return run


def _in_lists(tokens: DataFrame, keys: list[str], matches: int) -> DataFrame:
    """Classes with `matches` values at least that others have too; tokens in order of frequency."""
    frequent = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    posted = tokens.join(frequent, "token").groupBy(*keys).agg(F.collect_list(F.struct("df", "token")).alias("found"))
    posted = posted.where(F.size("found") >= matches)
    return posted.select(*keys, F.transform(F.array_sort("found"), lambda t: t["token"]).alias("tokens"))


def _collisions(pairs: DataFrame, posted: DataFrame, matches: int) -> DataFrame:
    """The pairs whose signatures match in `matches` coordinates."""
    a, b = (posted.select(F.col("rep").alias(f"rep_{x}"), F.col("tokens").alias(f"tokens_{x}")) for x in "ab")
    near = pairs.join(a.hint("merge"), F.col("a") == F.col("rep_a")).join(b.hint("merge"), F.col("b") == F.col("rep_b"))
    return near.where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= matches).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a, b = (sets.select(F.col("id").alias(f"id_{side}"), F.col("shingles").alias(f"set_{side}")) for side in "ab")
    both = pairs.join(a.hint("merge"), F.col("a") == F.col("id_a")).join(b.hint("merge"), F.col("b") == F.col("id_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    both = both.withColumn("shared", shared).where(
        100 * F.col("shared") >= percent * (F.size("set_a") + F.size("set_b") - F.col("shared"))
    )
    return both.select("a", "b").distinct()


def _possible(percent: int):
    """Whether sizes and shared shingles of two classes (n_a, s_a, n_b, s_b) allow a link."""
    return (100 + percent) * F.least("s_a", "s_b") >= percent * (F.col("n_a") + F.col("n_b"))


def _side(rows: DataFrame, side: str) -> DataFrame:
    """Postings renamed for one side of a pair."""
    names = {"rep": side, "n": f"n_{side}", "s": f"s_{side}", "label": f"label_{side}"}
    return rows.select("token", *[F.col(c).alias(new) for c, new in names.items() if c in rows.columns])


def _apart(postings: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings with their component, and the lists that span several, with their length."""
    at = postings.join(labels.hint("merge"), F.col("rep") == F.col("node"), "left")
    at = at.select("token", "rep", "n", "s", F.coalesce("label", "rep").alias("label"))
    lists = at.groupBy("token").agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high"))
    return at, lists.where("low < high").select("token", "m")


def _intersections(lists: pa.ListArray, chosen: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the chosen sets, all with all."""
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = np.asarray(lists.values)
    parts = [flat[offsets[k] : offsets[k + 1]] for k in chosen]
    doc = np.repeat(np.arange(len(chosen)), [len(p) for p in parts])
    values, column = np.unique(np.concatenate(parts), return_inverse=True)
    shared = np.bincount(column, minlength=len(values)) > 1
    doc, column = doc[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    both = np.zeros((len(chosen), len(chosen)), np.float32)
    for first in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(column, (first, first + COLUMNS))
        part = np.zeros((len(chosen), COLUMNS), np.float32)
        part[doc[i:j], column[i:j] - first] = 1
        both += part @ part.T
    return both.astype(np.int64)


def _products(percent: int, matches: int):
    """(a, b): of all classes of a block, one link for each two components that have any."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        reps, labels = (table.column(c).to_numpy() for c in ("rep", "label"))
        tokens, sets = (table.column(c).combine_chunks() for c in ("tokens", "shingles"))
        near = (_intersections(tokens, np.arange(len(reps))) >= matches) & (labels[:, None] != labels[None, :])
        chosen = np.flatnonzero(near.any(axis=1))
        if not len(chosen):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        reps, labels, near = reps[chosen], labels[chosen], near[np.ix_(chosen, chosen)]
        sizes = np.diff(np.asarray(sets.offsets).astype(np.int64))[chosen]
        total = sizes[:, None] + sizes[None, :]
        linked = near & ((100 + percent) * _intersections(sets, chosen) >= percent * total)
        i, j = np.nonzero(linked & (labels[:, None] < labels[None, :]))
        _, once = np.unique(np.stack([labels[i], labels[j]]), axis=1, return_index=True)
        return pa.table({"a": pa.array(reps[i[once]]), "b": pa.array(reps[j[once]])})

    return run


def _blocks(at: DataFrame, lists: DataFrame, posted: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """Links across the components of long lists.

    The component with the most members of a list is never compared with itself: its blocks meet the rest's
    blocks only, so a large component and a few outsiders cost no more than its members.
    """
    at = at.join(lists.select("token"), "token", "left_semi")
    by = at.groupBy("token", "label").agg(F.count("*").alias("c"))
    by = by.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("bulk"), F.max("c").alias("c"), F.sum("c").alias("m"))
    at = at.join(by, "token")
    blocks = lambda n: F.greatest(F.ceil(n / F.lit(BLOCK)), F.lit(1)).cast("int")
    few, rest = F.col("m") <= BLOCK, blocks(F.col("m") - F.col("c"))
    in_bulk = (F.col("label") == F.col("bulk")) & ~few
    own = F.pmod(F.xxhash64("rep"), F.when(in_bulk, blocks(F.col("c"))).otherwise(F.when(few, 1).otherwise(rest))).cast("int")
    at = at.select("token", "rep", "label", in_bulk.alias("in_bulk"), own.alias("own"), F.when(few, 1).otherwise(rest).alias("n_rest"), F.when(few, 0).otherwise(blocks(F.col("c"))).alias("n_bulk"))
    pair = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    to_rest = F.transform(F.sequence(F.lit(0), F.col("n_rest") - 1), lambda j: pair(F.least("own", j), F.greatest("own", j)))
    to_bulk = F.when(F.col("n_bulk") > 0, F.transform(F.sequence(F.lit(1), F.greatest("n_bulk", F.lit(1))), lambda j: pair(F.col("own"), -j)))
    from_bulk = F.transform(F.sequence(F.lit(0), F.col("n_rest") - 1), lambda i: pair(i, -1 - F.col("own")))
    none = F.array().cast("array<struct<p:int,q:int>>")
    places = F.when(F.col("in_bulk"), from_bulk).otherwise(F.concat(to_rest, F.coalesce(to_bulk, none)))
    at = at.select("token", "rep", "label", F.explode(places).alias("at"))
    each = posted.select("rep", "tokens").join(sets.select(F.col("id").alias("rep"), "shingles"), "rep")
    at = at.join(each, "rep").select("token", "at.p", "at.q", "rep", "label", "tokens", "shingles")
    return at.groupBy("token", "p", "q").applyInArrow(_drop_key(_products(percent, matches)), "a long, b long").distinct()


def _drop_key(run):
    return lambda table: run(table.select(["rep", "label", "tokens", "shingles"]))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    rows, names = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    sketches = staged(
        rows.mapInArrow(_sketches(shingle, coordinates), "id long, n long, set_a long, set_b long, tokens array<long>")
    )
    filled = sketches.where("n > 0 AND id IS NOT NULL")
    classes = staged(filled.groupBy("set_a", "set_b", "n", "tokens").agg(F.min("id").alias("rep")))

    tokens = classes.select("rep", "n", F.explode("tokens").alias("token"))
    posted = staged(_in_lists(tokens, ["rep", "n"], matches))

    wanted = posted.select(F.col("rep").alias("id")).distinct()
    wanted = F.broadcast(wanted) if posted.count() <= BROADCAST_IDS else wanted
    sets = rows.join(wanted, "id", "left_semi").mapInArrow(_full_sets(shingle), "id long, shingles array<long>")
    sets = staged(sets.where(F.size("shingles") > 0))

    each = sets.select(F.col("id").alias("rep"), F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(shared, "shingle").groupBy("rep").agg(
        F.count("*").alias("s"), F.sum(F.floor(16 * F.log2("df")).cast("long")).alias("weight")
    )
    posted = posted.join(shared, "rep").where(100 * F.col("s") >= percent * F.col("n"))
    posted = posted.withColumn("central", F.floor(F.col("weight") / F.col("n")).cast("long")).drop("weight")
    tokens = posted.select("rep", "n", "s", "central", F.explode("tokens").alias("token"))
    posted = staged(_in_lists(tokens, ["rep", "n", "s", "central"], matches))
    prefix = F.explode(F.slice("tokens", 1, F.size("tokens") - (matches - 1)))
    postings = posted.select("rep", "n", "s", "central", prefix.alias("token"))

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return staged(_confirmed(_collisions(pairs, posted, matches), sets, percent))

    heads = postings.groupBy("token").agg(F.max(F.struct("central", "rep", "n", "s")).alias("head"), F.count("*").alias("m"))
    heads = heads.where("m > 1").select("token", *[F.col(f"head.{c}").alias(new) for c, new in (("rep", "a"), ("n", "n_a"), ("s", "s_a"))])
    links = linked(_side(postings, "b").join(heads, "token").where(_possible(percent)).select("a", "b"))
    labels = staged(components(links))
    at, apart = _apart(postings, labels)
    apart = staged(apart)
    short = at.join(apart.where(F.col("m") <= SHORT), "token", "left_semi")
    across = _side(short, "a").join(_side(short, "b"), "token").where("a < b AND label_a <> label_b").where(_possible(percent))
    across = linked(across.select("a", "b"))
    long = apart.where(F.col("m") > SHORT)
    if not long.isEmpty():
        across = across.unionByName(staged(_blocks(at, long, posted, sets, percent, matches)))
    if not across.isEmpty():
        labels = staged(components(links.unionByName(across)))
    reps = classes.select("set_a", "set_b", "rep").join(labels, F.col("rep") == F.col("node"), "left")
    reps = reps.select("set_a", "set_b", F.coalesce("label", "rep").alias("component_id"))
    out = sketches.where("n > 0").select("id", "n", "set_a", "set_b").join(reps, ["set_a", "set_b"], "left")
    out = out.select("id", "n", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    out = out.unionByName(sketches.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return named(out.select("id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept")), names, "id", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents that stay, one of each component, with all their columns."""
    gone = near_duplicates(docs, id_col, text_col, **params).where("NOT kept").select(F.col("id").alias("gone")).distinct()
    rows, names = plain(docs)
    rest = rows.join(gone, F.col(names[docs.columns.index(id_col)]) == F.col("gone"), "left_anti")
    return rest.toDF(*docs.columns)
