"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sizes are words. Each source is dealt into shards of about `shard_words` words by a hash of the id; each
shard's words, in seeded order, are cut into equal blocks of about `block_words` words. Highest quotients
v / (2k + 1) give every source an integer number of blocks, within a source every bucket of BUCKET_SHARDS
shards, and within a bucket every shard its integer quota, so no task ranks more than that many. A shard repeats all its blocks (quota div blocks) times and picks (quota mod blocks) more by a seeded
permutation of the block numbers. All is DataFrame algebra; no block is ever a row, so the cost follows
the documents and not the blocks.

Texts without words never enter a shard: they take 0 whatever their number. Sources themselves are counted to
one row each and apportioned in one task.

Defined results: null or wordless text has size 0 and takes 0; a null source is a source of its own and
comes last; a null id is dealt like an empty string; rows that repeat an id and its size are
interchangeable. Reruns agree: every order ends in a total order of (hash, id, size). An empty table gives
an empty result. mix_plan ignores further columns; mix_sources keeps them, whatever their names, and numbers
the rows of a table it writes down, so that repeated rows spread like any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, plain, staged

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
REPEATS = 2
BLOCK_WORDS = 32
SHARD_WORDS = 65_536
BUCKET_SHARDS = 1024
STEP = 2_654_435_761  # a prime above any number of blocks in a shard
#: Sources that may be broadcast; with more, the plain join shuffles.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, repeats: int = REPEATS) -> DataFrame:
    """Adds weight and target to (skey, source, source_size): percent of all sizes by weight, capped at repeats x size."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(ordered) - 1) % len(weights)
    s = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "skey")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    # The level at which all sources from this one on would share what the capped ones before it leave.
    total = F.sum("source_size").over(everything) * percent
    left = total - 100 * F.coalesce(F.sum("cap").over(before), F.lit(0))
    s = s.withColumn("level", left / (100 * F.sum("weight").over(after)))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    capped = F.col("cap").cast("double")
    target = F.when(F.col("level").isNull(), capped).otherwise(F.least(capped, F.col("weight") * F.col("level")))
    return s.select("skey", "source", "source_size", "weight", target.alias("target"))


def sainte_lague(parties: DataFrame, key: str, *group: str, votes: str = "votes", seats: str = "seats") -> DataFrame:
    """Adds quota: `seats` (constant in a group) to its parties by highest quotients votes / (2k + 1); ties go by key.

    votes x seats / all votes, rounded, is the outcome for some other number of seats; quotients next in
    line then add or take the few that differ. A party can gain or lose no more than its share of that
    difference plus the number of parties, plus one, so few quotients need to be listed.
    """
    whole = Window.partitionBy(*group)
    v, total = F.col(votes).cast("double"), F.sum(F.col(votes).cast("double")).over(whole)
    p = parties.withColumn("__v", v).withColumn("__all", total).withColumn("__n", F.count("*").over(whole))
    ideal = F.when(F.col("__all") > 0, F.col("__v") * F.col(seats) / F.col("__all")).otherwise(F.lit(0.0))
    p = p.withColumn("__first", F.floor(ideal + 0.5).cast("long"))
    p = p.withColumn("__diff", F.when(F.col("__all") > 0, F.col(seats) - F.sum("__first").over(whole)).otherwise(F.lit(0)))
    reach = F.floor(F.col("__v") / F.col("__all") * (F.abs("__diff") + F.col("__n"))) + 2
    turns = F.when(
        (F.col("__diff") != 0) & (F.col("__v") > 0), F.sequence(F.lit(1), F.least(reach, F.abs("__diff")).cast("int"))
    )
    keys = [*group, key]
    q = p.select(*keys, "__v", "__first", "__diff", F.explode(turns).alias("__turn"))
    adds = F.col("__diff") > 0
    held = F.when(adds, F.col("__first") + F.col("__turn") - 1).otherwise(F.col("__first") - F.col("__turn"))
    q = q.where(held >= 0).withColumn("__quotient", F.col("__v") / (2 * held + 1))
    line = whole.orderBy(
        F.when(adds, -F.col("__quotient")).otherwise(F.col("__quotient")), F.when(adds, F.col(key)).asc(), F.col(key).desc()
    )
    q = q.withColumn("__place", F.row_number().over(line)).where(F.col("__place") <= F.abs("__diff"))
    moved = q.groupBy(*keys).agg(F.sum(F.signum("__diff")).cast("long").alias("__moved"))
    out = p.join(moved, keys, "left").withColumn("quota", F.col("__first") + F.coalesce("__moved", F.lit(0)))
    return out.drop("__v", "__all", "__n", "__first", "__diff", "__moved")


def _seeded(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def _hex_number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: tuple[int, ...] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: str = "mix:",
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken and how: begin, words, blocks, times, extra, shift (and row)."""
    skey = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("~"))
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        skey.alias("skey"),
        word_count(F.col(text_col)).alias("size"),
        _seeded(id_col, seed).alias("hash"),
        *([F.col(row_col).alias("row")] if row_col else []),
    )
    sized = staged(sized)
    own = ["row"] if row_col else []
    sources = sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    sources = staged(water_fill(sources, weights))
    few = sources.count() <= BROADCAST_SOURCES
    by_source = F.broadcast(sources) if few else sources
    n_shards = F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / F.lit(shard_words))
    shard = F.pmod(_hex_number(F.substring("hash", 1, 8)), n_shards)
    known = sized.join(by_source.drop("source"), "skey")
    dealt = known.where("size > 0").withColumn("shard", shard)

    shards = dealt.groupBy("skey", "shard").agg(F.sum("size").alias("words"))
    shards = shards.withColumn("votes", F.greatest(F.lit(1), F.round(F.col("words") / block_words)).cast("long"))
    shards = staged(shards.withColumn("bucket", F.floor(F.col("shard") / BUCKET_SHARDS)))
    buckets = staged(shards.groupBy("skey", "bucket").agg(F.sum("votes").alias("votes")))
    ask = buckets.groupBy("skey").agg(F.sum("votes").alias("blocks")).join(by_source, "skey")
    ask = ask.withColumn("votes", F.col("target") / F.col("source_size") * F.col("blocks"))
    ask = ask.withColumn("seats", F.round(F.sum("votes").over(Window.partitionBy())).cast("long"))
    seats = staged(sainte_lague(ask, "skey").select("skey", F.col("quota").alias("seats")))
    seats = buckets.join(F.broadcast(seats) if few else seats, "skey")
    seats = staged(sainte_lague(seats, "bucket", "skey").select("skey", "bucket", F.col("quota").alias("seats")))
    quotas = sainte_lague(shards.join(seats, ["skey", "bucket"]), "shard", "skey", "bucket")
    blocks, quota = F.col("blocks"), F.col("quota")
    quotas = quotas.select("skey", "shard", "words", F.col("votes").alias("blocks"), F.least("quota", REPEATS * F.col("votes")).alias("quota"))
    number = _hex_number(F.substring(F.md5(F.concat(F.lit(seed), "skey", F.lit(":"), F.col("shard").cast("string"))), 1, 8))
    quotas = staged(
        quotas.select(
            "skey", "shard", "words", "blocks",
            F.floor(quota / blocks).cast("long").alias("times"), (quota % blocks).cast("long").alias("extra"), F.pmod(number, blocks).cast("long").alias("shift"),
        )
    )
    line = Window.partitionBy("skey", "shard").orderBy("hash", "id", "size", *own).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("begin", F.coalesce(F.sum("size").over(line), F.lit(0))).join(quotas, ["skey", "shard"])
    placed = placed.withColumn("taken", (F.col("times") * F.col("size") + _extra_words()).cast("long"))
    how = ["begin", "words", "blocks", "times", "extra", "shift"]
    empty = known.where("size = 0").select("*", *[F.lit(0).cast("long").alias(c) for c in ("taken", *how)])
    keep = ["id", "size", "source_size", "target", "taken", *how, *own]
    return placed.select(*keep).unionByName(empty.select(*keep))


def _edge(i: Column) -> Column:
    """First word of block i of a shard."""
    return F.floor(i * F.col("words") / F.col("blocks")).cast("long")


def _block_of(word: Column) -> Column:
    return F.floor(((word + 1) * F.col("blocks") - 1) / F.col("words")).cast("long")


def _picked(i: Column) -> Column:
    return F.pmod(i * STEP + F.col("shift"), F.col("blocks")) < F.col("extra")


def _extra_words() -> Column:
    """Words of the document in the blocks that the shard takes once more."""
    begin, end = F.col("begin"), F.col("begin") + F.col("size")
    inside = lambda i: F.least(_edge(i + 1), end) - F.greatest(_edge(i), begin)
    return F.aggregate(
        F.sequence(_block_of(begin), _block_of(end - 1)),
        F.lit(0).cast("long"),
        lambda sum_, i: sum_ + F.when(_picked(i), inside(i)).otherwise(F.lit(0)).cast("long"),
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The mixture as rows like those of docs: whole texts as often as taken, and texts of the words taken once more."""
    rows, columns = plain(docs)
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()))
    id_, text_, source_ = (columns[docs.columns.index(c)] for c in (id_col, text_col, source_col))
    plan = mix_plan(rows, id_, text_, source_, row_col="row", **params).where("taken > 0")
    use = rows.join(plan.select("row", "begin", "words", "blocks", "times", "extra", "shift"), "row")
    text = F.col(text_)
    words = F.filter(
        F.regexp_extract_all(text, F.lit(WORD), 0), lambda _, i: _picked(_block_of(F.col("begin") + i.cast("long")))
    )
    part = F.array_join(words, " ")
    pieces = F.concat(
        F.array_repeat(text, F.col("times").cast("int")),
        F.when(F.col("extra") > 0, F.filter(F.array(part), lambda t: t != "")).otherwise(F.array().cast("array<string>")),
    )
    out = use.withColumn("taken_text", F.explode(pieces))
    return out.select(*[F.col("taken_text" if c == text_ else c) for c in columns]).toDF(*docs.columns)
