"""Sharding along a Hilbert curve over metadata.

Equal texts form a group, which takes the metadata of its smallest id. Source, language and size are each
quantised to 16 levels; the cell's index on a three-dimensional Hilbert curve, then the text's digest,
order the groups. The order is cut into runs of equal bytes, so neighbouring shards hold similar metadata
and min/max statistics of a shard's files prune on all three dimensions at once. A group stays in one shard
unless its bytes exceed `whole_share` of a shard; only such a group is cut, by a hash of the id.

No step sorts or sums everything in one task: groups, then rows, are sorted by range into a written table, where
the monotonic number of a row tells its part and its place in it; sums and counts per part, a few rows, give the
offsets. Groups that hold over 1 / HEAVY of the rows meet their rows by broadcast. Values of a dimension are counted
to one row each before they are cut into levels.

Defined results (law `bytes`): size is the UTF-8 bytes of the text plus 8, null text counts as empty; null
source and language are levels of their own; a null id counts as an empty one. Slots number the rows of a shard
from 0 along the curve, rows that tie in everything in any order. Rows that repeat one id and text, or lack an id,
and fill over `whole_share` of a shard are cut by where they stand. Shards may be empty when there are few rows. An
empty table gives an empty result. shard_plan ignores further columns; write_shards keeps them, and names its
folders `shard`, with underscores added while a column has that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import plain, spread_join, staged

SHARDS = 24
LEVEL_BITS = 4
WHOLE_SHARE = 0.25
#: Values of one dimension that may be broadcast; with more, the plain join shuffles.
BROADCAST_VALUES = 20_000


def hilbert_index(cell: tuple[int, ...], bits: int) -> int:
    """Position of a cell on the Hilbert curve (the axes-to-transpose transform of J. Skilling, 2004)."""
    x, n, top = list(cell), len(cell), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            swap = 0 if x[i] & q else (x[0] ^ x[i]) & low
            x[0] ^= swap if not x[i] & q else low
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = 0, top
    while q > 1:
        flip ^= q - 1 if x[-1] & q else 0
        q >>= 1
    out = 0
    for b in reversed(range(bits)):
        for v in x:
            out = out << 1 | ((v ^ flip) >> b & 1)
    return out


def hilbert_table(bits: int = LEVEL_BITS) -> list[int]:
    """hilbert_index of (x, y, z) at place x << 2 * bits | y << bits | z."""
    side = range(1 << bits)
    return [hilbert_index((x, y, z), bits) for x in side for y in side for z in side]


def _levels(rows: DataFrame, column: str) -> DataFrame:
    """(key, level): values in order, null last, cut into 2 ** LEVEL_BITS levels of about equal rows."""
    values = rows.groupBy("value").count()
    upto = Window.orderBy(F.col("value").asc_nulls_last())
    middle = F.sum("count").over(upto) - F.col("count") / 2
    level = F.floor(middle * (1 << LEVEL_BITS) / F.sum("count").over(Window.partitionBy()))
    return values.select(_key("value").alias(f"{column}_key"), level.cast("int").alias(f"{column}_level"))


def _key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("~"))


def _parts(ordered: DataFrame, *order: str) -> DataFrame:
    """A table written in this order, with `pos`, a number that rises along it, and `part`, one of its pieces of that."""
    out = staged(ordered.orderBy(*order).withColumn("pos", F.monotonically_increasing_id()))
    return out.withColumn("part", F.shiftright("pos", 33))


def shard_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: tuple[str, str] = ("source", "lang"),
    shards: int = SHARDS,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: id, size, text_crc32, digest, curve, shard, slot (and row)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = staged(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("digest"),
            F.md5(id_text).alias("id_hash"),
            *[F.col(c).cast("string").alias(f"dim{i}") for i, c in enumerate(dims)],
            (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        )
    )
    groups = rows.groupBy("digest").agg(
        F.count("*").alias("n"), F.first("size").alias("size"), F.min(F.struct("id", "dim0", "dim1")).alias("head")
    )
    groups = groups.select("digest", "n", "size", "head.dim0", "head.dim1", (F.col("n") * F.col("size")).alias("bytes"))
    for i in range(len(dims)):
        levels = staged(_levels(rows.select(F.col(f"dim{i}").alias("value")), f"dim{i}"))
        levels = F.broadcast(levels) if levels.count() <= BROADCAST_VALUES else levels
        groups = groups.withColumn(f"dim{i}_key", _key(f"dim{i}")).join(levels, f"dim{i}_key")
    size_level = F.least(F.greatest(F.floor(F.log2(F.col("size")) - 3), F.lit(0)), F.lit((1 << LEVEL_BITS) - 1)).cast("int")
    place = F.shiftleft("dim0_level", 2 * LEVEL_BITS) + F.shiftleft("dim1_level", LEVEL_BITS) + size_level
    curve = F.element_at(F.array(*[F.lit(x) for x in hilbert_table()]), place + 1)

    ordered = _parts(groups.select("digest", "n", "bytes", curve.alias("curve")), "curve", "digest")
    sums = ordered.groupBy("part").agg(F.sum("bytes").alias("part_bytes"), F.sum("n").alias("part_rows"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = staged(sums.withColumn("part_start", F.coalesce(F.sum("part_bytes").over(upto), F.lit(0))).coalesce(1))
    total, count = sums.agg(F.coalesce(F.sum("part_bytes"), F.lit(0)), F.coalesce(F.sum("part_rows"), F.lit(0))).first()
    each = max(total, 1) / shards
    line = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("part_start") + F.coalesce(F.sum("bytes").over(line), F.lit(0))
    placed = ordered.join(F.broadcast(sums), "part").select("digest", "n", "bytes", "curve", start.alias("start"))  # a row a part
    cut = F.col("bytes") > WHOLE_SHARE * each
    out = spread_join(rows.drop("dim0", "dim1"), staged(placed), ["digest"], "n", count).withColumn("cut", cut)

    # A whole group goes where its middle lies; a row of a cut group where its share of the group lies.
    repeats = out.where("cut").groupBy("digest", "id_hash").agg(F.sum("size").alias("own"))
    repeats = staged(repeats.where(F.col("own") > WHOLE_SHARE * each).select("digest", "id_hash", F.lit(True).alias("repeats")))
    out = out.join(F.broadcast(repeats), ["digest", "id_hash"], "left")  # shards / WHOLE_SHARE rows at most
    hashed = F.conv(F.substring(F.when(F.col("repeats"), F.md5(F.col("row").cast("string"))).otherwise(F.col("id_hash")), 1, 8), 16, 10)
    part = hashed.cast("long") / F.lit(float(1 << 32))
    at = F.col("start") + F.col("bytes") * F.when(F.col("cut"), part).otherwise(F.lit(0.5))
    out = out.withColumn("at", at).withColumn("shard", F.least(F.floor(F.col("at") / F.lit(each)), F.lit(shards - 1)).cast("int"))
    out = _parts(out.select("id", "size", "text_crc32", "digest", "id_hash", "curve", "at", "shard", "row"), "at", "digest", "id_hash", "id", "row")

    # Slots: rows of a shard are numbered within a part, after those of the parts before.
    runs = out.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = staged(runs.select("part", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")).coalesce(1))
    out = out.join(F.broadcast(runs), ["part", "shard"])  # parts + shards rows at most
    own = ["row"] if row_col else []
    return out.select("id", "size", "text_crc32", "digest", "curve", "shard", (F.col("shift") + F.col("pos")).alias("slot"), *own)


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, str] = ("source", "lang"), shards: int = SHARDS) -> None:
    """The documents as Parquet, a folder per shard, each file sorted along the curve."""
    rows, columns = plain(docs)
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()))
    own = dict(zip(docs.columns, columns, strict=True))
    plan = shard_plan(rows, own[id_col], own[text_col], (own[dims[0]], own[dims[1]]), shards, "row")
    folder = "shard"
    while folder in docs.columns:
        folder += "_"
    out = rows.join(plan.select("row", "shard", "slot"), "row").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    out.select(*[F.col(c).alias(name) for name, c in own.items()], F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)
