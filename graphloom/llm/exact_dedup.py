"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries find every digest that more than 2 / (counters + 1) of the rows carry. One exact
count verifies them; their winners, at most counters + 1 rows, are broadcast and settle their rows on the
map side. All other digests are too rare to be hot and go through an ordinary shuffle of (digest, id).

The stage drops the rows of heavy digests that lose to their winner in the scan. Of what is left, only digests
and row numbers are shuffled; the losers found there are taken out by a broadcast of row numbers where their
count allows it, and by a join on row numbers, each of which occurs once, beyond that.

Defined results: null text counts as empty; equal means equal SHA-256 of the unchanged UTF-8 bytes. The
largest id of a group stays, a null id only where all ids are null, and of rows that repeat one id exactly
one. An empty table gives an empty result; digest_groups ignores columns besides id and text, exact_dedup
keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import plain, staged

COUNTERS = 256
#: Row numbers of losers that may be broadcast (8 bytes each); with more, the join shuffles.
BROADCAST_ROWS = 500_000


def misra_gries(digests: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """Per partition at most `counters` rows (column, low): a lower bound of each frequent value's count.

    Batches are merged the mergeable way: add the counts, then subtract the (counters + 1)-th largest, so a
    partition of n rows undercounts no value by more than n / (counters + 1).
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for pair in pc.value_counts(batch.column(0)).to_pylist():
                held[pair["values"]] = held.get(pair["values"], 0) + pair["counts"]
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {k: v - cut for k, v in held.items() if v > cut}
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=[column, "low"]
            )

    return digests.select(column).mapInArrow(summarise, f"{column} binary, low long")


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def _winners(base: DataFrame, counters: int, *by: str) -> DataFrame:
    """(digest, size, best) of the verified heavy digests, best being the largest struct of `by`."""
    n = base.count()
    likely = misra_gries(base, "digest", counters).groupBy("digest").agg(F.sum("low").alias("low"))
    # Lower bounds add up to n at most, so at most counters + 1 digests reach this.
    likely = likely.where(F.col("low") * (counters + 1) >= n).select("digest")
    found = base.join(F.broadcast(likely), "digest", "left_semi").groupBy("digest")
    return staged(found.agg(F.count("*").alias("size"), F.max(F.struct(*by)).alias("best")))


def digest_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, digest (binary)."""
    base = docs.select(F.col(id_col).alias("id"), _digest(text_col).alias("digest"))
    base = staged(base.withColumn("row", F.monotonically_increasing_id()))
    winners = _winners(base, counters, "id", "row")
    split = base.join(F.broadcast(winners), "digest", "left")
    whole = Window.partitionBy("digest")
    rare = (
        base.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumn("size", F.count("*").over(whole))
        .withColumn("best", F.max(F.struct("id", "row")).over(whole))
    )
    return (
        split.where(F.col("size").isNotNull())
        .select("id", "row", "digest", "size", "best")
        .unionByName(rare.select("id", "row", "digest", "size", "best"))
        .select(
            "id",
            F.col("best.id").alias("keep_id"),
            F.col("size").alias("group_size"),
            (F.col("row") == F.col("best.row")).alias("kept"),
            "digest",
        )
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns."""
    rows, columns = plain(docs)
    id_, text = (columns[docs.columns.index(c)] for c in (id_col, text_col))
    keyed = rows.withColumn("digest", _digest(text))
    winners = _winners(staged(keyed.select(F.col(id_).alias("id"), "digest")), counters, "id")
    winners = winners.select("digest", F.lit(True).alias("heavy"), F.col("best.id").alias("best_id"))
    rest = keyed.join(F.broadcast(winners), "digest", "left")
    rest = rest.where(F.col("heavy").isNull() | F.col(id_).eqNullSafe(F.col("best_id"))).select(*columns, "digest")
    rest = staged(rest.withColumn("row", F.monotonically_increasing_id()))
    each = rest.select("digest", "row", F.col(id_).alias("id"))
    # Aggregates combine on the map side, and only digests of several rows come back.
    best = each.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", "row")).alias("best")).where("n > 1")
    heavy = F.broadcast(winners.select("digest"))
    hot = each.join(F.broadcast(best.join(heavy, "digest", "left_semi")), "digest")  # a row of best a heavy digest
    cold = each.join(heavy, "digest", "left_anti").join(best.join(heavy, "digest", "left_anti"), "digest")
    losers = staged(hot.unionByName(cold).where(F.col("row") != F.col("best.row")).select("row"))
    few = losers.count() <= BROADCAST_ROWS
    return rest.join(F.broadcast(losers) if few else losers, "row", "left_anti").select(*columns).toDF(*docs.columns)
