"""Best-fit packing of documents into sequences, with conflicts.

Sizes are words. A text longer than the capacity is cut into full sequences and a rest; all pieces of at
most the capacity are packed decreasing by size. A bin holds at most one piece of each duplicate cluster
(equal texts) and `per_source` pieces of each source: it carries a bitmap of the sources that are full and one of its
clusters, numbered within the shard. Bins are kept in order of residual room; the search starts at the
smallest residual that fits and goes to the successor until a bin without conflict is found: the tightest
compatible one. Without one a new bin opens.

Documents are dealt into shards of about `shard_rows` by a hash of their id, which spreads the largest source
and the largest group of copies alike. Rows that repeat id, source, cluster and size are counted first, on the
map side, and then dealt by their number among each other, so they spread as well and a shard is bounded.

Defined results: null or wordless text has 0 words and takes no room, in bin -1 of its shard; null source
is a source of its own, a null id comes after all others of its size. Reruns agree: pieces are ordered by size,
id, cluster, source and piece, and rows alike in all of them are interchangeable. An empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, staged, steps

CAPACITY = 2048
PER_SOURCE = 3
SHARD_ROWS = 4096
#: Repeated rows that one task writes out.
REPEATS = 65_536


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, text, replaced by its number of words."""
    for batch in batches:
        counts = np.zeros(batch.num_rows, np.int64)
        for i, j, data, offsets in steps(batch, "text"):
            counts[i:j] = Words(data, offsets).counts
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], names=[*batch.schema.names[:-1], "words"])


class Bins:
    """Open bins in order of (residual, number), with their conflict bitmaps."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []
        self.sources: list[int] = []  # bitmap of the sources that have per_source pieces in the bin
        self.clusters: list[int] = []  # bitmap of the duplicate clusters in the bin
        self.held: list[dict[int, int]] = []
        self.used: list[int] = []
        self.pieces: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int, int]:
        """(bin, position in it, first word) of a piece put into the tightest compatible bin; cluster is a bitmap."""
        own = 1 << source
        for at in range(bisect_left(self.order, (size, -1)), len(self.order)):
            n = self.order[at][1]
            if not (self.sources[n] & own or self.clusters[n] & cluster):
                del self.order[at]
                break
        else:
            n = len(self.used)
            for column, empty in ((self.sources, 0), (self.clusters, 0), (self.used, 0), (self.pieces, 0)):
                column.append(empty)
            self.held.append({})
        begin, position = self.used[n], self.pieces[n]
        held = self.held[n][source] = self.held[n].get(source, 0) + 1
        if held >= self.per_source:
            self.sources[n] |= own
        self.clusters[n] |= cluster
        self.used[n] += size
        self.pieces[n] += 1
        if self.used[n] < self.capacity:
            insort(self.order, (self.capacity - self.used[n], n))
        return n, position, begin


def pack_shard(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[tuple[int, int, int]]:
    """(bin, position, first word) of pieces given in a fixed order; size 0 gets (-1, 0, 0)."""
    number = {s: k for k, s in enumerate(dict.fromkeys(sources))}
    met: set = set()
    again = {c for c in clusters if c in met or met.add(c)}
    bits = {c: 1 << k for k, c in enumerate(x for x in dict.fromkeys(clusters) if x in again)}  # others can't conflict
    bins = Bins(capacity, per_source)
    places = [(-1, 0, 0)] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        if sizes[k]:
            places[k] = bins.place(sizes[k], number[sources[k]], bits.get(clusters[k], 0))
    return places


def _packer(capacity: int, per_source: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("words", "id", "source", "cluster", "shard")), strict=True), key=lambda r: (r[0], r[1] is None, r[1], r[3], r[2]))
        pieces = []
        for words, id_, source, cluster, _ in rows:
            for nth, begin in enumerate(range(0, max(words, 1), capacity)):
                pieces.append((min(capacity, words - begin), id_, source, cluster, nth, begin))
        size, ids, sources, clusters, nth, begin = map(list, zip(*pieces, strict=True))
        places = pack_shard(size, sources, clusters, capacity, per_source)
        columns = [ids, [rows[0][4]] * len(ids), *map(list, zip(*places, strict=True)), nth, begin, size]
        kinds = [table.schema.field("id").type, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "shard", "bin", "position", "offset", "piece", "word_start", "n_words"])

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
    *,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per piece: id, shard, bin, position, offset (in the bin), piece, word_start (in the text), n_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cluster = F.xxhash64(F.col(cluster_col)) if cluster_col else F.xxhash64(text)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("~")).alias("source"),
        cluster.alias("cluster"),
        text.alias("text"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    sized = rows.mapInArrow(_sized, f"id {kind}, source string, cluster long, words long")
    # Repeats are counted, then written out again in lots, each row with its number among its like.
    sized = staged(sized.groupBy("id", "source", "cluster", "words").agg(F.count("*").alias("n")))
    total, most = sized.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    lots = sized.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / REPEATS))).alias("lot"))
    lots = lots.repartition("id", "lot") if most > REPEATS else lots
    least = F.least(F.lit(REPEATS), F.col("n") - F.col("lot") * REPEATS)
    each = lots.select("*", F.explode(F.sequence(F.lit(0).cast("long"), least - 1)).alias("nth"))
    shards = max(1, -(-total // shard_rows))
    text_id = F.coalesce(F.col("id").cast("string"), F.lit(""))
    shard = F.pmod(F.xxhash64(text_id, "cluster", "lot", "nth"), F.lit(shards)).cast("long")
    dealt = each.select("id", "source", "cluster", "words", shard.alias("shard"))
    schema = f"id {kind}, shard long, bin long, position int, offset int, piece int, word_start long, n_words long"
    return dealt.groupBy("shard").applyInArrow(_packer(capacity, per_source), schema)
