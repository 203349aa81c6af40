"""What the operators of this subpackage share: scratch tables and vectorised word tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ..storage import staged

__all__ = ["LOWER", "SPACE", "WORD", "Words", "mixed", "named", "numbered", "plain", "signed", "spread_join", "staged", "steps"]

#: Word pattern of all contracts: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step works on; whole documents only, so a longer one is a step of its own.
STEP_BYTES = 1 << 19


def plain(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with its columns renamed to c0, c1, ..., which clash with none that are added, and those names in order."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """rows with the column id as a long, and the table (own, id) that leads back, None where ids are integers already.

    Other ids get numbers that rise with them: a range-sorted table's monotonic ids. Null stays null.
    """
    if isinstance(rows.schema["id"].dataType, (ByteType, ShortType, IntegerType, LongType)):
        return rows.withColumn("id", F.col("id").cast("long")), None
    own = rows.select(F.col("id").alias("own")).where("own IS NOT NULL").distinct().orderBy("own")
    names = staged(own.withColumn("id", F.monotonically_increasing_id()))
    return rows.withColumnRenamed("id", "own").join(names, "own", "left").select("id", *[c for c in rows.columns if c != "id"]), names


def named(found: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """found with the ids in `columns` as they were before numbered()."""
    if names is None:
        return found
    order = found.columns
    for c in columns:
        found = found.withColumnRenamed(c, "__id").join(names.select(F.col("id").alias("__id"), F.col("own").alias(c)), "__id", "left").drop("__id")
    return found.select(*order)


#: A key with a greater share of the rows than one in so many is joined by broadcast.
HEAVY = 4096


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows joined with the one row of table for each key; `size` is how many of the rows, `total` at most, have that key.

    Keys with over 1 / HEAVY of the total, HEAVY at most, are settled on the map side; the others, none of them
    hot, go through a shuffle. `size` is left out.
    """
    heavy = F.broadcast(table.where(F.col(size) * HEAVY > total).drop(size))
    light = table.where(F.col(size) * HEAVY <= total).drop(size)
    rest = rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys)
    return rows.join(heavy, keys).unionByName(rest)


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n), data[offsets[i] : offsets[min(j, n)]], offsets[i : min(j, n) + 1] - offsets[i]
        i = j


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bases of the hash of a word's bytes and of that of a window's words; a second pair checks the first.
BYTE_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n at least."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        n = 1 << (n - 1).bit_length()
        table = np.full(n, base, np.uint64)
        table[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(table)
    return have


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each span, independent of its position."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, n)[:n], out=sums[1:])
    return (sums[ends] - sums[starts]) * _powers(pow(base, -1, 1 << 64), n + 1)[starts]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a run of texts: byte spans, the text each belongs to, and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, gaps: np.ndarray = SPACE):
        self.data, self.offsets = (LOWER[data] if lower else data), offsets
        n = len(data)
        inside = ~gaps[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = offsets[:-1][offsets[:-1] < n]
        begins[edges] = inside[edges]
        edges = offsets[1:][offsets[1:] > 0] - 1
        stops[edges] = inside[edges]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))

    def hashes(self, nth: int = 0) -> np.ndarray:
        return self.heads(len(self.data) + 1, nth)

    def heads(self, most: int, nth: int = 0) -> np.ndarray:
        """Hashes of the first `most` bytes of each word."""
        ends = np.minimum(self.ends, self.starts + most)
        raw = _spans(self.data.astype(np.uint64) + np.uint64(1), self.starts, ends, BYTE_BASES[nth])
        return mixed(raw + (ends - self.starts).astype(np.uint64))

    def windows(self, hashes: np.ndarray, k: int, nth: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each position, and which positions have k words of one text."""
        m = len(hashes) - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        at = np.arange(m)
        return mixed(_spans(hashes, at, at + k, WORD_BASES[nth]) + np.uint64(k)), self.doc[:m] == self.doc[k - 1 :]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
