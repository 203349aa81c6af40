"""Search indexes and embeddings on disk, as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search


def save_index(docs: DataFrame, path: str) -> None:
    """Postings of (id, seq, tokens) in order of their token, so that a search reads the files of its words, and the totals."""
    search.postings(docs).repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/postings")
    search.index_stats(docs).write.mode("overwrite").parquet(f"{path}/stats")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, stats), for search.bm25."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats")


class Vectors:
    """A table (id, embedding) on disk in numbered versions; an id has one embedding, that added last."""

    def __init__(self, spark: SparkSession, path: str, version: int = 0):
        self.spark, self.path, self.version = spark, path, version

    def table(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], "id string, embedding array<float>")
        return self.spark.read.parquet(f"{self.path}/v{self.version}")

    def add(self, rows: DataFrame) -> Vectors:
        """The next version: rows (id, embedding) in place of those of their ids."""
        rows = rows.select("id", F.col("embedding").cast("array<float>").alias("embedding"))
        after = Vectors(self.spark, self.path, self.version + 1)
        rows.unionByName(self.table().join(rows.select("id"), "id", "left_anti")).write.parquet(f"{self.path}/v{after.version}")
        return after

    def has(self, node_id: str) -> bool:
        return not self.table().where(F.col("id") == node_id).isEmpty()

    def ids(self) -> DataFrame:
        return self.table().select("id")

    def size(self) -> int:
        return self.table().count()

    def nearest(self, query: list[float], limit: int = 10) -> DataFrame:
        return search.nearest(self.table(), query, limit)
