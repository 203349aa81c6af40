"""Live updates: a stream of file events, debounced per file, applied to the graph batch by batch."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..graph import CodeGraph
from ..sources.graph_store import remove_files, upsert
from ..storage import staged

EVENTS = "ts timestamp, file string, event string"


def debounce(events: DataFrame, gap: str = "1500 milliseconds", late: str = "10 seconds", key: str = "file", ts: str = "ts", event: str = "event") -> DataFrame:
    """The last event of each burst of a key: bursts end with a gap, events later than the watermark are dropped.

    Works on a stream and, without the watermark's effect, on a table. Ties in time go to the larger event.
    """
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    bursts = rows.groupBy(F.session_window(ts, gap).alias("burst"), F.col(key))
    return bursts.agg(F.count("*").alias("events"), F.max_by(event, F.struct(ts, event)).alias("last_event"), F.max(ts).alias("last_ts")).select(
        F.col(key), F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), "events", "last_event", "last_ts"
    )


def relink(old: CodeGraph, new_nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Edges from outside into rewritten files, moved to the new symbols of the same name; confidence 0.7."""
    gone = old.nodes.join(files, "file", "left_semi").select(F.col("id").alias("target_id"), "name")
    outside = old.nodes.join(files, "file", "left_anti").select(F.col("id").alias("source_id"))
    kept = old.edges.where("type <> 'DEFINES'").join(gone, "target_id").join(outside, "source_id", "left_semi").drop("target_id", "id")
    first = Window.partitionBy("name").orderBy("node_seq", "id")
    to = new_nodes.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("name", F.col("id").alias("target_id"))
    edges = kept.join(to, "name").drop("name").withColumn("confidence", F.lit(0.7))
    return edges.withColumn("id", F.concat_ws(":", "type", "source_id", "target_id")).select(*old.edges.columns).dropDuplicates(["id"])


def apply_changes(graph: CodeGraph, changes: DataFrame, extracted: CodeGraph) -> CodeGraph:
    """The graph after (file, last_event) changes; `extracted` holds the new content of changed files.

    A file's nodes and their edges go, the new ones come, and callers from other files are linked again.
    """
    files = changes.select("file").distinct()
    fresh = changes.where("last_event <> 'unlink'").select("file").distinct()
    nodes = extracted.nodes.join(fresh, "file", "left_semi")
    again = relink(graph, nodes, fresh)
    left = remove_files(graph, files)
    edges = extracted.edges.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    edges = upsert(again, edges).select(*graph.edges.columns)
    return CodeGraph.of(upsert(left.nodes, nodes), upsert(left.edges, edges))


@dataclass
class Status:
    """What a status report shows."""

    updates: int = 0
    last_update: datetime | None = None
    unsaved: int = 0
    errors: deque = field(default_factory=lambda: deque(maxlen=10))


class Watcher:
    """Applies debounced changes to a graph held as written tables, one micro-batch at a time.

    `extract(files)` returns the CodeGraph of changed files; `save(graph)` is called after SAVE_EVERY
    updates, or at the first micro-batch SAVE_SECONDS after the last save that finds updates unsaved; a batch
    may be empty.
    """

    SAVE_EVERY, SAVE_SECONDS = 5, 30

    def __init__(self, graph: CodeGraph, extract: Callable[[DataFrame], CodeGraph], save: Callable[[CodeGraph], None] | None = None):
        self.graph, self.extract, self.save, self.status = graph.staged(), extract, save, Status()
        self.saved_at = time.monotonic()

    def on_batch(self, changes: DataFrame, _: int = 0) -> None:
        changes = staged(changes)
        n = changes.count()
        if not n:
            self._save_if_due()
            return
        try:
            extracted = self.extract(changes.where("last_event <> 'unlink'").select("file"))
            self.graph = apply_changes(self.graph, changes, extracted).staged()
        except Exception as e:
            self.status.errors.append(f"{type(e).__name__}: {e}"[:300])
            raise
        self.status.updates += n
        self.status.unsaved += n
        self.status.last_update = datetime.now(timezone.utc)
        self._save_if_due()

    def _save_if_due(self) -> None:
        late = time.monotonic() - self.saved_at >= self.SAVE_SECONDS
        if self.save and self.status.unsaved and (late or self.status.unsaved >= self.SAVE_EVERY):
            self.save(self.graph)
            self.status.unsaved, self.saved_at = 0, time.monotonic()

    def start(self, events: DataFrame, checkpoint: str, gap: str = "1500 milliseconds", every: str = "30 seconds") -> StreamingQuery:
        writer = debounce(events, gap).writeStream.outputMode("append").foreachBatch(self.on_batch)
        return writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
