"""Change feed: graph changes as a stream, subscriptions as filters.

Events: (event_type, node_id, edge_id, from_node, to_node, key_hash,
snapshot_id, ts).  Changes are appended as files to a folder; a subscription is
a streaming read of it.  Watermarks, windows and deduplication are extensions
by Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

NODE, EDGE, KV, COMMIT = "NodeChanged", "EdgeChanged", "KvChanged", "SnapshotCommitted"
SCHEMA = "event_type string, node_id long, edge_id long, from_node long, to_node long, key_hash long, snapshot_id long, ts timestamp"


@dataclass(frozen=True)
class Filter:
    nodes: bool = True
    edges: bool = True
    kv: bool = True
    commits: bool = True

    def column(self) -> Column:
        kinds = [k for k, on in ((NODE, self.nodes), (EDGE, self.edges), (KV, self.kv), (COMMIT, self.commits)) if on]
        return F.col("event_type").isin(*kinds) if kinds else F.lit(False)


ALL, NODES_ONLY, EDGES_ONLY, KV_ONLY = Filter(), Filter(True, False, False, False), Filter(False, True, False, False), Filter(False, False, True, False)


class Feed:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.subscribers = spark, path, {}

    def emit(self, changes: DataFrame) -> None:
        """Append change rows; missing columns become null."""
        fields = self.spark.createDataFrame([], SCHEMA).schema.fields
        columns = [(F.col(f.name) if f.name in changes.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
        changes.select(*columns).write.mode("append").parquet(self.path)

    def stream(self, keep: Filter = ALL, max_files: int | None = None) -> DataFrame:
        reader = self.spark.readStream.schema(SCHEMA)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return reader.parquet(self.path).where(keep.column())

    def subscribe(self, handler: Callable[[DataFrame, int], None], keep: Filter = ALL, checkpoint: str | None = None, once: bool = False) -> str:
        """Run ``handler`` on every batch of matching events; the id ends it again."""
        writer = self.stream(keep).writeStream.foreachBatch(handler)
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        query: StreamingQuery = (writer.trigger(availableNow=True) if once else writer).start()
        self.subscribers[query.id] = query
        return query.id

    def wait(self, subscriber: str, seconds: float | None = None) -> bool:
        return bool(self.subscribers[subscriber].awaitTermination(seconds) if seconds else self.subscribers[subscriber].awaitTermination())

    def unsubscribe(self, subscriber: str) -> bool:
        query = self.subscribers.pop(subscriber, None)
        if query is None:
            return False
        query.stop()
        return True

    # -- extensions --------------------------------------------------------------

    @staticmethod
    def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
        """(start, end, event_type, n) over tumbling or sliding windows, for streams with a watermark and for tables alike."""
        window = F.window("ts", width, slide) if slide else F.window("ts", width)
        return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "w.end", "event_type", "n")

    @staticmethod
    def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
        """(node_id, start, end, n): bursts of changes of one node."""
        return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "node_id").agg(F.count("*").alias("n")).select("node_id", "w.start", "w.end", "n")

    @staticmethod
    def distinct(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def changes_between(before, after, snapshot_id: int) -> DataFrame:
    """Node and edge change events between two graphs, and one commit event."""
    spark = before.spark
    none = F.lit(None).cast("long")
    nodes = after.nodes.exceptAll(before.nodes).union(before.nodes.exceptAll(after.nodes)).select("id").distinct()
    edges = after.edges.exceptAll(before.edges).union(before.edges.exceptAll(after.edges)).select("id", "from_id", "to_id").distinct()
    return (
        nodes.select(F.lit(NODE).alias("event_type"), F.col("id").alias("node_id"), none.alias("edge_id"), none.alias("from_node"), none.alias("to_node"), F.lit(snapshot_id).cast("long").alias("snapshot_id"))
        .union(edges.select(F.lit(EDGE), none, F.col("id"), F.col("from_id"), F.col("to_id"), F.lit(snapshot_id).cast("long")))
        .union(spark.range(1).select(F.lit(COMMIT), none, none, none, none, F.lit(snapshot_id).cast("long")))
    )
