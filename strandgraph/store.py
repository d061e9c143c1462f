"""A mutable store over the immutable graph: one current version, its caches, indexes, keys and change feed.

Every write replaces the current graph and its version number; readers that
hold an earlier ``snapshot()`` keep it.  Results of traversals are remembered
until the next write.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandgraph.errors import InvalidInput, NotFound
from strandgraph.graph import OUTGOING, Graph, arcs
from strandgraph.operators import community, component, flow, match, rank, reach, traverse
from strandgraph.operators.kv import KvFrame
from strandgraph.operators.vector import IndexConfig, IndexRegistry, VectorIndex
from strandgraph.plans.planner import Result, execute
from strandgraph.sources import dump
from strandgraph.streaming.feed import ALL, Feed, Filter, changes_between


class GraphStore:
    def __init__(self, graph: Graph, feed: Feed | None = None):
        self.graph, self.feed = graph, feed
        self.kv, self.indexes, self.cache, self.hits = KvFrame.empty(graph.spark), IndexRegistry(graph.spark), {}, [0, 0]

    @staticmethod
    def open(spark: SparkSession, path: str | None = None, feed: str | None = None) -> GraphStore:
        """A saved graph, or an empty one in memory."""
        graph = dump.restore(spark, path) if path else Graph.empty(spark)
        return GraphStore(graph, Feed(spark, feed) if feed else None)

    # -- versions ------------------------------------------------------------------

    def snapshot(self) -> Graph:
        return self.graph

    def _become(self, graph: Graph) -> None:
        if self.feed is not None:
            self.feed.emit(changes_between(self.graph, graph, graph.version).withColumn("ts", F.current_timestamp()))
        self.graph = graph
        self.cache.clear()

    def _remembered(self, key: tuple, make: Callable[[], object]):
        key = (self.graph.version, *key)
        self.hits[key not in self.cache] += 1
        if key not in self.cache:
            made = make()
            self.cache[key] = made.persist() if isinstance(made, DataFrame) else made
        return self.cache[key]

    def cache_stats(self) -> dict:
        return {"entries": len(self.cache), "hits": self.hits[0], "misses": self.hits[1]}

    # -- writes ----------------------------------------------------------------------

    def add_node(self, kind: str, name: str, data: dict | None = None, file_path: str | None = None) -> int:
        return self.add_nodes_bulk([{"kind": kind, "name": name, "data": data or {}, "file_path": file_path}])[0]

    def add_nodes_bulk(self, specs: Sequence[dict]) -> list[int]:
        graph, ids = self.graph.add_nodes(specs)
        self._become(graph)
        return ids

    def add_edge(self, from_id: int, to_id: int, edge_type: str, data: dict | None = None) -> int:
        return self.add_edges_bulk([{"from_id": from_id, "to_id": to_id, "edge_type": edge_type, "data": data or {}}])[0]

    def add_edges_bulk(self, specs: Sequence[dict]) -> list[int]:
        graph, ids = self.graph.add_edges(specs)
        self._become(graph)
        return ids

    def update_node(self, node_id: int, kind: str, name: str, data: dict | None = None, file_path: str | None = None) -> None:
        self._become(self.graph.update_node(node_id, kind, name, file_path, data))

    def delete_node(self, node_id: int) -> None:
        self._become(self.graph.delete_node(node_id))

    def delete_edge(self, edge_id: int) -> None:
        self._become(self.graph.delete_edge(edge_id))

    def add_label(self, node_id: int, label: str) -> None:
        self._become(self.graph.add_label(node_id, label))

    def add_property(self, node_id: int, key: str, value: str) -> None:
        self._become(self.graph.add_property(node_id, key, value))

    def transaction(self, writes: Callable[[Graph], Graph]) -> None:
        """All writes of a function, or none if it raises."""
        self._become(writes(self.graph))

    def query(self, text: str, strict: bool = False) -> Result:
        result = execute(self.graph, text, strict=strict, indexes=self.indexes)
        if result.graph is not None:
            self._become(result.graph)
        return result

    # -- reads -------------------------------------------------------------------------

    def get_node(self, node_id: int) -> dict:
        return self.graph.get_node(node_id)

    def get_edge(self, edge_id: int) -> dict:
        return self.graph.get_edge(edge_id)

    def node_ids(self) -> list[int]:
        return [r["id"] for r in self.graph.node_ids().toLocalIterator()]

    def nodes_by_kind(self, kind: str) -> DataFrame:
        return self.graph.nodes_by_kind(kind).select("id")

    def nodes_by_name_pattern(self, pattern: str) -> DataFrame:
        return self.graph.nodes_by_name_pattern(pattern)

    def neighbors(self, node_id: int, direction: str = OUTGOING, edge_type: str | None = None) -> DataFrame:
        return self.graph.neighbors(node_id, direction, edge_type)

    def node_degree(self, node_id: int) -> tuple[int, int]:
        return self.graph.node_degree(node_id)

    def node_count(self) -> int:
        return self.graph.nodes.count()

    def edge_count(self) -> int:
        return self.graph.edges.count()

    def contains_node(self, node_id: int) -> bool:
        return not self.graph.nodes.where(F.col("id") == node_id).isEmpty()

    def edge_endpoints(self, edge_id: int) -> tuple[int, int]:
        edge = self.get_edge(edge_id)
        return edge["from_id"], edge["to_id"]

    def find_edge(self, from_id: int, to_id: int) -> int | None:
        return self.graph.edges.where((F.col("from_id") == from_id) & (F.col("to_id") == to_id)).agg(F.min("id")).first()[0]

    def edges_directed(self, node_id: int, direction: str = OUTGOING) -> DataFrame:
        return arcs(self.graph.edges, direction).where(F.col("src") == node_id)

    def introspect(self) -> dict:
        return {**self.graph.introspect(), "cache": self.cache_stats()}

    # -- traversals, remembered ------------------------------------------------------------

    def bfs(self, start: int, depth: int) -> DataFrame:
        return self._remembered(("bfs", start, depth), lambda: traverse.bfs(self.graph, start, depth))

    def bfs_filtered(self, start: int, depth: int, types: Sequence[str], direction: str = OUTGOING) -> DataFrame:
        return self._remembered(("bfs", start, depth, tuple(types), direction), lambda: traverse.bfs_filtered(self.graph, start, depth, types, direction))

    def k_hop(self, start: int, depth: int, direction: str = OUTGOING, types: Sequence[str] | None = None) -> DataFrame:
        return self._remembered(("k_hop", start, depth, direction, None if types is None else tuple(types)), lambda: traverse.k_hop(self.graph, start, depth, direction, types))

    def shortest_path(self, a: int, b: int, types: Sequence[str] | None = None) -> list[int] | None:
        return self._remembered(("path", a, b, None if types is None else tuple(types)), lambda: traverse.shortest_path(self.graph, a, b, types))

    def chain_query(self, start: int, legs: Sequence[tuple[str, str]]) -> DataFrame:
        return match.chain_query(self.graph, start, legs)

    def pattern_search(self, start: int, legs: Sequence[match.LegPattern]) -> DataFrame:
        return match.execute_pattern(self.graph, start, legs)

    # -- algorithms ------------------------------------------------------------------------

    def pagerank(self, damping: float = 0.85, iterations: int = 20) -> DataFrame:
        return rank.pagerank(self.graph, damping, iterations)

    def betweenness(self) -> DataFrame:
        return rank.betweenness(self.graph)

    def louvain_communities(self, iterations: int = 20) -> DataFrame:
        return community.groups(community.louvain(self.graph, iterations))

    def label_propagation(self, iterations: int = 20) -> DataFrame:
        return community.groups(community.label_propagation(self.graph, iterations))

    def connected_components(self) -> DataFrame:
        return component.connected_components(self.graph)

    def strongly_connected_components(self) -> DataFrame:
        return component.strongly_connected_components(self.graph)

    def find_cycles(self, limit: int = 100) -> DataFrame:
        return community.cycles(self.graph, limit)

    def dominators(self, entry: int) -> DataFrame:
        return flow.immediate_dominators(flow.from_graph(self.graph), entry)

    def topological_sort(self) -> DataFrame:
        return reach.topological_levels(self.graph).orderBy("level", "id")

    def critical_path(self) -> dict:
        return reach.critical_path(self.graph)

    # -- keys, vectors, events, copies ---------------------------------------------------------

    def kv_set(self, key: str, value, now: int, ttl: int | None = None) -> None:
        self.kv = self.kv.set(key, value, now, ttl)

    def kv_get(self, key: str, now: int | None = None, snapshot: int = 0):
        return self.kv.get(key, now, snapshot)

    def kv_delete(self, key: str, now: int) -> None:
        self.kv = self.kv.delete(key, now)

    def kv_prefix_scan(self, prefix: str, now: int | None = None, snapshot: int = 0) -> DataFrame:
        return self.kv.prefix_scan(prefix, now, snapshot)

    def create_hnsw_index(self, name: str, config: IndexConfig) -> VectorIndex:
        return self.indexes.create(name, config)

    def get_hnsw_index(self, name: str) -> VectorIndex:
        return self.indexes[name]

    def list_hnsw_indexes(self) -> list[str]:
        return self.indexes.names()

    def delete_hnsw_index(self, name: str) -> None:
        self.indexes.drop(name)

    def insert_vector(self, index: str, vector: Sequence[float], metadata: dict | None = None) -> int:
        return self.bulk_insert_vectors(index, [(vector, metadata)])[0]

    def bulk_insert_vectors(self, index: str, vectors: Sequence[tuple[Sequence[float], dict | None]]) -> list[int]:
        new, ids = self.indexes[index].insert(vectors)
        self.indexes.replace(new)
        return ids

    def subscribe(self, handler: Callable[[DataFrame, int], None], keep: Filter = ALL, **options) -> str:
        if self.feed is None:
            raise InvalidInput("this store has no change feed")
        return self.feed.subscribe(handler, keep, **options)

    def unsubscribe(self, subscriber: str) -> bool:
        if self.feed is None:
            raise NotFound("this store has no change feed")
        return self.feed.unsubscribe(subscriber)

    def backup(self, path: str) -> dict:
        return dump.backup(self.graph, path)

    snapshot_export = backup

    def snapshot_import(self, path: str) -> None:
        self._become(dump.restore(self.graph.spark, path).with_frames())

    def checkpoint(self, path: str) -> None:
        """Write the current graph and go on from the files, which cuts its lineage."""
        dump.save(self.graph, path)
        saved = dump.open_saved(self.graph.spark, path)
        self.graph = self.graph.with_frames(nodes=saved.nodes, edges=saved.edges, extra_labels=saved.extra_labels, properties=saved.properties)
        self.cache.clear()
