"""The property graph: four DataFrames behind one immutable handle.

Writes return a new ``Graph``; earlier handles stay valid, which is all that
snapshot isolation needs.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandgraph.errors import InvalidInput, NotFound
from strandgraph.functions.json import glob_pattern
from strandgraph.plans.fixpoint import WorkTables

NODES = "id long, kind string, name string, file_path string, data string"
EDGES = "id long, from_id long, to_id long, edge_type string, data string"
LABELS = "entity_id long, label string"
PROPERTIES = "entity_id long, key string, value string"
OUTGOING, INCOMING, BOTH = "outgoing", "incoming", "both"


def arcs(edges: DataFrame, direction: str = OUTGOING, types: Sequence[str] | None = None) -> DataFrame:
    """(src, dst, edge_type, edge_id): edges as they are walked; only the columns a traversal needs."""
    if types is not None:
        edges = edges.where(F.col("edge_type").isin(*types)) if types else edges.where(F.lit(False))
    out = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "edge_type", F.col("id").alias("edge_id"))
    back = edges.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), "edge_type", F.col("id").alias("edge_id"))
    if direction == OUTGOING:
        return out
    if direction == INCOMING:
        return back
    if direction == BOTH:
        return out.unionByName(back)
    raise InvalidInput(f"unknown direction {direction}")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    extra_labels: DataFrame
    properties: DataFrame
    version: int = 0

    # -- making one ------------------------------------------------------------

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame, labels: DataFrame | None = None, properties: DataFrame | None = None) -> Graph:
        spark = nodes.sparkSession
        return Graph(
            nodes,
            edges,
            labels if labels is not None else spark.createDataFrame([], LABELS),
            properties if properties is not None else spark.createDataFrame([], PROPERTIES),
        )

    @staticmethod
    def empty(spark: SparkSession) -> Graph:
        return Graph.of(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @property
    def labels(self) -> DataFrame:
        """Every node's kind and the labels added to it."""
        return self.nodes.select(F.col("id").alias("entity_id"), F.col("kind").alias("label")).union(self.extra_labels.select("entity_id", "label")).distinct()

    def with_frames(self, **frames: DataFrame) -> Graph:
        return replace(self, **frames, version=self.version + 1)

    # -- lookups ---------------------------------------------------------------

    def node_ids(self) -> DataFrame:
        return self.nodes.select("id").orderBy("id")

    entity_ids = node_ids

    def get_node(self, node_id: int) -> dict:
        row = self.nodes.where(F.col("id") == node_id).first()
        if row is None:
            raise NotFound(f"node {node_id}")
        return row.asDict()

    def get_edge(self, edge_id: int) -> dict:
        row = self.edges.where(F.col("id") == edge_id).first()
        if row is None:
            raise NotFound(f"edge {edge_id}")
        return row.asDict()

    def nodes_by_kind(self, kind: str) -> DataFrame:
        return self.nodes.where(F.col("kind") == kind).orderBy("id")

    def node_by_kind_and_name(self, kind: str, name: str) -> dict | None:
        row = self.nodes.where((F.col("kind") == kind) & (F.col("name") == name)).orderBy("id").first()
        return row.asDict() if row else None

    def nodes_by_name_pattern(self, pattern: str) -> DataFrame:
        """Case-sensitive GLOB; a pure prefix pattern becomes a pushed-down filter."""
        head = pattern[:-1]
        if pattern.endswith("*") and not any(c in head for c in "*?["):
            return self.nodes.where(F.col("name").startswith(head)).select("id").orderBy("id")
        return self.nodes.where(F.col("name").rlike(glob_pattern(pattern))).select("id").orderBy("id")

    def nodes_with_constraint(self, kind: str | None = None, name_prefix: str | None = None) -> DataFrame:
        found = self.nodes
        if kind is not None:
            found = found.where(F.col("kind") == kind)
        if name_prefix is not None:
            found = found.where(F.col("name").startswith(name_prefix))
        return found.select("id").orderBy("id")

    def nodes_by_label(self, label: str) -> DataFrame:
        tagged = self.extra_labels.where(F.col("label") == label)
        return self.nodes.join(tagged, self.nodes["id"] == tagged["entity_id"], "left_semi").union(self.nodes.where(F.col("kind") == label)).distinct().orderBy("id")

    def nodes_by_property(self, key: str, value: str) -> DataFrame:
        """One row for each matching property row."""
        hit = self.properties.where((F.col("key") == key) & (F.col("value") == value)).select("entity_id")
        return self.nodes.join(hit, self.nodes["id"] == hit["entity_id"]).drop("entity_id").orderBy("id")

    # -- adjacency -------------------------------------------------------------

    def neighbors(self, node_id: int, direction: str = OUTGOING, edge_type: str | None = None) -> DataFrame:
        """(neighbor, edge_type, edge_id), duplicates kept."""
        found = arcs(self.edges, direction, None if edge_type is None else [edge_type]).where(F.col("src") == node_id)
        return found.select(F.col("dst").alias("neighbor"), "edge_type", "edge_id").orderBy("neighbor", "edge_type", "edge_id")

    def outgoing(self, node_id: int) -> DataFrame:
        return self.neighbors(node_id, OUTGOING)

    def incoming(self, node_id: int) -> DataFrame:
        return self.neighbors(node_id, INCOMING)

    def edges_of_type(self, node_id: int, edge_type: str) -> DataFrame:
        if not edge_type.strip():
            raise InvalidInput("edge type must not be blank")
        return self.neighbors(node_id, OUTGOING, edge_type)

    def adjacency(self, ids: DataFrame, direction: str = OUTGOING) -> DataFrame:
        """(id, neighbors, edge_types) for each id, in (neighbor, type, edge id) order."""
        grouped = (
            arcs(self.edges, direction)
            .join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
            .groupBy(F.col("src").alias("id"))
            .agg(F.sort_array(F.collect_list(F.struct("dst", "edge_type", "edge_id"))).alias("a"))
        )
        none = F.array()
        return ids.select("id").distinct().join(grouped, "id", "left").select(
            "id", F.coalesce("a.dst", none.cast("array<long>")).alias("neighbors"), F.coalesce("a.edge_type", none.cast("array<string>")).alias("edge_types")
        )

    def degrees(self) -> DataFrame:
        """(id, out_degree, in_degree) of every node, duplicates counted."""
        ends = self.edges.select(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(self.edges.select("to_id", F.lit(0), F.lit(1)))
        counted = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        zero = F.lit(0).cast("long")
        return self.nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("o", zero).alias("out_degree"), F.coalesce("i", zero).alias("in_degree"))

    def node_degree(self, node_id: int) -> tuple[int, int]:
        """(out, in)."""
        row = self.edges.where((F.col("from_id") == node_id) | (F.col("to_id") == node_id)).agg(
            F.count_if(F.col("from_id") == node_id), F.count_if(F.col("to_id") == node_id)
        ).first()
        return row[0], row[1]

    # -- writes ----------------------------------------------------------------

    def next_id(self, frame: DataFrame) -> int:
        return (frame.agg(F.max("id")).first()[0] or 0) + 1

    def add_nodes(self, specs: Iterable[dict]) -> tuple[Graph, list[int]]:
        """Append nodes given as dicts (kind, name, file_path, data); ids follow the largest one."""
        first, rows = self.next_id(self.nodes), []
        for i, s in enumerate(specs):
            if not str(s.get("kind", "")).strip() or not str(s.get("name", "")).strip():
                raise InvalidInput("kind and name must not be blank")
            rows.append((first + i, s["kind"], s["name"], s.get("file_path"), json.dumps(s.get("data", {}), ensure_ascii=False)))
        more = self.spark.createDataFrame(rows, NODES)
        return self.with_frames(nodes=self.nodes.unionByName(more)), [r[0] for r in rows]

    def add_node(self, kind: str, name: str, file_path: str | None = None, data: dict | None = None) -> tuple[Graph, int]:
        g, ids = self.add_nodes([{"kind": kind, "name": name, "file_path": file_path, "data": data or {}}])
        return g, ids[0]

    def append_nodes(self, frame: DataFrame) -> Graph:
        """Bulk append of a DataFrame with the node columns but the id; ids are dealt per partition, without a global sort."""
        return self.with_frames(nodes=self.nodes.unionByName(numbered(frame, self.next_id(self.nodes)).select("id", "kind", "name", "file_path", "data")))

    def add_edges(self, specs: Iterable[dict]) -> tuple[Graph, list[int]]:
        """Append edges given as dicts (from_id, to_id, edge_type, data); both ends must exist."""
        first, rows = self.next_id(self.edges), []
        for i, s in enumerate(specs):
            if not str(s.get("edge_type", "")).strip() or s["from_id"] <= 0 or s["to_id"] <= 0:
                raise InvalidInput("edge type must not be blank, ends must be positive")
            rows.append((first + i, s["from_id"], s["to_id"], s["edge_type"], json.dumps(s.get("data", {}), ensure_ascii=False)))
        more = self.spark.createDataFrame(rows, EDGES)
        return self.append_edges(more, with_ids=True), [r[0] for r in rows]

    def add_edge(self, from_id: int, to_id: int, edge_type: str, data: dict | None = None) -> tuple[Graph, int]:
        g, ids = self.add_edges([{"from_id": from_id, "to_id": to_id, "edge_type": edge_type, "data": data or {}}])
        return g, ids[0]

    def append_edges(self, frame: DataFrame, with_ids: bool = False) -> Graph:
        if not with_ids:
            frame = numbered(frame, self.next_id(self.edges))
        frame = frame.select("id", "from_id", "to_id", "edge_type", "data")
        if not self.dangling(frame).isEmpty():
            raise InvalidInput("an edge's end does not exist")
        return self.with_frames(edges=self.edges.unionByName(frame))

    def dangling(self, edges: DataFrame | None = None) -> DataFrame:
        """Ids that edges name but no node has."""
        edges = self.edges if edges is None else edges
        ends = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id")).distinct()
        return ends.join(self.nodes.select("id"), "id", "left_anti")

    def update_node(self, node_id: int, kind: str, name: str, file_path: str | None = None, data: dict | None = None) -> Graph:
        self.get_node(node_id)
        hit = F.col("id") == node_id
        new = {"kind": kind, "name": name, "file_path": file_path, "data": json.dumps(data or {}, ensure_ascii=False)}
        return self.with_frames(nodes=self.nodes.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in new.items()}))

    def delete_nodes(self, ids: DataFrame) -> Graph:
        """Without these nodes and their edges; labels and properties stay."""
        gone = ids.select("id").distinct()
        a, b = gone.withColumnRenamed("id", "from_id"), gone.withColumnRenamed("id", "to_id")
        return self.with_frames(nodes=self.nodes.join(gone, "id", "left_anti"), edges=self.edges.join(a, "from_id", "left_anti").join(b, "to_id", "left_anti").select(*self.edges.columns))

    def delete_node(self, node_id: int) -> Graph:
        self.get_node(node_id)
        return self.with_frames(nodes=self.nodes.where(F.col("id") != node_id), edges=self.edges.where((F.col("from_id") != node_id) & (F.col("to_id") != node_id)))

    def delete_edge(self, edge_id: int) -> Graph:
        return self.with_frames(edges=self.edges.where(F.col("id") != edge_id))

    def add_label(self, node_id: int, label: str) -> Graph:
        more = self.spark.createDataFrame([(node_id, label)], LABELS)
        return self.with_frames(extra_labels=self.extra_labels.union(more).distinct())

    def add_property(self, node_id: int, key: str, value: str) -> Graph:
        more = self.spark.createDataFrame([(node_id, key, value)], PROPERTIES)
        return self.with_frames(properties=self.properties.union(more))

    def transaction(self) -> Transaction:
        return Transaction(self)

    # -- facts -----------------------------------------------------------------

    def introspect(self) -> dict:
        kinds = {r["kind"]: r["n"] for r in self.nodes.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        types = {r["edge_type"]: r["n"] for r in self.edges.groupBy("edge_type").agg(F.count("*").alias("n")).collect()}
        return {"nodes": sum(kinds.values()), "edges": sum(types.values()), "kinds": kinds, "edge_types": types, "version": self.version, "cached": str(self.nodes.storageLevel)}

    def property_of(self, key: str) -> Column:
        return F.get_json_object("data", "$['" + key + "']")


def numbered(frame: DataFrame, first: int) -> DataFrame:
    """Consecutive ids per partition.

    The rows are written with the partition that made them, so that what is
    counted is what is numbered, whatever is retried or replanned later; the
    partitions' offsets, one row each, are joined.
    """
    work = WorkTables(frame.sparkSession, "numbered")
    tagged, _ = work.save(frame.withColumn("__i", F.monotonically_increasing_id()))
    # The upper bits of the running number are the partition, the lower ones the place in it.
    tagged = tagged.withColumn("__p", F.shiftright("__i", 33)).withColumn("__at", F.col("__i").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = tagged.groupBy("__p").agg(F.count("*").alias("n")).orderBy("__p").collect()
    starts, at = [], first
    for r in sizes:
        starts.append((r["__p"], at))
        at += r["n"]
    offsets = frame.sparkSession.createDataFrame(starts, "__p long, __start long")
    return tagged.join(F.broadcast(offsets), "__p").withColumn("id", F.col("__start") + F.col("__at")).drop("__p", "__i", "__at", "__start")


class Transaction:
    """Collects writes on a graph; ``commit`` returns the new handle, ``rollback`` the old one."""

    def __init__(self, graph: Graph):
        self.before = self.graph = graph

    def apply(self, write) -> Transaction:
        result = write(self.graph)
        self.graph = result[0] if isinstance(result, tuple) else result
        return self

    def commit(self) -> Graph:
        return self.graph

    def rollback(self) -> Graph:
        self.graph = self.before
        return self.before
