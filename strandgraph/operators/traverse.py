"""Traversals: level-synchronous frontier joins over a stored edge list."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, functions as F

from strandgraph.errors import NotFound
from strandgraph.graph import BOTH, INCOMING, OUTGOING, Graph, arcs
from strandgraph.operators import local
from strandgraph.plans.fixpoint import grow


def _starts(g: Graph, starts: Sequence[int] | DataFrame) -> DataFrame:
    if isinstance(starts, DataFrame):
        return starts.select("id").distinct()
    return g.spark.createDataFrame([(int(s),) for s in starts], "id long").distinct()


def bfs_levels(g: Graph, starts: Sequence[int] | DataFrame, depth: int | None = None, direction: str = OUTGOING, types: Sequence[str] | None = None) -> DataFrame:
    """(id, level) of every node within ``depth`` of the starts, which have level 0."""
    edges = arcs(g.edges, direction, types).select("src", "dst")
    step = lambda frontier, _: edges.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
    return grow(_starts(g, starts), step, ["id"], depth)


def bfs(g: Graph, start: int, depth: int) -> DataFrame:
    """(id, level) in (level, id) order, the start included."""
    return bfs_levels(g, [start], depth).orderBy("level", "id")


def bfs_filtered(g: Graph, start: int, depth: int, types: Sequence[str], direction: str = OUTGOING) -> DataFrame:
    """As ``bfs`` over some edge types only; without types there is no result at all."""
    if not types:
        return g.spark.sql("SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS INT) AS level WHERE FALSE")
    return bfs_levels(g, [start], depth, direction, types).orderBy("level", "id")


def bfs_frontier(g: Graph, start: int, depth: int) -> DataFrame:
    """Nodes at exactly ``depth``."""
    return bfs_levels(g, [start], depth).where(F.col("level") == depth).select("id").orderBy("id")


def k_hop(g: Graph, starts: int | Sequence[int], depth: int, direction: str = OUTGOING, types: Sequence[str] | None = None) -> DataFrame:
    """(id, level) within ``depth`` hops without the starts, in (level, id) order."""
    starts = [starts] if isinstance(starts, int) else starts
    return bfs_levels(g, starts, depth, direction, types).where("level > 0").orderBy("level", "id")


def multi_source(g: Graph, sources: DataFrame, depth: int | None = None, direction: str = OUTGOING, types: Sequence[str] | None = None) -> DataFrame:
    """(source, id, level): the closure of each source on its own."""
    edges = arcs(g.edges, direction, types).select("src", "dst")
    step = lambda frontier, _: edges.join(frontier.select("source", F.col("id").alias("src")), "src").select("source", F.col("dst").alias("id")).distinct()
    return grow(sources.select(F.col("id").alias("source"), "id").distinct(), step, ["source", "id"], depth)


def has_path(g: Graph, a: int, b: int, depth: int | None = None) -> bool:
    """Whether b is within ``depth`` of a; the search stops at the level that holds b."""
    if a == b:
        return True
    edges = arcs(g.edges).select("src", "dst")
    step = lambda frontier, _: edges.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
    found = grow(_starts(g, [a]), step, ["id"], depth, until=lambda level: not level.where(F.col("id") == b).isEmpty())
    return not found.where(F.col("id") == b).isEmpty()


def shortest_path(g: Graph, a: int, b: int, types: Sequence[str] | None = None, direction: str = OUTGOING) -> list[int] | None:
    """Node ids of a shortest path, or None.

    A node's parent is the first to discover it in breadth-first order over
    sorted neighbours.  Within a level that order is the lexicographic order of
    the chosen paths, so the parent rule amounts to the smallest path array.
    """
    for n in (a, b):
        if g.nodes.where(F.col("id") == n).isEmpty():
            raise NotFound(f"node {n}")
    if a == b:
        return [a]
    if types is not None and not types:
        return None
    edges = arcs(g.edges, direction, types).select("src", "dst")
    step = lambda frontier, _: (
        edges.join(frontier.select(F.col("id").alias("src"), "path"), "src")
        .groupBy(F.col("dst").alias("id"))
        .agg(F.min("path").alias("path"))
        .select("id", F.concat("path", F.array("id")).alias("path"))
    )
    first = g.spark.createDataFrame([(a, [a])], "id long, path array<long>")
    found = grow(first, step, ["id"], None, until=lambda level: not level.where(F.col("id") == b).isEmpty())
    row = found.where(F.col("id") == b).first()
    return list(row["path"]) if row else None


def shortest_paths(g: Graph, a: int, depth: int | None = None) -> DataFrame:
    """(id, level, path) from one start to every node it reaches, with the same choice of paths."""
    edges = arcs(g.edges).select("src", "dst")
    step = lambda frontier, _: (
        edges.join(frontier.select(F.col("id").alias("src"), "path"), "src")
        .groupBy(F.col("dst").alias("id"))
        .agg(F.min("path").alias("path"))
        .select("id", F.concat("path", F.array("id")).alias("path"))
    )
    return grow(g.spark.createDataFrame([(a, [a])], "id long, path array<long>"), step, ["id"], depth)


def bfs_iter(g: Graph, start: int) -> Iterator[int]:
    """Ids level by level, fetched as they are read."""
    for row in bfs_levels(g, [start]).orderBy("level", "id").toLocalIterator():
        yield row["id"]


def dfs_iter(g: Graph, start: int) -> Iterator[int]:
    """Ids in depth-first order, the start first, fetched as they are read."""
    yield start
    for row in dfs_traversal(g, start).toLocalIterator():
        yield row["id"]


def dfs_traversal(g: Graph, start: int) -> DataFrame:
    """(position, id) in stack order without the start; one task walks what the start reaches."""
    live = bfs_levels(g, [start]).select("id")
    edges = arcs(g.edges).select("src", "dst").join(live.withColumnRenamed("id", "src"), "src", "left_semi").withColumn("walk", F.lit(0))

    def walk(pdf):
        import pandas as pd

        order = local.dfs_order(local.adjacency([start], zip(pdf["src"], pdf["dst"], strict=True)), start)[1:]
        return pd.DataFrame({"position": range(len(order)), "id": order}, dtype="int64")

    return edges.groupBy("walk").applyInPandas(walk, "position long, id long").orderBy("position")


__all__ = ["BOTH", "INCOMING", "OUTGOING", "bfs", "bfs_filtered", "bfs_frontier", "bfs_iter", "bfs_levels", "dfs_iter", "dfs_traversal", "has_path", "k_hop", "multi_source", "shortest_path", "shortest_paths"]
