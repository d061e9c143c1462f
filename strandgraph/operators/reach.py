"""Reachability, closure, and operators on acyclic graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandgraph.errors import CycleDetected, InvalidInput
from strandgraph.graph import INCOMING, Graph, arcs
from strandgraph.operators.traverse import bfs_levels, has_path, multi_source
from strandgraph.plans.fixpoint import WorkTables, grow


def reachable_from(g: Graph, start: int) -> DataFrame:
    """Ids, the start included."""
    return bfs_levels(g, [start]).select("id").orderBy("id")


def reverse_reachable_from(g: Graph, target: int) -> DataFrame:
    return bfs_levels(g, [target], direction=INCOMING).select("id").orderBy("id")


def can_reach(g: Graph, a: int, b: int) -> bool:
    return has_path(g, a, b)


def unreachable_from(g: Graph, entry: int) -> DataFrame:
    """All ids that the entry does not reach; every id if there is no such entry."""
    known = g.nodes.where(F.col("id") == entry).select("id")
    return g.nodes.select("id").join(bfs_levels(g, known).select("id"), "id", "left_anti").orderBy("id")


def transitive_closure(g: Graph, max_depth: int | None = None, max_sources: int | None = None, max_pairs: int | None = None) -> DataFrame:
    """(source, id) with (v, v) included, semi-naive; bounds as given, sources by smallest id."""
    sources = g.nodes.select("id")
    if max_sources is not None:
        sources = sources.orderBy("id").limit(max_sources)
    pairs = multi_source(g, sources, max_depth).select("source", "id")
    return pairs.orderBy("source", "id").limit(max_pairs) if max_pairs is not None else pairs


def transitive_reduction(g: Graph) -> DataFrame:
    """(from_id, to_id) of the distinct edges that no longer path implies; self-loops stay out of the test."""
    edges = arcs(g.edges).select("src", "dst").distinct()
    proper = edges.where("src <> dst")
    first = proper.select(F.col("src").alias("source"), F.col("dst").alias("id"))
    step = lambda frontier, _: proper.join(frontier.select("source", F.col("id").alias("src")), "src").select("source", F.col("dst").alias("id")).distinct()
    reach = grow(first, step, ["source", "id"], None).select("source", "id")
    # an edge (s, d) is implied if s -> m is an edge, m <> d, and m reaches d
    via = proper.select(F.col("src").alias("s"), F.col("dst").alias("m")).join(reach.toDF("m", "d"), "m").where("m <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()
    kept = proper.join(via, ["src", "dst"], "left_anti").union(edges.where("src = dst"))
    return kept.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"))


def topological_levels(g: Graph) -> DataFrame:
    """(id, level): nodes whose predecessors all have smaller levels; (level, id) is the order.

    Peels nodes without unpeeled predecessors, by counting down in-degrees;
    what is never peeled lies on or behind a cycle.
    """
    work = WorkTables(g.spark, "topo")
    edges = arcs(g.edges).select("src", "dst")
    heads = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("need"))
    waiting, _ = work.save(g.nodes.select("id").join(heads, "id", "left").select("id", F.coalesce("need", F.lit(0).cast("long")).alias("need")))
    layers, level = [], 0
    while True:
        ready, path = work.save(waiting.where("need = 0").select("id", F.lit(level).alias("level")))
        if ready.isEmpty():
            break
        layers.append(path)
        done = edges.join(ready.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("done"))
        waiting, _ = work.save(waiting.where("need > 0").join(done, "id", "left").select("id", (F.col("need") - F.coalesce("done", F.lit(0).cast("long"))).alias("need")))
        level += 1
    if not waiting.isEmpty():
        raise CycleDetected(_some_cycle(g, waiting.select("id")))
    spark, schema = g.spark, ready.schema
    return spark.read.schema(schema).parquet(*layers) if layers else ready


def _some_cycle(g: Graph, stuck: DataFrame) -> list[int]:
    """A cycle among nodes that all have a predecessor there: walk back from the smallest until one repeats."""
    edges = arcs(g.edges, INCOMING).select("src", "dst").join(stuck.withColumnRenamed("id", "dst"), "dst", "left_semi")
    at = stuck.agg(F.min("id")).first()[0]
    path: list[int] = []
    while at not in path:
        path.append(at)
        at = edges.where(F.col("src") == at).agg(F.min("dst")).first()[0]
    return list(reversed([*path[path.index(at) :], at]))


def critical_path(g: Graph, weight: Column | None = None) -> dict:
    """Longest weighted path of an acyclic graph: length, path, and the distance of every node.

    ``weight`` is a column over the edges (default 1).  Among equal paths the
    smallest node array wins at every node.
    """
    work = WorkTables(g.spark, "critical")
    weighed = g.edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
    if not weighed.where(F.col("w").isNull() | F.isnan("w") | (F.abs("w") == float("inf"))).isEmpty():
        raise InvalidInput("edge weights must be finite")
    order, _ = work.save(topological_levels(g))
    edges, _ = work.save(weighed.join(order.select(F.col("id").alias("dst"), F.col("level").alias("dst_level")), "dst"))
    top = order.agg(F.max("level")).first()[0]
    dist, path = work.save(order.where("level = 0").select("id", F.lit(0.0).alias("distance"), F.array("id").alias("path")))
    paths = [path]
    for level in range(1, (top or 0) + 1):
        known = g.spark.read.schema(dist.schema).parquet(*paths)
        best = (
            edges.where(F.col("dst_level") == level)
            .join(known.withColumnRenamed("id", "src"), "src")
            .groupBy(F.col("dst").alias("id"))
            .agg(F.min(F.struct((-(F.col("distance") + F.col("w"))).alias("d"), F.col("path"))).alias("b"))
        )
        grown = best.select("id", F.greatest(-F.col("b.d"), F.lit(0.0)).alias("distance"), F.when(-F.col("b.d") > 0, F.concat("b.path", F.array("id"))).otherwise(F.array("id")).alias("path"))
        paths.append(work.save(grown)[1])
    distances = g.spark.read.schema(dist.schema).parquet(*paths)
    last = distances.orderBy(F.desc("distance"), "path").first()
    return {"length": last["distance"] if last else 0.0, "path": list(last["path"]) if last else [], "distances": distances}


def bottlenecks(result: dict) -> set[int]:
    """The nodes of the critical path: a delay of any one delays the end."""
    return set(result["path"])


def is_bottleneck(result: dict, node: int) -> bool:
    return node in result["path"]


def toposort(g: Graph) -> list[int]:
    """Node ids level by level, smallest first; raises on a cycle.  For graphs whose ids fit the driver."""
    return [r["id"] for r in topological_levels(g).orderBy("level", "id").toLocalIterator()]


def is_cyclic(g: Graph) -> bool:
    try:
        topological_levels(g)
    except CycleDetected:
        return True
    return False


def slack(g: Graph, result: dict, weight: Column | None = None) -> DataFrame:
    """(id, slack): how much later than its distance a node may lie without lengthening the critical path."""
    flipped = g.with_frames(edges=g.edges.select("id", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "edge_type", "data"))
    back = critical_path(flipped, weight)["distances"].select("id", F.col("distance").alias("rest"))
    return result["distances"].select("id", "distance").join(back, "id").select("id", (F.lit(result["length"]) - F.col("distance") - F.col("rest")).alias("slack"))


def impact_radius(g: Graph, source: int, max_distance: float | None = None, max_hops: int | None = None, weight: Column | None = None) -> DataFrame:
    """(id, distance, boundary) of nodes within the weighted distance and hops of the source.

    Bellman-Ford rounds: each round only nodes whose distance fell push on; at
    most ``max_hops`` rounds.
    """
    work = WorkTables(g.spark, "impact")
    edges = g.edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
    if weight is not None and not edges.where(F.col("w").isNull() | F.isnan("w") | (F.col("w") < 0) | (F.col("w") == float("inf"))).isEmpty():
        raise InvalidInput("edge weights must be finite and not negative")
    best, path = work.save(g.nodes.where(F.col("id") == source).select("id", F.lit(0.0).alias("distance")))
    changed, hops = best, 0
    while not changed.isEmpty() and (max_hops is None or hops < max_hops):
        hops += 1
        pushed = edges.join(changed.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("w")).alias("new"))
        if max_distance is not None:
            pushed = pushed.where(F.col("new") <= max_distance)
        changed, _ = work.save(pushed.join(best, "id", "left").where(F.col("distance").isNull() | (F.col("new") < F.col("distance"))).select("id", F.col("new").alias("distance")))
        best, new_path = work.save(best.union(changed).groupBy("id").agg(F.min("distance").alias("distance")))
        work.drop(path)
        path = new_path
    edge = F.lit(False) if max_distance is None else F.abs(F.col("distance") - max_distance) < 1e-9
    return best.select("id", "distance", edge.alias("boundary"))
