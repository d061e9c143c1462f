"""Components: weak ones by alternating stars, strong ones by trimming and colouring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from strandgraph.graph import Graph, arcs
from strandgraph.plans.fixpoint import WorkTables


#: Edges in one file of an intermediate table.
FILE_EDGES = 1_000_000


def star_components(links: DataFrame, work: WorkTables, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """(node, component) for links (a, b): large-star and small-star in turn until nothing changes.

    Component smallest nodes have no row of their own.  Every step is a grouped
    minimum with map-side partial results and a plain equi-join, so a hub costs
    a skewed join, which AQE splits, and never a collected group.  ``links``
    should be a stored table; it is read twice before the first cut.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    path, state, rounds = None, None, 0
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state, rounds = now, rounds + 1
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.least("x", "m").alias("v")).distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_min)
        edges, new = work.save(small.distinct(), files=1 + 2 * now[0] // FILE_EDGES)
        if path:
            work.drop(path)
        path = new
        if progress:
            progress(rounds, now[0])


def connected_components(g: Graph, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """(id, component): undirected; the component's name is its smallest id."""
    links = g.edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    work = WorkTables(g.spark, "wcc")
    found = star_components(work.save(links.where("a <> b").distinct())[0], work, progress)
    return g.nodes.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


weakly_connected_components = connected_components


def _trim(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with both an in- and an out-edge, edges among them)."""
    keep = nodes.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi").join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
    a, b = keep.withColumnRenamed("id", "src"), keep.withColumnRenamed("id", "dst")
    return keep, edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def _spread(labels: DataFrame, edges: DataFrame, work: WorkTables) -> DataFrame:
    """(id, colour): the smallest id that reaches a node, by propagating minima to a fixpoint."""
    state, path = work.save(labels)
    while True:
        pushed = edges.join(state.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "colour")
        new, new_path = work.save(state.select("id", "colour").union(pushed).groupBy("id").agg(F.min("colour").alias("colour")))
        changed = not new.join(state.withColumnRenamed("colour", "old"), "id").where("colour < old").isEmpty()
        work.drop(path)
        state, path = new, new_path
        if not changed:
            return state


def strongly_connected_components(g: Graph) -> DataFrame:
    """(id, component): the component's name is its smallest id.

    Nodes without an in- or an out-edge are components of their own and are
    trimmed away.  The rest get as colour the smallest id that reaches them;
    a colour's own component is what reaches its root within the colour.  What
    is left over is searched again.
    """
    work = WorkTables(g.spark, "scc")
    edges = arcs(g.edges).select("src", "dst").where("src <> dst").distinct()
    nodes, parts = g.nodes.select("id"), []
    while True:
        while True:
            before = nodes.count()
            nodes, edges = _trim(nodes, edges)
            nodes, _ = work.save(nodes)
            edges, _ = work.save(edges)
            if (left := nodes.count()) in (0, before):
                break
        if not left:
            break
        colours = _spread(nodes.select("id", F.col("id").alias("colour")), edges, work)
        c1, c2 = colours.toDF("src", "c1"), colours.toDF("dst", "c2")
        inside, _ = work.save(edges.join(c1, "src").join(c2, "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("c")))
        # Backwards from each root, within its colour.
        found, _ = work.save(colours.where("id = colour"))
        frontier = found
        while not frontier.isEmpty():
            grown = inside.join(frontier.toDF("dst", "colour"), "dst").where("c = colour").select(F.col("src").alias("id"), "colour").distinct()
            frontier, _ = work.save(grown.join(found.select("id"), "id", "left_anti"))
            found, _ = work.save(found.union(frontier))
        parts.append(found.withColumnRenamed("colour", "component"))
        nodes, _ = work.save(nodes.join(found.select("id"), "id", "left_anti"))
        a, b = nodes.withColumnRenamed("id", "src"), nodes.withColumnRenamed("id", "dst")
        edges, _ = work.save(edges.join(a, "src", "left_semi").join(b, "dst", "left_semi"))
    every = g.nodes.select("id")
    if not parts:
        return every.select("id", F.col("id").alias("component"))
    known = parts[0]
    for p in parts[1:]:
        known = known.union(p)
    return every.join(known, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def non_trivial(components: DataFrame) -> DataFrame:
    """(component, size) of components with more than one node."""
    return components.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")


def in_cycle(components: DataFrame) -> DataFrame:
    """Ids in components of more than one node."""
    return components.join(non_trivial(components), "component", "left_semi").select("id")


def collapse_components(g: Graph, components: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members (supernode, id), edges (from_supernode, to_supernode)): the condensed graph, its edges distinct."""
    components = strongly_connected_components(g) if components is None else components
    a = components.toDF("from_id", "from_supernode")
    b = components.toDF("to_id", "to_supernode")
    edges = g.edges.select("from_id", "to_id").join(a, "from_id").join(b, "to_id").where("from_supernode <> to_supernode").select("from_supernode", "to_supernode").distinct()
    return components.select(F.col("component").alias("supernode"), "id"), edges
