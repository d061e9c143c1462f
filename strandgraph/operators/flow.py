"""Control-flow analysis: dominance, frontiers, control dependence, loops, paths.

A table of control-flow graphs has columns (cfg, src, dst); each graph is one
shard, analysed by an exact kernel.  ``from_graph`` makes one shard of a whole
property graph, cut down to what the entry reaches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandgraph.errors import InvalidInput
from strandgraph.graph import Graph, arcs
from strandgraph.operators import local


def from_graph(g: Graph, cfg: int = 0) -> DataFrame:
    """(cfg, src, dst) of the whole graph; a node without edges is a row without dst."""
    nodes = g.nodes.select(F.lit(cfg).cast("long").alias("cfg"), F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"))
    return nodes.unionByName(arcs(g.edges).select(F.lit(cfg).cast("long").alias("cfg"), "src", "dst"))


def _shard(pdf: pd.DataFrame) -> local.Adjacency:
    edges = pdf.dropna(subset=["dst"])
    return local.adjacency(pdf["src"].tolist(), zip(edges["src"].tolist(), edges["dst"].astype("int64").tolist(), strict=True))


def _entry(graph: local.Adjacency, entry: int | None) -> int:
    """The given entry, else the smallest node without predecessors, else the smallest node."""
    if entry is not None:
        return entry
    targets = {b for bs in graph.values() for b in bs}
    return min((n for n in graph if n not in targets), default=min(graph))


def _ends(graph: local.Adjacency, end: int | Sequence[int] | None) -> list[int]:
    if end is None:
        return local.exits(graph)
    return [end] if isinstance(end, int) else list(end)


def _run(cfgs: DataFrame, schema: str, columns: Sequence[str], rows: Callable[[local.Adjacency], list[tuple]]) -> DataFrame:
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(rows(_shard(pdf)), columns=list(columns), dtype=object)
        out.insert(0, "cfg", int(pdf["cfg"].iloc[0]))
        return out

    return cfgs.groupBy("cfg").applyInPandas(kernel, "cfg long, " + schema)


def dominators(cfgs: DataFrame, entry: int | None = None) -> DataFrame:
    """(cfg, id, dominator); nodes that the entry does not reach keep all nodes."""

    def rows(graph):
        return [(n, d) for n, ds in local.dominator_sets(graph, _entry(graph, entry)).items() for d in sorted(ds)]

    return _run(cfgs, "id long, dominator long", ["id", "dominator"], rows)


def immediate_dominators(cfgs: DataFrame, entry: int | None = None) -> DataFrame:
    """(cfg, id, idom) of reachable nodes; null for the entry."""
    return _run(cfgs, "id long, idom long", ["id", "idom"], lambda graph: list(local.immediate_dominators(graph, _entry(graph, entry)).items()))


def post_dominators(cfgs: DataFrame, end: int | Sequence[int] | None = None) -> DataFrame:
    """(cfg, id, post_dominator); without ``end`` towards all exits, of which there must be one."""

    def rows(graph):
        ends = _ends(graph, end)
        if not ends:
            raise InvalidInput("the graph has no exit")
        return [(n, d) for n, ds in local.post_dominance(graph, ends)[1].items() for d in sorted(ds)]

    return _run(cfgs, "id long, post_dominator long", ["id", "post_dominator"], rows)


def immediate_post_dominators(cfgs: DataFrame, end: int | Sequence[int] | None = None) -> DataFrame:
    def rows(graph):
        ends = _ends(graph, end)
        if not ends:
            raise InvalidInput("the graph has no exit")
        return list(local.post_dominance(graph, ends)[0].items())

    return _run(cfgs, "id long, ipdom long", ["id", "ipdom"], rows)


def dominance_frontiers(cfgs: DataFrame, entry: int | None = None) -> DataFrame:
    """(cfg, id, frontier)."""
    return _run(cfgs, "id long, frontier long", ["id", "frontier"], lambda graph: [(n, f) for n, fs in local.frontiers(graph, _entry(graph, entry)).items() for f in sorted(fs)])


def iterated_dominance_frontier(cfgs: DataFrame, definitions: Sequence[int], entry: int | None = None) -> DataFrame:
    """(cfg, id, iterations): the definitions and every node where their values meet."""

    def rows(graph):
        found, rounds = local.iterated_frontier(graph, _entry(graph, entry), [d for d in definitions if d in graph])
        return [(n, rounds) for n in sorted(found)]

    return _run(cfgs, "id long, iterations long", ["id", "iterations"], rows)


def control_dependence(cfgs: DataFrame, end: int | Sequence[int] | None = None) -> DataFrame:
    """(cfg, controller, dependent)."""

    def rows(graph):
        ends = _ends(graph, end)
        if not ends:
            raise InvalidInput("the graph has no exit")
        return local.control_dependence(graph, ends)

    return _run(cfgs, "controller long, dependent long", ["controller", "dependent"], rows)


def control_dependence_from_exit(cfgs: DataFrame, end: int) -> DataFrame:
    """The dependence of graphs whose one exit is stated."""
    return control_dependence(cfgs, end)


def controlled_by(dependences: DataFrame, controller: int) -> DataFrame:
    """(cfg, id) that a node controls."""
    return dependences.where(F.col("controller") == controller).select("cfg", F.col("dependent").alias("id"))


def dependencies_of(dependences: DataFrame, dependent: int) -> DataFrame:
    """(cfg, id) that a node depends on."""
    return dependences.where(F.col("dependent") == dependent).select("cfg", F.col("controller").alias("id"))


def controls(dependences: DataFrame, controller: int, dependent: int) -> bool:
    return not controlled_by(dependences, controller).where(F.col("id") == dependent).isEmpty()


def depends_on(dependences: DataFrame, dependent: int, controller: int) -> bool:
    return controls(dependences, controller, dependent)


def natural_loops(cfgs: DataFrame, entry: int | None = None) -> DataFrame:
    """(cfg, header, id, back_edges, depth): a row for each body node; depth counts the loops around the header."""

    def rows(graph):
        loops = local.natural_loops(graph, _entry(graph, entry))
        depth = {h: sum(h in body for body, _ in loops.values()) for h in loops}
        return [(h, n, len(tails), depth[h]) for h, (body, tails) in sorted(loops.items()) for n in sorted(body)]

    return _run(cfgs, "header long, id long, back_edges long, depth long", ["header", "id", "back_edges", "depth"], rows)


DOMINANCE, CONTROL, LOOPS = "dominance", "control", "loops"


def enumerate_paths(
    cfgs: DataFrame, entry: int | None = None, ends: Sequence[int] | None = None, errors: Sequence[int] = (), max_depth: int = 100, max_paths: int = 10_000, revisits: int = 2, prune: str | None = None
) -> DataFrame:
    """(cfg, position, path, class): depth-first paths to an exit, an error node, or the depth cap.

    Without ``ends`` dead ends are not recorded.  ``prune`` drops extensions by
    one rule: a step into a node that dominates the one before it unless it
    lies on the path (dominance), a step along an edge no branch controls and
    no post-dominator explains (control), or a second trip round a loop (loops).
    """

    def rows(graph):
        start = _entry(graph, entry)
        allow = None
        if prune == DOMINANCE:
            sets = local.dominator_sets(graph, start)
            allow = lambda path, n: sets[n] - {n} <= set(path)
        elif prune == CONTROL:
            finish = _ends(graph, None if ends is None else list(ends))
            controlled = set(local.control_dependence(graph, finish)) if finish else set()
            ipdom = local.post_dominance(graph, finish)[0] if finish else {}
            allow = lambda path, n: (path[-1], n) in controlled or ipdom.get(path[-1]) == n or ipdom.get(n) == path[-1]
        elif prune == LOOPS:
            headers = local.natural_loops(graph, start)
            allow = lambda path, n: not (n in headers and n in path)
        found = local.enumerate_paths(graph, start, None if ends is None else set(ends), set(errors), max_depth, max_paths, revisits, allow)
        return [(i, p, c) for i, (p, c) in enumerate(found)]

    return _run(cfgs, "position long, path array<long>, class string", ["position", "path", "class"], rows)
