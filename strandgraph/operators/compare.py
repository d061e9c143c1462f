"""Subgraph isomorphism, similarity, difference and rewriting."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from strandgraph.errors import InvalidInput
from strandgraph.graph import Graph, arcs, numbered
from strandgraph.operators import local
from strandgraph.plans.fixpoint import WorkTables


@dataclass(frozen=True)
class Shape:
    """A small directed pattern: nodes 0..n-1 and edges between them."""

    n: int
    edges: tuple[tuple[int, int], ...]

    def order(self) -> list[int]:
        """Nodes so that each next one touches an earlier one, where the shape is connected."""
        out = [0]
        while len(out) < self.n:
            near = [x for x in range(self.n) if x not in out and any((x in e) and (set(e) & set(out)) for e in self.edges)]
            out.append(near[0] if near else next(x for x in range(self.n) if x not in out))
        return out


TRIANGLE = Shape(3, ((0, 1), (1, 2), (2, 0)))
CHAIN3 = Shape(3, ((0, 1), (1, 2)))
DIAMOND = Shape(4, ((0, 1), (0, 2), (1, 3), (2, 3)))


def find_subgraphs(g: Graph, shape: Shape, max_matches: int | None = None, max_nodes: int = 10) -> DataFrame:
    """n0..n(k-1): node-induced embeddings, all mappings.

    Edges of the shape are self-joins of the distinct edge list, in an order in
    which every join has a bound end; pairs without an edge are anti joins.
    """
    if not 0 < shape.n <= max_nodes:
        raise InvalidInput(f"a pattern has 1 to {max_nodes} nodes")
    edges = arcs(g.edges).select("src", "dst").distinct()
    wanted = set(shape.edges)
    order = shape.order()
    found = g.nodes.select(F.col("id").alias("n0"))
    bound = [0]
    for v in order[1:]:
        links = [(a, b) for a, b in shape.edges if v in (a, b) and (a in bound or b in bound) and a != b]
        if not links:
            found = found.crossJoin(g.nodes.select(F.col("id").alias(f"n{v}")))
        for i, (a, b) in enumerate(links):
            pair = edges.toDF(f"n{a}", f"n{b}")
            keys = [f"n{x}" for x in (a, b) if x in bound or (x == v and i > 0)]
            found = found.join(pair, keys) if i == 0 else found.join(pair, keys, "left_semi")
        found = found.where(" AND ".join(f"n{v} <> n{x}" for x in bound))
        bound.append(v)
    for a in range(shape.n):
        for b in range(shape.n):
            if a == b:
                loops = edges.where("src = dst").select(F.col("src").alias(f"n{a}"))
                found = found.join(loops, f"n{a}", "left_semi" if (a, a) in wanted else "left_anti")
            elif (a, b) not in wanted:
                found = found.join(edges.toDF(f"n{a}", f"n{b}"), [f"n{a}", f"n{b}"], "left_anti")
    found = found.select(*[f"n{i}" for i in range(shape.n)])
    return found.orderBy(*found.columns).limit(max_matches) if max_matches is not None else found


def _small(g: Graph, most: int = 2000) -> local.Adjacency:
    nodes = [r["id"] for r in g.nodes.select("id").limit(most + 1).collect()]
    if len(nodes) > most:
        raise InvalidInput(f"similarity compares graphs of at most {most} nodes")
    pairs = arcs(g.edges).select("src", "dst").distinct().collect()
    return local.adjacency(nodes, [(r["src"], r["dst"]) for r in pairs])


def structural_similarity(a: Graph, b: Graph) -> dict:
    """similarity, edit distance, common nodes and class: 1 if isomorphic, else by whether the smaller embeds in the larger."""
    x, y = _small(a), _small(b)
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    same = local.isomorphic(x, y)
    common = len(x) if same else (len(small) if small and local.embeddings(small, large, 1) else 0)
    most = max(len(x), len(y))
    score = 1.0 if same or not most else common / most
    kind = "identical" if same else "very similar" if score >= 0.8 else "moderately similar" if score >= 0.5 else "dissimilar" if score > 0 else "nothing in common"
    return {"similarity": score, "edit_distance": 1 - score, "common_nodes": common, "isomorphic": same, "class": kind}


def graph_diff(a: Graph, b: Graph) -> DataFrame:
    """(change, element, id, from_id, to_id): nodes by id, edges by (from, to)."""
    none = F.lit(None).cast("long")
    n1, n2 = a.nodes.select("id"), b.nodes.select("id")
    e1, e2 = (g.edges.select("from_id", "to_id").distinct() for g in (a, b))

    def nodes(frame: DataFrame, change: str) -> DataFrame:
        return frame.select(F.lit(change).alias("change"), F.lit("node").alias("element"), "id", none.alias("from_id"), none.alias("to_id"))

    def edges(frame: DataFrame, change: str) -> DataFrame:
        return frame.select(F.lit(change).alias("change"), F.lit("edge").alias("element"), none.alias("id"), "from_id", "to_id")

    pair = ["from_id", "to_id"]
    return (
        nodes(n2.join(n1, "id", "left_anti"), "added")
        .unionByName(nodes(n1.join(n2, "id", "left_anti"), "removed"))
        .unionByName(edges(e2.join(e1, pair, "left_anti"), "added"))
        .unionByName(edges(e1.join(e2, pair, "left_anti"), "removed"))
    )


def validate_refactor(before: Graph, after: Graph) -> dict:
    """Whether a change is safe: counts of the difference, similarity, warnings and errors."""
    counts = {(r["change"], r["element"]): r["n"] for r in graph_diff(before, after).groupBy("change", "element").agg(F.count("*").alias("n")).collect()}
    likeness = structural_similarity(before, after)
    errors, warnings = [], []
    if counts.get(("removed", "node")):
        errors.append(f"{counts['removed', 'node']} nodes removed")
    if likeness["similarity"] < 0.5:
        errors.append("similarity below 0.5")
    elif likeness["similarity"] < 0.8:
        warnings.append("similarity below 0.8")
    if counts.get(("removed", "edge")):
        warnings.append(f"{counts['removed', 'edge']} edges removed")
    return {"safe": not errors, "errors": errors, "warnings": warnings, "isomorphic": likeness["isomorphic"], "similarity": likeness["similarity"], **{f"{e}s_{c}": counts.get((c, e), 0) for c in ("added", "removed") for e in ("node", "edge")}}


@dataclass(frozen=True)
class Rule:
    """Replace a shape: ``interface`` nodes stay; the others go and ``added`` nodes (kind, name) come.

    ``new_edges`` name interface nodes by shape number and added ones by
    shape.n + position.
    """

    shape: Shape
    interface: tuple[int, ...]
    added: tuple[tuple[str, str], ...] = ()
    new_edges: tuple[tuple[int, int, str], ...] = ()
    drop_shape_edges: bool = True
    labels: tuple[str, ...] = field(default=())


def rewrite(g: Graph, rule: Rule, max_matches: int | None = None) -> tuple[Graph, dict]:
    """(new graph, counts): applies the rule to matches that share no node, in order of their smallest ids.

    Matches that would leave an edge without its end are not applied.  Kept
    nodes and edges keep their ids and types.
    """
    if any(i >= rule.shape.n for i in rule.interface):
        raise InvalidInput("interface nodes belong to the shape")
    columns = [f"n{i}" for i in range(rule.shape.n)]
    found = find_subgraphs(g, rule.shape)
    members = F.array_sort(F.array(*columns))
    # Several mappings of one node set are one place: the smallest mapping counts.
    first = Window.partitionBy("nodes").orderBy(*columns)
    places = found.withColumn("nodes", members).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    gone = [c for i, c in enumerate(columns) if i not in rule.interface]
    if gone:
        stray = arcs(g.edges, "both").select(F.col("src").alias("x"), F.col("dst").alias("y"))
        outside = places.select("nodes", F.explode(F.array(*gone)).alias("x")).join(stray, "x").where(~F.array_contains("nodes", F.col("y"))).select("nodes").distinct()
        places = places.join(outside, "nodes", "left_anti")
    chosen = first_disjoint(g, places)
    if max_matches is not None:
        chosen = chosen.orderBy("nodes").limit(max_matches)
    chosen, _ = WorkTables(g.spark, "matches").save(numbered(chosen.select(*columns), 0).withColumnRenamed("id", "match"))
    count, before = chosen.count(), g
    if count:
        if rule.drop_shape_edges and rule.shape.edges:
            pairs = _stack([chosen.select(F.col(f"n{a}").alias("from_id"), F.col(f"n{b}").alias("to_id")) for a, b in rule.shape.edges]).distinct()
            g = g.with_frames(edges=g.edges.join(pairs, ["from_id", "to_id"], "left_anti").select(*g.edges.columns))
        if gone:
            g = g.delete_nodes(_stack([chosen.select(F.col(c).alias("id")) for c in gone]))
        base, k = g.next_id(before.nodes), len(rule.added)
        new_id = lambda i: (F.lit(base) + F.col("match") * k + i).cast("long")
        none = F.lit(None).cast("string")
        if k:
            made = [chosen.select(new_id(i).alias("id"), F.lit(kind).alias("kind"), F.concat(F.lit(f"{name}_rewrite_"), F.col("match")).alias("name"), none.alias("file_path"), F.lit("{}").alias("data")) for i, (kind, name) in enumerate(rule.added)]
            g = g.with_frames(nodes=g.nodes.unionByName(_stack(made)))
        if rule.new_edges:
            end = lambda x: F.col(f"n{x}") if x < rule.shape.n else new_id(x - rule.shape.n)
            links = [chosen.select(end(a).alias("from_id"), end(b).alias("to_id"), F.lit(t).alias("edge_type"), F.lit("{}").alias("data")) for a, b, t in rule.new_edges]
            g = g.append_edges(_stack(links))
    return g, {"matches": count, "nodes_added": count * len(rule.added), "nodes_deleted": count * len(gone), "edges_added": count * len(rule.new_edges)}


def _stack(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def first_disjoint(g: Graph, places: DataFrame) -> DataFrame:
    """The places that taking them in order of their node arrays, none that shares a node with an earlier one, would take.

    Each round takes every place that is the first one at all of its nodes and
    drops the places that touch it, which gives the sequential choice.
    """
    work = WorkTables(g.spark, "disjoint")
    left, _ = work.save(places)
    taken = []
    while not left.isEmpty():
        at = left.select("nodes", F.explode("nodes").alias("x"))
        first = at.groupBy("x").agg(F.min("nodes").alias("first"))
        beaten = at.join(first, "x").where("nodes <> first").select("nodes").distinct()
        won, path = work.save(left.join(beaten, "nodes", "left_anti"))
        taken.append(path)
        used = won.select(F.explode("nodes").alias("x")).distinct()
        touched = at.join(used, "x", "left_semi").select("nodes").distinct()
        left, _ = work.save(left.join(touched, "nodes", "left_anti"))
    return g.spark.read.schema(left.schema).parquet(*taken) if taken else left


def shape_of(nodes: Sequence[int], edges: Sequence[tuple[int, int]]) -> Shape:
    index = {n: i for i, n in enumerate(nodes)}
    return Shape(len(nodes), tuple((index[a], index[b]) for a, b in edges))
