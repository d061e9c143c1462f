"""Communities and cycles: exact sequential kernels, one task for each component.

Inside a component the order of moves matters, between components it does not,
so the weakly (or strongly) connected component is the unit of parallelism.  A
giant component is one task; ``label_propagation_synchronous`` is the variant
for graphs where that is too slow.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandgraph.graph import Graph, arcs
from strandgraph.operators import local
from strandgraph.operators.component import connected_components, strongly_connected_components
from strandgraph.plans.fixpoint import iterate


def by_component(g: Graph, components: DataFrame) -> DataFrame:
    """(component, src, dst): a component's edges, and a row (id, null) for each of its nodes."""
    own = components.select("component", F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"))
    a, b = components.toDF("src", "component"), components.toDF("dst", "dst_component")
    inside = arcs(g.edges).select("src", "dst").join(a, "src").join(b, "dst").where("component = dst_component")
    return own.unionByName(inside.select("component", "src", "dst"))


def graph_of(pdf: pd.DataFrame) -> local.Adjacency:
    edges = pdf.dropna(subset=["dst"])
    return local.adjacency(pdf["src"].tolist(), zip(edges["src"].tolist(), edges["dst"].astype("int64").tolist(), strict=True))


def _labels(found: dict[int, int]) -> pd.DataFrame:
    return pd.DataFrame({"id": list(found), "community": list(found.values())}).astype("int64")


def label_propagation(g: Graph, rounds: int = 20) -> DataFrame:
    """(id, community): asynchronous in id order; the community's name is its final label."""
    parts = by_component(g, connected_components(g))
    return parts.groupBy("component").applyInPandas(lambda pdf: _labels(local.label_propagation(graph_of(pdf), rounds)), "id long, community long")


def louvain(g: Graph, rounds: int = 20) -> DataFrame:
    """(id, community): one level of local moving; the community's name is its smallest id."""
    total = float(g.edges.count())
    parts = by_component(g, connected_components(g))
    return parts.groupBy("component").applyInPandas(lambda pdf: _labels(local.louvain(graph_of(pdf), rounds, total)), "id long, community long")


def label_propagation_synchronous(g: Graph, rounds: int = 10) -> DataFrame:
    """(id, community): all nodes move at once, from the labels of the round before; joins only."""
    near = arcs(g.edges, "both").select("src", "dst")

    def step(state: DataFrame, _: int) -> DataFrame:
        votes = near.join(state.toDF("dst", "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("id", F.col("b.label").alias("new"))
        return state.join(best, "id", "left").select("id", F.coalesce("new", "community").alias("community"))

    return iterate(g.nodes.select("id", F.col("id").alias("community")), step, rounds)


def groups(labels: DataFrame) -> DataFrame:
    """(community, members): sorted members, for graphs whose communities are small."""
    return labels.groupBy("community").agg(F.sort_array(F.collect_list("id")).alias("members")).orderBy("community")


def cycles(g: Graph, limit: int = 100, longest: int = 50) -> DataFrame:
    """(component, position, cycle): simple cycles, each once and closed, at most ``limit`` a strong component."""
    parts = by_component(g, strongly_connected_components(g))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = local.simple_cycles(graph_of(pdf), limit, longest)
        return pd.DataFrame({"component": pdf["component"].iloc[0], "position": pd.Series(range(len(found)), dtype="int64"), "cycle": pd.Series(found, dtype=object)})

    return parts.groupBy("component").applyInPandas(run, "component long, position long, cycle array<long>")


def cycle_basis(g: Graph, max_cycles: int | None = None, max_length: int | None = None, max_per_component: int | None = None) -> DataFrame:
    """(component, cycle, skipped): fundamental cycles of each strong component; bounds count what they skip."""
    parts = by_component(g, strongly_connected_components(g))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found, skipped = local.cycle_basis(graph_of(pdf), max_cycles, max_length, max_per_component)
        return pd.DataFrame({"component": pdf["component"].iloc[0], "cycle": pd.Series(found, dtype=object), "skipped": skipped})

    basis = parts.groupBy("component").applyInPandas(run, "component long, cycle array<long>, skipped long")
    return basis.orderBy("component", "cycle").limit(max_cycles) if max_cycles is not None else basis


def cyclic_nodes(basis: DataFrame) -> DataFrame:
    return basis.select(F.explode("cycle").alias("id")).distinct().orderBy("id")


def cycles_containing(basis: DataFrame, node: int) -> DataFrame:
    return basis.where(F.array_contains("cycle", node))


def is_cyclic(basis: DataFrame, node: int) -> bool:
    """Whether the node lies on a cycle of the basis."""
    return not cycles_containing(basis, node).isEmpty()


def explain_cycle(basis: DataFrame, node: int) -> str:
    """The cycles of the basis through a node, in words."""
    found = [r["cycle"] for r in cycles_containing(basis, node).orderBy("cycle").collect()]
    if not found:
        return f"Node {node} is not part of any cycle"
    return f"Node {node} is in {len(found)} cycle(s): " + "; ".join(" -> ".join(map(str, c)) for c in found)


def cyclic_component_count(basis: DataFrame) -> int:
    return basis.select("component").distinct().count()


def has_cycles(basis: DataFrame) -> bool:
    return not basis.isEmpty()
