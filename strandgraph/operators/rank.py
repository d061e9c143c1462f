"""Centrality: PageRank, betweenness, degree ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from strandgraph.errors import InvalidInput
from strandgraph.graph import Graph, arcs
from strandgraph.operators import local
from strandgraph.plans.fixpoint import WorkTables, iterate


def pagerank(g: Graph, damping: float = 0.85, rounds: int = 20, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """(id, score), best first: exactly ``rounds`` rounds from 1/n.

    Parallel edges are folded into one weighted edge before the loop, the
    weights already divided by the out-degree; dangling mass is one scalar a
    round, spread uniformly.
    """
    work = WorkTables(g.spark, "pagerank")
    n = g.nodes.count()
    if not n:
        return g.spark.sql("SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS score WHERE FALSE")
    pairs = arcs(g.edges).groupBy("src", "dst").agg(F.count("*").alias("k"))
    out = pairs.groupBy("src").agg(F.sum("k").alias("degree"))
    share, _ = work.save(pairs.join(out, "src").select("src", "dst", (F.col("k") / F.col("degree")).alias("w")))
    nodes, _ = work.save(g.nodes.select("id").join(out.select(F.col("src").alias("id"), F.lit(True).alias("has_out")), "id", "left").select("id", F.coalesce("has_out", F.lit(False)).alias("has_out")))
    state = nodes.select("id", "has_out", F.lit(1.0 / n).alias("score"))

    def step(state: DataFrame, _: int) -> DataFrame:
        lost = state.where(~F.col("has_out")).agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("m"))
        given = share.join(state.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("score")).alias("s"))
        base = (1 - damping) / n
        return nodes.join(given, "id", "left").select("id", "has_out", (F.lit(base) + damping * (F.coalesce("s", F.lit(0.0)) + lost.scalar() / n)).alias("score"))

    return iterate(state, step, rounds, progress, cut_every=2).select("id", "score").orderBy(F.desc("score"), "id")


def betweenness(g: Graph, progress: Callable[[int, int], None] | None = None, max_edges: int = 5_000_000) -> DataFrame:
    """(id, score), best first: Brandes over all sources, directed, unnormalised.

    Sources are dealt over the partitions; each worker gets the edge list once,
    as a broadcast whose size is checked first.
    """
    edges = arcs(g.edges).select("src", "dst")
    if (size := edges.count()) > max_edges:
        raise InvalidInput(f"{size} edges; betweenness sends all of them to every worker, at most {max_edges}")
    table = edges.toPandas()
    sent = g.spark.sparkContext.broadcast((table["src"].to_numpy(), table["dst"].to_numpy()))

    def run(batches):
        import pandas as pd

        src, dst = sent.value
        graph = local.adjacency([], zip(src.tolist(), dst.tolist(), strict=True))
        total: dict[int, float] = {}
        for pdf in batches:
            for s in pdf["id"].tolist():
                if s in graph:
                    for n, v in local.dependency(graph, s).items():
                        total[n] = total.get(n, 0.0) + v
        yield pd.DataFrame({"id": list(total), "score": list(total.values())}).astype({"id": "int64", "score": "float64"})

    parts = g.nodes.select("id").repartition(g.spark.sparkContext.defaultParallelism, "id").mapInPandas(run, "id long, score double")
    summed = parts.groupBy("id").agg(F.sum("score").alias("score"))
    if progress:
        progress(1, 1)
    return g.nodes.select("id").join(summed, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "id")


def nodes_by_degree(g: Graph, descending: bool = True) -> DataFrame:
    """(id, degree), in + out with duplicates; nodes without edges included, ties by id."""
    d = g.degrees().select("id", (F.col("out_degree") + F.col("in_degree")).alias("degree"))
    return d.orderBy(F.desc("degree") if descending else F.asc("degree"), "id")
