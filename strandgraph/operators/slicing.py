"""Program slices and taint: reachability over the graph and its control dependences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandgraph.functions.json import any_value
from strandgraph.graph import INCOMING, OUTGOING, Graph
from strandgraph.operators.flow import control_dependence, from_graph
from strandgraph.operators.traverse import bfs_levels, multi_source

# What marks a source and a sink.
SOURCE_KINDS = ("source", "untrusted", "user_input")
SINK_KINDS = ("sink", "sql_query", "html_output", "command", "file_operation")
SINK_OPERATIONS = ("execute", "query", "render", "write")


def _slice(g: Graph, node: int, direction: str, dependences: DataFrame | None) -> DataFrame:
    if dependences is None:
        dependences = control_dependence(from_graph(g)).select("controller", "dependent")
    none = F.lit(None).cast("string")
    cdg = g.with_frames(edges=dependences.select(F.lit(0).cast("long").alias("id"), F.col("controller").alias("from_id"), F.col("dependent").alias("to_id"), F.lit("CONTROLS").alias("edge_type"), none.alias("data")))
    control = bfs_levels(cdg, [node], direction=direction).select("id", F.lit(True).alias("control"))
    data = bfs_levels(g, [node], direction=direction).select("id", F.lit(True).alias("data"))
    no = F.lit(False)
    return control.join(data, "id", "full_outer").select("id", F.coalesce("control", no).alias("control"), F.coalesce("data", no).alias("data")).orderBy("id")


def backward_slice(g: Graph, node: int, dependences: DataFrame | None = None) -> DataFrame:
    """(id, control, data): what the node depends on, by control dependence or by reachability; itself included."""
    return _slice(g, node, INCOMING, dependences)


def forward_slice(g: Graph, node: int, dependences: DataFrame | None = None) -> DataFrame:
    return _slice(g, node, OUTGOING, dependences)


def default_source() -> Column:
    d = F.col("data")
    return F.coalesce(any_value(d, "kind").isin(*SOURCE_KINDS), F.lit(False)) | F.coalesce(any_value(d, "taint") == "source", F.lit(False))


def default_sink() -> Column:
    d = F.col("data")
    return F.coalesce(any_value(d, "kind").isin(*SINK_KINDS), F.lit(False)) | F.coalesce(any_value(d, "operation").isin(*SINK_OPERATIONS), F.lit(False))


def discover(g: Graph, source: Column | None = None, sink: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(sources, sinks) as id frames, by boolean columns over the node columns."""
    return (
        g.nodes.where(default_source() if source is None else source).select("id"),
        g.nodes.where(default_sink() if sink is None else sink).select("id"),
    )


def taint_forward(g: Graph, sources: DataFrame, sinks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tainted ids, (source, sink) pairs): what the sources reach, and which of it are sinks."""
    reach = multi_source(g, sources)
    pairs = reach.join(sinks.select("id").distinct(), "id", "left_semi").select("source", F.col("id").alias("sink"))
    return reach.select("id").distinct(), pairs


def taint_backward(g: Graph, sink: int, sources: DataFrame) -> DataFrame:
    """Sources among the ancestors of a sink."""
    return bfs_levels(g, [sink], direction=INCOMING).select("id").join(sources.select("id").distinct(), "id", "left_semi").orderBy("id")


def sink_reachability(g: Graph, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """(sink, source) for every sink that some source reaches."""
    return taint_forward(g, sources, sinks)[1].select("sink", "source").orderBy("sink", "source")
