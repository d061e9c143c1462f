"""Pattern operators below the query language: triples, leg patterns, chains, a path DSL, scoring."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from strandgraph.errors import InvalidInput
from strandgraph.graph import INCOMING, OUTGOING, Graph, arcs
from strandgraph.operators.traverse import multi_source


@dataclass(frozen=True)
class TriplePattern:
    edge_type: str
    start_label: str | None = None
    end_label: str | None = None
    start_props: tuple[tuple[str, str], ...] = ()
    end_props: tuple[tuple[str, str], ...] = ()
    direction: str = OUTGOING

    def validate(self) -> None:
        if not self.edge_type.strip():
            raise InvalidInput("edge type must not be blank")


@dataclass(frozen=True)
class LegPattern:
    direction: str = OUTGOING
    edge_type: str | None = None
    kind: str | None = None
    name_prefix: str | None = None


def _restricted(g: Graph, frame: DataFrame, column: str, label: str | None, props: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows whose node has the label and every property: semi joins, so nothing multiplies."""
    if label is not None:
        tagged = g.labels.where(F.col("label") == label).select(F.col("entity_id").alias(column))
        frame = frame.join(tagged, column, "left_semi")
    for key, value in props:
        owned = g.properties.where((F.col("key") == key) & (F.col("value") == value)).select(F.col("entity_id").alias(column))
        frame = frame.join(owned, column, "left_semi")
    return frame


def match_triples(g: Graph, p: TriplePattern) -> DataFrame:
    """(start_id, edge_id, end_id) in that order."""
    p.validate()
    found = arcs(g.edges, p.direction, [p.edge_type]).select(F.col("src").alias("start_id"), "edge_id", F.col("dst").alias("end_id"))
    found = _restricted(g, found, "start_id", p.start_label, p.start_props)
    found = _restricted(g, found, "end_id", p.end_label, p.end_props)
    return found.select("start_id", "edge_id", "end_id").orderBy("start_id", "edge_id", "end_id")


match_triples_fast = match_triples


def edge_exists(g: Graph, a: int, b: int, edge_type: str) -> bool:
    return not _edges(g, a, b, edge_type).isEmpty()


def edge_id(g: Graph, a: int, b: int, edge_type: str) -> int | None:
    row = _edges(g, a, b, edge_type).agg(F.min("id")).first()
    return row[0]


def _edges(g: Graph, a: int, b: int, edge_type: str) -> DataFrame:
    return g.edges.where((F.col("from_id") == a) & (F.col("to_id") == b) & (F.col("edge_type") == edge_type))


def execute_pattern(g: Graph, starts: int | DataFrame, legs: Sequence[LegPattern]) -> DataFrame:
    """(path): distinct node sequences that follow the legs, in order."""
    if isinstance(starts, int):
        starts = g.nodes.where(F.col("id") == starts)
    paths = starts.select(F.col("id").alias("at"), F.array("id").alias("path"))
    for leg in legs:
        step = arcs(g.edges, leg.direction, None if leg.edge_type is None else [leg.edge_type]).select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct()
        if leg.kind is not None or leg.name_prefix is not None:
            step = step.join(g.nodes_with_constraint(leg.kind, leg.name_prefix).withColumnRenamed("id", "next"), "next", "left_semi")
        paths = paths.join(step, "at").select(F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"))
    return paths.select("path").distinct().orderBy("path")


pattern_search = execute_pattern


def chain_query(g: Graph, start: int, legs: Sequence[tuple[str, str]]) -> DataFrame:
    """(id): nodes after following (direction, edge type) steps; a set at every step, the start if there are none."""
    found = g.nodes.where(F.col("id") == start).select("id")
    for direction, edge_type in legs:
        step = arcs(g.edges, direction, [edge_type]).select(F.col("src").alias("id"), "dst")
        found = found.join(step, "id").select(F.col("dst").alias("id")).distinct()
    return found.orderBy("id")


def parse_dsl(text: str) -> list[LegPattern]:
    """``CALLS->USES*2->OWNS``: edge types in order, each with an optional repeat count; a bad count is one."""
    text = re.sub(r"(?i)^\s*pattern\s+", "", text.strip())
    text = re.split(r"(?i)\s+filter\s+", text)[0]
    legs = []
    for part in filter(None, (p.strip() for p in text.split("->"))):
        name, _, times = part.partition("*")
        legs += [LegPattern(OUTGOING, name.strip())] * (int(times) if times.strip().isdigit() and int(times) > 0 else 1)
    return legs


def reason(g: Graph, starts: DataFrame, legs: Sequence[LegPattern], depth: int) -> DataFrame:
    """(path, expansion, score), best first: score = path length + nodes within ``depth`` hops of its end + the end's degree."""
    paths = execute_pattern(g, starts, legs).withColumn("anchor", F.element_at("path", -1))
    near = multi_source(g, paths.select(F.col("anchor").alias("id")), depth).where("level > 0").groupBy(F.col("source").alias("anchor")).agg(F.count("*").alias("expansion"))
    degree = g.degrees().select(F.col("id").alias("anchor"), (F.col("out_degree") + F.col("in_degree")).alias("degree"))
    zero = F.lit(0).cast("long")
    return (
        paths.join(near, "anchor", "left")
        .join(degree, "anchor", "left")
        .select("path", F.coalesce("expansion", zero).alias("expansion"), (F.size("path") + F.coalesce("expansion", zero) + F.coalesce("degree", zero)).alias("score"))
        .orderBy(F.desc("score"), "path")
    )


__all__ = ["INCOMING", "OUTGOING", "LegPattern", "TriplePattern", "chain_query", "edge_exists", "edge_id", "execute_pattern", "match_triples", "match_triples_fast", "parse_dsl", "pattern_search", "reason"]
