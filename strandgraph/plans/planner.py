"""Syntax tree to DataFrame plan.

Bindings carry ids only; node attributes are joined at the end, and only for
variables that the condition or the result names.  Conditions on one variable
are applied to its node set before any edge is joined.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from strandgraph.errors import InvalidInput
from strandgraph.functions.json import any_value, compare, scalar, text
from strandgraph.graph import Graph, arcs
from strandgraph.operators.traverse import multi_source
from strandgraph.plans import syntax as S

PSEUDO = ("id", "kind", "name")


@dataclass
class Result:
    """What a query gives: rows of a read, or a new graph and facts about a write."""

    frame: DataFrame | None = None
    graph: Graph | None = None
    info: dict | None = None


def conjuncts(e) -> list:
    if e is None:
        return []
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, S.Both) else [e]


def variables(e) -> set[str]:
    if isinstance(e, S.Test):
        return {e.var}
    return variables(e.left) | variables(e.right)


def condition(e, value_of, known: set[str]) -> Column:
    """A Boolean column; a test on an unknown variable is true."""
    if isinstance(e, S.Test):
        return compare(value_of(e.var, e.field), e.op, e.value) if e.var in known else F.lit(True)
    left, right = condition(e.left, value_of, known), condition(e.right, value_of, known)
    return left & right if isinstance(e, S.Both) else left | right


def field_column(field: str, prefix: str = "") -> Column:
    """A field as text: pseudo-fields as they are, others from the data's top level."""
    if field in PSEUDO:
        return F.col(prefix + field).cast("string")
    return scalar(F.col(prefix + "data"), field)


def node_set(g: Graph, pattern: S.NodePattern, tests: list) -> DataFrame | None:
    """The nodes that may bind a variable, or None if any may."""
    if not (pattern.label or pattern.props or tests):
        return None
    found = g.nodes
    if pattern.label:
        tagged = g.extra_labels.where(F.col("label") == pattern.label).select(F.col("entity_id").alias("id"))
        found = found.where(F.col("kind") == pattern.label).unionByName(found.where(F.col("kind") != pattern.label).join(tagged, "id", "left_semi"))
    for key, value in pattern.props:
        same = F.coalesce(text(F.col("data"), key) == value, F.lit(False))
        owned = g.properties.where((F.col("key") == key) & (F.col("value") == value)).select(F.col("entity_id").alias("id"))
        found = found.where(same).unionByName(found.where(~same).join(owned, "id", "left_semi"))
    for e in tests:
        found = found.where(condition(e, lambda _, f: field_column(f), variables(e)))
    return found


class MatchPlan:
    def __init__(self, g: Graph, match: S.Match, strict: bool = False, min_depth: bool = False):
        self.g, self.match, self.min_depth = g, match, min_depth
        self.patterns: dict[str, S.NodePattern] = {}
        for leg in match.legs:
            for n in leg.nodes:
                old = self.patterns.get(n.var)
                if old is None or not (old.label or old.props):
                    self.patterns[n.var] = n
        parts = conjuncts(match.where)
        self.edge_vars = [e.var for leg in match.legs for e in leg.edges if e.var]
        if strict:
            named = set().union(*map(variables, parts)) if parts else set()
            named |= {v for v, _ in match.returns if v != "*"}
            if unknown := named - set(self.patterns) - set(self.edge_vars):
                raise InvalidInput(f"unknown variables {sorted(unknown)}")
        self.early: dict[str, list] = {v: [e for e in parts if variables(e) == {v}] for v in self.patterns}
        self.late = [e for e in parts if len(variables(e) & set(self.patterns)) > 1 or not variables(e) <= set(self.patterns)]
        self.sets = {v: node_set(g, p, self.early[v]) for v, p in self.patterns.items()}

    def ids(self, var: str) -> DataFrame:
        nodes = self.g.nodes if self.sets[var] is None else self.sets[var]
        return nodes.select(F.col("id").alias(var))

    def keep(self, frame: DataFrame, var: str) -> DataFrame:
        return frame if self.sets[var] is None else frame.join(self.ids(var), var, "left_semi")

    def hop(self, frame: DataFrame, a: str, edge: S.EdgePattern, b: str, edge_column: str | None) -> DataFrame:
        types = None if edge.edge_type is None else [edge.edge_type]
        if edge.depth is not None:
            low, high = edge.depth
            starts = frame.select(F.col(a).alias("id")).distinct()
            reach = multi_source(self.g, starts, high, edge.direction, types).where("level >= 1 AND id <> source")
            if self.min_depth:
                reach = reach.where(F.col("level") >= low)
            step = reach.select(F.col("source").alias(a), F.col("id").alias("__b"))
        else:
            step = arcs(self.g.edges, edge.direction, types).select(F.col("src").alias(a), F.col("dst").alias("__b"), *([F.col("edge_id").alias(edge_column)] if edge_column else []))
        out = frame.join(step, a)
        if b in frame.columns:
            return out.where(F.col("__b") == F.col(b)).drop("__b")
        return self.keep(out.withColumnRenamed("__b", b), b)

    def leg(self, leg: S.Leg, single: bool) -> DataFrame:
        frame = self.ids(leg.nodes[0].var)
        for i, edge in enumerate(leg.edges):
            column = "edge_id" if single and len(leg.edges) == 1 and edge.depth is None else None
            frame = self.hop(frame, leg.nodes[i].var, edge, leg.nodes[i + 1].var, column)
        if len(leg.edges) > 1 or any(e.depth for e in leg.edges):
            frame = frame.select(*self.wanted(leg, single)).distinct()
        return frame

    def wanted(self, leg: S.Leg, single: bool) -> list[str]:
        """A chain's rows are its distinct ends, and inner variables only where they are asked for or shared."""
        named = {v for v, _ in self.match.returns} | {v for e in self.late for v in variables(e)}
        ends = [leg.nodes[0].var, leg.nodes[-1].var]
        inner = [n.var for n in leg.nodes[1:-1] if n.var in named or not single and any(n.var in {m.var for m in other.nodes} for other in self.match.legs if other is not leg)]
        return list(dict.fromkeys([*ends, *inner]))

    def bindings(self) -> DataFrame:
        single = len(self.match.legs) == 1
        frame = None
        waiting = [self.leg(x, single) for x in self.match.legs]
        while waiting:
            if frame is None:
                frame = waiting.pop(0)
                continue
            at = next((i for i, f in enumerate(waiting) if set(f.columns) & set(frame.columns)), None)
            if at is None:
                frame = frame.crossJoin(waiting.pop(0))
            else:
                other = waiting.pop(at)
                frame = frame.join(other, [c for c in other.columns if c in frame.columns])
        return frame

    def rows(self) -> DataFrame:
        frame = self.bindings()
        known = {v for v in self.patterns if v in frame.columns}
        returns = list(self.match.returns)
        if ("*", None) in returns:
            at = returns.index(("*", None))
            returns[at : at + 1] = [(v, None) for v in frame.columns if v in known] + [("edge_id", None)] * ("edge_id" in frame.columns)
        returns = [r for r in returns if r[0] in known or r == ("edge_id", None)]
        needed = {v for v, f in returns if f != "id" and v in known} | {v for e in self.late for v in variables(e) & known if v}
        for v in sorted(needed):
            attributes = self.g.nodes.select(F.col("id").alias(v), *[F.col(c).alias(f"{v}__{c}") for c in ("kind", "name", "data")])
            frame = frame.join(attributes, v)

        def value_of(var: str, field: str) -> Column:
            return F.col(var).cast("string") if field == "id" else field_column(field, f"{var}__")

        for e in self.late:
            frame = frame.where(condition(e, value_of, known))
        if self.match.limit is not None:
            order = [F.col(c) for c in frame.columns if c in known or c == "edge_id"]
            frame = frame.orderBy(*order).limit(self.match.limit)
        if not returns:
            return frame.select().limit(0)
        return frame.select(*[self.output(v, f) for v, f in returns])

    def output(self, var: str, field: str | None) -> Column:
        if var == "edge_id":
            return F.col("edge_id")
        if field is None:
            return F.struct(F.col(var).alias("id"), *[F.col(f"{var}__{c}").alias(c) for c in ("kind", "name", "data")]).alias(var)
        if field == "id":
            return F.col(var).alias(f"{var}.id")
        if field in PSEUDO:
            return F.col(f"{var}__{field}").alias(f"{var}.{field}")
        return any_value(F.col(f"{var}__data"), field).alias(f"{var}.{field}")

    def targets(self) -> DataFrame:
        """Ids that SET and DELETE act on: the first node pattern's matches."""
        return self.ids(self.match.legs[0].nodes[0].var).withColumnRenamed(self.match.legs[0].nodes[0].var, "id")


def execute(g: Graph, query: str, strict: bool = False, min_depth: bool = False, indexes: dict | None = None) -> Result:
    """Run a query; reads are lazy frames, writes give a new graph."""
    tree = S.parse(query)
    if isinstance(tree, S.Match):
        return Result(frame=MatchPlan(g, tree, strict, min_depth).rows())
    if isinstance(tree, S.CreateNode):
        props = dict(tree.node.props)
        new, node_id = g.add_node(tree.node.label or "Node", props.get("name", tree.node.var), data=props)
        return Result(graph=new, info={"id": node_id})
    if isinstance(tree, S.CreateEdge):
        new, edge_id = g.add_edge(tree.from_id, tree.to_id, tree.edge_type)
        return Result(graph=new, info={"id": edge_id})
    if isinstance(tree, S.VectorQuery):
        if not indexes or tree.index not in indexes:
            raise InvalidInput(f"no vector index {tree.index!r}")
        return Result(frame=indexes[tree.index].search(tree.vector, tree.k).select("id", F.col("distance").alias("score")))
    plan = MatchPlan(g, tree.match, strict)
    targets = plan.targets().distinct()
    count = targets.count()
    if isinstance(tree, S.Delete):
        return Result(graph=g.delete_nodes(targets), info={"deleted": count})
    return Result(graph=_set(g, targets, tree.field, tree.value), info={"updated": count})


def _set(g: Graph, targets: DataFrame, field: str, value: str) -> Graph:
    """Name and kind are columns; any other field becomes a JSON string; file_path is cleared."""
    hit = g.nodes.join(targets.withColumn("__hit", F.lit(True)), "id", "left")
    chosen = F.coalesce("__hit", F.lit(False))
    if field in ("name", "kind"):
        changed = hit.withColumn(field, F.when(chosen, F.lit(value)).otherwise(F.col(field)))
    else:
        changed = hit.withColumn("data", F.when(chosen, _with_field("data", field, value)).otherwise(F.col("data")))
    nodes = changed.withColumn("file_path", F.when(~chosen, F.col("file_path"))).select("id", "kind", "name", "file_path", "data")
    return g.with_frames(nodes=nodes)


def _merge_json(data: pd.Series, key: pd.Series, value: pd.Series) -> pd.Series:
    """JSON objects with one field replaced; what is no object counts as an empty one."""
    out = []
    for d, k, v in zip(data, key, value, strict=True):
        try:
            old = json.loads(d) if d else {}
        except ValueError:
            old = {}
        out.append(json.dumps((old if isinstance(old, dict) else {}) | {k: v}, ensure_ascii=False))
    return pd.Series(out)


def _with_field(column: str, field: str, value: str) -> Column:
    return F.pandas_udf(_merge_json, "string")(F.col(column), F.lit(field), F.lit(value))
