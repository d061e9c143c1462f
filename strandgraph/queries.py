"""Registered queries of the graph operators, each over its whole tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandgraph.functions import clocks
from strandgraph.functions.json import scalar
from strandgraph.graph import BOTH, INCOMING, Graph
from strandgraph.operators import community, compare, component, cuts, flow, match, rank, reach, slicing, trace, traverse, vector
from strandgraph.operators.kv import KvFrame
from strandgraph.plans.fixpoint import WorkTables
from strandgraph.plans.planner import execute
from strandgraph.sources import dump, tables
from strandgraph.streaming.feed import NODE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The trade graph in SQL.
VIEWS = """
n AS (
  SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, 'Region' AS kind, r_name AS name, NULL AS segment, NULL AS acctbal, NULL AS status FROM region
  UNION ALL SELECT n_nationkey + 1001, 'Nation', n_name, NULL, NULL, NULL FROM nation
  UNION ALL SELECT s_suppkey + 1000001, 'Supplier', s_name, NULL, s_acctbal, NULL FROM supplier
  UNION ALL SELECT c_custkey + 2000001, 'Customer', c_name, c_mktsegment, c_acctbal, NULL FROM customer
  UNION ALL SELECT p_partkey + 3000001, 'Part', p_name, NULL, NULL, NULL FROM part
  UNION ALL SELECT o_orderkey + 10000001, 'Order', 'Order#' || o_orderkey, NULL, o_totalprice, o_orderstatus FROM orders
), geo AS (
  SELECT 1000000000000 + n_nationkey AS id, CAST(n_nationkey + 1001 AS BIGINT) AS from_id, CAST(n_regionkey + 1 AS BIGINT) AS to_id, 'IN_REGION' AS edge_type FROM nation
  UNION ALL SELECT 2000000000000 + s_suppkey, s_suppkey + 1000001, s_nationkey + 1001, 'IN_NATION' FROM supplier
  UNION ALL SELECT 3000000000000 + c_custkey, c_custkey + 2000001, c_nationkey + 1001, 'IN_NATION' FROM customer
), li AS (
  SELECT (l_orderkey * 8 + l_linenumber) * 64 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS line, l_orderkey, l_partkey, l_suppkey FROM lineitem
), e AS (
  SELECT CAST(id AS BIGINT) AS id, CAST(from_id AS BIGINT) AS from_id, CAST(to_id AS BIGINT) AS to_id, edge_type FROM (
    SELECT * FROM geo
    UNION ALL SELECT 4000000000000 + o_orderkey, o_custkey + 2000001, o_orderkey + 10000001, 'PLACED' FROM orders
    UNION ALL SELECT 5000000000000 + line, l_orderkey + 10000001, l_partkey + 3000001, 'CONTAINS' FROM li
    UNION ALL SELECT 6000000000000 + line, l_orderkey + 10000001, l_suppkey + 1000001, 'SHIPPED_BY' FROM li
    UNION ALL SELECT 7000000000000 + l_suppkey * 10000000 + l_partkey, l_suppkey + 1000001, l_partkey + 3000001, 'SUPPLIES' FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
  )
), gn AS (SELECT * FROM n WHERE kind IN ('Region', 'Nation', 'Supplier', 'Customer')),
ge AS (SELECT * FROM e WHERE edge_type IN ('IN_REGION', 'IN_NATION'))
"""
STEPS = """
k AS (SELECT event_type, CAST(100 + row_number() OVER (ORDER BY event_type) AS BIGINT) AS num FROM (SELECT DISTINCT event_type FROM events)),
s AS (SELECT * FROM (SELECT user_id, event_id, num AS src, lead(num) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events JOIN k USING (event_type)) WHERE dst IS NOT NULL),
f AS (SELECT DISTINCT user_id AS cfg, src, dst FROM s)
"""


def query(sql: str | None = None, views: str = VIEWS, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query; ``sql`` follows the common views."""

    def add(f: Query) -> Query:
        name = f.__name__
        QUERIES[name] = f
        if sql is not None:
            head = f"WITH {'RECURSIVE ' if recursive else ''}{views}"
            ORACLES[name] = head + (sql if sql.lstrip().startswith(",") else " " + sql)
        return f

    return add


def tagged(spark: SparkSession, sf_dir: str) -> Graph:
    """The trade graph with a second label (Debtor: negative balance) and a property (segment) of customers."""
    g = tables.trade(spark, sf_dir)
    customers = g.nodes.where("kind = 'Customer'")
    labels = customers.where(scalar(F.col("data"), "acctbal").cast("double") < 0).select(F.col("id").alias("entity_id"), F.lit("Debtor").alias("label"))
    properties = customers.select(F.col("id").alias("entity_id"), F.lit("segment").alias("key"), scalar(F.col("data"), "segment").alias("value"))
    return Graph.of(g.nodes, g.edges, labels, properties)


# -- lookups ---------------------------------------------------------------------


@query("SELECT id, name FROM n WHERE kind = 'Supplier'")
def scan_by_kind(spark, d):
    return tables.trade(spark, d).nodes_by_kind("Supplier").select("id", "name")


@query("SELECT id FROM n WHERE name GLOB '*#0000?00[1-4]*'")
def name_glob(spark, d):
    return tables.trade(spark, d).nodes_by_name_pattern("*#0000?00[1-4]*")


@query("SELECT id FROM n WHERE kind = 'Order' AND starts_with(name, 'Order#12')")
def name_prefix(spark, d):
    return tables.trade(spark, d).nodes_with_constraint("Order", "Order#12")


@query("SELECT id, name FROM n WHERE kind = 'Customer' AND acctbal < 0")
def by_label(spark, d):
    return tagged(spark, d).nodes_by_label("Debtor").select("id", "name")


@query("SELECT id, name FROM n WHERE kind = 'Customer' AND segment = 'MACHINERY'")
def by_property(spark, d):
    return tagged(spark, d).nodes_by_property("segment", "MACHINERY").select("id", "name")


@query("SELECT id, coalesce(string_agg(to_id, ',' ORDER BY to_id, edge_type, eid), '') AS neighbors FROM n LEFT JOIN (SELECT from_id, to_id, edge_type, id AS eid FROM e) ON from_id = n.id GROUP BY id")
def adjacency_out(spark, d):
    g = tables.trade(spark, d)
    return g.adjacency(g.nodes).select("id", F.array_join("neighbors", ",").alias("neighbors"))


@query("SELECT id, coalesce(string_agg(from_id, ',' ORDER BY from_id, edge_type, eid), '') AS neighbors FROM n LEFT JOIN (SELECT from_id, to_id, edge_type, id AS eid FROM e) ON to_id = n.id GROUP BY id")
def adjacency_in(spark, d):
    g = tables.trade(spark, d)
    return g.adjacency(g.nodes, INCOMING).select("id", F.array_join("neighbors", ",").alias("neighbors"))


@query("SELECT to_id AS neighbor, edge_type, id AS edge_id FROM e WHERE from_id = 1000005")
def neighbors_out(spark, d):
    return tables.trade(spark, d).outgoing(1_000_005)


@query("SELECT id, CAST((SELECT count(*) FROM e WHERE from_id = n.id) AS BIGINT) AS out_degree, CAST((SELECT count(*) FROM e WHERE to_id = n.id) AS BIGINT) AS in_degree FROM n")
def node_degree(spark, d):
    return tables.trade(spark, d).degrees()


@query("SELECT n.id, CAST(count(x) AS BIGINT) AS degree FROM n LEFT JOIN (SELECT from_id AS x FROM e UNION ALL SELECT to_id FROM e) ON x = n.id GROUP BY n.id")
def nodes_by_degree(spark, d):
    return rank.nodes_by_degree(tables.trade(spark, d))


@query("SELECT CAST(0 AS BIGINT) AS id WHERE 1 = 0")
def dangling_edges(spark, d):
    return tables.trade(spark, d).dangling()


@query("SELECT kind, CAST(count(*) AS BIGINT) AS nodes FROM n GROUP BY kind")
def dump_roundtrip(spark, d):
    """The full dump, read back from its JSON lines."""
    return dump.of_lines(dump.dump_lines(tables.trade(spark, d))).nodes.groupBy("kind").agg(F.count("*").alias("nodes"))


# -- query language ---------------------------------------------------------------


def rows(g: Graph, text: str, **names: str) -> DataFrame:
    frame = execute(g, text).frame
    return frame.select(*[F.col(f"`{c}`").alias(names.get(c.replace(".", "_"), c.replace(".", "_"))) for c in frame.columns])


@query("SELECT id AS c_id, name AS c_name FROM n WHERE kind = 'Customer' AND segment = 'BUILDING'")
def cypher_node_where(spark, d):
    return rows(tables.trade(spark, d), 'MATCH (c:Customer) WHERE c.segment = "BUILDING" RETURN c.id, c.name')


@query("SELECT id AS c_id FROM n WHERE kind = 'Customer' AND (segment = 'BUILDING' OR segment = 'MACHINERY') AND acctbal > 9000")
def cypher_or_and_parens(spark, d):
    return rows(tables.trade(spark, d), 'MATCH (c:Customer) WHERE (c.segment = "BUILDING" OR c.segment = "MACHINERY") AND c.acctbal > 9000 RETURN c.id')


@query("SELECT id AS c_id, name AS c_name FROM n WHERE kind = 'Customer' AND regexp_matches(name, '00[0-9]7$')")
def cypher_regex(spark, d):
    return rows(tables.trade(spark, d), 'MATCH (c:Customer) WHERE c.name =~ "00[0-9]7$" RETURN c.id, c.name')


@query("SELECT id AS o_id FROM n WHERE kind = 'Order' AND acctbal >= 300000 AND status <> 'F'")
def cypher_numeric(spark, d):
    return rows(tables.trade(spark, d), 'MATCH (o:Order) WHERE o.total >= 300000 AND o.status <> "F" RETURN o.id')


@query("SELECT c.name AS c_name, o.name AS o_name FROM e JOIN n c ON c.id = e.from_id JOIN n o ON o.id = e.to_id WHERE edge_type = 'PLACED' AND o.status = 'F'")
def cypher_edge(spark, d):
    return rows(tables.trade(spark, d), 'MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.status = "F" RETURN c.name, o.name')


@query("SELECT o.id AS o_id, c.id AS c_id, e.id AS edge_id FROM e JOIN n c ON c.id = e.from_id JOIN n o ON o.id = e.to_id WHERE edge_type = 'PLACED' AND c.segment = 'FURNITURE'")
def cypher_edge_incoming(spark, d):
    frame = execute(tables.trade(spark, d), 'MATCH (o:Order)<-[:PLACED]-(c:Customer) WHERE c.segment = "FURNITURE" RETURN *').frame
    return frame.select(F.col("o.id").alias("o_id"), F.col("c.id").alias("c_id"), "edge_id")


@query("SELECT a.id AS a_id, b.id AS b_id FROM (SELECT from_id AS x, to_id AS y FROM e WHERE edge_type LIKE 'IN_%' UNION ALL SELECT to_id, from_id FROM e WHERE edge_type LIKE 'IN_%') JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE a.kind = 'Nation'")
def cypher_edge_undirected(spark, d):
    g = tables.geography(spark, d)
    return rows(g, "MATCH (a:Nation)-[]-(b) RETURN a.id, b.id")


@query("SELECT DISTINCT c.id AS c_id, p.to_id AS p_id FROM n c JOIN e o ON o.from_id = c.id AND o.edge_type = 'PLACED' JOIN e p ON p.from_id = o.to_id AND p.edge_type = 'CONTAINS' WHERE c.segment = 'HOUSEHOLD'")
def cypher_multi_hop(spark, d):
    return rows(tables.trade(spark, d), 'MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) WHERE c.segment = "HOUSEHOLD" RETURN c.id, p.id')


@query("SELECT o_orderkey + 10000001 AS o_id, o_custkey + 2000001 AS c_id, l_suppkey + 1000001 AS s_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'", "one AS (SELECT 1)")
def cypher_star(spark, d):
    return rows(tables.trade(spark, d), 'MATCH (c:Customer)-[:PLACED]->(o:Order), (o)-[:SHIPPED_BY]->(s:Supplier) WHERE o.status = "O" RETURN o.id, c.id, s.id')


@query("SELECT a.id AS r_id, b.id AS n_id FROM n a, n b WHERE a.kind = 'Region' AND b.kind = 'Nation'")
def cypher_cross(spark, d):
    return rows(tables.geography(spark, d), "MATCH (r:Region), (n:Nation) RETURN r.id, n.id")


@query("SELECT s.id AS s_id, m.to_id AS r_id FROM n s JOIN ge m ON m.from_id = s.id WHERE s.kind = 'Supplier' UNION SELECT s.id, r.to_id FROM n s JOIN ge m ON m.from_id = s.id JOIN ge r ON r.from_id = m.to_id WHERE s.kind = 'Supplier'")
def cypher_var_depth(spark, d):
    return rows(tables.geography(spark, d), "MATCH (s:Supplier)-[*1..2]->(r) RETURN s.id, r.id")


@query("SELECT id AS c_id FROM n WHERE kind = 'Customer' ORDER BY id LIMIT 25")
def cypher_limit(spark, d):
    return rows(tables.trade(spark, d), "MATCH (c:Customer) RETURN c.id LIMIT 25")


# -- patterns -----------------------------------------------------------------------


@query("SELECT from_id AS start_id, e.id AS edge_id, to_id AS end_id FROM e JOIN n c ON c.id = from_id WHERE edge_type = 'PLACED' AND c.acctbal < 0")
def match_triples_labels(spark, d):
    return match.match_triples(tagged(spark, d), match.TriplePattern("PLACED", start_label="Debtor", end_label="Order"))


@query("SELECT to_id AS start_id, e.id AS edge_id, from_id AS end_id FROM e JOIN n c ON c.id = from_id WHERE edge_type = 'PLACED' AND c.segment = 'MACHINERY'")
def match_triples_props(spark, d):
    return match.match_triples(tagged(spark, d), match.TriplePattern("PLACED", end_props=(("segment", "MACHINERY"),), direction=INCOMING))


@query("SELECT DISTINCT s.id || ',' || a.to_id || ',' || b.to_id AS path FROM n s JOIN ge a ON a.from_id = s.id JOIN ge b ON b.from_id = a.to_id WHERE s.kind = 'Supplier'")
def pattern_search(spark, d):
    g = tables.geography(spark, d)
    found = match.pattern_search(g, g.nodes_by_kind("Supplier"), [match.LegPattern(edge_type="IN_NATION", kind="Nation", name_prefix="NATION"), match.LegPattern(edge_type="IN_REGION")])
    return found.select(F.array_join("path", ",").alias("path"))


@query("SELECT DISTINCT p.to_id AS id FROM e o JOIN e p ON p.from_id = o.to_id WHERE o.from_id = 2000002 AND o.edge_type = 'PLACED' AND p.edge_type = 'CONTAINS'")
def chain_query(spark, d):
    return match.chain_query(tables.trade(spark, d), 2_000_002, [("outgoing", "PLACED"), ("outgoing", "CONTAINS")])


@query("SELECT DISTINCT c.id || ',' || a.to_id || ',' || b.to_id AS path FROM n c JOIN e a ON a.from_id = c.id AND a.edge_type = 'IN_NATION' JOIN e b ON b.from_id = a.to_id AND b.edge_type = 'IN_REGION' WHERE c.kind = 'Customer'")
def dsl_pattern(spark, d):
    g = tables.trade(spark, d)
    return match.execute_pattern(g, g.nodes_by_kind("Customer"), match.parse_dsl("IN_NATION->IN_REGION")).select(F.array_join("path", ",").alias("path"))


@query(
    ", deg AS (SELECT x, count(*) AS degree FROM (SELECT from_id AS x FROM ge UNION ALL SELECT to_id FROM ge) GROUP BY x)"
    " SELECT s.id || ',' || a.to_id AS path, CAST((SELECT count(*) FROM ge r WHERE r.from_id = a.to_id) AS BIGINT) AS expansion, CAST(2 + (SELECT count(*) FROM ge r WHERE r.from_id = a.to_id) + deg.degree AS BIGINT) AS score"
    " FROM n s JOIN ge a ON a.from_id = s.id JOIN deg ON deg.x = a.to_id WHERE s.kind = 'Supplier'"
)
def reasoner_scores(spark, d):
    g = tables.geography(spark, d)
    return match.reason(g, g.nodes_by_kind("Supplier"), [match.LegPattern(edge_type="IN_NATION")], 2).select(F.array_join("path", ",").alias("path"), "expansion", "score")


# -- traversal -----------------------------------------------------------------------

_WALK = ", r AS (SELECT CAST({start} AS BIGINT) AS id, 0 AS level UNION SELECT e.to_id, r.level + 1 FROM r JOIN {edges} e ON e.from_id = r.id WHERE r.level < {depth})"


@query(_WALK.format(start=2_000_002, edges="e", depth=3) + " SELECT id, CAST(min(level) AS INTEGER) AS level FROM r GROUP BY id", recursive=True)
def bfs_levels(spark, d):
    return traverse.bfs(tables.trade(spark, d), 2_000_002, 3)


@query(_WALK.format(start=2_000_002, edges="(SELECT * FROM e WHERE edge_type IN ('PLACED', 'SHIPPED_BY'))", depth=2) + " SELECT id, CAST(min(level) AS INTEGER) AS level FROM r GROUP BY id", recursive=True)
def bfs_filtered(spark, d):
    return traverse.bfs_filtered(tables.trade(spark, d), 2_000_002, 2, ["PLACED", "SHIPPED_BY"])


@query(_WALK.format(start=2_000_002, edges="e", depth=2) + " SELECT id FROM r GROUP BY id HAVING min(level) = 2", recursive=True)
def bfs_frontier(spark, d):
    return traverse.bfs_frontier(tables.trade(spark, d), 2_000_002, 2)


@query(_WALK.format(start=10_000_010, edges="e", depth=2) + " SELECT id, CAST(min(level) AS INTEGER) AS level FROM r GROUP BY id HAVING min(level) > 0", recursive=True)
def k_hop(spark, d):
    return traverse.k_hop(tables.trade(spark, d), 10_000_010, 2)


@query(
    ", r AS (SELECT id, 0 AS level FROM n WHERE kind = 'Supplier' UNION SELECT e.to_id, r.level + 1 FROM r JOIN e ON e.from_id = r.id WHERE r.level < 2) SELECT id, CAST(min(level) AS INTEGER) AS level FROM r GROUP BY id HAVING min(level) > 0",
    recursive=True,
)
def k_hop_multi(spark, d):
    g = tables.trade(spark, d)
    return traverse.bfs_levels(g, g.nodes.where("kind = 'Supplier'"), 2).where("level > 0")


@query(", r AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS level UNION SELECT e.from_id, r.level + 1 FROM r JOIN e ON e.to_id = r.id WHERE r.level < 3) SELECT id, CAST(min(level) AS INTEGER) AS level FROM r GROUP BY id HAVING min(level) > 0", recursive=True)
def k_hop_incoming(spark, d):
    return traverse.k_hop(tables.trade(spark, d), 1, 3, INCOMING)


@query(_WALK.format(start=2_000_002, edges="e", depth=8) + " SELECT CAST(min(level) AS INTEGER) AS length FROM r WHERE id = 1", recursive=True)
def shortest_path_length(spark, d):
    path = traverse.shortest_path(tables.trade(spark, d), 2_000_002, 1)
    return spark.createDataFrame([(len(path) - 1 if path else None,)], "length int")


@query(
    ", p AS (SELECT CAST(2000002 AS BIGINT) AS id, [CAST(2000002 AS BIGINT)] AS path UNION ALL SELECT e.to_id, list_append(p.path, e.to_id) FROM p JOIN (SELECT DISTINCT from_id, to_id FROM e) e ON e.from_id = p.id WHERE len(p.path) < 5)"
    " SELECT array_to_string(path, ',') AS path FROM p WHERE id = 3000001 ORDER BY len(path), path LIMIT 1",
    recursive=True,
)
def shortest_path_nodes(spark, d):
    path = traverse.shortest_path(tables.trade(spark, d), 2_000_002, 3_000_001)
    return spark.createDataFrame([(",".join(map(str, path)),)] if path else [], "path string")


@query(_WALK.format(start=2_000_002, edges="e", depth=8) + " SELECT count(*) FILTER (WHERE id = 3000001) > 0 AS yes FROM r", recursive=True)
def has_path(spark, d):
    return spark.createDataFrame([(traverse.has_path(tables.trade(spark, d), 2_000_002, 3_000_001),)], "yes boolean")


@query()
def dfs_traversal(spark, d):
    return traverse.dfs_traversal(tables.trade(spark, d), 2_000_002)


# -- reachability and acyclic graphs ----------------------------------------------------

_REACH = ", r AS (SELECT CAST({start} AS BIGINT) AS id UNION SELECT {to} FROM r JOIN e ON {fr} = r.id)"


@query(_REACH.format(start=2_000_004, to="e.to_id", fr="e.from_id") + " SELECT id FROM r", recursive=True)
def reachable_from(spark, d):
    return reach.reachable_from(tables.trade(spark, d), 2_000_004)


@query(_REACH.format(start=3_000_004, to="e.from_id", fr="e.to_id") + " SELECT id FROM r", recursive=True)
def reverse_reachable(spark, d):
    return reach.reverse_reachable_from(tables.trade(spark, d), 3_000_004)


@query(_REACH.format(start=2_000_004, to="e.to_id", fr="e.from_id") + " SELECT id FROM n WHERE id NOT IN (SELECT id FROM r)", recursive=True)
def unreachable_from(spark, d):
    return reach.unreachable_from(tables.trade(spark, d), 2_000_004)


@query(_REACH.format(start=2_000_004, to="e.to_id", fr="e.from_id") + " SELECT count(*) FILTER (WHERE id = 1) > 0 AS yes FROM r", recursive=True)
def can_reach(spark, d):
    return spark.createDataFrame([(reach.can_reach(tables.trade(spark, d), 2_000_004, 1),)], "yes boolean")


@query(", r AS (SELECT id AS source, id FROM gn UNION SELECT r.source, ge.to_id FROM r JOIN ge ON ge.from_id = r.id) SELECT source, id FROM r", recursive=True)
def transitive_closure(spark, d):
    return reach.transitive_closure(tables.geography(spark, d))


def _with_shortcuts(spark, d) -> Graph:
    """The geography with an edge from each supplier to its region, which its nation already implies."""
    g = tables.geography(spark, d)
    a, b = g.edges.where("edge_type = 'IN_NATION'"), g.edges.where("edge_type = 'IN_REGION'").select(F.col("from_id").alias("mid"), F.col("to_id").alias("region"))
    extra = a.join(b, a["to_id"] == b["mid"]).select(F.lit(9 * tables.EDGE_SPACE).alias("id"), "from_id", F.col("region").alias("to_id"), F.lit("IMPLIED").alias("edge_type"), F.lit("{}").alias("data"))
    return g.with_frames(edges=g.edges.unionByName(extra))


@query("SELECT DISTINCT from_id, to_id FROM ge")
def transitive_reduction(spark, d):
    return reach.transitive_reduction(_with_shortcuts(spark, d))


@query(
    ", r AS (SELECT id, 0 AS level FROM gn UNION SELECT ge.to_id, r.level + 1 FROM r JOIN ge ON ge.from_id = r.id) SELECT id, CAST(max(level) AS INTEGER) AS level FROM r GROUP BY id",
    recursive=True,
)
def topological_levels(spark, d):
    return reach.topological_levels(tables.geography(spark, d))


@query(
    ", r AS (SELECT id, 0 AS level FROM n UNION SELECT e.to_id, r.level + 1 FROM r JOIN e ON e.from_id = r.id) SELECT id, CAST(max(level) AS DOUBLE) AS distance FROM r GROUP BY id",
    recursive=True,
)
def critical_path(spark, d):
    return reach.critical_path(tables.trade(spark, d))["distances"].select("id", "distance")


@query(_WALK.format(start=2_000_006, edges="e", depth=3) + " SELECT id, CAST(min(level) AS DOUBLE) AS distance, min(level) = 3 AS boundary FROM r GROUP BY id", recursive=True)
def impact_radius(spark, d):
    return reach.impact_radius(tables.trade(spark, d), 2_000_006, max_distance=3.0)


# -- centrality, components, communities ----------------------------------------------------


def _pagerank_sql(rounds: int) -> str:
    """Rounds as chained views."""
    out = [", c AS (SELECT count(*) AS n FROM n), o AS (SELECT from_id, count(*) AS deg FROM e GROUP BY from_id), w AS (SELECT e.from_id, e.to_id, count(*) * 1.0 / any_value(o.deg) AS w FROM e JOIN o USING (from_id) GROUP BY e.from_id, e.to_id)", "p0 AS (SELECT n.id, 1.0::DOUBLE / c.n AS s FROM n, c)"]
    for i in range(rounds):
        out.append(
            f"g{i} AS (SELECT w.to_id AS id, sum(w.w::DOUBLE * p.s) AS s FROM w JOIN p{i} p ON p.id = w.from_id GROUP BY w.to_id), l{i} AS (SELECT coalesce(sum(s), 0) AS m FROM p{i} WHERE id NOT IN (SELECT from_id FROM o)),"
            f"p{i + 1} AS (SELECT n.id, 0.15::DOUBLE / c.n + 0.85::DOUBLE * (coalesce(g.s, 0) + l.m / c.n) AS s FROM n CROSS JOIN c CROSS JOIN l{i} l LEFT JOIN g{i} g ON g.id = n.id)"
        )
    return ",\n".join(out) + f" SELECT id, round(s, 9) AS score FROM p{rounds}"


@query(_pagerank_sql(10))
def pagerank_10(spark, d):
    return rank.pagerank(tables.trade(spark, d), 0.85, 10).select("id", F.round("score", 9).alias("score"))


@query(", r AS (SELECT id, id AS c FROM gn UNION SELECT x.b, r.c FROM r JOIN (SELECT from_id AS a, to_id AS b FROM ge UNION ALL SELECT to_id, from_id FROM ge) x ON x.a = r.id WHERE x.b > r.c) SELECT id, min(c) AS component FROM r GROUP BY id", recursive=True)
def wcc(spark, d):
    return component.connected_components(tables.geography(spark, d))


@query("SELECT CAST(count(DISTINCT id) AS BIGINT) AS nodes, CAST(1 AS BIGINT) AS component FROM n")
def connected_components(spark, d):
    """The whole trade graph is one component, whose smallest id is the first region."""
    return component.connected_components(tables.trade(spark, d)).groupBy("component").agg(F.count("*").alias("nodes"))


@query(
    ", r AS (SELECT DISTINCT src AS a, src AS b FROM s UNION SELECT r.a, s.dst FROM r JOIN (SELECT DISTINCT src, dst FROM s) s ON s.src = r.b) SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a",
    STEPS,
    recursive=True,
)
def scc(spark, d):
    return component.strongly_connected_components(tables.event_steps(spark, d))


def _orders_both_ways(spark, d) -> Graph:
    """PLACED in both directions: a strong component for each customer with orders."""
    g = tables.trade(spark, d)
    placed = g.edges.where("edge_type = 'PLACED'")
    back = placed.select((F.col("id") + 10**14).alias("id"), F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.lit("PLACED_BY").alias("edge_type"), "data")
    nodes = g.nodes.where("kind IN ('Customer', 'Order', 'Part')")
    return Graph.of(nodes, placed.unionByName(back).unionByName(g.edges.where("edge_type = 'CONTAINS'")))


@query("SELECT id, coalesce(from_id, id) AS component FROM n LEFT JOIN (SELECT from_id, to_id FROM e WHERE edge_type = 'PLACED') p ON p.to_id = n.id WHERE kind IN ('Customer', 'Order', 'Part')")
def scc_orders(spark, d):
    return component.strongly_connected_components(_orders_both_ways(spark, d))


@query("SELECT DISTINCT p.from_id AS from_supernode, c.to_id AS to_supernode FROM e p JOIN e c ON c.from_id = p.to_id WHERE p.edge_type = 'PLACED' AND c.edge_type = 'CONTAINS'")
def collapse_sccs(spark, d):
    return component.collapse_components(_orders_both_ways(spark, d))[1]


@query()
def label_propagation(spark, d):
    return community.label_propagation(tables.geography(spark, d), 10)


@query()
def label_propagation_synchronous(spark, d):
    return community.label_propagation_synchronous(tables.geography(spark, d), 5)


@query()
def louvain(spark, d):
    return community.louvain(tables.geography(spark, d), 10)


@query(
    ", p AS (SELECT m.id, (SELECT count(*) FROM ge WHERE to_id = m.id) AS i FROM gn m WHERE kind = 'Nation') SELECT gn.id, CAST(coalesce(p.i * (SELECT count(*) FROM ge WHERE from_id = gn.id), 0) AS DOUBLE) AS score FROM gn LEFT JOIN p USING (id)"
)
def betweenness(spark, d):
    """Every shortest path of the geography that has an inner node runs through a nation."""
    return rank.betweenness(tables.geography(spark, d))


def _step_cycles(n: int) -> str:
    tabs = ", ".join(f"d AS e{i}" for i in range(n))
    joins = " AND ".join([f"e{i}.dst = e{i + 1}.src" for i in range(n - 1)] + [f"e{n - 1}.dst = e0.src"] + [f"e{i}.src > e0.src" for i in range(1, n)] + [f"e{i}.src <> e{j}.src" for i in range(n) for j in range(i)])
    return f"SELECT {' || '.join([*(f'e{i}.src || chr(44)' for i in range(n)), 'e0.src'])} AS cycle FROM {tabs} WHERE {joins}"


@query(", d AS (SELECT DISTINCT src, dst FROM s) " + " UNION ALL ".join(_step_cycles(n) for n in range(1, 6)), STEPS)
def cycles_bounded(spark, d):
    return community.cycles(tables.event_steps(spark, d), limit=1000, longest=5).select(F.array_join("cycle", ",").alias("cycle"))


@query()
def cycle_basis(spark, d):
    return community.cycle_basis(tables.event_steps(spark, d)).select("component", F.array_join("cycle", ",").alias("cycle"), "skipped")


# -- control flow ---------------------------------------------------------------------------

# The entry of a user's graph: the smallest node without a predecessor, else the smallest.
_ENTRY = """, v AS (SELECT cfg, src AS id FROM f UNION SELECT cfg, dst FROM f),
entry AS (SELECT cfg, coalesce(min(id) FILTER (WHERE id NOT IN (SELECT dst FROM f g WHERE g.cfg = v.cfg)), min(id)) AS id FROM v GROUP BY cfg),
live AS (SELECT cfg, id FROM entry UNION SELECT f.cfg, f.dst FROM live JOIN f ON f.cfg = live.cfg AND f.src = live.id),
avoid AS (SELECT v.cfg, v.id AS without, entry.id FROM v JOIN entry ON entry.cfg = v.cfg WHERE v.id <> entry.id
  UNION SELECT a.cfg, a.without, f.dst FROM avoid a JOIN f ON f.cfg = a.cfg AND f.src = a.id WHERE f.dst <> a.without)"""
_DOM = ", dom AS (SELECT x.cfg, x.id, y.id AS dominator FROM v x JOIN v y ON y.cfg = x.cfg WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.cfg = x.cfg AND live.id = x.id) OR NOT EXISTS (SELECT 1 FROM avoid a WHERE a.cfg = x.cfg AND a.without = y.id AND a.id = x.id))"


@query(_ENTRY + _DOM + " SELECT cfg, id, dominator FROM dom", STEPS, recursive=True)
def dominators(spark, d):
    return flow.dominators(tables.user_flows(spark, d))


@query(
    _ENTRY + _DOM + ", strict AS (SELECT dom.* FROM dom JOIN live USING (cfg, id) WHERE id <> dominator), size AS (SELECT cfg, id, count(*) AS k FROM dom JOIN live USING (cfg, id) GROUP BY cfg, id) "
    "SELECT live.cfg, live.id, (SELECT arg_max(s.dominator, size.k) FROM strict s JOIN size ON size.cfg = s.cfg AND size.id = s.dominator WHERE s.cfg = live.cfg AND s.id = live.id) AS idom FROM live",
    STEPS,
    recursive=True,
)
def idom(spark, d):
    return flow.immediate_dominators(tables.user_flows(spark, d))


_DAGS = STEPS.replace("SELECT DISTINCT user_id AS cfg, src, dst FROM s", "SELECT DISTINCT user_id AS cfg, src, dst FROM s WHERE src < dst")


@query(
    """, v AS (SELECT cfg, src AS id FROM f UNION SELECT cfg, dst FROM f), ends AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.cfg = v.cfg AND f.src = v.id)),
avoid AS (SELECT w.cfg, w.id AS without, ends.id FROM v w JOIN ends ON ends.cfg = w.cfg WHERE w.id <> ends.id UNION SELECT a.cfg, a.without, f.src FROM avoid a JOIN f ON f.cfg = a.cfg AND f.dst = a.id WHERE f.src <> a.without)
SELECT x.cfg, x.id, y.id AS post_dominator FROM v x JOIN v y ON y.cfg = x.cfg WHERE NOT EXISTS (SELECT 1 FROM avoid a WHERE a.cfg = x.cfg AND a.without = y.id AND a.id = x.id)""",
    _DAGS,
    recursive=True,
)
def post_dominators(spark, d):
    return flow.post_dominators(tables.user_dags(spark, d))


@query(
    _ENTRY + _DOM + " SELECT DISTINCT d.cfg, d.dominator AS id, f.dst AS frontier FROM dom d JOIN live USING (cfg, id) JOIN f ON f.cfg = d.cfg AND f.src = d.id WHERE f.dst = d.dominator OR NOT EXISTS (SELECT 1 FROM dom x WHERE x.cfg = d.cfg AND x.id = f.dst AND x.dominator = d.dominator)",
    STEPS,
    recursive=True,
)
def dominance_frontier(spark, d):
    return flow.dominance_frontiers(tables.user_flows(spark, d))


@query(
    _ENTRY + _DOM + """, df AS (SELECT DISTINCT d.cfg, d.dominator AS id, f.dst AS frontier FROM dom d JOIN live USING (cfg, id) JOIN f ON f.cfg = d.cfg AND f.src = d.id
  WHERE f.dst = d.dominator OR NOT EXISTS (SELECT 1 FROM dom x WHERE x.cfg = d.cfg AND x.id = f.dst AND x.dominator = d.dominator)),
idf AS (SELECT cfg, id FROM v WHERE id IN (101, 103) UNION SELECT df.cfg, df.frontier FROM idf JOIN df ON df.cfg = idf.cfg AND df.id = idf.id)
SELECT cfg, id FROM idf""",
    STEPS,
    recursive=True,
)
def iterated_frontier(spark, d):
    return flow.iterated_dominance_frontier(tables.user_flows(spark, d), [101, 103]).select("cfg", "id")


@query("SELECT cfg, src AS controller, dst AS dependent FROM f", _DAGS)
def control_dependence(spark, d):
    """In an acyclic graph no node post-dominates its successor, so every edge counts."""
    return flow.control_dependence(tables.user_dags(spark, d))


@query(
    _ENTRY + _DOM + """, back AS (SELECT f.cfg, f.dst AS header, f.src AS tail FROM f JOIN live ON live.cfg = f.cfg AND live.id = f.src JOIN dom ON dom.cfg = f.cfg AND dom.id = f.src AND dom.dominator = f.dst WHERE f.src <> f.dst),
body AS (SELECT cfg, header, tail AS id FROM back UNION SELECT b.cfg, b.header, f.src FROM body b JOIN f ON f.cfg = b.cfg AND f.dst = b.id JOIN live ON live.cfg = f.cfg AND live.id = f.src WHERE f.src <> b.header)
SELECT cfg, header, id, CAST((SELECT count(*) FROM back WHERE back.cfg = body.cfg AND back.header = body.header) AS BIGINT) AS back_edges,
  CAST((SELECT count(*) FROM body o WHERE o.cfg = body.cfg AND o.id = body.header) AS BIGINT) AS depth FROM body""",
    STEPS,
    recursive=True,
)
def natural_loops(spark, d):
    return flow.natural_loops(tables.user_flows(spark, d))


@query(
    """, v AS (SELECT cfg, src AS id FROM f UNION SELECT cfg, dst FROM f), entry AS (SELECT cfg, min(id) FILTER (WHERE id NOT IN (SELECT dst FROM f g WHERE g.cfg = v.cfg)) AS id FROM v GROUP BY cfg),
top AS (SELECT max(id) AS id FROM v), p AS (SELECT cfg, id, CAST(id AS VARCHAR) AS path FROM entry UNION ALL SELECT p.cfg, f.dst, p.path || ',' || f.dst FROM p JOIN f ON f.cfg = p.cfg AND f.src = p.id)
SELECT cfg, path, 'normal' AS class FROM p JOIN top USING (id)""",
    _DAGS,
    recursive=True,
)
def path_enumeration(spark, d):
    last = tables.user_dags(spark, d).agg(F.max("dst")).first()[0]
    return flow.enumerate_paths(tables.user_dags(spark, d), ends=[last]).select("cfg", F.array_join("path", ",").alias("path"), "class")


# -- slices and taint ------------------------------------------------------------------------


def _no_control(spark) -> DataFrame:
    return spark.sql("SELECT CAST(NULL AS BIGINT) AS controller, CAST(NULL AS BIGINT) AS dependent WHERE FALSE")


@query(_REACH.format(start=3_000_007, to="e.from_id", fr="e.to_id") + " SELECT id, id = 3000007 AS control, true AS data FROM r", recursive=True)
def backward_slice(spark, d):
    return slicing.backward_slice(tables.trade(spark, d), 3_000_007, _no_control(spark))


@query(_REACH.format(start=2_000_007, to="e.to_id", fr="e.from_id") + " SELECT id, id = 2000007 AS control, true AS data FROM r", recursive=True)
def forward_slice(spark, d):
    return slicing.forward_slice(tables.trade(spark, d), 2_000_007, _no_control(spark))


def _taint(spark, d) -> tuple[Graph, DataFrame, DataFrame]:
    g = tables.trade(spark, d)
    sources, sinks = slicing.discover(g, (F.col("kind") == "Customer") & (scalar(F.col("data"), "acctbal").cast("double") < -900), (F.col("kind") == "Part") & (scalar(F.col("data"), "size") == "1"))
    return g, sources, sinks


_TAINT = ", src AS (SELECT id FROM n WHERE kind = 'Customer' AND acctbal < -900), snk AS (SELECT p_partkey + 3000001 AS id FROM part WHERE p_size = 1), r AS (SELECT id AS source, id FROM src UNION SELECT r.source, e.to_id FROM r JOIN e ON e.from_id = r.id)"


@query(_TAINT + " SELECT DISTINCT id FROM r", recursive=True)
def taint_forward(spark, d):
    return slicing.taint_forward(*_taint(spark, d))[0]


@query(_TAINT + " SELECT id AS sink, source FROM r WHERE id IN (SELECT id FROM snk)", recursive=True)
def sink_reachability(spark, d):
    return slicing.sink_reachability(*_taint(spark, d))


@query(_TAINT + " SELECT DISTINCT source AS id FROM r WHERE id = 3000010", recursive=True)
def taint_backward(spark, d):
    g, sources, _ = _taint(spark, d)
    return slicing.taint_backward(g, 3_000_010, sources)


@query("SELECT id FROM n WHERE kind = 'Customer' AND acctbal < -900")
def discover_sources(spark, d):
    return _taint(spark, d)[1]


# -- cuts, shapes, differences ------------------------------------------------------------------


@query()
def min_cut_value(spark, d):
    found = cuts.min_st_cut(tables.trade(spark, d), 2_000_002, 1)
    return spark.createDataFrame([(found["size"], len(found["cut_edges"]))], "size long, edges long")


@query()
def vertex_cut_value(spark, d):
    found = cuts.min_vertex_cut(tables.trade(spark, d), 2_000_002, 1)
    return spark.createDataFrame([(found["size"], len(found["separator"]))], "size long, nodes long")


@query("SELECT from_id, to_id FROM ge JOIN gn a ON a.id = from_id JOIN gn b ON b.id = to_id WHERE (a.kind = 'Region') <> (b.kind = 'Region')")
def partition_cut_edges(spark, d):
    g = tables.geography(spark, d)
    return cuts.cut_edges(g, g.nodes.select("id", (F.col("kind") == "Region").cast("int").alias("part")))


@query()
def partition_greedy(spark, d):
    g = tables.geography(spark, d)
    return cuts.partition_greedy(g, g.nodes.select("id", (F.col("kind") == "Region").cast("int").alias("part")), 20)


@query()
def partition_kway(spark, d):
    return cuts.partition_kway(tables.geography(spark, d), 4)


@query()
def partition_bfs_level(spark, d):
    return cuts.partition_bfs_level(tables.event_steps(spark, d), 2)


@query(
    ", d AS (SELECT DISTINCT src, dst FROM s WHERE src <> dst) SELECT a.src AS n0, b.src AS n1, c.src AS n2 FROM d a JOIN d b ON b.src = a.dst JOIN d c ON c.src = b.dst AND c.dst = a.src"
    " WHERE NOT EXISTS (SELECT 1 FROM d x WHERE (x.src = a.dst AND x.dst = a.src) OR (x.src = b.dst AND x.dst = b.src) OR (x.src = c.dst AND x.dst = c.src)) AND NOT EXISTS (SELECT 1 FROM s l WHERE l.src = l.dst AND l.src IN (a.src, b.src, c.src))",
    STEPS,
)
def triangles(spark, d):
    return compare.find_subgraphs(tables.event_steps(spark, d), compare.TRIANGLE)


@query("SELECT a.from_id AS n0, a.to_id AS n1, b.to_id AS n2 FROM ge a JOIN ge b ON b.from_id = a.to_id")
def chain3_iso(spark, d):
    return compare.find_subgraphs(tables.geography(spark, d), compare.CHAIN3)


@query(
    "SELECT a.c + 2000001 AS n0, a.o + 10000001 AS n1, b.o + 10000001 AS n2, a.p + 3000001 AS n3 FROM ol a JOIN ol b ON a.c = b.c AND a.p = b.p AND a.o <> b.o",
    "ol AS (SELECT DISTINCT o_custkey AS c, o_orderkey AS o, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey)",
)
def diamond_iso(spark, d):
    g = tables.trade(spark, d)
    return compare.find_subgraphs(Graph.of(g.nodes.where("kind IN ('Customer', 'Order', 'Part')"), g.edges.where("edge_type IN ('PLACED', 'CONTAINS')")), compare.DIAMOND)


@query(
    "SELECT 'removed' AS change, 'node' AS element, id, CAST(NULL AS BIGINT) AS from_id, CAST(NULL AS BIGINT) AS to_id FROM n WHERE kind = 'Customer' AND acctbal < 0"
    " UNION ALL SELECT DISTINCT 'removed', 'edge', CAST(NULL AS BIGINT), from_id, to_id FROM e JOIN n ON n.id = e.from_id WHERE n.kind = 'Customer' AND n.acctbal < 0"
)
def graph_diff(spark, d):
    g = tagged(spark, d)
    return compare.graph_diff(g, g.delete_nodes(_debtors(g)))


def _debtors(g: Graph) -> DataFrame:
    """Ids with the Debtor label, written once, since the difference reads them several times."""
    return WorkTables(g.spark, "debtors").save(g.nodes_by_label("Debtor").select("id"))[0]


@query()
def validate_refactor(spark, d):
    g = tables.geography(spark, d)
    small = Graph.of(g.nodes.where("kind IN ('Region', 'Nation')"), g.edges.where("edge_type = 'IN_REGION'"))
    found = compare.validate_refactor(small, small.delete_node(1_001))
    return spark.createDataFrame([(found["safe"], found["nodes_removed"], found["edges_removed"])], "safe boolean, nodes_removed long, edges_removed long")


@query()
def rewrite_pattern(spark, d):
    """Chains supplier or customer -> nation -> region, as far as they share no node: the two edges become one."""
    rule = compare.Rule(compare.CHAIN3, (0, 1, 2), new_edges=((0, 2, "SHORT"),))
    new, _ = compare.rewrite(tables.geography(spark, d), rule)
    return new.edges.groupBy("edge_type").agg(F.count("*").alias("edges"))


@query(
    "SELECT a.location, least(a.event_id, b.event_id) AS first, greatest(a.event_id, b.event_id) AS second FROM t a JOIN t b ON a.location = b.location AND a.event_id < b.event_id AND a.user_id <> b.user_id AND (a.w OR b.w)",
    "t AS (SELECT event_id, user_id, CAST(event_id // 100 AS BIGINT) AS location, event_type IN ('purchase', 'signup') AS w FROM events)",
)
def races(spark, d):
    return trace.races(trace.local_clocks(tables.trace(spark, d)))


@query(
    "SELECT event_id, CAST(c AS BIGINT) AS own, CAST(m AS BIGINT) AS merged FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS c FROM events) JOIN (SELECT user_id, count(*) AS m FROM events GROUP BY user_id) USING (user_id)",
    "one AS (SELECT 1)",
)
def vector_clocks(spark, d):
    t = trace.local_clocks(tables.trace(spark, d))
    last = t.groupBy("thread_id").agg(F.max_by("clock", "event_id").alias("last"))
    merged = clocks.merge(F.col("clock"), F.col("last"))
    return t.join(last, "thread_id").select("event_id", clocks.get(F.col("clock"), F.col("thread_id")).alias("own"), clocks.get(merged, F.col("thread_id")).alias("merged"))


# -- vectors ---------------------------------------------------------------------------------------

_DIST = {
    "cosine": "abs(1 - list_sum(list_transform(range(1, 65), lambda i: a.e[i] * b.e[i])) / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x))))) / 2",
    "euclidean": "sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))))",
    "dot": "-list_sum(list_transform(range(1, 65), lambda i: a.e[i] * b.e[i]))",
    "manhattan": "list_sum(list_transform(range(1, 65), lambda i: abs(a.e[i] - b.e[i])))",
}


def _knn(metric: str, where: str = "TRUE") -> str:
    return f"SELECT id, round(distance, 6) AS distance FROM (SELECT b.vec_id AS id, {_DIST[metric]} AS distance FROM x a, x b WHERE a.vec_id = 0 AND {where}) ORDER BY distance, id LIMIT 10"


_X = "x AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings)"


def _index(spark, d, metric: str) -> tuple[vector.VectorIndex, list[float]]:
    frame = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.to_json(F.struct("label")).alias("metadata"))
    return vector.VectorIndex("v", vector.IndexConfig(dimension=64, metric=metric), frame), list(frame.where("id = 0").first()["embedding"])


def _search(spark, d, metric: str, **filters) -> DataFrame:
    index, q = _index(spark, d, metric)
    return index.search(q, 10, **filters).select("id", F.round("distance", 6).alias("distance"))


@query(_knn("cosine"), _X)
def knn_cosine(spark, d):
    return _search(spark, d, "cosine").withColumn("distance", F.abs("distance"))


@query(_knn("euclidean"), _X)
def knn_euclidean(spark, d):
    return _search(spark, d, "euclidean")


@query(_knn("dot"), _X)
def knn_dot(spark, d):
    return _search(spark, d, "dot")


@query(_knn("manhattan"), _X)
def knn_manhattan(spark, d):
    return _search(spark, d, "manhattan")


@query(_knn("euclidean", "b.label = 3"), _X)
def knn_filtered(spark, d):
    return _search(spark, d, "euclidean", allow=tables.table(spark, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("id")))


# -- key-value view and change feed -----------------------------------------------------------------

_KV = "kv AS (SELECT 'user:' || user_id AS key, event_id % 7 = 0 AS dead, event_type AS value, event_id + 1 AS version, event_id AS updated_at, CASE WHEN event_id % 3 = 0 THEN 500 END AS ttl FROM events)"
_LATEST = "SELECT key, arg_max(value, version) AS value, max(version) AS version, arg_max(dead, version) AS dead, arg_max(updated_at, version) AS updated_at, max(version) FILTER (WHERE ttl IS NOT NULL) AS with_ttl FROM kv {where} GROUP BY key"


@query(f"SELECT key, value, version FROM ({_LATEST.format(where='')}) WHERE NOT dead", _KV)
def kv_latest(spark, d):
    return KvFrame(tables.key_values(spark, d)).latest().select("key", "value", "version")


@query(f"SELECT key, value, version FROM ({_LATEST.format(where='WHERE version <= 600')}) WHERE NOT dead", _KV)
def kv_as_of(spark, d):
    return KvFrame(tables.key_values(spark, d)).latest(snapshot=600).select("key", "value", "version")


@query(f"SELECT key, value, version FROM ({_LATEST.format(where='')}) WHERE NOT dead AND starts_with(key, 'user:1')", _KV)
def kv_prefix(spark, d):
    return KvFrame(tables.key_values(spark, d)).prefix_scan("user:1").select("key", "value", "version")


@query(f"SELECT key, value, version FROM ({_LATEST.format(where='')}) WHERE NOT dead AND (with_ttl IS DISTINCT FROM version OR 10200 < updated_at + 500)", _KV)
def kv_ttl(spark, d):
    return KvFrame(tables.key_values(spark, d)).latest(now=10_200).select("key", "value", "version")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'NodeChanged' AS event_type FROM n WHERE kind = 'Customer' AND acctbal < 0 UNION ALL SELECT 'EdgeChanged' FROM e JOIN n ON n.id = e.from_id WHERE n.kind = 'Customer' AND n.acctbal < 0 UNION ALL SELECT 'SnapshotCommitted') GROUP BY event_type")
def change_feed_counts(spark, d):
    from strandgraph.streaming.feed import changes_between

    g = tagged(spark, d)
    return changes_between(g, g.delete_nodes(_debtors(g)), 1).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2", "one AS (SELECT 1)")
def change_feed_windows(spark, d):
    from strandgraph.streaming.feed import Feed

    changes = tables.table(spark, d, "events").select(F.col("ts"), F.col("event_type"), F.lit(NODE).alias("kind"))
    return Feed.windowed_counts(changes).select("start", "event_type", "n")


__all__ = ["BOTH", "ORACLES", "QUERIES"]
