"""Registered queries of lookups by id, writes read back, stores, the writing half of the language, and index upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandgraph.graph import Graph
from strandgraph.operators import match, reach, slicing, traverse, vector
from strandgraph.plans.fixpoint import shared_dir
from strandgraph.plans.planner import execute
from strandgraph.queries import _DIST, _X, query
from strandgraph.sources import dump, tables
from strandgraph.store import GraphStore

_ORDER, _CUSTOMER, _NATION, _PLACED = 10_000_008, 2_000_007, 1_001, 4_000_000_000_003


def _one(spark: SparkSession, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([tuple(values)], schema)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _counts(g: Graph) -> DataFrame:
    """(what, n): nodes by kind and edges by type."""
    return g.nodes.groupBy(F.col("kind").alias("what")).agg(F.count("*").alias("n")).union(g.edges.groupBy("edge_type").agg(F.count("*")))


_COUNTS = "SELECT kind AS what, CAST(count(*) AS BIGINT) AS n FROM {nodes} GROUP BY kind UNION ALL SELECT edge_type, CAST(count(*) AS BIGINT) FROM {edges} GROUP BY edge_type"
_ALL = _COUNTS.format(nodes="n", edges="e")


# -- lookups ---------------------------------------------------------------------------


@query("SELECT id FROM n")
def all_ids(spark, d):
    return tables.trade(spark, d).node_ids()


@query(f"SELECT id, kind, name FROM n WHERE id = {_CUSTOMER}")
def get_node(spark, d):
    found = tables.trade(spark, d).get_node(_CUSTOMER)
    return _one(spark, "id long, kind string, name string", found["id"], found["kind"], found["name"])


@query(f"SELECT id, from_id, to_id, edge_type FROM e WHERE id = {_PLACED}")
def get_edge(spark, d):
    found = tables.trade(spark, d).get_edge(_PLACED)
    return _one(spark, "id long, from_id long, to_id long, edge_type string", *(found[k] for k in ("id", "from_id", "to_id", "edge_type")))


@query("SELECT id, kind, name FROM n WHERE kind = 'Order' AND name = 'Order#7'")
def node_by_kind_and_name(spark, d):
    found = tables.trade(spark, d).node_by_kind_and_name("Order", "Order#7")
    return _one(spark, "id long, kind string, name string", found["id"], found["kind"], found["name"])


@query(f"SELECT to_id AS neighbor, edge_type, id AS edge_id FROM e WHERE from_id = {_ORDER} AND edge_type = 'CONTAINS'")
def edges_of_type(spark, d):
    return tables.trade(spark, d).edges_of_type(_ORDER, "CONTAINS")


@query(f"SELECT from_id AS neighbor, edge_type, id AS edge_id FROM e WHERE to_id = {_NATION}")
def neighbors_in(spark, d):
    return tables.trade(spark, d).incoming(_NATION)


@query(f"SELECT CAST(count(*) FILTER (WHERE from_id = {_ORDER}) AS BIGINT) AS out_degree, CAST(count(*) FILTER (WHERE to_id = {_ORDER}) AS BIGINT) AS in_degree FROM e")
def one_degree(spark, d):
    return _one(spark, "out_degree long, in_degree long", *tables.trade(spark, d).node_degree(_ORDER))


@query(f"SELECT count(*) > 0 AS found, min(id) AS edge_id FROM e WHERE edge_type = 'PLACED' AND to_id = {_ORDER} AND from_id = (SELECT from_id FROM e WHERE edge_type = 'PLACED' AND to_id = {_ORDER})")
def edge_exists_and_id(spark, d):
    g = tables.trade(spark, d)
    buyer = g.incoming(_ORDER).first()["neighbor"]
    return _one(spark, "found boolean, edge_id long", match.edge_exists(g, buyer, _ORDER, "PLACED"), match.edge_id(g, buyer, _ORDER, "PLACED"))


@query(
    f"SELECT CAST(2 AS BIGINT) AS hops, min(o.to_id) AS middle, (SELECT min(p.to_id) FROM e o JOIN e p ON p.from_id = o.to_id AND p.edge_type = 'CONTAINS' WHERE o.edge_type = 'PLACED' AND o.from_id = {_CUSTOMER}) AS target"
    f" FROM e o JOIN e p ON p.from_id = o.to_id AND p.edge_type = 'CONTAINS' WHERE o.edge_type = 'PLACED' AND o.from_id = {_CUSTOMER}"
    f" AND p.to_id = (SELECT min(p.to_id) FROM e o JOIN e p ON p.from_id = o.to_id AND p.edge_type = 'CONTAINS' WHERE o.edge_type = 'PLACED' AND o.from_id = {_CUSTOMER})"
)
def shortest_path_filtered(spark, d):
    """The path by PLACED and CONTAINS edges from a customer to the smallest part that it ordered."""
    g = tables.trade(spark, d)
    target = traverse.k_hop(g, _CUSTOMER, 2, types=["PLACED", "CONTAINS"]).where("id > 3000000 AND id < 10000000").agg(F.min("id")).first()[0]
    path = traverse.shortest_path(g, _CUSTOMER, target, types=["PLACED", "CONTAINS"])
    return _one(spark, "hops long, middle long, target long", len(path) - 1, path[1], path[-1])


# -- writes, read back -----------------------------------------------------------------------


@query("SELECT (SELECT max(id) FROM n) + i AS id, 'Tag' AS kind, 'tag' || i AS name FROM range(1, 4) t(i)")
def insert_nodes(spark, d):
    g = tables.trade(spark, d)
    new, ids = g.add_nodes([{"kind": "Tag", "name": f"tag{i}"} for i in (1, 2, 3)])
    return new.nodes.where(F.col("id").isin(ids)).select("id", "kind", "name")


@query("SELECT 'Moment' AS kind, event_type AS name, CAST(count(*) AS BIGINT) AS n, true AS fresh FROM events GROUP BY event_type")
def bulk_insert_nodes(spark, d):
    """Every event as a node; ids are new and distinct."""
    g = tables.trade(spark, d)
    frame = tables.table(spark, d, "events").select(F.lit("Moment").alias("kind"), F.col("event_type").alias("name"), F.lit(None).cast("string").alias("file_path"), F.lit("{}").alias("data"))
    made = g.append_nodes(frame).nodes.where("kind = 'Moment'")
    return made.groupBy("kind", "name").agg(F.count_distinct("id").alias("n"), (F.min("id") > g.next_id(g.nodes) - 1).alias("fresh"))


@query(f"SELECT (SELECT max(id) FROM e) + 1 AS id, CAST({_CUSTOMER} AS BIGINT) AS from_id, CAST({_NATION} AS BIGINT) AS to_id, 'VISITS' AS edge_type")
def insert_edge(spark, d):
    new, edge_id = tables.trade(spark, d).add_edge(_CUSTOMER, _NATION, "VISITS")
    return new.edges.where(F.col("id") == edge_id).select("id", "from_id", "to_id", "edge_type")


@query("SELECT to_id, CAST(count(*) AS BIGINT) AS n, true AS fresh FROM (SELECT c.from_id, r.to_id FROM e c JOIN e r ON r.from_id = c.to_id AND r.edge_type = 'IN_REGION' WHERE c.edge_type = 'IN_NATION') GROUP BY to_id")
def bulk_insert_edges(spark, d):
    """Every customer and supplier gets an edge to its region; ids are new and distinct."""
    g = tables.trade(spark, d)
    near, far = (g.edges.where(F.col("edge_type") == t) for t in ("IN_NATION", "IN_REGION"))
    frame = near.select("from_id", F.col("to_id").alias("nation")).join(far.select(F.col("from_id").alias("nation"), "to_id"), "nation").select("from_id", "to_id", F.lit("SERVES").alias("edge_type"), F.lit("{}").alias("data"))
    made = g.append_edges(frame).edges.where("edge_type = 'SERVES'")
    return made.groupBy("to_id").agg(F.count_distinct("id").alias("n"), (F.min("id") > g.next_id(g.edges) - 1).alias("fresh"))


@query(f"SELECT id, CASE WHEN id = {_NATION} THEN 'Renamed' ELSE name END AS name FROM n WHERE kind = 'Nation'")
def update_node(spark, d):
    return tables.trade(spark, d).update_node(_NATION, "Nation", "Renamed").nodes.where("kind = 'Nation'").select("id", "name")


@query(_COUNTS.format(nodes=f"(SELECT * FROM n WHERE id <> {_NATION})", edges=f"(SELECT * FROM e WHERE from_id <> {_NATION} AND to_id <> {_NATION})"))
def delete_node_cascade(spark, d):
    return _counts(tables.trade(spark, d).delete_node(_NATION))


@query(_COUNTS.format(nodes="n", edges=f"(SELECT * FROM e WHERE id <> {_PLACED})"))
def delete_edge(spark, d):
    return _counts(tables.trade(spark, d).delete_edge(_PLACED))


@query(f"SELECT * FROM ({_COUNTS.format(nodes=f'(SELECT * FROM n WHERE id <> {_NATION})', edges=f'(SELECT * FROM e WHERE from_id <> {_NATION} AND to_id <> {_NATION})')}) UNION ALL SELECT 'Tag', CAST(1 AS BIGINT)")
def transaction_commit(spark, d):
    work = tables.trade(spark, d).transaction()
    return _counts(work.apply(lambda g: g.delete_node(_NATION)).apply(lambda g: g.add_node("Tag", "new")).commit())


@query(_ALL)
def transaction_rollback(spark, d):
    work = tables.trade(spark, d).transaction()
    return _counts(work.apply(lambda g: g.delete_node(_NATION)).rollback())


@query("SELECT id, kind || '+' || CASE WHEN acctbal < 0 THEN 'Debtor' ELSE '' END AS labels FROM n WHERE kind = 'Supplier'")
def labels_added(spark, d):
    g = tables.trade(spark, d)
    poor = g.nodes.where("kind = 'Supplier'").where(F.get_json_object("data", "$.acctbal").cast("double") < 0).select(F.col("id").alias("entity_id"), F.lit("Debtor").alias("label"))
    g = g.with_frames(extra_labels=poor)
    suppliers = g.nodes.where("kind = 'Supplier'").select("id")
    return suppliers.join(g.labels.where("label <> 'Supplier'").withColumnRenamed("entity_id", "id"), "id", "left").select("id", F.concat(F.lit("Supplier+"), F.coalesce("label", F.lit(""))).alias("labels"))


# -- stores ------------------------------------------------------------------------------------


@query(_ALL)
def snapshot_roundtrip(spark, d):
    """Saved with a checked manifest, and read back."""
    path = _folder(spark, "snapshot")
    dump.save(tables.trade(spark, d), path)
    return _counts(dump.restore(spark, path))


@query(_ALL)
def dump_file_roundtrip(spark, d):
    path = _folder(spark, "dump")
    dump.dump(tables.trade(spark, d), path)
    return _counts(dump.load(spark, path))


@query(_ALL)
def store_backup_and_import(spark, d):
    path = _folder(spark, "backup")
    GraphStore(tables.trade(spark, d)).backup(path)
    other = GraphStore(Graph.empty(spark))
    other.snapshot_import(path)
    return _counts(other.snapshot())


@query(_COUNTS.format(nodes=f"(SELECT * FROM n WHERE id <> {_NATION})", edges=f"(SELECT * FROM e WHERE from_id <> {_NATION} AND to_id <> {_NATION})"))
def store_checkpoint(spark, d):
    store = GraphStore(tables.trade(spark, d))
    store.delete_node(_NATION)
    store.checkpoint(_folder(spark, "checkpoint"))
    return _counts(store.snapshot())


@query(_ALL)
def store_snapshot_is_stable(spark, d):
    """A snapshot taken before a write does not see it."""
    store = GraphStore(tables.trade(spark, d))
    before = store.snapshot()
    store.delete_node(_NATION)
    return _counts(before)


@query(_ALL)
def introspect(spark, d):
    found = tables.trade(spark, d).introspect()
    return spark.createDataFrame([*found["kinds"].items(), *found["edge_types"].items()], "what string, n long")


# -- the writing half of the language -------------------------------------------------------------


@query("SELECT max(id) + 1 AS id, 'Tag' AS kind, 'fresh' AS name FROM n")
def cypher_create_node(spark, d):
    made = execute(tables.trade(spark, d), 'CREATE (t:Tag {name: "fresh", colour: "red"})')
    return made.graph.nodes.where(F.col("id") == made.info["id"]).select("id", "kind", "name")


@query(f"SELECT max(id) + 1 AS id, CAST({_CUSTOMER} AS BIGINT) AS from_id, CAST({_NATION} AS BIGINT) AS to_id, 'VISITS' AS edge_type FROM e")
def cypher_create_edge(spark, d):
    made = execute(tables.trade(spark, d), f"CREATE ({_CUSTOMER})-[:VISITS]->({_NATION})")
    return made.graph.edges.where(F.col("id") == made.info["id"]).select("id", "from_id", "to_id", "edge_type")


@query("SELECT CASE WHEN segment = 'BUILDING' THEN 'SHIPYARD' ELSE segment END AS segment, CAST(count(*) AS BIGINT) AS n, (SELECT CAST(count(*) AS BIGINT) FROM n WHERE segment = 'BUILDING') AS updated FROM n WHERE kind = 'Customer' GROUP BY 1")
def cypher_set(spark, d):
    made = execute(tables.trade(spark, d), 'MATCH (c:Customer) WHERE c.segment = "BUILDING" SET c.segment = "SHIPYARD"')
    customers = made.graph.nodes.where("kind = 'Customer'").select(F.get_json_object("data", "$.segment").alias("segment"))
    return customers.groupBy("segment").agg(F.count("*").alias("n")).withColumn("updated", F.lit(made.info["updated"]).cast("long"))


@query(_COUNTS.format(nodes="(SELECT * FROM n WHERE status IS DISTINCT FROM 'F')", edges="(SELECT e.* FROM e LEFT JOIN n a ON a.id = e.from_id LEFT JOIN n b ON b.id = e.to_id WHERE a.status IS DISTINCT FROM 'F' AND b.status IS DISTINCT FROM 'F')"))
def cypher_delete(spark, d):
    return _counts(execute(tables.trade(spark, d), 'MATCH (o:Order) WHERE o.status = "F" DELETE o').graph)


@query("SELECT id AS c_id FROM n WHERE kind = 'Region'")
def cypher_unknown_variable(spark, d):
    """A condition on a variable that the pattern does not name holds."""
    frame = execute(tables.trade(spark, d), 'MATCH (c:Region) WHERE z.name = "nobody" RETURN c.id').frame
    return frame.select(F.col("`c.id`").alias("c_id"))


@query(f"SELECT b.vec_id AS id FROM x a, x b WHERE a.vec_id = 0 ORDER BY {_DIST['euclidean']}, b.vec_id LIMIT 5", _X)
def cypher_vector_call(spark, d):
    registry, q = _registry(spark, d)
    text = f'CALL db.index.vector.queryNodes("v", 5, [{", ".join(repr(x) for x in q)}])'
    return execute(tables.geography(spark, d), text, indexes={"v": registry["v"]}).frame.select("id")


# -- index upkeep -------------------------------------------------------------------------------------


def _registry(spark, d) -> tuple[vector.IndexRegistry, list[float]]:
    frame = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.to_json(F.struct("label")).alias("metadata"))
    registry = vector.IndexRegistry(spark)
    registry.create("v", vector.IndexConfig(dimension=64, metric="euclidean"), frame)
    return registry, [float(x) for x in frame.where("id = 0").first()["embedding"]]


@query(f"SELECT id, round(distance, 6) AS distance FROM (SELECT b.vec_id AS id, {_DIST['euclidean']} AS distance FROM x a, x b WHERE a.vec_id = 0) ORDER BY distance, id LIMIT 10", _X)
def index_save_and_load(spark, d):
    registry, q = _registry(spark, d)
    path = _folder(spark, "index")
    registry.save("v", path)
    return vector.IndexRegistry(spark).load(path).search(q, 10).select("id", F.round("distance", 6).alias("distance"))


@query(f"SELECT id, round(distance, 6) AS distance FROM (SELECT b.vec_id AS id, {_DIST['euclidean']} AS distance FROM x a, x b WHERE a.vec_id = 0 AND b.vec_id <> 0) ORDER BY distance, id LIMIT 10", _X)
def index_delete_vector(spark, d):
    registry, q = _registry(spark, d)
    return registry["v"].delete(0).search(q, 10).select("id", F.round("distance", 6).alias("distance"))


@query("SELECT max(vec_id) + 1 AS id, CAST(count(*) + 1 AS BIGINT) AS vectors FROM x", _X)
def index_insert_vector(spark, d):
    registry, q = _registry(spark, d)
    more, ids = registry["v"].insert([([-x for x in q], {"far": True})])
    return _one(spark, "id long, vectors long", ids[0], more.statistics()["vectors"])


@query(
    f"SELECT query_id, CAST(k AS INTEGER) AS rank, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS k FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_DIST['euclidean']} AS distance FROM x a JOIN x b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)) WHERE k <= 10",
    _X,
)
def knn_batch(spark, d):
    """Every vector whose id is divisible by 20 against all vectors."""
    frame = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vector.knn_join(frame.where("id % 20 = 0"), frame, 10, "euclidean").select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


# -- hooks ----------------------------------------------------------------------------------------------


@query("SELECT id, 'source' AS part FROM n WHERE kind = 'Customer' AND acctbal < 0 UNION ALL SELECT id, 'sink' FROM n WHERE kind = 'Order' AND status = 'F'")
def discover_sources_and_sinks(spark, d):
    field = lambda name: F.get_json_object("data", f"$.{name}")
    sources, sinks = slicing.discover(tables.trade(spark, d), (F.col("kind") == "Customer") & (field("acctbal").cast("double") < 0), (F.col("kind") == "Order") & (field("status") == "F"))
    return sources.select("id", F.lit("source").alias("part")).union(sinks.select("id", F.lit("sink").alias("part")))


@query(f", r AS (SELECT CAST({_CUSTOMER} AS BIGINT) AS id UNION SELECT e.to_id FROM r JOIN e ON e.from_id = r.id) SELECT (SELECT count(*) FROM r WHERE id = 1) > 0 AS to_region, (SELECT count(*) FROM r WHERE id = 3000001) > 0 AS to_part", recursive=True)
def can_reach_pairs(spark, d):
    g = tables.trade(spark, d)
    return _one(spark, "to_region boolean, to_part boolean", reach.can_reach(g, _CUSTOMER, 1), reach.can_reach(g, _CUSTOMER, 3_000_001))
