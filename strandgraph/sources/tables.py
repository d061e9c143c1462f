"""Relational tables to a property graph: the trade graph, the event graph, trace and key-value views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strandgraph.graph import Graph

# Id ranges of the kinds.  Table keys start at 0, so every range starts above it.
REGION, NATION, SUPPLIER, CUSTOMER, PART, ORDER = 1, 1001, 1_000_001, 2_000_001, 3_000_001, 10_000_001
# Edge ids: the type's number times EDGE_SPACE plus the source row's key.
EDGE_SPACE = 10**12
IN_REGION, IN_NATION_S, IN_NATION_C, PLACED, CONTAINS, SHIPPED_BY, SUPPLIES, NEXT = range(1, 9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(frame: DataFrame, key: str, base: int, kind: str, name: Column, **data: str) -> DataFrame:
    payload = F.to_json(F.struct(*[F.col(c).alias(k) for k, c in data.items()])) if data else F.lit("{}")
    return frame.select((F.col(key) + base).cast("long").alias("id"), F.lit(kind).alias("kind"), name.cast("string").alias("name"), F.lit(None).cast("string").alias("file_path"), payload.alias("data"))


def _edge(frame: DataFrame, number: int, row: Column, a: Column, b: Column, kind: str) -> DataFrame:
    return frame.select((F.lit(number * EDGE_SPACE) + row).cast("long").alias("id"), a.cast("long").alias("from_id"), b.cast("long").alias("to_id"), F.lit(kind).alias("edge_type"), F.lit("{}").alias("data"))


def geography(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and suppliers -> nations -> regions: an acyclic graph."""
    t = lambda name: table(spark, sf_dir, name)
    nodes = (
        _node(t("region"), "r_regionkey", REGION, "Region", F.col("r_name"))
        .union(_node(t("nation"), "n_nationkey", NATION, "Nation", F.col("n_name")))
        .union(_node(t("supplier"), "s_suppkey", SUPPLIER, "Supplier", F.col("s_name"), acctbal="s_acctbal"))
        .union(_node(t("customer"), "c_custkey", CUSTOMER, "Customer", F.col("c_name"), segment="c_mktsegment", acctbal="c_acctbal"))
    )
    c = F.col
    edges = (
        _edge(t("nation"), IN_REGION, c("n_nationkey"), c("n_nationkey") + NATION, c("n_regionkey") + REGION, "IN_REGION")
        .union(_edge(t("supplier"), IN_NATION_S, c("s_suppkey"), c("s_suppkey") + SUPPLIER, c("s_nationkey") + NATION, "IN_NATION"))
        .union(_edge(t("customer"), IN_NATION_C, c("c_custkey"), c("c_custkey") + CUSTOMER, c("c_nationkey") + NATION, "IN_NATION"))
    )
    return Graph.of(nodes, edges)


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """The full graph: geography, parts, orders, and their lines."""
    t = lambda name: table(spark, sf_dir, name)
    base, c = geography(spark, sf_dir), F.col
    nodes = base.nodes.union(_node(t("part"), "p_partkey", PART, "Part", F.col("p_name"), brand="p_brand", type="p_type", size="p_size")).union(
        _node(t("orders"), "o_orderkey", ORDER, "Order", F.concat(F.lit("Order#"), c("o_orderkey")), status="o_orderstatus", priority="o_orderpriority", total="o_totalprice")
    )
    # (order, line number) may repeat; a count within the order makes the edge ids unique.
    again = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey"))
    line = (c("l_orderkey") * 8 + c("l_linenumber")) * 64 + again
    edges = (
        base.edges.union(_edge(t("orders"), PLACED, c("o_orderkey"), c("o_custkey") + CUSTOMER, c("o_orderkey") + ORDER, "PLACED"))
        .union(_edge(t("lineitem"), CONTAINS, line, c("l_orderkey") + ORDER, c("l_partkey") + PART, "CONTAINS"))
        .union(_edge(t("lineitem"), SHIPPED_BY, line, c("l_orderkey") + ORDER, c("l_suppkey") + SUPPLIER, "SHIPPED_BY"))
    )
    supplies = t("lineitem").select("l_suppkey", "l_partkey").distinct()
    edges = edges.union(_edge(supplies, SUPPLIES, c("l_suppkey") * 10_000_000 + c("l_partkey"), c("l_suppkey") + SUPPLIER, c("l_partkey") + PART, "SUPPLIES"))
    return Graph.of(nodes, edges)


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers, parts, and a SUPPLIES edge for each distinct pair in the order lines."""
    g = trade(spark, sf_dir)
    return Graph.of(g.nodes.where(F.col("kind").isin("Supplier", "Part")), g.edges.where(F.col("edge_type") == "SUPPLIES"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, src, dst): each event type and the next one of the same user, numbered from 101."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    kinds = events.select("event_type").distinct()
    number = kinds.join(kinds.toDF("other"), F.col("other") <= F.col("event_type")).groupBy("event_type").agg((F.count("*") + 100).alias("n"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    named = events.join(number, "event_type").select("user_id", "event_id", F.col("n").alias("src"), F.lead("n").over(order).alias("dst"))
    return named.where("dst IS NOT NULL")


def event_steps(spark: SparkSession, sf_dir: str) -> Graph:
    """Event types as nodes, NEXT edges between them (one for each step)."""
    events = table(spark, sf_dir, "events")
    kinds = events.select("event_type").distinct()
    number = kinds.join(kinds.toDF("other"), F.col("other") <= F.col("event_type")).groupBy("event_type").agg((F.count("*") + 100).alias("n"))
    nodes = number.select(F.col("n").cast("long").alias("id"), F.lit("EventType").alias("kind"), F.col("event_type").alias("name"), F.lit(None).cast("string").alias("file_path"), F.lit("{}").alias("data"))
    s = steps(spark, sf_dir)
    return Graph.of(nodes, _edge(s, NEXT, F.col("event_id"), F.col("src"), F.col("dst"), "NEXT"))


def user_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cfg, src, dst): each user's distinct steps as a control-flow graph; the user is the shard."""
    return steps(spark, sf_dir).select(F.col("user_id").alias("cfg"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct()


def user_dags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cfg, src, dst): of each user's distinct steps those to a larger type number, which makes them acyclic, with one exit or more."""
    return user_flows(spark, sf_dir).where("src < dst")


def trace(spark: SparkSession, sf_dir: str, span: int = 100) -> DataFrame:
    """Events as memory accesses: thread = user, location = id by spans of ``span``, writes are purchases and signups."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("thread_id"), F.floor(F.col("event_id") / span).cast("long").alias("location"), F.when(F.col("event_type").isin("purchase", "signup"), "W").otherwise("R").alias("op")
    )


def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of one key a user, newer events being newer versions; every seventh is a tombstone."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user:"), F.col("user_id")).alias("key"),
        F.when(e % 7 == 0, 0).otherwise(2).cast("int").alias("type_tag"),
        F.when(e % 7 != 0, F.col("event_type")).alias("value"),
        (e + 1).alias("version"),
        e.alias("created_at"),
        e.alias("updated_at"),
        F.when(e % 3 == 0, F.lit(500)).cast("long").alias("ttl_seconds"),
    )
