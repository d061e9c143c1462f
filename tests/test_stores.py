"""Vectors, key-value view, change feed, sources."""

import math

import pytest
from helpers import graph_of, values
from pyspark.sql import functions as F

from strandgraph.errors import InvalidInput, NotFound
from strandgraph.functions import clocks
from strandgraph.operators.kv import KvFrame
from strandgraph.operators.vector import IndexConfig, IndexRegistry, knn_join
from strandgraph.plans.planner import execute
from strandgraph.streaming import feed


@pytest.fixture
def registry(spark):
    r = IndexRegistry(spark)
    index, ids = r.create("v", IndexConfig(dimension=3, metric="euclidean")).insert([([1, 0, 0], {"a": 1}), ([0, 1, 0], None), ([0, 0, 1], None)])
    assert ids == [1, 2, 3]
    r.replace(index)
    return r


def test_index(spark, registry, tmp_path):
    found = registry["v"].search([0.9, 0.1, 0.0], 2).collect()
    assert [r["id"] for r in found] == [1, 2] and abs(found[0]["distance"] - math.sqrt(0.02)) < 1e-6
    assert values(registry["v"].search([0.9, 0.1, 0.0], 2, deny=spark.createDataFrame([(1,)], "id long")), "id") == [(2,), (3,)]
    with pytest.raises(InvalidInput):
        registry["v"].search([1.0], 1)
    with pytest.raises(InvalidInput):
        IndexConfig(dimension=0)
    with pytest.raises(NotFound):
        registry["nope"]
    registry.save("v", f"file://{tmp_path}/i")
    other = IndexRegistry(spark)
    assert other.load(f"file://{tmp_path}/i").statistics()["vectors"] == 3
    assert registry["v"].delete(1).count() == 2 and registry["v"].get(1)["metadata"] == '{"a": 1}'
    rows = execute(graph_of(spark, [1], []), 'CALL db.index.vector.queryNodes("v", 1, [0.9, 0.1, 0])', indexes=registry).frame
    assert [r["id"] for r in rows.collect()] == [1]
    frame = registry["v"].vectors
    assert values(knn_join(frame.where("id = 1"), frame, 1, "dot"), "query_id", "rank", "id") == [(1, 1, 2)]


@pytest.mark.parametrize(("metric", "want"), [("cosine", 0.0), ("dot", -1.0), ("manhattan", 0.0), ("euclidean", 0.0)])
def test_metrics(spark, metric, want):
    index, _ = IndexRegistry(spark).create("m", IndexConfig(dimension=2, metric=metric)).insert([([1, 0], None), ([0, 0], None)])
    assert abs(index.search([1, 0], 1).first()["distance"] - want) < 1e-9


def test_kv(spark):
    kv = KvFrame.empty(spark).set("a", 1, now=10).set("a", {"x": [1]}, now=11).set("b", b"\x01", now=12, ttl=5).set("ab", True, now=13)
    assert kv.get("a") == {"x": [1]} and kv.get("a", snapshot=1) == 1 and kv.get("b") == b"\x01"
    assert kv.get("b", now=16) == b"\x01" and kv.get("b", now=17) is None
    assert [r["key"] for r in kv.prefix_scan("a").collect()] == ["a", "ab"]
    gone = kv.delete("a", now=14)
    assert gone.get("a") is None and gone.delete("zzz", now=15).get("zzz") is None
    assert values(kv.without_expired(100).latest(), "key") == [("a",), ("ab",)]


def test_feed(spark, tmp_path):
    before = graph_of(spark, [1, 2], [(1, 2)])
    after = before.delete_node(2)
    f = feed.Feed(spark, f"file://{tmp_path}/feed")
    f.emit(feed.changes_between(before, after, 7).withColumn("ts", F.lit("2024-01-01 00:05:00").cast("timestamp")))
    got = []
    sub = f.subscribe(lambda batch, _: got.extend(r["event_type"] for r in batch.collect()), feed.NODES_ONLY, checkpoint=f"file://{tmp_path}/cp", once=True)
    f.wait(sub)
    assert got == [feed.NODE] and f.unsubscribe(sub) and not f.unsubscribe(sub)
    table = spark.read.schema(feed.SCHEMA).parquet(f.path)
    assert sorted(r["n"] for r in feed.Feed.windowed_counts(table).collect()) == [1, 1, 1]
    assert feed.Feed.sessions(table).count() == 2
    assert table.where(feed.Filter(False, False, False, False).column()).count() == 0


def test_clocks(spark):
    row = spark.sql("SELECT map(1L, 2L) AS a, map(1L, 1L, 2L, 5L) AS b").select(
        clocks.merge(F.col("a"), F.col("b")).alias("m"), clocks.concurrent(F.col("a"), F.col("b")).alias("c"), clocks.increment(F.col("a"), F.lit(1).cast("long")).alias("i"), clocks.happens_before(F.col("a"), clocks.merge(F.col("a"), F.col("b"))).alias("h")
    ).first()
    assert row["m"] == {1: 2, 2: 5} and row["c"] and row["i"] == {1: 3} and row["h"]
