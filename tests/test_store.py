"""The mutable store and the command line."""

import io
import json

import pytest

from strandgraph import cli
from strandgraph.errors import NotFound
from strandgraph.operators.vector import IndexConfig
from strandgraph.plans.progress import ConsoleProgress, Throttled
from strandgraph.store import GraphStore
from strandgraph.streaming import feed


def test_store(spark, tmp_path):
    s = GraphStore.open(spark, feed=f"file://{tmp_path}/feed")
    a, b = s.add_nodes_bulk([{"kind": "F", "name": "a"}, {"kind": "F", "name": "b"}])
    e = s.add_edge(a, b, "CALLS")
    assert s.node_ids() == [1, 2] and s.edge_endpoints(e) == (1, 2) and s.find_edge(1, 2) == e and s.contains_node(2)
    before = s.snapshot()
    assert s.shortest_path(1, 2) == [1, 2] == s.shortest_path(1, 2) and s.cache_stats()["hits"] == 1
    assert s.query('MATCH (n) WHERE n.name = "a" SET n.name = "z"').info == {"updated": 1}
    assert s.get_node(1)["name"] == "z" and before.get_node(1)["name"] == "a" and s.cache_stats()["entries"] == 0
    with pytest.raises(NotFound):
        s.transaction(lambda g: g.delete_node(2).delete_node(77))
    assert s.node_count() == 2
    s.backup(f"file://{tmp_path}/b")
    s.delete_node(2)
    assert s.edge_count() == 0
    s.snapshot_import(f"file://{tmp_path}/b")
    assert s.edge_count() == 1
    s.kv_set("k", 5, now=1)
    assert s.kv_get("k") == 5 and s.kv_prefix_scan("k").count() == 1
    s.kv_delete("k", now=2)
    assert s.kv_get("k") is None
    s.create_hnsw_index("v", IndexConfig(dimension=2))
    assert s.insert_vector("v", [1, 0]) == 1 and s.list_hnsw_indexes() == ["v"] and s.get_hnsw_index("v").count() == 1
    s.delete_hnsw_index("v")
    s.checkpoint(f"file://{tmp_path}/c")
    assert s.node_count() == 2
    got = []
    sub = s.subscribe(lambda batch, _: got.append(batch.count()), feed.EDGES_ONLY, checkpoint=f"file://{tmp_path}/cp", once=True)
    s.feed.wait(sub)
    assert sum(got) == 3 and s.unsubscribe(sub)


def test_cli(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    s = GraphStore.open(spark)
    s.add_nodes_bulk([{"kind": "F", "name": "a"}, {"kind": "F", "name": "b"}])
    s.add_edge(1, 2, "CALLS")
    s.backup(path)

    def run(*argv):
        out = io.StringIO()
        return cli.run(spark, [path, *argv], out), [json.loads(x) if x[0] in "{[" else x for x in out.getvalue().splitlines()]

    assert run("query", "MATCH (a)-[:CALLS]->(b) RETURN a.name, b.name") == (0, [{"a.name": "a", "b.name": "b"}])
    assert run("path", "1", "2") == (0, [[1, 2]])
    assert run("insert", "F", "c")[0] == 1
    out = io.StringIO()
    assert cli.run(spark, ["--write", path, "insert", "F", "c"], out) == 0
    assert len(run("list", "F")[1]) == 3
    assert run("status")[1][0]["nodes"] == 3
    assert len(run("algo", "components")[1]) == 3
    assert run("neighbors", "2", "--direction", "both")[1][0]["neighbor"] == 1
    assert run("query", "FETCH x")[0] == 1


def test_progress():
    out = io.StringIO()
    report = Throttled(ConsoleProgress("walk", out), seconds=1000, last=1e18)
    report(1, 3)
    report(3, 3)
    assert out.getvalue() == "walk: 3 of 3\n"
