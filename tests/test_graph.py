"""Handle, lookups, writes, dumps."""

import pytest
from helpers import graph_of, values

from strandgraph.errors import InvalidInput, NotFound
from strandgraph.graph import INCOMING, Graph
from strandgraph.sources import dump


@pytest.fixture(scope="module")
def calls(spark):
    nodes = [(1, "Function", "main", '{"lang": "rust"}'), (2, "Function", "helper", '{"lang": "rust"}'), (3, "Function", "util", '{"lang": "python"}'), (4, "File", "main.rs")]
    return graph_of(spark, nodes, [(1, 2, "CALLS"), (2, 3, "CALLS"), (4, 1, "CONTAINS"), (1, 2, "CALLS")])


def test_lookups(calls):
    assert values(calls.nodes_by_kind("Function"), "id") == [(1,), (2,), (3,)]
    assert calls.get_node(4)["name"] == "main.rs"
    with pytest.raises(NotFound):
        calls.get_node(9)
    assert values(calls.nodes_by_name_pattern("m*")) == [(1,), (4,)]
    assert values(calls.nodes_by_name_pattern("[hu]*")) == [(2,), (3,)]
    assert values(calls.nodes_by_name_pattern("?ain")) == [(1,)]
    assert values(calls.nodes_with_constraint("Function", "u")) == [(3,)]
    assert calls.node_by_kind_and_name("File", "main.rs")["id"] == 4
    assert calls.node_by_kind_and_name("File", "no") is None


def test_adjacency(calls):
    assert values(calls.outgoing(1), "neighbor", "edge_id") == [(2, 1), (2, 4)]
    assert values(calls.neighbors(1, INCOMING), "neighbor") == [(4,)]
    assert values(calls.degrees()) == [(1, 2, 1), (2, 1, 2), (3, 0, 1), (4, 1, 0)]
    assert calls.node_degree(2) == (1, 2)
    with pytest.raises(InvalidInput):
        calls.edges_of_type(1, " ")
    assert values(calls.adjacency(calls.nodes), "id", "neighbors") == [(1, (2, 2)), (2, (3,)), (3, ()), (4, (1,))]


def test_labels_and_properties(calls):
    g = calls.add_label(1, "hot").add_property(2, "k", "v").add_property(2, "k", "v")
    assert values(g.nodes_by_label("hot"), "id") == [(1,)]
    assert values(g.nodes_by_label("File"), "id") == [(4,)]
    assert values(g.nodes_by_property("k", "v"), "id") == [(2,), (2,)]


def test_writes_make_new_graphs(spark, calls):
    g, node = calls.add_node("Function", "new", data={"a": 1})
    assert node == 5 and g.nodes.count() == 5 and calls.nodes.count() == 4
    g, edge = g.add_edge(5, 1, "CALLS")
    assert edge == 5
    with pytest.raises(InvalidInput):
        g.add_edge(5, 99, "CALLS")
    with pytest.raises(InvalidInput):
        g.add_node(" ", "x")
    g2 = g.delete_node(1)
    assert g2.edges.count() == 1 and g2.dangling().count() == 0
    assert g.update_node(5, "F", "other").get_node(5)["kind"] == "F"
    t = calls.transaction().apply(lambda x: x.add_node("A", "b")).apply(lambda x: x.delete_edge(1))
    assert t.commit().nodes.count() == 5 and t.rollback() is calls
    many = calls.append_nodes(spark.createDataFrame([("K", f"m{i}", None, "{}") for i in range(5)], "kind string, name string, file_path string, data string"))
    assert sorted(r["id"] for r in many.nodes_by_kind("K").collect()) == [5, 6, 7, 8, 9]


def test_dump_and_backup(spark, calls, tmp_path):
    g = calls.add_label(1, "hot").add_property(2, "k", "v")
    dump.dump(g, f"file://{tmp_path}/d")
    back = dump.load(spark, f"file://{tmp_path}/d")
    for a, b in ((g.nodes, back.nodes), (g.edges, back.edges), (g.labels, back.labels), (g.properties, back.properties)):
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    facts = dump.save(g, f"file://{tmp_path}/b")
    assert facts["nodes"] == 4 and dump.restore(spark, f"file://{tmp_path}/b").nodes.count() == 4
    restored = dump.open_saved(spark, f"file://{tmp_path}/b")
    restored.edges.limit(1).write.mode("append").partitionBy("edge_type").parquet(f"file://{tmp_path}/b/edges")
    with pytest.raises(InvalidInput):
        dump.restore(spark, f"file://{tmp_path}/b")


def test_empty(spark):
    g = Graph.empty(spark)
    assert g.degrees().count() == 0 and g.introspect()["nodes"] == 0
