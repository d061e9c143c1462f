"""Query language and pattern operators on the hand graphs."""

import pytest
from helpers import graph_of, values

from strandgraph.errors import InvalidInput, QuerySyntax
from strandgraph.operators import match as M
from strandgraph.plans import syntax
from strandgraph.plans.planner import execute


@pytest.fixture(scope="module")
def calls(spark):
    nodes = [(1, "Function", "main", '{"lang": "rust", "size": 10, "ok": true, "tags": [1], "v": 1.50}'), (2, "Function", "helper", '{"lang": "rust", "size": 5}'), (3, "Function", "util", '{"lang": "python", "size": "7"}'), (4, "File", "main.rs", "{}")]
    return graph_of(spark, nodes, [(1, 2, "CALLS"), (2, 3, "CALLS"), (4, 1, "CONTAINS")])


@pytest.fixture(scope="module")
def star(spark):
    nodes = [(1, "Hub", "root"), (2, "Thing", "a", '{"colour": "red"}'), (3, "Thing", "b", '{"colour": "blue"}'), (4, "Thing", "c", '{"colour": "green"}')]
    return graph_of(spark, nodes, [(1, 2, "OWNS"), (1, 3, "OWNS"), (1, 4, "LIKES"), (1, 2, "TAGS")])


def run(g, text, **kw):
    return values(execute(g, text, **kw).frame)


def test_where(calls):
    assert run(calls, 'MATCH (n:Function) WHERE n.lang = "rust" AND n.name = "main" RETURN n.id') == [(1,)]
    assert run(calls, 'MATCH (n) WHERE n.lang = "python" OR (n.kind = "File" AND n.name =~ "rs$") RETURN n.id') == [(3,), (4,)]
    assert run(calls, "MATCH (n) WHERE n.size > 6 RETURN n.id") == [(1,), (3,)]
    assert run(calls, "MATCH (n) WHERE n.ok = true RETURN n.id") == [(1,)]
    assert run(calls, 'MATCH (n) WHERE n.tags = "[1]" RETURN n.id') == []
    assert run(calls, 'MATCH (n) WHERE n.lang <> "rust" RETURN n.id') == [(3,)]
    assert run(calls, 'MATCH (n) WHERE n.name =~ "(" RETURN n.id') == []
    assert run(calls, 'MATCH (n) WHERE x.name = "q" RETURN n.id') == [(1,), (2,), (3,), (4,)]
    with pytest.raises(InvalidInput):
        execute(calls, 'MATCH (n) WHERE x.name = "q" RETURN n.id', strict=True)


def test_limit_and_projection(calls):
    assert len(run(calls, "MATCH (n:Function) RETURN n.id LIMIT 2")) == 2
    assert len(run(calls, "MATCH (n:Function) RETURN n.id LIMIT 10")) == 3
    assert run(calls, "MATCH (n:Function) RETURN n.missing") == [(None,)] * 3
    assert run(calls, 'MATCH (n {lang: "rust"}) RETURN n.name') == [("helper",), ("main",)]
    assert execute(calls, "MATCH (n:Function) RETURN z").frame.count() == 0
    assert execute(calls, "MATCH (a)-[:CALLS]->(b) RETURN *").frame.columns == ["a", "b", "edge_id"]


def test_edges(calls):
    assert run(calls, "MATCH (a)-[:CALLS]->(b) RETURN a.id, b.id") == [(1, 2), (2, 3)]
    assert run(calls, "MATCH (a)<-[:CALLS]-(b) RETURN a.id, b.id") == [(2, 1), (3, 2)]
    assert run(calls, "MATCH (a)-[:CALLS]-(b) RETURN a.id, b.id") == [(1, 2), (2, 1), (2, 3), (3, 2)]
    assert run(calls, "MATCH (a:File)-[:CONTAINS]->(b)-[:CALLS]->(c) RETURN a.id, c.id") == [(4, 2)]
    assert run(calls, 'MATCH (a)-[:CALLS]->(b)-[:CALLS]->(c) WHERE b.name = "helper" RETURN a.id, b.name, c.id') == [(1, "helper", 3)]


def test_depth(calls):
    assert run(calls, 'MATCH (a:Function)-[:CALLS*1..2]->(b) WHERE a.name = "main" RETURN b.name') == [("helper",), ("util",)]
    assert run(calls, 'MATCH (a:Function)-[:CALLS*2]->(b) WHERE a.name = "main" RETURN b.name') == [("helper",), ("util",)]
    assert run(calls, 'MATCH (a:Function)-[:CALLS*2]->(b) WHERE a.name = "main" RETURN b.name', min_depth=True) == [("util",)]


def test_star(star):
    assert run(star, "MATCH (r)-[:OWNS]->(x), (r)-[:LIKES]->(y) RETURN x.name, y.name") == [("a", "c"), ("b", "c")]
    assert run(star, "MATCH (r)-[:OWNS]->(x), (r)-[:TAGS]->(x) RETURN x.name") == [("a",)]
    assert len(run(star, "MATCH (h:Hub), (t:Thing) RETURN h.id, t.id")) == 3
    assert run(star, 'MATCH (r:Hub)-[:OWNS]->(x {colour: "red"}) RETURN x.id') == [(2,)]


def test_inline_property_from_either_source(star):
    g = star.add_property(3, "mark", "yes")
    assert run(g, 'MATCH (r)-[:OWNS]->(x {mark: "yes"}) RETURN x.id') == [(3,)]


def test_writes(calls):
    made = execute(calls, 'CREATE (n:Function {name: "fresh", lang: "go"})')
    assert made.graph.get_node(made.info["id"])["name"] == "fresh"
    linked = execute(made.graph, "CREATE (1)-[:CALLS]->(5)")
    assert linked.graph.get_edge(linked.info["id"])["to_id"] == 5
    changed = execute(calls, 'MATCH (n:Function) WHERE n.lang = "rust" SET n.lang = "zig"')
    assert changed.info == {"updated": 2}
    assert run(changed.graph, 'MATCH (n) WHERE n.lang = "zig" RETURN n.id') == [(1,), (2,)]
    assert run(changed.graph, "MATCH (n) WHERE n.size > 6 RETURN n.id") == [(1,), (3,)]
    gone = execute(calls, 'MATCH (n) WHERE n.name = "helper" DELETE n')
    assert gone.info == {"deleted": 1} and gone.graph.edges.count() == 1


def test_syntax_errors():
    for bad in ("FETCH (n)", "MATCH n", "MATCH (n) WHERE n.a ~ 3", "CREATE (1)-[:X]-(2)", "MATCH (n) RETURN n.id extra"):
        with pytest.raises(QuerySyntax):
            syntax.parse(bad)
    call = syntax.parse('CALL db.index.vector.queryNodes("v", 3, [1, 0.5, -2])')
    assert call == syntax.VectorQuery("v", 3, (1.0, 0.5, -2.0))


def test_triples_patterns_chains(calls, star):
    assert values(M.match_triples(calls, M.TriplePattern("CALLS", start_label="Function"))) == [(1, 1, 2), (2, 2, 3)]
    with pytest.raises(InvalidInput):
        M.match_triples(calls, M.TriplePattern(" "))
    assert M.edge_exists(calls, 1, 2, "CALLS") and M.edge_id(calls, 1, 3, "CALLS") is None
    assert values(M.execute_pattern(calls, 4, [M.LegPattern(edge_type="CONTAINS"), M.LegPattern(edge_type="CALLS")])) == [((4, 1, 2),)]
    assert values(M.chain_query(calls, 1, [])) == [(1,)]
    assert values(M.chain_query(calls, 1, [("outgoing", "CALLS"), ("outgoing", "CALLS")])) == [(3,)]
    assert [leg.edge_type for leg in M.parse_dsl("A->B*2->C*x")] == ["A", "B", "B", "C"]
    scored = M.reason(calls, calls.nodes.where("id = 4"), [M.LegPattern(edge_type="CONTAINS")], 2)
    assert values(scored) == [((4, 1), 2, 6)]
