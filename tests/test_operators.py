"""Distributed operators against the kernels and exact answers."""

import random

import pytest
from helpers import graph_of, values
from pyspark.sql import functions as F

from strandgraph.errors import CycleDetected, InvalidInput, NotFound
from strandgraph.operators import community, compare, component, cuts, flow, local, rank, reach, slicing, trace, traverse


def random_graph(spark, seed, n=12, p=0.15):
    r = random.Random(seed)
    edges = [(a, b) for a in range(1, n + 1) for b in range(1, n + 1) if r.random() < p]
    return graph_of(spark, range(1, n + 1), edges), local.adjacency(range(1, n + 1), edges)


@pytest.fixture(scope="module")
def diamond(spark):
    return graph_of(spark, range(1, 5), [(1, 2), (1, 3), (2, 4), (3, 4), (1, 4)])


def test_traversals(diamond):
    assert values(traverse.bfs(diamond, 1, 5)) == [(1, 0), (2, 1), (3, 1), (4, 1)]
    assert values(traverse.k_hop(diamond, 1, 0)) == []
    assert values(traverse.bfs_frontier(diamond, 1, 1)) == [(2,), (3,), (4,)]
    assert values(traverse.bfs_filtered(diamond, 1, 3, [])) == []
    assert traverse.shortest_path(diamond, 1, 4) == [1, 4] and traverse.shortest_path(diamond, 4, 1) is None
    assert traverse.shortest_path(diamond, 1, 4, types=[]) is None
    assert traverse.has_path(diamond, 2, 2) and not traverse.has_path(diamond, 4, 1)
    with pytest.raises(NotFound):
        traverse.shortest_path(diamond, 1, 77)
    assert [r["id"] for r in traverse.dfs_traversal(diamond, 1).collect()] == local.dfs_order(local.adjacency([], [(1, 2), (1, 3), (2, 4), (3, 4), (1, 4)]), 1)[1:]


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_path_parent_is_first_discoverer(spark, seed):
    g, adj = random_graph(spark, seed)
    parent, order, todo = {1: None}, [1], [1]
    for n in todo:
        for b in adj[n]:
            if b not in parent:
                parent[b] = n
                todo.append(b)
    got = {r["id"]: list(r["path"]) for r in traverse.shortest_paths(g, 1).collect()}
    assert got.keys() == parent.keys()
    for t in parent:
        path, at = [], t
        while at is not None:
            path.append(at)
            at = parent[at]
        assert got[t] == path[::-1]


@pytest.mark.parametrize("seed", [3, 4])
def test_components(spark, seed):
    g, adj = random_graph(spark, seed, p=0.09)
    both = local.adjacency(adj, [(a, b) for a, bs in adj.items() for b in bs] + [(b, a) for a, bs in adj.items() for b in bs])
    assert values(component.connected_components(g)) == sorted((n, min(local.reach(both, [n]))) for n in adj)
    want = sorted((n, c[0]) for c in local.strong_components(adj) for n in c)
    got = component.strongly_connected_components(g)
    assert values(got) == want
    members, edges = component.collapse_components(g, got)
    name = dict(want)
    assert values(edges) == sorted({(name[a], name[b]) for a, bs in adj.items() for b in bs if name[a] != name[b]})
    assert members.count() == len(adj)


def test_dag(diamond, spark):
    assert values(reach.topological_levels(diamond)) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert values(reach.transitive_reduction(diamond)) == [(1, 2), (1, 3), (2, 4), (3, 4)]
    assert values(reach.transitive_closure(diamond)) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 2), (2, 4), (3, 3), (3, 4), (4, 4)]
    assert values(reach.transitive_closure(diamond, max_depth=0)) == [(n, n) for n in range(1, 5)]
    found = reach.critical_path(diamond)
    assert found["length"] == 2 and found["path"] == [1, 2, 4]
    assert values(reach.slack(diamond, found)) == [(1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0)]
    with pytest.raises(InvalidInput):
        reach.critical_path(diamond, F.lit(float("nan")))
    with pytest.raises(CycleDetected) as e:
        reach.topological_levels(graph_of(spark, [1, 2, 3], [(1, 2), (2, 3), (3, 2)]))
    assert set(e.value.cycle) == {2, 3} and e.value.cycle[0] == e.value.cycle[-1]
    assert values(reach.unreachable_from(diamond, 2)) == [(1,), (3,)]
    assert values(reach.unreachable_from(diamond, 99)) == [(1,), (2,), (3,), (4,)]
    assert values(reach.impact_radius(diamond, 1, max_distance=1.0)) == [(1, 0.0, False), (2, 1.0, True), (3, 1.0, True), (4, 1.0, True)]


def test_ranks(spark):
    g = graph_of(spark, [1, 2, 3], [(1, 2), (2, 3), (3, 1)])
    scores = [r["score"] for r in rank.pagerank(g, rounds=7).collect()]
    assert all(abs(s - 1 / 3) < 1e-12 for s in scores)
    g, adj = random_graph(spark, 5)
    n = len(adj)
    p = dict.fromkeys(adj, 1 / n)
    for _ in range(6):
        lost = sum(p[v] for v in adj if not adj[v])
        new = dict.fromkeys(adj, 0.15 / n + 0.85 * lost / n)
        for a, bs in adj.items():
            for b in bs:
                new[b] += 0.85 * p[a] / len(bs)
        p = new
    assert all(abs(r["score"] - p[r["id"]]) < 1e-12 for r in rank.pagerank(g, rounds=6).collect())
    want = dict.fromkeys(adj, 0.0)
    for s in adj:
        for v, x in local.dependency(adj, s).items():
            want[v] += x
    assert all(abs(r["score"] - want[r["id"]]) < 1e-9 for r in rank.betweenness(g).collect())
    assert values(rank.nodes_by_degree(graph_of(spark, [1, 2, 3], [(1, 2), (1, 2)]))) == [(1, 2), (2, 2), (3, 0)]


def test_communities_and_cycles(spark):
    g = graph_of(spark, range(1, 8), [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4)])
    assert values(community.louvain(g)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7)]
    adj = local.adjacency(range(1, 8), [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4)])
    assert dict(values(community.label_propagation(g, 5))) == local.label_propagation(adj, 5)
    assert values(community.cycles(g), "cycle") == [((1, 2, 3, 1),), ((4, 5, 6, 4),)]
    basis = community.cycle_basis(g)
    assert community.has_cycles(basis) and values(community.cyclic_nodes(basis)) == [(n,) for n in range(1, 7)]
    assert community.label_propagation_synchronous(g, 3).count() == 7


def test_flow_and_slices(spark):
    g = graph_of(spark, range(1, 7), [(1, 2), (1, 6), (2, 3), (2, 4), (3, 5), (4, 5), (5, 6)])
    cfg = flow.from_graph(g)
    assert dict(values(flow.immediate_dominators(cfg), "id", "idom"))[5] == 2
    assert (5, 6) in values(flow.post_dominators(cfg), "id", "post_dominator")
    with pytest.raises(Exception, match="no exit"):
        flow.post_dominators(flow.from_graph(graph_of(spark, [1, 2], [(1, 2), (2, 1)]))).collect()
    back = values(slicing.backward_slice(g, 5), "id")
    assert back == [(1,), (2,), (3,), (4,), (5,)]
    assert values(slicing.forward_slice(g, 5), "id") == [(5,), (6,)]
    assert values(flow.enumerate_paths(cfg, ends=[6]), "path") == [((1, 2, 3, 5, 6),), ((1, 2, 4, 5, 6),), ((1, 6),)]
    for rule in (flow.DOMINANCE, flow.CONTROL, flow.LOOPS):
        assert flow.enumerate_paths(cfg, ends=[6], prune=rule).count() >= 1


def test_taint(spark):
    g = graph_of(spark, [(1, "N", "a", '{"kind": "user_input"}'), (2, "N", "b"), (3, "N", "c", '{"operation": "execute"}'), (4, "N", "d", '{"taint": "source"}')], [(1, 2), (2, 3)])
    sources, sinks = slicing.discover(g)
    assert values(sources) == [(1,), (4,)] and values(sinks) == [(3,)]
    tainted, pairs = slicing.taint_forward(g, sources, sinks)
    assert values(tainted) == [(1,), (2,), (3,), (4,)] and values(pairs) == [(1, 3)]
    assert values(slicing.taint_backward(g, 3, sources)) == [(1,)]
    assert values(slicing.sink_reachability(g, sources, sinks)) == [(3, 1)]


def test_cuts(spark):
    g = graph_of(spark, range(1, 7), [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (4, 6), (5, 6)])
    assert cuts.min_st_cut(g, 1, 6)["size"] == 2
    assert cuts.min_vertex_cut(g, 1, 6) == {"size": 1, "separator": [4]}
    assert cuts.min_vertex_cut(g, 1, 2)["size"] is None
    with pytest.raises(InvalidInput):
        cuts.partition_kway(g, 1)
    parts = cuts.partition_bfs_level(g, 2)
    assert parts.count() == 6 and cuts.cut_edges(g, parts).count() > 0
    assert cuts.partition_greedy(g, parts).count() == 6


@pytest.mark.parametrize("shape", [compare.TRIANGLE, compare.CHAIN3, compare.DIAMOND])
def test_subgraphs(spark, shape):
    g, adj = random_graph(spark, 8, n=9, p=0.25)
    pattern = local.adjacency(range(shape.n), shape.edges)
    want = sorted(tuple(m[i] for i in range(shape.n)) for m in local.embeddings(pattern, adj, 100_000))
    assert values(compare.find_subgraphs(g, shape)) == want


def test_compare_and_rewrite(spark):
    a = graph_of(spark, [1, 2, 3], [(1, 2), (2, 3)])
    b = a.delete_node(3)
    assert values(compare.graph_diff(a, b), "change", "element") == [("removed", "edge"), ("removed", "node")]
    report = compare.validate_refactor(a, b)
    assert not report["safe"] and report["nodes_removed"] == 1
    assert compare.structural_similarity(a, a)["isomorphic"]
    rule = compare.Rule(compare.CHAIN3, (0, 2), new_edges=((0, 2, "DIRECT"),))
    new, facts = compare.rewrite(a, rule)
    assert facts["matches"] == 1 and values(new.edges, "from_id", "to_id", "edge_type") == [(1, 3, "DIRECT")]


def test_races(spark):
    rows = [(1, 1, 5, "W"), (2, 2, 5, "R"), (3, 2, 6, "R"), (4, 1, 6, "R"), (5, 1, 5, "R")]
    events = spark.createDataFrame(rows, "event_id long, thread_id long, location long, op string")
    assert values(trace.races(trace.local_clocks(events))) == [(5, 1, 2)]


def test_result_helpers(spark):
    import pytest

    from pyspark.sql import functions as F
    from strandgraph.errors import InvalidInput
    from strandgraph.operators import community, flow, reach, traverse

    diamond = graph_of(spark, [1, 2, 3, 4, 5], [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)])
    path = reach.critical_path(diamond)
    assert reach.bottlenecks(path) == {1, 2, 4, 5} and reach.is_bottleneck(path, 2) and not reach.is_bottleneck(path, 3)
    assert reach.toposort(diamond) == [1, 2, 3, 4, 5] and not reach.is_cyclic(diamond)
    assert list(traverse.dfs_iter(diamond, 1))[0] == 1 and set(traverse.dfs_iter(diamond, 1)) == {1, 2, 3, 4, 5}
    with pytest.raises(InvalidInput):
        reach.impact_radius(diamond, 1, weight=F.lit(-1.0))
    ring = graph_of(spark, [1, 2, 3, 4], [(1, 2), (2, 3), (3, 1), (3, 4)])
    assert reach.is_cyclic(ring)
    basis = community.cycle_basis(ring)
    assert community.is_cyclic(basis, 2) and not community.is_cyclic(basis, 4) and community.cyclic_component_count(basis) == 1
    assert "1 cycle(s)" in community.explain_cycle(basis, 1) and "not part" in community.explain_cycle(basis, 4)
    cfgs = spark.createDataFrame([(1, a, b) for a, b in [(1, 2), (1, 3), (2, 4), (3, 4)]], "cfg long, src long, dst long")
    found = flow.control_dependence_from_exit(cfgs, 4)
    assert {r["id"] for r in flow.controlled_by(found, 1).collect()} == {2, 3} and flow.controls(found, 1, 2) and flow.depends_on(found, 3, 1)
    assert {r["id"] for r in flow.dependencies_of(found, 2).collect()} == {1}


def test_batch_search_against_brute_force(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F
    from strandgraph.operators import vector

    monkeypatch.setattr(vector, "QUERY_BLOCK", 4)
    r = random.Random(8)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(3)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, embedding array<float>")
    norm = lambda v: sum(x * x for x in v) ** 0.5
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    metrics = {
        "cosine": lambda a, b: (1 - dot(a, b) / (norm(a) * norm(b))) / 2 if norm(a) * norm(b) else None,
        "euclidean": lambda a, b: norm([x - y for x, y in zip(a, b, strict=True)]),
        "dot": lambda a, b: -dot(a, b),
        "manhattan": lambda a, b: sum(abs(x - y) for x, y in zip(a, b, strict=True)),
    }
    for metric, of in metrics.items():
        got = {}
        for x in vector.knn_join(frame.where("id % 6 = 0"), frame, 5, metric).collect():
            got.setdefault(x["query_id"], []).append((x["rank"], round(x["distance"], 9)))
        for q, v in rows[::6]:
            want = sorted(round(dist, 9) for i, u in rows if i != q and (dist := of(v, u)) is not None)[:5]
            assert [d for _, d in sorted(got.get(q, []))] == want, metric


def test_numbered_after_a_shuffle(spark):
    from pyspark.sql import functions as F
    from strandgraph.graph import numbered

    frame = spark.range(1000).withColumn("k", F.col("id") % 7).repartition(5, "k").select("k")
    ids = [r["id"] for r in numbered(frame, 11).collect()]
    assert sorted(ids) == list(range(11, 1011))
    assert numbered(frame.where("false"), 5).count() == 0
