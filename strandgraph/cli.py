"""Command line over a saved graph: ``python -m strandgraph.cli GRAPH command ...``.

Commands that change the graph need ``--write`` and replace the saved folder
after the new one is complete.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from strandgraph.errors import GraphError, InvalidInput
from strandgraph.graph import INCOMING, OUTGOING, Graph
from strandgraph.operators import community, component, flow, rank, reach, traverse
from strandgraph.operators.vector import IndexConfig, IndexRegistry
from strandgraph.plans.planner import execute
from strandgraph.sources import dump


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandgraph")
    p.add_argument("graph", help="folder of a saved graph")
    p.add_argument("--write", action="store_true", help="allow commands that change the graph")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("query").add_argument("text")
    c.add_parser("status")
    c.add_parser("list").add_argument("kind", nargs="?")
    for name in ("bfs", "neighbors"):
        s = c.add_parser(name)
        s.add_argument("id", type=int)
        s.add_argument("--depth", type=int, default=3)
        s.add_argument("--direction", choices=["outgoing", "incoming", "both"], default="outgoing")
    s = c.add_parser("path")
    s.add_argument("start", type=int)
    s.add_argument("end", type=int)
    s = c.add_parser("algo")
    s.add_argument("name", choices=sorted(ALGORITHMS))
    s.add_argument("--entry", type=int)
    s.add_argument("--limit", type=int, default=10)
    c.add_parser("export").add_argument("path")
    c.add_parser("import").add_argument("path")
    s = c.add_parser("insert")
    s.add_argument("kind")
    s.add_argument("name")
    s.add_argument("--data", default="{}")
    s = c.add_parser("index")
    s.add_argument("action", choices=["create", "insert", "search", "delete"])
    s.add_argument("path", help="folder of the index")
    s.add_argument("--vector", help="JSON list of numbers")
    s.add_argument("--dimension", type=int, default=768)
    s.add_argument("--metric", default="cosine")
    s.add_argument("-k", type=int, default=10)
    return p


ALGORITHMS = {
    "pagerank": lambda g, a: rank.pagerank(g).limit(a.limit),
    "betweenness": lambda g, a: rank.betweenness(g).limit(a.limit),
    "components": lambda g, a: component.connected_components(g),
    "scc": lambda g, a: component.strongly_connected_components(g),
    "topo": lambda g, a: reach.topological_levels(g).orderBy("level", "id"),
    "louvain": lambda g, a: community.louvain(g),
    "label-prop": lambda g, a: community.label_propagation(g),
    "cycles": lambda g, a: community.cycles(g, limit=a.limit),
    "dominators": lambda g, a: flow.immediate_dominators(flow.from_graph(g), a.entry),
    "critical-path": lambda g, a: reach.critical_path(g)["distances"],
}
WRITES = ("import", "insert")


def run(spark: SparkSession, argv: list[str], out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    try:
        return _run(spark, a, out)
    except GraphError as e:
        print(f"error: {e}", file=out)
        return 1


def _show(frame: DataFrame, out) -> None:
    for row in frame.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False), file=out)


def _save(g: Graph, path: str) -> None:
    """Write beside the old folder, then swap the names."""
    fs_path = g.spark._jvm.org.apache.hadoop.fs.Path
    dump.save(g, f"{path}.new")
    fs = fs_path(path).getFileSystem(g.spark._jsc.hadoopConfiguration())
    fs.delete(fs_path(f"{path}.old"), True)
    if fs.exists(fs_path(path)):
        fs.rename(fs_path(path), fs_path(f"{path}.old"))
    fs.rename(fs_path(f"{path}.new"), fs_path(path))


def _run(spark: SparkSession, a, out) -> int:
    if a.command in WRITES and not a.write:
        raise InvalidInput("this command changes the graph; add --write")
    if a.command == "import":
        _save(dump.load(spark, a.path), a.graph)
        return 0
    g = dump.open_saved(spark, a.graph)
    if a.command == "query":
        result = execute(g, a.text)
        if result.frame is not None:
            _show(result.frame, out)
        else:
            if not a.write:
                raise InvalidInput("this query changes the graph; add --write")
            _save(result.graph, a.graph)
            print(json.dumps(result.info), file=out)
    elif a.command == "status":
        print(json.dumps(g.introspect()), file=out)
    elif a.command == "list":
        _show(g.nodes_by_kind(a.kind) if a.kind else g.nodes.orderBy("id"), out)
    elif a.command == "bfs":
        _show(traverse.bfs_levels(g, [a.id], a.depth, a.direction).orderBy("level", "id"), out)
    elif a.command == "neighbors":
        for direction in (INCOMING, OUTGOING) if a.direction == "both" else (a.direction,):
            _show(g.neighbors(a.id, direction), out)
    elif a.command == "path":
        print(json.dumps(traverse.shortest_path(g, a.start, a.end)), file=out)
    elif a.command == "algo":
        _show(ALGORITHMS[a.name](g, a), out)
    elif a.command == "export":
        dump.dump(g, a.path)
    elif a.command == "insert":
        new, node = g.add_node(a.kind, a.name, data=json.loads(a.data))
        _save(new, a.graph)
        print(json.dumps({"id": node}), file=out)
    else:
        _index(spark, a, out)
    return 0


def _index(spark: SparkSession, a, out) -> None:
    registry = IndexRegistry(spark)
    if a.action == "create":
        if not a.write:
            raise InvalidInput("this command writes; add --write")
        registry.create("index", IndexConfig(dimension=a.dimension, metric=a.metric))
        registry.save("index", a.path)
        return
    index = registry.load(a.path)
    if a.action == "search":
        _show(index.search(json.loads(a.vector), a.k), out)
        return
    if not a.write:
        raise InvalidInput("this command writes; add --write")
    if a.action == "insert":
        index, ids = index.insert([(json.loads(a.vector), None)])
        index.vectors.write.mode("overwrite").parquet(f"{a.path}/vectors.new")
        _swap(spark, a.path)
        print(json.dumps({"ids": ids}), file=out)
    else:
        path = spark._jvm.org.apache.hadoop.fs.Path(a.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _swap(spark: SparkSession, path: str) -> None:
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(make(f"{path}/vectors"), True)
    fs.rename(make(f"{path}/vectors.new"), make(f"{path}/vectors"))


def main() -> None:
    spark = SparkSession.builder.appName("strandgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    sys.exit(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
