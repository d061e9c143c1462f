"""Small graphs by hand."""

from strandgraph.graph import EDGES, NODES, Graph


def graph_of(spark, nodes, edges):
    """``nodes``: ids, or (id, kind, name, data); ``edges``: (from, to) or (from, to, type)."""
    rows = [(n, "Node", f"n{n}", None, "{}") if isinstance(n, int) else (n[0], n[1], n[2], None, n[3] if len(n) > 3 else "{}") for n in nodes]
    lines = [(i + 1, e[0], e[1], e[2] if len(e) > 2 else "LINK", "{}") for i, e in enumerate(edges)]
    return Graph.of(spark.createDataFrame(rows, NODES), spark.createDataFrame(lines, EDGES))


def values(frame, *columns):
    columns = columns or tuple(frame.columns)
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in (r[c] for c in columns)) for r in frame.collect())
