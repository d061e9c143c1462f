"""Dumps, snapshots and backups: tagged JSON lines, and Parquet folders with a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandgraph.errors import InvalidInput
from strandgraph.graph import EDGES, LABELS, NODES, PROPERTIES, Graph

FORMAT = 1
_RECORD = "type string, id long, kind string, name string, file_path string, from_id long, to_id long, edge_type string, entity_id long, label string, key string, value string, data string"


def dump_lines(g: Graph) -> DataFrame:
    """(value): one JSON record a row, tagged entity, edge, label or property."""

    def record(frame: DataFrame, tag: str) -> DataFrame:
        return frame.select(F.to_json(F.struct(F.lit(tag).alias("type"), *[F.col(c) for c in frame.columns])).alias("value"))

    return record(g.nodes, "entity").union(record(g.edges, "edge")).union(record(g.labels, "label")).union(record(g.properties, "property"))


def dump(g: Graph, path: str) -> None:
    dump_lines(g).write.mode("overwrite").text(path)


def of_lines(lines: DataFrame) -> Graph:
    """A graph from the records of a dump."""
    rows = lines.select(F.from_json("value", _RECORD).alias("r")).select("r.*")

    def pick(tag: str, schema: str) -> DataFrame:
        names = [part.strip().split(" ")[0] for part in schema.split(",")]
        return rows.where(F.col("type") == tag).select(*names)

    return Graph.of(pick("entity", NODES), pick("edge", EDGES), pick("label", LABELS), pick("property", PROPERTIES))


def load(spark: SparkSession, path: str) -> Graph:
    return of_lines(spark.read.text(path))


def save(g: Graph, path: str) -> dict:
    """Write four Parquet tables, then a manifest with their counts and checksums; nodes are partitioned by kind."""
    g.nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")
    g.extra_labels.write.mode("overwrite").parquet(f"{path}/labels")
    g.properties.write.mode("overwrite").parquet(f"{path}/properties")
    facts = {"format": FORMAT, "version": g.version, **_facts(open_saved(g.spark, path))}
    g.spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return facts


backup = snapshot_export = save


def _facts(g: Graph) -> dict:
    out = {}
    for name, frame in (("nodes", g.nodes), ("edges", g.edges)):
        columns = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(frame.columns)]
        row = frame.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        out[name], out[f"{name}_checksum"] = row["n"], str(row["h"])
    return out


def open_saved(spark: SparkSession, path: str) -> Graph:
    nodes = spark.read.schema("id long, name string, file_path string, data string, kind string").parquet(f"{path}/nodes").select("id", "kind", "name", "file_path", "data")
    edges = spark.read.schema("id long, from_id long, to_id long, data string, edge_type string").parquet(f"{path}/edges").select("id", "from_id", "to_id", "edge_type", "data")
    return Graph.of(nodes, edges, spark.read.schema(LABELS).parquet(f"{path}/labels"), spark.read.schema(PROPERTIES).parquet(f"{path}/properties"))


def restore(spark: SparkSession, path: str) -> Graph:
    """A saved graph, its counts and checksums checked against the manifest."""
    facts = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if facts["format"] > FORMAT:
        raise InvalidInput(f"format {facts['format']} is newer than {FORMAT}")
    g = open_saved(spark, path)
    now = _facts(g)
    if bad := [k for k, v in now.items() if facts[k] != v]:
        raise InvalidInput(f"the backup is damaged: {', '.join(bad)} differ")
    return g


snapshot_import = restore
