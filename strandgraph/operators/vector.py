"""Vector search: exact k-nearest neighbours for four metrics, id filters, a registry of indexes.

An index is a Parquet-backed or lazy frame; search is one scan that computes
the distance of every vector and a top-k that Spark keeps per task, so there is
nothing to build, and results are exact rather than approximate.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandgraph.errors import InvalidInput, NotFound
from strandgraph.functions.vectors import METRICS, distance, literal
from strandgraph.plans.fixpoint import WorkTables

#: Queries of a batch search that are sent out at once.
QUERY_BLOCK = 1024
SCHEMA = "id long, embedding array<float>, metadata string"


@dataclass(frozen=True)
class IndexConfig:
    """Of an index; the graph parameters are kept for callers but exact search does not use them."""

    dimension: int = 768
    metric: str = "cosine"
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    max_layers: int = 16

    def __post_init__(self):
        if self.dimension <= 0 or self.m <= 0 or self.ef_construction < self.m or self.ef_search <= 0 or self.max_layers <= 0:
            raise InvalidInput("dimension, m, ef_search and max_layers must be positive, ef_construction at least m")
        if self.metric not in METRICS:
            raise InvalidInput(f"unknown metric {self.metric!r}")


@dataclass(frozen=True)
class VectorIndex:
    name: str
    config: IndexConfig
    vectors: DataFrame

    def _checked(self, vector: Sequence[float]) -> Sequence[float]:
        if len(vector) != self.config.dimension:
            raise InvalidInput(f"dimension {len(vector)}, index has {self.config.dimension}")
        return vector

    def insert(self, vectors: Sequence[tuple[Sequence[float], dict | None]]) -> tuple[VectorIndex, list[int]]:
        """Append vectors; ids follow the largest one, from 1."""
        first = (self.vectors.agg(F.max("id")).first()[0] or 0) + 1
        rows = [(first + i, [float(x) for x in self._checked(v)], json.dumps(meta or {})) for i, (v, meta) in enumerate(vectors)]
        more = self.vectors.sparkSession.createDataFrame(rows, SCHEMA)
        return VectorIndex(self.name, self.config, self.vectors.unionByName(more)), [r[0] for r in rows]

    def search(self, query: Sequence[float], k: int, allow: DataFrame | None = None, deny: DataFrame | None = None) -> DataFrame:
        """(id, distance), nearest first, ties by id; vectors without a distance (zero norm under cosine) are left out."""
        self._checked(query)
        return knn(self.vectors, query, k, self.config.metric, allow, deny)

    def get(self, vector_id: int) -> dict:
        row = self.vectors.where(F.col("id") == vector_id).first()
        if row is None:
            raise NotFound(f"vector {vector_id}")
        return row.asDict()

    def delete(self, vector_id: int) -> VectorIndex:
        return VectorIndex(self.name, self.config, self.vectors.where(F.col("id") != vector_id))

    def count(self) -> int:
        return self.vectors.count()

    def statistics(self) -> dict:
        return {"name": self.name, "vectors": self.count(), **asdict(self.config)}


def knn(vectors: DataFrame, query: Sequence[float], k: int, metric: str, allow: DataFrame | None = None, deny: DataFrame | None = None) -> DataFrame:
    if allow is not None:
        vectors = vectors.join(allow.select("id"), "id", "left_semi")
    if deny is not None:
        vectors = vectors.join(deny.select("id"), "id", "left_anti")
    near = vectors.select("id", distance(metric, F.col("embedding"), literal(query)).alias("distance")).where(F.col("distance").isNotNull())
    return near.orderBy("distance", "id").limit(k)


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, metric: str) -> DataFrame:
    """(query_id, rank, id, distance) for a stated set of query rows against all vectors; a row is no neighbour of its own id.

    The queries go out in blocks of at most QUERY_BLOCK; each block is one scan
    of the vectors, which stay where they are, and only a task's k nearest of
    each query are written and ranked.
    """
    spark, work = vectors.sparkSession, WorkTables(vectors.sparkSession, "knn")
    stated, _ = work.save(queries.select("id", "embedding"))
    blocks = max(1, -(-2 * stated.count() // QUERY_BLOCK)) if stated.count() > QUERY_BLOCK else 1
    schema, paths = "query_id long, id long, distance double", []
    for block in range(blocks):
        rows = stated.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()
        sent = spark.sparkContext.broadcast(([r["id"] for r in rows], [list(r["embedding"]) for r in rows]))
        paths.append(work.save(vectors.select("id", "embedding").mapInArrow(_nearest(sent, k, metric), schema))[1])
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    found = spark.read.schema(schema).parquet(*paths)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _nearest(sent, k: int, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = sent.value
        ids, q = np.array(names, dtype=np.int64), np.array(vectors, dtype=np.float64)
        best_d, best_i = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows if len(ids) else 0, 512):
                piece = batch.slice(at, 512)
                x = np.array(piece.column("embedding").to_pylist(), dtype=np.float64)
                here = piece.column("id").to_numpy()
                d = pairwise(metric, q, x)
                d[(ids[:, None] == here) | np.isnan(d)] = np.inf
                best_d, best_i = np.hstack([best_d, d]), np.hstack([best_i, np.tile(here, (len(ids), 1))])
                keep = np.lexsort((best_i, best_d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(best_d, keep, 1), np.take_along_axis(best_i, keep, 1)
        real = np.isfinite(best_d)
        if real.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, real.sum(axis=1))), pa.array(best_i[real]), pa.array(best_d[real])], ["query_id", "id", "distance"])

    return run


def pairwise(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of every query to every vector, as ``functions.vectors.distance`` defines them; NaN: none."""
    if metric == "manhattan":
        return np.stack([np.abs(x - row).sum(axis=1) for row in q])
    if metric == "euclidean":
        return np.stack([np.sqrt(((x - row) ** 2).sum(axis=1)) for row in q])
    dots = np.stack([(x * row).sum(axis=1) for row in q])  # the same for equal vectors wherever they stand
    if metric == "dot":
        return -dots
    with np.errstate(divide="ignore", invalid="ignore"):
        return (1 - dots / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1))) / 2


class IndexRegistry:
    """Named indexes, kept in memory or in a folder of Parquet tables."""

    def __init__(self, spark: SparkSession):
        self.spark, self.indexes = spark, {}

    def __contains__(self, name: str) -> bool:
        return name in self.indexes

    def __getitem__(self, name: str) -> VectorIndex:
        if name not in self.indexes:
            raise NotFound(f"vector index {name}")
        return self.indexes[name]

    def create(self, name: str, config: IndexConfig, vectors: DataFrame | None = None) -> VectorIndex:
        if name in self.indexes:
            raise InvalidInput(f"index {name!r} exists")
        self.indexes[name] = VectorIndex(name, config, vectors if vectors is not None else self.spark.createDataFrame([], SCHEMA))
        return self.indexes[name]

    def replace(self, index: VectorIndex) -> None:
        self.indexes[index.name] = index

    def names(self) -> list[str]:
        return sorted(self.indexes)

    def drop(self, name: str) -> None:
        self[name]
        del self.indexes[name]

    def save(self, name: str, path: str) -> None:
        index = self[name]
        index.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        self.spark.createDataFrame([(json.dumps(asdict(index.config)), name)], "config string, name string").coalesce(1).write.mode("overwrite").json(f"{path}/index")

    def load(self, path: str) -> VectorIndex:
        row = self.spark.read.schema("config string, name string").json(f"{path}/index").first()
        index = VectorIndex(row["name"], IndexConfig(**json.loads(row["config"])), self.spark.read.parquet(f"{path}/vectors"))
        self.indexes[index.name] = index
        return index
