"""Exact top-k search by pivot-table elimination.

A vector component x becomes floor(1024 * x); the score is the integer inner
product.  With d the Euclidean distance, <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2,
and |d(q, p) - d(x, p)| is a lower bound of d(q, x) for every pivot p, so the
largest of them bounds the score from above.  Candidates are evaluated in the
order of this bound until no bound reaches the k-th score found, ties included,
so the result is exact.

The vectors are written once with their row number, squared norm and distances
to the pivots.  The queries are sent out in blocks of at most ``QUERY_BYTES``;
each block is one scan whose k best a task are written; the candidates stay
where they are and are never shuffled.  Pivots, and the first threshold of each
query, come from a bounded sample.

Vectors whose components lie beyond ``PLAIN`` (their products could leave 64
bits, or the bounds lose precision) take no part in this arithmetic: such
candidates, and such queries, are scored with Python's integers.  Candidates
are ranked by an order-preserving key of the exact score.

Defined results: vectors that are null, empty, or hold a null or non-finite
component take no part; a candidate of another length than the query's is none;
every row is a query or candidate of its own, also if it shares its vec_id with
others; ties go to the smaller vec_id; a score beyond 64 bits is given as the
nearest long, but ranked by its own value; an empty table, or one without
queries, gives an empty result; only the id and vector columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandgraph.llm.common import WorkTables, map_batches

SCALE = 1024
QUERY_BYTES, SAMPLE, PIVOTS, STEP = 4 << 20, 2048, 48, 256
#: Largest size of a scaled component in 64-bit arithmetic; squared norms of up to 2^21 components stay below 2^61.
PLAIN = 1 << 20
LONGEST_PLAIN = 1 << 21
LONG = (-(1 << 63), (1 << 63) - 1)
FOUND = "query_row long, query_id long, vec_id long, score long, key binary"


def sound_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, v, plain): the vectors that take part, and whether 64-bit arithmetic is safe for them."""
    x_sound = lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))
    return (
        table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
        .where(F.forall("v", x_sound))
        .select(
            F.monotonically_increasing_id().alias("row"),
            "vec_id",
            "v",
            (F.forall("v", lambda x: F.abs(x) < PLAIN / SCALE) & (F.size("v") <= LONGEST_PLAIN)).alias("plain"),
        )
    )


def scaled(v) -> list[int]:
    """floor(1024 * x) of finite doubles of any size, exactly."""
    return [math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE for x in v]


def order_key(score: int) -> bytes:
    """Bytes that sort as the integers do."""
    size = (abs(score).bit_length() + 7) // 8
    body = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\x01" + body if score >= 0 else b"\x00" + bytes(255 - c for c in body)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each next pivot is the sample vector farthest from the ones before."""
    if not len(sample):
        return sample
    picked, gap = [0], np.full(len(sample), np.inf)
    while len(picked) < min(count, len(sample)):
        gap = np.minimum(gap, ((sample - sample[picked[-1]]).astype(float) ** 2).sum(axis=1))
        if gap.max() == 0:
            break
        picked.append(int(gap.argmax()))
    return sample[picked]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    a, b = x.astype(float), pivots.astype(float)
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T))


class Best:
    """The k best (score, id) of each query so far, and the score that a candidate must reach."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.score = [np.zeros(0, np.int64) for _ in range(n)]
        self.id = [np.zeros(0, np.int64) for _ in range(n)]

    def add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.floor[i]
        s, v = np.concatenate([self.score[i], score[keep]]), np.concatenate([self.id[i], ids[keep]])
        order = np.lexsort((v, -s))[: self.k]
        self.score[i], self.id[i] = s[order], v[order]
        if len(order) == self.k:
            self.floor[i] = max(self.floor[i], s[order[-1]])


def search_block(q_rows, q, q_table, q_norm, x_rows, x_ids, x, x_table, x_norm, best: Best) -> None:
    """Evaluate one block of candidates for every query, in bound order, until the bound rules out the rest."""
    for i in range(len(q)):
        gap = np.abs(x_table - q_table[i]).max(axis=1)
        top = (q_norm[i] + x_norm - gap * gap) / 2
        top += 1e-6 * (q_norm[i] + x_norm) + 1  # rounding must not rule out a candidate
        if len(top) > 4 * STEP:
            open_ = np.flatnonzero(top >= best.floor[i])
            order = open_[np.argsort(-top[open_], kind="stable")]
        else:
            order = np.argsort(-top, kind="stable")
        for at in range(0, len(order), STEP):
            part = order[at : at + STEP]
            part = part[top[part] >= best.floor[i]]
            if not len(part):
                break
            part = part[x_rows[part] != q_rows[i]]
            best.add(i, x[part] @ q[i], x_ids[part])


def matrix(column: pa.Array, wanted: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scaled rows) of the ``wanted`` vectors of one length."""
    lists = column.cast(pa.large_list(pa.float64()))
    offsets = lists.offsets.to_numpy()
    at = np.flatnonzero(wanted & (np.diff(offsets) == size))
    return at, np.floor(lists.values.to_numpy()[offsets[:-1][at][:, None] + np.arange(size)] * SCALE).astype(np.int64)


def with_table(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with the squared norm and the pivot distances of the plain ones."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        pivots = sent.value
        for batch in batches:
            norm, table = [None] * batch.num_rows, [None] * batch.num_rows
            plain = batch.column("plain").to_numpy(zero_copy_only=False)
            for size in set(np.diff(batch.column("v").offsets.to_numpy())[plain].tolist()):
                at, x = matrix(batch.column("v"), plain, size)
                d = distances(x, pivots[size]) if size in pivots else np.zeros((len(x), 1))
                for i, n, row in zip(at, (x.astype(float) ** 2).sum(axis=1), d, strict=True):
                    norm[i], table[i] = n, row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm, pa.float64()), pa.array(table, pa.list_(pa.float64()))], [*batch.schema.names, "norm", "table"])

    return map_batches(vectors, run, "row long, vec_id long, v array<double>, plain boolean, norm double, table array<double>")


def top_k(table: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for every row whose id is divisible by ``every``."""
    spark = table.sparkSession
    work = WorkTables(spark, "topk")
    vectors, raw = work.save(sound_vectors(table, id_col, vector_col))
    sample: dict[int, list] = {}
    for r in vectors.where("plain").orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).collect():
        sample.setdefault(len(r["v"]), []).append((r["row"], scaled(r["v"])))
    arrays = {size: (np.array([r for r, _ in rows]), np.array([v for _, v in rows], dtype=np.int64)) for size, rows in sample.items()}
    pivots = {size: choose_pivots(rows, PIVOTS) for size, (_, rows) in arrays.items()}
    stored, _ = work.save(with_table(vectors, pivots))
    work.drop(raw)
    queries = stored.where(F.col("vec_id") % every == 0)
    total = queries.agg(F.sum(F.size("v") + PIVOTS).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(2 * 8 * total / QUERY_BYTES)) if 8 * total > QUERY_BYTES else 1
    found = []
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "vec_id", "v", "plain").collect()
        if rows:
            found.append(work.save(_search(stored, rows, arrays, pivots, k))[1])
    best = spark.read.schema(FOUND).parquet(*found) if found else spark.createDataFrame([], FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("key"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(stored: DataFrame, rows: list, arrays: dict, pivots: dict, k: int) -> DataFrame:
    """Each task's k best candidates of every query of one block."""
    plain: dict[int, tuple] = {}
    for size in {len(r["v"]) for r in rows if r["plain"]}:
        mine = [r for r in rows if r["plain"] and len(r["v"]) == size]
        q = np.array([scaled(r["v"]) for r in mine], dtype=np.int64)
        q_rows = np.array([r["row"] for r in mine], dtype=np.int64)
        floor = np.full(len(q), np.iinfo(np.int64).min)
        if size in arrays:
            s_rows, s = arrays[size]
            for at in range(0, len(q), 256):
                for i, row in enumerate(q[at : at + 256] @ s.T):
                    row = row[s_rows != q_rows[at + i]]
                    if len(row) >= k:
                        floor[at + i] = np.partition(row, len(row) - k)[len(row) - k]
        plain[size] = (q_rows, np.array([r["vec_id"] for r in mine], dtype=np.int64), q, floor)
    # All queries meet the wide candidates, and the wide queries all candidates.
    exact: dict[int, list] = {}
    for r in rows:
        exact.setdefault(len(r["v"]), []).append((r["row"], r["vec_id"], list(r["v"]), r["plain"]))
    sent = stored.sparkSession.sparkContext.broadcast((plain, pivots, exact))

    def run(batches):
        plain, pivots, exact = sent.value
        state = {}
        for size, (q_rows, _, q, floor) in plain.items():
            q_table = distances(q, pivots[size]) if size in pivots else np.zeros((len(q), 1))
            state[size] = (q_rows, q, q_table, (q.astype(float) ** 2).sum(axis=1), Best(len(q), k, floor))
        wide: dict[tuple[int, int], list] = {}
        integers: dict[int, list] = {}  # made when a wide vector first asks for them
        some_wide = any(not p for found in exact.values() for *_, p in found)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                piece = batch.slice(start, 4096)
                is_plain = piece.column("plain").to_numpy(zero_copy_only=False)
                row_ids, ids = piece.column("row").to_numpy(), piece.column("vec_id").to_numpy()
                for size, (q_rows, q, q_table, q_norm, best) in state.items():
                    at, x = matrix(piece.column("v"), is_plain, size)
                    if len(at):
                        lists = piece.column("table").cast(pa.large_list(pa.float64()))
                        width = q_table.shape[1]
                        x_table = lists.values.to_numpy()[lists.offsets.to_numpy()[:-1][at][:, None] + np.arange(width)]
                        search_block(q_rows, q, q_table, q_norm, row_ids[at], ids[at], x, x_table, piece.column("norm").to_numpy(zero_copy_only=False)[at].astype(float), best)
                for i in range(piece.num_rows) if some_wide else np.flatnonzero(~is_plain):
                    v = piece.column("v")[int(i)].as_py()
                    if len(v) not in integers:
                        integers[len(v)] = [(row, vec_id, scaled(u), p) for row, vec_id, u, p in exact.get(len(v), ())]
                    mine = [e for e in integers[len(v)] if e[0] != row_ids[i] and not (e[3] and is_plain[i])]
                    if mine:
                        x = scaled(v)
                        for row, vec_id, q, _ in mine:
                            held = wide.setdefault((row, vec_id), [])
                            held.append((-sum(a * b for a, b in zip(q, x, strict=True)), int(ids[i])))
                            if len(held) > 4 * k:
                                held.sort()
                                del held[k:]
        out = [(row, q_id, x_id, -minus) for (row, q_id), held in wide.items() for minus, x_id in sorted(held)[:k]]
        for size, (q_rows, *_, best) in state.items():
            for i, (row, q_id) in enumerate(zip(q_rows.tolist(), plain[size][1].tolist(), strict=True)):
                out += [(row, q_id, x_id, score) for x_id, score in zip(best.id[i].tolist(), best.score[i].tolist(), strict=True)]
        if out:
            q_row, q_id, x_id, score = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_row, pa.int64()), pa.array(q_id, pa.int64()), pa.array(x_id, pa.int64()), pa.array([min(max(s, LONG[0]), LONG[1]) for s in score], pa.int64()), pa.array(map(order_key, score), pa.binary())],
                ["query_row", "query_id", "vec_id", "score", "key"],
            )

    return map_batches(stored, run, FOUND)


ORACLE = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * x.e[i])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 100 = 0 AND q.rid <> x.rid AND len(q.e) = len(x.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""
