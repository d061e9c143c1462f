"""Shared helpers: Arrow row maps, and the work tables of the engine."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from strandgraph.plans.fixpoint import WorkTables, scope as work_scope

__all__ = ["WorkTables", "fresh", "keeps", "map_batches", "map_rows", "slices", "texts_of", "work_scope"]


#: Rows handled at once in a worker.  Working on slices keeps their python forms small.
SLICE_ROWS = 1000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most SLICE_ROWS rows; empty ones are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


#: Upper bound of an Arrow batch.  The JVM holds a few copies of one for each running task, outside its heap.
BATCH_BYTES = 8 << 20


#: How to drop what the operators keep in a worker from task to task, by module.
_kept: dict[str, list[Callable[[], None]]] = {}


def keeps(owner: str, *drops: Callable[[], None]) -> None:
    """The module ``owner`` keeps things in a worker that ``drops`` remove; they are made again when they are needed."""
    _kept.setdefault(owner, []).extend(drops)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # a C library without it
        return None


def release() -> None:
    """Give freed memory back to the system; the allocators of Arrow and C would hold the most that any batch took, as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


#: The operator that this worker serves.
_serving: str | None = None


def enter(owner: str) -> None:
    """A worker serves one operator after the other; when the next one comes, what the others kept goes."""
    global _serving
    if owner == _serving:
        return
    _serving = owner
    for name, drops in _kept.items():
        if name != owner:
            for drop in drops:
                drop()
    gc.collect()  # caches that call their owner's methods stand in cycles
    release()


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what each took goes back to the system before the next one is read."""
    for batch in batches:
        yield batch
        release()


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, owner: str | None = None) -> DataFrame:
    """``mapInArrow`` with smaller batches: the session's bound is lowered, never raised, and stays lowered for the lazy plan.

    An executor's workers live on between tasks, stages and operators, beside its JVM.  Each holds the tables of one
    operator at a time (``owner``, the module of ``run`` if none is named), and no memory that it has freed.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    owner = owner or run.__module__

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(owner)
        yield from run(released(batches))
        release()

    return df.mapInArrow(task, schema)


def map_rows(df: DataFrame, build: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``build()`` once per task, then its result to every slice of the Arrow batches.

    ``build`` loads what a worker needs (vocabularies, weights), so a retried
    task on another executor starts from nothing but its input split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = build()
        for piece in slices(batches):
            yield step(piece)

    return map_batches(df, run, schema, build.__module__)


def texts_of(batch: pa.RecordBatch, column: int | str = 1) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no column of the caller's has, in any case of letters."""
    low = {t.lower() for t in taken}
    while name in low:
        name += "_"
    return name
