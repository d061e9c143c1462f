"""Lineage cuts and the one loop that iterative operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is set, a local session gets a private one; on a cluster, whose
    executors could not see that, the warehouse folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="strandgraph-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_folders: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean_up() -> None:
    """Remove this process's work tables, if its session still runs; results read from them are gone with it."""
    spark = SparkSession.getActiveSession() if _folders else None
    for path in list(_folders) if spark is not None else ():
        try:
            _delete(spark, path)
        except Exception:  # the gateway may be closing already
            return


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove the work tables begun inside once it ends: for results that were written or collected there."""
    before = set(_folders)
    yield
    for path in _folders - before:
        _delete(spark, path)
        _folders.discard(path)


class WorkTables:
    """Tables written to the shared folder to cut lineage; ``drop`` removes one early, the end of the process the rest."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        _folders.add(self.base)

    def save(self, df: DataFrame, files: int | None = None) -> tuple[DataFrame, str]:
        """Write a frame and read it again; a table known to be small goes into few ``files``."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        (df.coalesce(files) if files else df).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str) -> None:
        for path in paths:
            _delete(self.spark, path)


#: Frontiers of at most so many rows are broadcast to the edges; their size is counted as each level is written.
BROADCAST_ROWS = 100_000


def grow(first: DataFrame, step: Callable[[DataFrame, int], DataFrame], key: list[str], depth: int | None, until: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """Level-synchronous closure: ``first`` is level 0, ``step`` makes candidates from the last level.

    Each level is written once; candidates whose key was reached before are
    dropped by an anti join with the levels already written.  Ends when a level
    is empty, ``depth`` levels were made, or ``until`` holds for a level.  The
    result has the columns of ``first`` and ``level``.
    """
    spark = first.sparkSession
    work = WorkTables(spark, "levels")
    new, path = work.save(first.withColumn("level", F.lit(0)))
    paths, level = [path], 0
    while (size := new.count()) and (depth is None or level < depth) and not (until and until(new)):
        level += 1
        frontier = F.broadcast(new) if size <= BROADCAST_ROWS else new
        seen = spark.read.schema(new.schema).parquet(*paths)
        grown = step(frontier, level).withColumn("level", F.lit(level))
        new, path = work.save(grown.join(seen.select(*key), key, "left_anti").select(*seen.columns))
        paths.append(path)
    return spark.read.schema(new.schema).parquet(*paths)


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int, progress: Callable[[int, int], None] | None = None, cut_every: int = 5) -> DataFrame:
    """Exactly ``rounds`` applications of ``step``; lineage is cut every ``cut_every`` rounds."""
    work = WorkTables(state.sparkSession, "rounds")
    old = None
    for i in range(rounds):
        state = step(state, i)
        if (i + 1) % cut_every == 0:
            state, path = work.save(state)
            if old:
                work.drop(old)
            old = path
        if progress:
            progress(i + 1, rounds)
    return state
