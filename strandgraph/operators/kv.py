"""Versioned key-value view: an append-only frame of versions, read as of a snapshot.

Rows: (key, type_tag, value, version, created_at, updated_at, ttl_seconds).  A
tombstone has the type Null.  Snapshot 0 means the latest version; a value with
a time to live is absent from ``updated_at + ttl_seconds`` on, ``now`` being a
parameter.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "key string, type_tag int, value string, version long, created_at long, updated_at long, ttl_seconds long"
NULL, BYTES, STRING, INTEGER, FLOAT, BOOLEAN, JSON = range(7)


def tag_of(value) -> tuple[int, str | None]:
    """(type tag, text form) of a python value."""
    if value is None:
        return NULL, None
    if isinstance(value, bool):
        return BOOLEAN, str(value).lower()
    if isinstance(value, int):
        return INTEGER, str(value)
    if isinstance(value, float):
        return FLOAT, repr(value)
    if isinstance(value, bytes):
        return BYTES, value.hex()
    if isinstance(value, str):
        return STRING, value
    return JSON, json.dumps(value, ensure_ascii=False)


def value_of(tag: int, text: str | None):
    if tag == NULL or text is None:
        return None
    return {BYTES: bytes.fromhex, STRING: str, INTEGER: int, FLOAT: float, BOOLEAN: lambda t: t == "true", JSON: json.loads}[tag](text)


@dataclass(frozen=True)
class KvFrame:
    versions: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> KvFrame:
        return KvFrame(spark.createDataFrame([], SCHEMA))

    def _append(self, key: str, value, now: int, ttl: int | None) -> KvFrame:
        spark = self.versions.sparkSession
        old = self.versions.agg(F.max("version").alias("v"), F.min(F.when(F.col("key") == key, F.col("created_at"))).alias("c")).first()
        tag, text = tag_of(value)
        row = (key, tag, text, (old["v"] or 0) + 1, old["c"] if old["c"] is not None else now, now, ttl)
        return KvFrame(self.versions.unionByName(spark.createDataFrame([row], SCHEMA)))

    def set(self, key: str, value, now: int, ttl: int | None = None) -> KvFrame:
        return self._append(key, value, now, ttl)

    def delete(self, key: str, now: int) -> KvFrame:
        return self._append(key, None, now, None)

    def latest(self, now: int | None = None, snapshot: int = 0) -> DataFrame:
        """The live value of every key: a grouped max_by over versions, with map-side partial results."""
        seen = self.versions if snapshot == 0 else self.versions.where(F.col("version") <= snapshot)
        last = seen.groupBy("key").agg(F.max_by(F.struct(*[c for c in seen.columns if c != "key"]), "version").alias("r")).select("key", "r.*")
        live = last.where(F.col("type_tag") != NULL)
        if now is not None:
            live = live.where(F.col("ttl_seconds").isNull() | (F.lit(now) < F.col("updated_at") + F.col("ttl_seconds")))
        return live

    def get(self, key: str, now: int | None = None, snapshot: int = 0):
        row = KvFrame(self.versions.where(F.col("key") == key)).latest(now, snapshot).first()
        return None if row is None else value_of(row["type_tag"], row["value"])

    def prefix_scan(self, prefix: str, now: int | None = None, snapshot: int = 0) -> DataFrame:
        return KvFrame(self.versions.where(F.col("key").startswith(prefix))).latest(now, snapshot).orderBy("key")

    def without_expired(self, now: int) -> KvFrame:
        """Versions of keys whose latest version has not expired."""
        dead = KvFrame(self.versions).latest().where(F.lit(now) >= F.col("updated_at") + F.col("ttl_seconds")).select("key")
        return KvFrame(self.versions.join(dead, "key", "left_anti").select(*self.versions.columns))
