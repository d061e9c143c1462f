"""Bounded samples of labelled documents for training on the driver."""

from __future__ import annotations

from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: tuple[int, int], max_chars: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """(text, label) pairs in a fixed order, and how many rows may be learnt from in each class.

    Only rows whose crc32 of the id as text leaves another remainder than
    ``held_out`` are used; ids may be of any type.  At most ``per_class[c]`` ids
    of class c are taken, by smallest hash, and of each text a run of at most
    ``max_chars`` characters whose place depends on the id's hash, so texts of
    every length are learnt from and what reaches the driver has a fixed bound
    at any input size.  Null texts are left out.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .select(F.col("doc_id").cast("string").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.crc32("doc_id") % modulus != held_out)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = []
    for y, most in enumerate(per_class):
        ids += known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    if not ids:
        return [], counts
    # An Arrow table goes to the JVM as it is; a list of rows would start a second set of python workers on the executors.
    table = pa.table({"doc_id": pa.array([r["doc_id"] for r in ids], pa.string()), "y": pa.array([r["y"] for r in ids], pa.int32())})
    chosen = F.broadcast(docs.sparkSession.createDataFrame(table))
    room = F.greatest(F.length("text") - max_chars, F.lit(0))
    rows = (
        docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
        .where(F.col("text").isNotNull())
        .join(chosen, "doc_id")
        .select("doc_id", "y", F.substring("text", F.lit(1) + F.pmod(F.xxhash64("doc_id"), room + 1).cast("int"), F.lit(max_chars)).alias("text"))
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("y").alias("y"))
        .collect()
    )
    rows.sort(key=lambda r: (crc32(r["doc_id"].encode()), r["doc_id"]))
    return [(r["text"], r["y"]) for r in rows], counts
