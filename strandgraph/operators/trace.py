"""Trace analysis: vector clocks and data races."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandgraph.functions.clocks import concurrent


def local_clocks(events: DataFrame) -> DataFrame:
    """Events with ``clock``: each thread counts its own events, none waits for another."""
    order = Window.partitionBy("thread_id").orderBy("event_id")
    return events.withColumn("clock", F.create_map("thread_id", F.row_number().over(order).cast("long")))


def races(events: DataFrame) -> DataFrame:
    """(location, first, second): concurrent event pairs at one location, at least one of them a write.

    Writes are joined with all events of their location, so pairs of reads are
    never made; the pair is kept once, with the smaller event id first.
    """
    e = events.select("location", "event_id", "op", "clock")
    writes = e.where("op = 'W'").select("location", F.col("event_id").alias("w_id"), F.col("clock").alias("w_clock"))
    pairs = writes.join(e, "location").where("(op = 'W' AND w_id < event_id) OR (op <> 'W' AND w_id <> event_id)")
    return pairs.where(concurrent(F.col("w_clock"), F.col("clock"))).select("location", F.least("w_id", "event_id").alias("first"), F.greatest("w_id", "event_id").alias("second"))


def raced_locations(found: DataFrame) -> DataFrame:
    return found.groupBy("location").agg(F.count("*").alias("races")).orderBy("location")
