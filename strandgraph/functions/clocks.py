"""Vector clocks: maps from thread to counter; a missing thread counts as zero."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EMPTY = "map<bigint,bigint>"


def get(clock: Column, thread: Column) -> Column:
    return F.coalesce(F.try_element_at(clock, thread), F.lit(0).cast("bigint"))


def increment(clock: Column, thread: Column) -> Column:
    one = F.create_map(thread, get(clock, thread) + 1)
    return F.map_concat(F.map_filter(clock, lambda k, _: k != thread), one)


def merge(a: Column, b: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, zero), F.coalesce(y, zero)))


def at_most(a: Column, b: Column) -> Column:
    return F.forall(F.map_entries(a), lambda e: e["value"] <= get(b, e["key"]))


def happens_before(a: Column, b: Column) -> Column:
    """a <= b in every thread and a < b in one."""
    return at_most(a, b) & ~at_most(b, a)


def concurrent(a: Column, b: Column) -> Column:
    return ~at_most(a, b) & ~at_most(b, a)
