"""Lists, sets, maps, bags, counters and queues as tables of elements or of operations on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import dequeued, global_rank, queue_states, running_sums


def in_order(adds: DataFrame, keys: list[str], order: str) -> DataFrame:
    """List elements with their place from 1, oldest first."""
    return running_sums(adds, keys, order, {"position": F.lit(1).cast("long")})


def sizes(elements: DataFrame, key: str) -> DataFrame:
    return elements.groupBy(key).agg(F.count("*").alias("size"))


def multiplicities(elements: DataFrame, key: str) -> DataFrame:
    """A set that keeps duplicates: each element with the number of its copies."""
    return elements.groupBy(key).agg(F.count("*").alias("copies"))


def without_one(elements: DataFrame, removed: DataFrame) -> DataFrame:
    """Each removal takes one occurrence."""
    return elements.exceptAll(removed)


def without_keys(entries: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    return entries.join(removed.select(key).distinct(), key, "left_anti")


def members(probes: DataFrame, elements: DataFrame, key: str) -> DataFrame:
    """Probes with ``present``, whether the element is there."""
    there = elements.select(key).distinct().withColumn("_there", F.lit(True))
    return probes.join(there, key, "left").withColumn("present", F.coalesce("_there", F.lit(False))).drop("_there")


def extremes(elements: DataFrame, key: str, *values: str) -> DataFrame:
    """Least and greatest element; with values, the whole entries."""
    c = F.struct(key, *values) if values else F.col(key)
    return elements.agg(F.min(c).alias("least"), F.max(c).alias("greatest"))


def first_written(puts: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """A map in which the first entry of a key wins."""
    return puts.groupBy(key).agg(F.min_by(value, order).alias(value))


def looked_up(probes: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Probes with the entry's values, null where there is none."""
    return probes.join(entries, key, "left")


def approximate_size(n: Column) -> Column:
    """A power of two near the size."""
    return F.pow(F.lit(2.0), F.floor(F.log2(n + 1))).cast("long")


def ranked(elements: DataFrame, order: list[str]) -> DataFrame:
    """All elements sorted, with their place: range-partitioned, never in one task."""
    return global_rank(elements, order)


def popped(elements: DataFrame, n: int, seed: int, tie: str) -> DataFrame:
    """``n`` elements of a bag in an order fixed by the seed."""
    return elements.orderBy(F.xxhash64(F.lit(seed), tie), tie).limit(n)


def counter(deltas: DataFrame, key: str, order: str, delta: str, shards: int) -> DataFrame:
    """A sharded counter: sums of shards, then of the counter."""
    parts = deltas.groupBy(key, F.pmod(F.col(order), F.lit(shards)).alias("_shard")).agg(F.sum(delta).alias("_part"))
    return parts.groupBy(key).agg(F.coalesce(F.sum("_part"), F.lit(0.0)).alias("value"))


def takes(operations: DataFrame, keys: list[str], order: str, is_add: Column) -> DataFrame:
    """First-in first-out: which addition each successful take returns."""
    return dequeued(operations, keys, order, is_add)


def lengths(operations: DataFrame, keys: list[str], order: str, is_add: Column) -> DataFrame:
    """A queue's length after every operation, and whether a take found something."""
    return queue_states(operations, keys, order, is_add)


def queued_at(operations: DataFrame, keys: list[str], order: str, is_add: Column, at: int) -> DataFrame:
    """Elements in the queue at a moment: added up to it and not yet returned."""
    adds = operations.where(is_add & (F.col(order) <= at)).select(*keys, F.col(order).alias("add_seq"))
    gone = takes(operations.where(F.col(order) <= at), keys, order, is_add).select(*keys, "add_seq")
    same = [adds[c].eqNullSafe(gone[c]) for c in keys] + [adds["add_seq"] == gone["add_seq"]]
    return adds.join(gone, same, "left_anti")
