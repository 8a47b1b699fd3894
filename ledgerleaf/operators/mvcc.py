"""Versioned keys and transactions as DataFrame programs.

versions(ptr, eff, seq, value, deleted): an append-only history; ``eff`` orders versions, ``seq`` breaks ties.
operations(ptr, txn, eff, seq, op, ...): a log in ``seq`` order of reads, locks and writes at each transaction's time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import asof_join, lagged

GC_NS, ORPHAN_NS = 15 * 10**9, 7 * 10**9


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each key; keys whose newest version is a tombstone are absent."""
    newest = versions.groupBy("ptr").agg(F.max(F.struct("eff", "seq", "value", "deleted")).alias("v"))
    return newest.select("ptr", "v.*").where(~F.col("deleted")).drop("deleted")


def snapshot(versions: DataFrame, at: int | Column) -> DataFrame:
    """What is visible at a time: the newest versions at or before it."""
    return latest(versions.where(F.col("eff") <= at))


def read_at(reads: DataFrame, versions: DataFrame, width: int) -> DataFrame:
    """Every read (``ptr``, ``eff``, ...) with the value visible at its own time; null if none or deleted."""
    found = asof_join(reads, versions, ["ptr"], "eff", ["seq", "value", "deleted"], width)
    live = ~F.coalesce("version_deleted", F.lit(True))
    return found.select(*reads.columns, F.when(live, F.col("version_seq")).alias("version_seq"), F.when(live, F.col("version_value")).alias("value"))


def first_versions(versions: DataFrame) -> DataFrame:
    """Of allocations of one key the first wins."""
    return versions.groupBy("ptr").agg(F.min(F.struct("eff", "seq", "value")).alias("v")).select("ptr", "v.*")


def published(staged: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Staged writes of committed transactions; of several at the same key and time the last stays."""
    kept = staged.join(outcomes.where("state = 'COMMIT'").select("txn"), "txn", "left_semi")
    return kept.groupBy("ptr", "eff").agg(F.max(F.struct("seq", "txn", "value")).alias("v")).select("ptr", "eff", "v.*")


def outcomes(log: DataFrame) -> DataFrame:
    """A transaction's state: its first commit or reset, else OPEN; and the locks taken while it was open."""
    end = F.min(F.when(F.col("op").isin("commit", "reset"), F.struct("seq", "op")))
    ends = log.groupBy("txn").agg(end.alias("end"))
    joined = log.where("op = 'lock'").join(ends, "txn", "right")
    counted = F.count_if(F.col("seq").isNotNull() & (F.col("end").isNull() | (F.col("seq") < F.col("end.seq"))))
    state = F.when(F.col("op") == "commit", "COMMIT").when(F.col("op") == "reset", "RESET").otherwise("OPEN")
    return joined.groupBy("txn", F.col("end.op").alias("op")).agg(counted.alias("n_locks")).select("txn", state.alias("state"), "n_locks")


def recovered(locks: DataFrame, now: Column, oldest: int = ORPHAN_NS) -> DataFrame:
    """What becomes of held locks: those older than ``oldest`` are rolled forward if their transaction has committed
    and back otherwise, younger ones stay."""
    old = now - F.col("eff") > oldest
    return locks.withColumn("outcome", F.when(~old, "held").when(F.col("state") == "COMMIT", "forward").otherwise("back"))


VERDICTS = "ptr {ptr}, txn long, eff long, seq long, op string, verdict string"


def replayed(operations: DataFrame) -> DataFrame:
    """The verdict on every read and lock, by a replay of each key's log in ``seq`` order.

    ``released`` is the ``seq`` at which the operation's transaction ended (null: never), ``committed`` whether by commit.
    A lock is ``held`` if another transaction's granted lock still stands, else ``ok`` if its own does, else ``read`` if
    an earlier read is of a later time, else ``version`` if a committed version is, else ``ok``: only then it stands. A
    read is ``held`` behind a foreign lock of an earlier time, else ``ok``, and only then marks the key as read.

    A verdict hangs on those before it, so that a key's log is one task's; it streams, and the state is five numbers.
    """
    ptr = operations.schema["ptr"].dataType
    rows = operations.select("ptr", *[F.col(c).cast("long").alias(c) for c in ("txn", "eff", "seq")], "op", F.coalesce("committed", F.lit(False)).alias("committed"), F.col("released").cast("long").alias("released"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, True
        for batch in batches:
            verdicts = []
            for key, txn, eff, seq, op, committed, released in zip(*(c.to_pylist() for c in batch.columns)):
                if first or key != at:
                    at, first, lock, read, version = key, False, None, None, None
                if lock and lock[1] is not None and lock[1] <= seq:
                    if lock[3]:
                        version = lock[2] if version is None else max(version, lock[2])
                    lock = None
                if op == "read":
                    held = lock and lock[0] != txn and lock[2] < eff
                    verdicts.append("held" if held else "ok")
                    if not held:
                        read = eff if read is None else max(read, eff)
                elif lock:
                    verdicts.append("ok" if lock[0] == txn else "held")
                elif read is not None and read > eff:
                    verdicts.append("read")
                elif version is not None and version > eff:
                    verdicts.append("version")
                else:
                    verdicts.append("ok")
                    lock = txn, released, eff, committed
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(verdicts, pa.string())], ["ptr", "txn", "eff", "seq", "op", "verdict"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.where("op in ('read', 'lock')").repartition(n, "ptr").sortWithinPartitions("ptr", "seq")
    return dealt.mapInArrow(run, VERDICTS.format(ptr=ptr.simpleString()))


def conflicts(operations: DataFrame) -> DataFrame:
    """The verdict on every lock: ``ok``, or what stands against it."""
    return replayed(operations).where("op = 'lock'").drop("op")


def collect_garbage(versions: DataFrame, now: Column, horizon: int = GC_NS) -> DataFrame:
    """The newest version of each key, and all not older than the horizon."""
    newest = versions.groupBy("ptr").agg(F.max(F.struct("eff", "seq")).alias("_newest"))
    joined = versions.join(newest, "ptr")
    return joined.where((F.struct("eff", "seq") == F.col("_newest")) | (now - F.col("eff") <= horizon)).drop("_newest")


def effective_writes(writes: DataFrame) -> DataFrame:
    """Writes that change something: those of the value already visible, the key's last one, take no lock."""
    before = lagged(writes.withColumn("_set", F.lit(True)), ["ptr"], "seq", "value", "_value")
    before = lagged(before, ["ptr"], "seq", "_set", "_any")
    return before.where(F.col("_any").isNull() | ~F.col("value").eqNullSafe(F.col("_value"))).select(*writes.columns)


def upserted(existing: DataFrame, initial: DataFrame) -> DataFrame:
    """Initial values where nothing exists yet."""
    joined = existing.select("ptr", F.col("value").alias("_old")).join(initial.select("ptr", F.col("value").alias("_new")), "ptr", "full")
    return joined.select("ptr", F.coalesce("_old", "_new").alias("value"), F.col("_old").isNull().alias("created"))


def routed(df: DataFrame, key: str, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.col(key), F.lit(shards)).cast("int"))


def merged_replicas(replicas: list[DataFrame]) -> DataFrame:
    """Versions that any replica holds, each once."""
    every = replicas[0]
    for r in replicas[1:]:
        every = every.unionByName(r)
    return every.dropDuplicates(["ptr", "eff", "seq"])


def metrics(calls: DataFrame) -> DataFrame:
    """Calls (``name``, ``time``, ``failed``) by name and by the part before its first dot."""
    group = F.substring_index("name", ".", 1)
    return calls.groupBy(group.alias("prefix"), "name").agg(
        F.count("*").alias("invocations"), F.count_if(~F.col("failed")).alias("success"), F.count_if("failed").alias("failed"),
        F.sum("time").alias("total_time"), F.avg("time").alias("avg_time"),
    )


def transaction_metrics(attempts: DataFrame) -> DataFrame:
    """Attempts (``site``, ``txn``, ``time``, ``ok``) by call site."""
    by_txn = attempts.groupBy("site", "txn").agg(F.count("*").alias("n"), F.sum("time").alias("t"), F.bool_or("ok").alias("ok"))
    return by_txn.groupBy("site").agg(
        F.count("*").alias("executed"), F.sum("n").alias("attempts"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"),
        (F.sum("t") / F.sum("n")).alias("avg_time"), (F.sum("n") / F.count("*")).alias("avg_attempts"),
    )
