"""Streams over operation logs: windowed counts, late writes, queues, and trees that grow with each batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules, tree
from ..sources.tables import shared_dir, written


def stream_of(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; the time column becomes a timestamp, as watermarks ask for."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream holds now, through a file sink in the shared folder."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows")
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/rows")


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, slide: str | None = None, late: str = "15 seconds") -> DataFrame:
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, width, slide or width), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), *keys, "n")
    )


def session_counts(events: DataFrame, time: str, keys: list[str], gap: str = "60 seconds", late: str = "15 seconds") -> DataFrame:
    return (
        events.withWatermark(time, late)
        .groupBy(F.session_window(time, gap), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")
    )


def judged_writes(operations: DataFrame) -> DataFrame:
    """Reads and writes (``ptr``, ``seq``, ``eff``, ``op``) in arrival order: a write earlier than a read or write that
    its key has seen is ``late``. The state of a key is the greatest time read and the greatest written."""

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        read, wrote = state.get if state.exists else (-(1 << 62), -(1 << 62))
        rows = pd.concat(list(batches)).sort_values("seq")
        late = []
        for eff, op in zip(rows.eff.tolist(), rows.op.tolist()):
            late.append(op == "write" and (read > eff or wrote > eff))
            if op == "read":
                read = max(read, eff)
            elif not late[-1]:
                wrote = max(wrote, eff)
        state.update((read, wrote))
        yield pd.DataFrame({"ptr": rows.ptr, "seq": rows.seq, "op": rows.op, "late": late})

    kind = operations.schema["ptr"].dataType.simpleString()
    return operations.groupBy("ptr").applyInPandasWithState(judge, f"ptr {kind}, seq long, op string, late boolean", "read long, wrote long", "append", "NoTimeout")


def consumed(operations: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands each micro-batch to ``handle`` until the stream is drained; a batch that failed is handed out again."""
    query = operations.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class GrowingTree:
    """A tree that routes each batch to its leaves and splits those that have become large, one level a batch.

    After each batch its members and nodes lie below ``at``, a folder that all executors share; the batch's number is
    noted last. A tree over the same folder goes on from there, and a batch handed out again changes nothing.
    """

    NODES = "node_id long, depth int, field string, threshold double, fitness double, is_leaf boolean"

    def __init__(self, spark: SparkSession, label: str, features: list[str], strategy: tree.Strategy = tree.Strategy(), at: str | None = None):
        self.spark, self.label, self.features, self.strategy = spark, label, features, strategy
        self.at = at or f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
        self.members: DataFrame | None = None
        self.nodes = spark.createDataFrame([], self.NODES)
        self.last = -1
        if at and (found := self._noted()) is not None:
            self.last = found
            self.members, self.nodes = (spark.read.parquet(f"{at}/{found}/{name}") for name in ("members", "nodes"))

    def _noted(self) -> int | None:
        try:
            return self.spark.read.schema("batch long").parquet(f"{self.at}/noted").agg(F.max("batch")).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def add(self, batch: DataFrame, batch_id: int | None = None) -> None:
        batch_id = self.last + 1 if batch_id is None else batch_id
        if batch_id <= self.last:
            return
        new = tree.routed(batch, self.nodes, self.features)
        members = written(new if self.members is None else self.members.unionByName(new))
        sizes = members.groupBy("node_id").agg(F.count("*").alias("n"))
        open_ = rules.splittable(sizes, self.strategy.branch_threshold).where(tree.depth(F.col("node_id")) < self.strategy.max_depth)
        inside = members.join(open_.select("node_id"), "node_id", "left_semi")
        chosen = rules.best(rules.candidates(inside, self.label, self.features, ["node_id"]), ["node_id"], self.strategy.fitness).where("n_le > 0 and n_gt > 0")
        chosen = written(chosen.where(F.col("fitness") > self.strategy.min_entropy))
        inner = chosen.select("node_id", tree.depth(F.col("node_id")).alias("depth"), "field", "threshold", "fitness", F.lit(False).alias("is_leaf"))
        parts = {"members": tree._routed_once(members, chosen, self.features, "node_id"), "nodes": self.nodes.union(inner)}
        for name, part in parts.items():
            # a batch that failed half-way has left files of no use
            part.write.mode("overwrite").parquet(f"{self.at}/{batch_id}/{name}")
        self.members, self.nodes = (self.spark.read.schema(p.schema).parquet(f"{self.at}/{batch_id}/{name}") for name, p in parts.items())
        self.spark.createDataFrame([(batch_id,)], "batch long").write.mode("append").parquet(f"{self.at}/noted")
        self.last = batch_id
