"""Tables, their forms as versions, operations, tasks and items, and stores of versions."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import epoch_us


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share; one of our own only where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        import tempfile

        at = "file://" + os.path.join(tempfile.gettempdir(), "ledgerleaf-checkpoints")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` as Parquet in the shared folder, reread: it cuts the lineage, and any executor can be lost afterwards. With
    ``by`` there is a folder for each value of that column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/level-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def versions(events: DataFrame) -> DataFrame:
    """Events as versions of users: ``ptr``, ``eff`` (microseconds), ``seq``, ``value``; errors are tombstones."""
    return events.select(
        F.col("user_id").alias("ptr"), epoch_us("ts").alias("eff"), F.col("event_id").alias("seq"), "value", (F.col("event_type") == "error").alias("deleted")
    )


def operations(events: DataFrame) -> DataFrame:
    """Events as reads and locks of users by transactions of five events each, whose times run out of step with the log."""
    seq, txn = F.col("event_id"), F.floor(F.col("event_id") / 5)
    op = F.when(F.col("event_type") == "purchase", "lock").otherwise("read")
    return events.where("event_type in ('view', 'purchase')").select(
        (F.col("user_id") % 512).alias("ptr"), txn.alias("txn"), (txn * 1000 + txn * 7919 % 600_000).alias("eff"), seq.alias("seq"), op.alias("op"),
        (txn % 3 != 0).alias("committed"), F.when(txn % 11 != 0, txn * 5 + 5 + txn % 4000).alias("released"),
    )


def collection_operations(events: DataFrame) -> DataFrame:
    """Events as additions to and takes from eight queues."""
    return events.where("event_type in ('signup', 'click', 'error')").select(
        (F.col("user_id") % 8).alias("coll"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("is_add"), F.col("user_id").alias("key"), "value"
    )


def tasks(orders: DataFrame) -> DataFrame:
    """Orders as tasks: F has a result, P an exception, the rest is open; every third open one has an executor."""
    open_ = F.col("o_orderstatus") == "O"
    executor = F.when(open_ & (F.col("o_orderkey") % 3 == 0), F.concat(F.lit("exec"), (F.col("o_custkey") % 16).cast("string")))
    return orders.select(
        F.col("o_orderkey").alias("task"), (F.col("o_orderstatus") == "F").alias("has_result"), (F.col("o_orderstatus") == "P").alias("has_exception"), executor.alias("executor")
    )


def edges(orders: DataFrame) -> DataFrame:
    """A task waits for the task of half its number; no task waits for itself."""
    return orders.where("o_orderkey > 0").select(F.col("o_orderkey").alias("task"), F.floor(F.col("o_orderkey") / 2).alias("trigger"))


class VersionStore:
    """A store of all versions of keys below a path, partitioned by a hash of the key. Storing is additive and the
    version stored first wins; reading gives every version; ``clear`` empties it."""

    COLUMNS = ["ptr", "eff", "seq", "value", "deleted"]

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64("ptr"), F.lit(self.buckets)).cast("int")

    def store(self, versions: DataFrame) -> None:
        stamped = versions.select(*self.COLUMNS).withColumns({"_bucket": self._bucket(), "_stored": F.lit(self._next())})
        stamped.repartition("_bucket").sortWithinPartitions("ptr", "eff").write.partitionBy("_bucket").mode("append").parquet(self.path)

    def _next(self) -> int:
        every = self._files()
        last = every.agg(F.max("_stored")).first()[0] if every is not None else None
        return 0 if last is None else last + 1

    def _files(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def read(self, ptr=None) -> DataFrame:
        every = self._files()
        if every is None:
            return self.spark.createDataFrame([], "ptr long, eff long, seq long, value double, deleted boolean")
        if ptr is not None:
            # the key's bucket is computed once, so that files of the others are not opened
            bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(ptr).cast(every.schema["ptr"].dataType)), F.lit(self.buckets)).cast("int")).first()[0]
            every = every.where((F.col("_bucket") == bucket) & (F.col("ptr") == ptr))
        first = every.groupBy("ptr", "eff").agg(F.min(F.struct("_stored", "seq", "value", "deleted")).alias("v"))
        return first.select("ptr", "eff", "v.seq", "v.value", "v.deleted")

    def clear(self) -> None:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
