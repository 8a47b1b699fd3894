"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


#: Rows of a batch that goes to a Python worker, where the session has no number of its own: texts are long.
BATCH_ROWS = "1000"


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started, and get texts in small batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset, as in tests, one below the working
    directory's system temporary folder is chosen and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        import tempfile

        at = "file://" + os.path.join(tempfile.gettempdir(), "ledgerleaf-checkpoints")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its lineage ends there, and a lost executor
    loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    """A null text counts as the empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def text_bytes(column: str = "text") -> Column:
    return F.encode(whole_text(column), "UTF-8")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], by: Column, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join in which a key with very many rows in ``big`` is dealt over ``salts`` tasks.

    ``small`` holds each key once, so that it grows by the factor ``salts`` and ``big`` not at all. ``by`` decides a
    row's salt and has to be the same when a lost task is run again.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
