"""Operators over ordered rows that stay parallel when one key holds a large share of them.

A plain window over a key puts all its rows into one task. Here the order is cut into stretches of a fixed width; each
stretch is handled by itself and gets what the earlier ones amount to from a summary with a row for each stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Positions of a stretch, where a caller names none.
STRETCH = 1 << 16


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with its keys as one struct: rows with null keys are a key of their own, in joins too."""
    return df.withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0)))


def _before() -> Window:
    return Window.partitionBy("_key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)


PLACE = ["_key", "_stretch"]


def running_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], stretch: int = STRETCH) -> DataFrame:
    """``df`` with running sums over ``order``, a whole number unique within the keys, the row itself included."""
    cut = _keyed(df, keys).withColumns({"_stretch": F.floor(F.col(order) / stretch)} | {f"_v_{k}": c for k, c in sums.items()})
    totals = cut.groupBy(*PLACE).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    carried = totals.select(*PLACE, *[F.coalesce(F.sum(f"_t_{k}").over(_before()), F.lit(0)).alias(f"_c_{k}") for k in sums])
    inner = Window.partitionBy(*PLACE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumns({f"_r_{k}": F.sum(f"_v_{k}").over(inner) for k in sums})
    joined = inside.join(carried, PLACE)
    return joined.select(*df.columns, *[(F.col(f"_r_{k}") + F.col(f"_c_{k}")).alias(k) for k in sums])


def running_max_before(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], stretch: int = STRETCH) -> DataFrame:
    """``df`` with the greatest value among the rows before each, null if there is none."""
    cut = _keyed(df, keys).withColumns({"_stretch": F.floor(F.col(order) / stretch)} | {f"_v_{k}": c for k, c in values.items()})
    totals = cut.groupBy(*PLACE).agg(*[F.max(f"_v_{k}").alias(f"_t_{k}") for k in values])
    carried = totals.select(*PLACE, *[F.max(f"_t_{k}").over(_before()).alias(f"_c_{k}") for k in values])
    inner = Window.partitionBy(*PLACE).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.withColumns({f"_r_{k}": F.max(f"_v_{k}").over(inner) for k in values}).join(carried, PLACE)
    return joined.select(*df.columns, *[F.greatest(f"_r_{k}", f"_c_{k}").alias(k) for k in values])


def lagged(df: DataFrame, keys: list[str], order: str, value: str, name: str, stretch: int = STRETCH) -> DataFrame:
    """``df`` with the value of the row before, null for a key's first."""
    cut = _keyed(df, keys).withColumn("_stretch", F.floor(F.col(order) / stretch))
    ends = cut.groupBy(*PLACE).agg(F.max(F.struct(order, F.struct(value).alias("v"))).alias("_end"))
    carried = ends.select(*PLACE, F.last("_end").over(_before()).alias("_carried"))
    inner = F.lag(F.struct(value)).over(Window.partitionBy(*PLACE).orderBy(order))
    joined = cut.withColumn("_inner", inner).join(carried, PLACE)
    return joined.select(*df.columns, F.coalesce("_inner", "_carried.v")[value].alias(name))


def _queue(df: DataFrame, keys: list[str], order: str, is_add: Column, stretch: int) -> DataFrame:
    """``df`` with ``_key``, ``_is_add``, ``_length`` and ``_adds`` after each row, and ``_ok``.

    With S the running sum of +1 and -1 and M the running minimum of S and 0, the length is S - M, and a take fails
    exactly when it lowers M. Both compose over stretches: a stretch's least inner sum is set upon the sum before it.
    """
    cut = _keyed(df, keys).withColumns({"_stretch": F.floor(F.col(order) / stretch), "_is_add": is_add, "_step": F.when(is_add, 1).otherwise(-1)})
    inner = Window.partitionBy(*PLACE).orderBy(order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumns({"_s": F.sum("_step").over(upto), "_a": F.sum(F.col("_is_add").cast("long")).over(upto)}).withColumn("_m", F.min("_s").over(upto))
    totals = cut.groupBy(*PLACE).agg(F.sum("_step").alias("_sum"), F.min("_s").alias("_least"), F.max("_a").alias("_n_adds"))
    totals = totals.withColumns({"_base": F.coalesce(F.sum("_sum").over(_before()), F.lit(0)), "_adds_before": F.coalesce(F.sum("_n_adds").over(_before()), F.lit(0))})
    totals = totals.withColumn("_floor", F.least(F.lit(0), F.coalesce(F.min(F.col("_base") + F.col("_least")).over(_before()), F.lit(0))))
    rows = cut.join(totals.select(*PLACE, "_base", "_floor", "_adds_before"), PLACE)
    rows = rows.withColumns({"_S": F.col("_base") + F.col("_s"), "_M": F.least("_floor", F.col("_base") + F.col("_m"))})
    earlier = F.coalesce(F.lag("_M").over(inner), F.col("_floor"))
    return rows.select(
        *df.columns, "_key", "_is_add", (F.col("_S") - F.col("_M")).cast("long").alias("_length"), (F.col("_adds_before") + F.col("_a")).alias("_adds"),
        (F.col("_is_add") | (F.col("_M") == earlier)).alias("_ok"),
    )


def queue_states(df: DataFrame, keys: list[str], order: str, is_add: Column, stretch: int = STRETCH) -> DataFrame:
    """Additions to and takes from a queue: ``length`` after each row and ``ok``, whether a take found something."""
    return _queue(df, keys, order, is_add, stretch).select(*df.columns, F.col("_length").alias("length"), F.col("_ok").alias("ok"))


def dequeued(df: DataFrame, keys: list[str], order: str, is_add: Column, stretch: int = STRETCH) -> DataFrame:
    """Successful takes with the row that each returns: the n-th take gets the n-th addition. ``take_seq``, ``add_seq``.

    What has been added and is not in the queue has been taken, which numbers the takes too."""
    rows = _queue(df, keys, order, is_add, stretch).where("_ok")
    n = F.when(F.col("_is_add"), F.col("_adds")).otherwise(F.col("_adds") - F.col("_length"))
    pairs = rows.withColumn("_n", n).groupBy("_key", "_n").agg(
        F.max(F.when(~F.col("_is_add"), F.col(order))).alias("take_seq"), F.max(F.when(F.col("_is_add"), F.col(order))).alias("add_seq")
    )
    return pairs.where("take_seq is not null").select(*[F.col(f"_key.`{k}`").alias(k) for k in keys], "take_seq", "add_seq")


def asof_join(reads: DataFrame, versions: DataFrame, keys: list[str], time: str, values: list[str], width: int) -> DataFrame:
    """Each read with the values of the last version of its key at or before its time; nulls if there is none.

    ``time`` is a whole number; stretches of ``width`` bound what one task sorts of one key. Versions of one time are
    taken in the order of ``values``.
    """
    version = F.struct(time, *values)
    every = versions.select(*keys, time, version.alias("_version"), F.lit(0).alias("_kind"), F.lit(None).alias("_read"))
    asked = reads.withColumn("_read", F.struct(*reads.columns)).select(*keys, time, F.lit(None).alias("_version"), F.lit(1).alias("_kind"), "_read")
    rows = _keyed(every.unionByName(asked), keys).withColumn("_stretch", F.floor(F.col(time) / width))
    lasts = rows.groupBy(*PLACE).agg(F.max("_version").alias("_last"))
    carried = lasts.select(*PLACE, F.last("_last", ignorenulls=True).over(_before()).alias("_carried"))
    upto = Window.partitionBy(*PLACE).orderBy(time, "_kind", "_version").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_own", F.last("_version", ignorenulls=True).over(upto)).where("_kind = 1")
    joined = found.join(carried, PLACE).withColumn("_hit", F.coalesce("_own", "_carried"))
    return joined.select("_read.*", F.col(f"_hit.{time}").alias(f"version_{time}"), *[F.col(f"_hit.{v}").alias(f"version_{v}") for v in values])


def global_rank(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """Places from 1 in a total order: a range-partitioned sort, numbered within partitions; counts of the partitions
    before, a row for each, are added. The ranged rows are written: their borders come from a sample, which another run
    of the same exchange need not repeat."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").count()
    before = counts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_inner", inner).join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_inner")).cast("long").alias(name))
