"""Task graphs: tasks(task, has_result, has_exception, executor), edges(task, trigger)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPLETED_MS = 10_000


def is_complete() -> Column:
    return F.col("has_result") | F.col("has_exception")


def claimed(claims: DataFrame) -> DataFrame:
    """Claims (``task``, ``seq``, ``executor``): the first executor gets the task."""
    return claims.groupBy("task").agg(F.min_by("executor", "seq").alias("executor"), F.count("*").alias("claims"))


def can_run(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether all triggers of a task are complete; failed ones are, and a task without triggers can run."""
    done = tasks.select(F.col("task").alias("trigger"), is_complete().alias("_done"))
    known = edges.join(done, "trigger", "left").groupBy("task").agg(F.bool_and(F.coalesce("_done", F.lit(False))).alias("_all"), F.count("*").alias("triggers"))
    joined = tasks.join(known, "task", "left")
    return joined.select("task", F.coalesce("_all", F.lit(True)).alias("can_run"), F.coalesce("triggers", F.lit(0)).cast("long").alias("triggers"))


def newly_runnable(tasks: DataFrame, edges: DataFrame, completed: DataFrame) -> DataFrame:
    """Subscribers of just completed tasks all of whose triggers are complete now."""
    near = edges.join(completed.select(F.col("task").alias("trigger")), "trigger", "left_semi").select("task").distinct()
    return can_run(tasks, edges).where("can_run").join(near, "task", "left_semi").select("task")


def statuses(tasks: DataFrame, edges: DataFrame, queued: DataFrame, alive: DataFrame) -> DataFrame:
    """Success, Failed, Running, Orphan, Blocked or Queued for each task; triggers that no task has are Ex_NotDefined.

    ``queued`` (``task``) are those in the queue, ``alive`` (``executor``) the executors that run something.
    """
    pending = tasks.where(~is_complete()).select(F.col("task").alias("trigger"), F.lit(True).alias("_pending"))
    unknown = edges.select("trigger").distinct().join(tasks.select(F.col("task").alias("trigger")), "trigger", "left_anti")
    waiting = edges.join(pending.union(unknown.withColumn("_pending", F.lit(True))), "trigger").select("task").distinct().withColumn("_blocked", F.lit(True))
    joined = (
        tasks.join(waiting, "task", "left")
        .join(queued.select("task").distinct().withColumn("_queued", F.lit(True)), "task", "left")
        .join(alive.select("executor").distinct().withColumn("_alive", F.lit(True)), "executor", "left")
    )
    status = (
        F.when(F.col("has_result"), "Success")
        .when(F.col("has_exception"), "Failed")
        .when(F.col("executor").isNotNull(), F.when(F.col("_alive"), "Running").otherwise("Orphan"))
        .when(F.col("_blocked"), "Blocked")
        .when(F.col("_queued"), "Queued")
        .otherwise("Orphan")
    )
    return joined.select("task", status.alias("status")).union(unknown.select("trigger", F.lit("Ex_NotDefined")))


def traces(tasks: DataFrame, edges: DataFrame, statuses: DataFrame, roots: DataFrame, most_depth: int = 64) -> DataFrame:
    """The trace of each root: (``root``, ``task``, ``depth``); below finished tasks nothing is shown.

    Paths double in length with each join: those of the full length so far go on with all that begin where they end. What
    each join finds is written, so that plans stay short and a lost executor costs one step.
    """
    from ..sources.tables import written

    open_ = statuses.where(~F.col("status").isin("Success", "Failed", "Ex_NotDefined")).select("task")
    steps = edges.join(open_, "task", "left_semi").select(F.col("task").alias("root"), F.col("trigger").alias("task"), F.lit(1).alias("depth"))
    every, reach = written(steps.distinct()), 1
    while True:
        onward = every.select(F.col("root").alias("task"), F.col("task").alias("_to"), F.col("depth").alias("_more"))
        longer = every.where(F.col("depth") == reach).join(onward, "task").select("root", F.col("_to").alias("task"), (F.col("depth") + F.col("_more")).alias("depth"))
        longer = written(longer.distinct())
        if longer.isEmpty():
            break
        if longer.where(F.col("depth") > most_depth).limit(1).count():
            raise RuntimeError(f"a trace deeper than {most_depth}")
        every, reach = every.union(longer), 2 * reach
    top = roots.select(F.col("task").alias("root"), "task", F.lit(0).alias("depth"))
    return top.union(every.join(roots.select(F.col("task").alias("root")).distinct(), "root", "left_semi"))


def histogram(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n"))


def running(executions: DataFrame, now: Column, expiry_ms: int = COMPLETED_MS) -> DataFrame:
    """Executors with a started task, from (``executor``, ``task``, ``started``, ``completed``) in milliseconds;
    completed entries stay listed until they expire."""
    open_ = F.col("completed").isNull() | (F.col("completed") > now)
    listed = open_ | (now - F.col("completed") <= expiry_ms)
    begun = executions.where(F.col("started") <= now)
    return begun.groupBy("executor").agg(F.count_if(open_).alias("running"), F.count_if(listed).alias("listed")).where("listed > 0")
