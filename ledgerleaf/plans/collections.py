"""Queries over collections, queues and tasks, each with its equivalent in SQL."""

from pyspark.sql import functions as F

from ..operators import collections as col
from ..operators import tasks as tsk
from ..sources.tables import collection_operations, edges, table, tasks

OPS = "o AS (SELECT user_id % 8 AS coll, event_id AS seq, event_type <> 'error' AS is_add, user_id AS key, value FROM events WHERE event_type IN ('signup', 'click', 'error'))"
QUEUE = """s AS (SELECT *, sum(CASE WHEN is_add THEN 1 ELSE -1 END) OVER w AS s FROM o WINDOW w AS (PARTITION BY coll ORDER BY seq)),
  m AS (SELECT *, least(0, min(s) OVER (PARTITION BY coll ORDER BY seq)) AS m FROM s),
  q AS (SELECT *, is_add OR m = coalesce(lag(m) OVER (PARTITION BY coll ORDER BY seq), 0) AS ok FROM m)"""
TAKES = """n AS (SELECT *, sum(CASE WHEN is_add THEN 1 ELSE 0 END) OVER w AS na, sum(CASE WHEN is_add THEN 0 ELSE 1 END) OVER w AS nt FROM q WHERE ok WINDOW w AS (PARTITION BY coll ORDER BY seq)),
  d AS (SELECT t.coll, t.seq AS take_seq, a.seq AS add_seq FROM n t JOIN n a ON a.coll = t.coll AND a.is_add AND NOT t.is_add AND a.na = t.nt)"""


def _is_add():
    return F.col("is_add")


def _ops(spark, sf):
    return collection_operations(table(spark, sf, "events"))


def _adds(spark, sf):
    return _ops(spark, sf).where("is_add")


def col2_dequeue(spark, sf):
    return col.takes(_ops(spark, sf), ["coll"], "seq", _is_add()).select("coll", "take_seq", "add_seq")


def col3_fifo(spark, sf):
    return col.in_order(_adds(spark, sf), ["coll"], "seq").select("coll", "seq", "position")


def col4_sizes(spark, sf):
    return col.sizes(_adds(spark, sf), "coll")


def col7_multiset(spark, sf):
    return col.multiplicities(_adds(spark, sf), "key")


def col8_remove(spark, sf):
    ops = _ops(spark, sf)
    return col.without_one(ops.where("is_add").select("key"), ops.where("not is_add").select("key")).groupBy("key").agg(F.count("*").alias("copies"))


def col9_contains(spark, sf):
    probes = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return col.members(probes, _adds(spark, sf), "key")


def col10_minmax(spark, sf):
    return col.extremes(_adds(spark, sf), "value")


def col11_first_write(spark, sf):
    return col.first_written(_adds(spark, sf), "key", "seq", "value")


def col12_get(spark, sf):
    probes = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return col.looked_up(probes, col.first_written(_adds(spark, sf), "key", "seq", "value"), "key")


def col14_remove_keys(spark, sf):
    entries = col.first_written(_adds(spark, sf), "key", "seq", "value")
    return col.without_keys(entries, _ops(spark, sf).where("not is_add and seq % 2 = 0"), "key")


def col15_map_minmax(spark, sf):
    e = col.extremes(col.first_written(_adds(spark, sf), "key", "seq", "value"), "key", "value")
    return e.select(F.col("least.key").alias("least_key"), F.col("least.value").alias("least_value"), F.col("greatest.key").alias("greatest_key"), F.col("greatest.value").alias("greatest_value"))


def col19_apx_size(spark, sf):
    return col.sizes(_adds(spark, sf), "coll").select("coll", col.approximate_size(F.col("size")).alias("apx_size"))


def col21_sort_rank(spark, sf):
    return col.ranked(table(spark, sf, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"])


def col24_sharded_sum(spark, sf):
    return col.counter(_adds(spark, sf), "coll", "seq", "value", 8).select("coll", F.round("value", 4).alias("value"))


def tsk3_take(spark, sf):
    return col.takes(_ops(spark, sf).withColumn("coll", F.col("key") % 3), ["coll"], "seq", _is_add()).select("coll", "take_seq", "add_seq")


def tsk5_size_timeline(spark, sf):
    return col.lengths(_ops(spark, sf), ["coll"], "seq", _is_add()).select("coll", "seq", "length", "ok")


def tsk5_contains(spark, sf):
    return col.queued_at(_ops(spark, sf), ["coll"], "seq", _is_add(), 700).select("coll", "add_seq")


def _graph(spark, sf):
    orders = table(spark, sf, "orders")
    t, e = tasks(orders), edges(orders)
    queued = t.where("task % 2 = 0").select("task")
    alive = t.where("executor is not null and task % 5 <> 0").select("executor")
    return t, e, queued, alive.where("executor <> 'exec7'")


def tsk12_claim(spark, sf):
    claims = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("task"), F.col("l_suppkey").alias("executor")).agg(F.min(F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("seq"))
    return tsk.claimed(claims)


def tsk14_runnable(spark, sf):
    t, e, _, _ = _graph(spark, sf)
    return tsk.newly_runnable(t, e, t.where("has_result and task % 10 = 3"))


def tsk15_can_run(spark, sf):
    t, e, _, _ = _graph(spark, sf)
    return tsk.can_run(t, e)


def tsk17_status(spark, sf):
    return tsk.statuses(*_graph(spark, sf))


def tsk17_trace(spark, sf):
    t, e, queued, alive = _graph(spark, sf)
    return tsk.traces(t, e, tsk.statuses(t, e, queued, alive), t.select("task"))


def tsk18_running(spark, sf):
    runs = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("executor"), F.col("l_orderkey").alias("task"), (F.col("l_orderkey") % 1000).alias("started"), F.when(F.col("l_linenumber") > 2, F.col("l_orderkey") % 1000 + 30 * F.col("l_linenumber")).alias("completed"))
    return tsk.running(runs, F.lit(500), 40)


def tsk19_histogram(spark, sf):
    return tsk.histogram(tsk17_status(spark, sf))


T = """t AS (SELECT o_orderkey AS task, o_orderstatus = 'F' AS ok, o_orderstatus = 'P' AS bad, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'exec' || (o_custkey % 16) END AS executor FROM orders),
  e AS (SELECT o_orderkey AS task, o_orderkey // 2 AS trigger FROM orders WHERE o_orderkey > 0)"""
STATUS = f"""{T}, alive AS (SELECT DISTINCT executor FROM t WHERE executor IS NOT NULL AND task % 5 <> 0 AND executor <> 'exec7'),
  blocked AS (SELECT DISTINCT e.task FROM e LEFT JOIN t ON t.task = e.trigger WHERE t.task IS NULL OR NOT (t.ok OR t.bad)),
  st AS (SELECT t.task, CASE WHEN ok THEN 'Success' WHEN bad THEN 'Failed' WHEN t.executor IS NOT NULL THEN CASE WHEN a.executor IS NOT NULL THEN 'Running' ELSE 'Orphan' END
    WHEN b.task IS NOT NULL THEN 'Blocked' WHEN t.task % 2 = 0 THEN 'Queued' ELSE 'Orphan' END AS status
    FROM t LEFT JOIN blocked b ON b.task = t.task LEFT JOIN alive a ON a.executor = t.executor
    UNION ALL SELECT DISTINCT trigger, 'Ex_NotDefined' FROM e WHERE trigger NOT IN (SELECT task FROM t))"""
FIRST = "f AS (SELECT key, arg_min(value, seq) AS value FROM o WHERE is_add GROUP BY 1)"

QUERIES = {
    "col2_dequeue": (col2_dequeue, f"WITH {OPS}, {QUEUE}, {TAKES} SELECT coll, take_seq, add_seq FROM d"),
    "col3_fifo": (col3_fifo, f"WITH {OPS} SELECT coll, seq, row_number() OVER (PARTITION BY coll ORDER BY seq) AS position FROM o WHERE is_add"),
    "col4_sizes": (col4_sizes, f"WITH {OPS} SELECT coll, count(*) AS size FROM o WHERE is_add GROUP BY 1"),
    "col7_multiset": (col7_multiset, f"WITH {OPS} SELECT key, count(*) AS copies FROM o WHERE is_add GROUP BY 1"),
    "col8_remove": (col8_remove, f"WITH {OPS} SELECT key, count(*) AS copies FROM (SELECT key FROM o WHERE is_add EXCEPT ALL SELECT key FROM o WHERE NOT is_add) GROUP BY 1"),
    "col9_contains": (col9_contains, f"WITH {OPS} SELECT c_custkey AS key, c_custkey IN (SELECT key FROM o WHERE is_add) AS present FROM customer"),
    "col10_minmax": (col10_minmax, f"WITH {OPS} SELECT min(value) AS least, max(value) AS greatest FROM o WHERE is_add"),
    "col11_first_write": (col11_first_write, f"WITH {OPS}, {FIRST} SELECT key, value FROM f"),
    "col12_get": (col12_get, f"WITH {OPS}, {FIRST} SELECT c_custkey AS key, value FROM customer LEFT JOIN f ON key = c_custkey"),
    "col14_remove_keys": (col14_remove_keys, f"WITH {OPS}, {FIRST} SELECT key, value FROM f WHERE key NOT IN (SELECT key FROM o WHERE NOT is_add AND seq % 2 = 0)"),
    "col15_map_minmax": (col15_map_minmax, f"WITH {OPS}, {FIRST} SELECT min(key) AS least_key, arg_min(value, key) AS least_value, max(key) AS greatest_key, arg_max(value, key) AS greatest_value FROM f"),
    "col19_apx_size": (col19_apx_size, f"WITH {OPS} SELECT coll, CAST(pow(2, floor(log2(count(*) + 1))) AS BIGINT) AS apx_size FROM o WHERE is_add GROUP BY 1"),
    "col21_sort_rank": (col21_sort_rank, "SELECT o_totalprice, o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders"),
    "col24_sharded_sum": (col24_sharded_sum, f"WITH {OPS}, p AS (SELECT coll, seq % 8 AS shard, sum(value) AS part FROM o WHERE is_add GROUP BY 1, 2) SELECT coll, round(sum(part), 4) AS value FROM p GROUP BY 1"),
    "tsk3_take": (tsk3_take, f"WITH {OPS.replace('user_id % 8', 'user_id % 3')}, {QUEUE}, {TAKES} SELECT coll, take_seq, add_seq FROM d"),
    "tsk5_size_timeline": (tsk5_size_timeline, f"WITH {OPS}, {QUEUE} SELECT coll, seq, CAST(s - m AS BIGINT) AS length, ok FROM q"),
    "tsk5_contains": (tsk5_contains, f"WITH {OPS.replace('WHERE', 'WHERE event_id <= 700 AND')}, {QUEUE}, {TAKES} SELECT coll, seq AS add_seq FROM o WHERE is_add AND seq NOT IN (SELECT add_seq FROM d)"),
    "tsk12_claim": (tsk12_claim, "WITH c AS (SELECT l_orderkey AS task, l_suppkey AS executor, min(l_linenumber * 1000000 + l_suppkey) AS seq FROM lineitem GROUP BY 1, 2) SELECT task, arg_min(executor, seq) AS executor, count(*) AS claims FROM c GROUP BY 1"),
    "tsk14_runnable": (tsk14_runnable, f"WITH {T} SELECT DISTINCT e.task FROM e JOIN t ON t.task = e.trigger WHERE t.ok AND t.task % 10 = 3"),
    "tsk15_can_run": (tsk15_can_run, f"WITH {T} SELECT t.task, coalesce(bool_and(coalesce(p.ok OR p.bad, false)) FILTER (e.task IS NOT NULL), true) AS can_run, count(e.task) AS triggers FROM t LEFT JOIN e ON e.task = t.task LEFT JOIN t p ON p.task = e.trigger GROUP BY 1"),
    "tsk17_status": (tsk17_status, f"WITH {STATUS} SELECT task, status FROM st"),
    "tsk17_trace": (tsk17_trace, f"""WITH RECURSIVE {STATUS}, r AS (SELECT task AS root, task, 0 AS depth FROM t
  UNION ALL SELECT r.root, e.trigger, r.depth + 1 FROM r JOIN st ON st.task = r.task AND st.status NOT IN ('Success', 'Failed', 'Ex_NotDefined') JOIN e ON e.task = r.task) SELECT root, task, depth FROM r"""),
    "tsk18_running": (tsk18_running, """WITH r AS (SELECT l_suppkey AS executor, CASE WHEN l_linenumber > 2 THEN l_orderkey % 1000 + 30 * l_linenumber END AS completed FROM lineitem WHERE l_orderkey % 1000 <= 500)
  SELECT executor, count(*) FILTER (completed IS NULL OR completed > 500) AS running, count(*) FILTER (completed IS NULL OR completed > 500 OR 500 - completed <= 40) AS listed FROM r GROUP BY 1 HAVING listed > 0"""),
    "tsk19_histogram": (tsk19_histogram, f"WITH {STATUS} SELECT status, count(*) AS n FROM st GROUP BY 1"),
}
