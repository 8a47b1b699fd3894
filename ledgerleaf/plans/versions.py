"""Queries over versioned keys and transactions, each with its equivalent in SQL."""

from pyspark.sql import functions as F

from ..functions.time import epoch_us
from ..operators import mvcc
from ..sources.tables import operations, table, versions

DAY = 86_400_000_000
MID = 1_705_276_800_000_000  # 2024-01-15 in microseconds
V = "v AS (SELECT user_id AS ptr, epoch_us(ts) AS eff, event_id AS seq, value, event_type = 'error' AS deleted FROM events)"
OPS = """RECURSIVE ops AS (SELECT *, row_number() OVER (PARTITION BY ptr ORDER BY seq) AS rn FROM (SELECT user_id % 512 AS ptr, event_id // 5 AS txn,
  event_id // 5 * 1000 + event_id // 5 * 7919 % 600000 AS eff, event_id AS seq, event_type = 'purchase' AS is_lock, event_id // 5 % 3 <> 0 AS committed,
  CASE WHEN event_id // 5 % 11 <> 0 THEN event_id // 5 * 5 + 5 + event_id // 5 % 4000 END AS released FROM events WHERE event_type IN ('view', 'purchase'))),
  s(ptr, rn, txn, eff, seq, is_lock, verdict, l_txn, l_rel, l_eff, l_com, rd, ve) AS (
    SELECT DISTINCT ptr, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, false, '', NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, false, NULL::BIGINT, NULL::BIGINT FROM ops
    UNION ALL
    SELECT ptr, rn, txn, eff, seq, is_lock, v, CASE WHEN v = 'ok' AND is_lock AND h_txn IS NULL THEN txn ELSE h_txn END, CASE WHEN v = 'ok' AND is_lock AND h_txn IS NULL THEN released ELSE h_rel END,
      CASE WHEN v = 'ok' AND is_lock AND h_txn IS NULL THEN eff ELSE h_eff END, CASE WHEN v = 'ok' AND is_lock AND h_txn IS NULL THEN committed ELSE h_com END,
      CASE WHEN v = 'ok' AND NOT is_lock THEN greatest(rd, eff) ELSE rd END, ve
    FROM (SELECT *, CASE WHEN NOT is_lock THEN CASE WHEN h_txn <> txn AND h_eff < eff THEN 'held' ELSE 'ok' END WHEN h_txn <> txn THEN 'held' WHEN h_txn = txn THEN 'ok'
        WHEN rd > eff THEN 'read' WHEN ve > eff THEN 'version' ELSE 'ok' END AS v
      FROM (SELECT o.*, CASE WHEN s.l_rel <= o.seq THEN NULL ELSE s.l_txn END AS h_txn, CASE WHEN s.l_rel <= o.seq THEN NULL ELSE s.l_rel END AS h_rel, CASE WHEN s.l_rel <= o.seq THEN NULL ELSE s.l_eff END AS h_eff,
        CASE WHEN s.l_rel <= o.seq THEN false ELSE s.l_com END AS h_com, s.rd, CASE WHEN s.l_rel <= o.seq AND s.l_com THEN greatest(s.ve, s.l_eff) ELSE s.ve END AS ve
        FROM s JOIN ops o ON o.ptr = s.ptr AND o.rn = s.rn + 1)))"""


def _versions(spark, sf):
    return versions(table(spark, sf, "events"))


def _staged(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("txn"), F.col("l_partkey").alias("ptr")).agg(F.max("l_quantity").alias("value"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("txn"), epoch_us("o_orderdate").alias("eff"))
    return lines.join(orders, "txn").withColumn("seq", F.col("txn"))


def _states(spark, sf):
    state = F.when(F.col("o_orderstatus") == "F", "COMMIT").when(F.col("o_orderstatus") == "P", "RESET").otherwise("OPEN")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("txn"), state.alias("state"), epoch_us("o_orderdate").alias("eff"))


def txn5_latest(spark, sf):
    return mvcc.latest(_versions(spark, sf)).select("ptr", "eff", "value")


def txn6_asof_point(spark, sf):
    return mvcc.snapshot(_versions(spark, sf), MID).select("ptr", "seq", "value")


def txn6_asof_join(spark, sf):
    events = table(spark, sf, "events")
    reads = versions(events.where("event_type = 'view'")).select("ptr", "eff", F.col("seq").alias("read_seq"))
    writes = versions(events.where("event_type in ('purchase', 'error')"))
    return mvcc.read_at(reads, writes, 2 * DAY).select("read_seq", "ptr", "version_seq", "value")


def txn7_conflicts(spark, sf):
    return mvcc.conflicts(operations(table(spark, sf, "events")))


def txn6_timed_reads(spark, sf):
    return mvcc.replayed(operations(table(spark, sf, "events"))).where("op = 'read'").drop("op")


def txn10_published(spark, sf):
    return mvcc.published(_staged(spark, sf), _states(spark, sf)).select("ptr", "eff", "txn", "value")


def txn12_recovery(spark, sf):
    states = _states(spark, sf)
    now = F.lit(906_000_000_000_000)
    return mvcc.recovered(states, now, 30 * DAY).groupBy("outcome", "state").agg(F.count("*").alias("n"))


def txn13_state(spark, sf):
    op = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "error", "reset").otherwise("lock")
    log = table(spark, sf, "events").select(F.floor(F.col("event_id") / 4).alias("txn"), F.col("event_id").alias("seq"), op.alias("op"))
    return mvcc.outcomes(log)


def txn14_gc(spark, sf):
    v = _versions(spark, sf)
    return mvcc.collect_garbage(v, F.lit(MID + 10 * DAY), 15 * DAY).select("ptr", "eff", "seq")


def txn17_upsert(spark, sf):
    existing = mvcc.latest(_versions(spark, sf))
    initial = table(spark, sf, "customer").select(F.col("c_custkey").alias("ptr"), F.lit(0.0).alias("value"))
    return mvcc.upserted(existing, initial)


def txn4_first(spark, sf):
    return mvcc.first_versions(_versions(spark, sf)).select("ptr", "seq", "value")


def txn21_noop(spark, sf):
    writes = table(spark, sf, "events").select(F.col("user_id").alias("ptr"), F.col("event_id").alias("seq"), (F.floor("value") % 3).alias("value"))
    return mvcc.effective_writes(writes)


def txn2_times(spark, sf):
    from ..functions.time import effective_ns

    t = table(spark, sf, "events").select("event_id", effective_ns(F.floor(epoch_us("ts") / 1_000_000), F.col("event_id") % 1000, F.col("user_id")).alias("eff"))
    return t.select("event_id", F.col("eff").cast("long").alias("eff"))


def txn23_shards(spark, sf):
    return mvcc.routed(_versions(spark, sf), "ptr", 8).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("ptr").alias("keys"))


def txn24_replicas(spark, sf):
    v = _versions(spark, sf)
    merged = mvcc.merged_replicas([v.where("seq % 3 <> 0"), v.where("seq % 3 <> 1")])
    return merged.groupBy("deleted").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


def txn27_metrics(spark, sf):
    calls = table(spark, sf, "events").select(
        F.concat_ws(".", "event_type", (F.col("event_id") % 3).cast("string")).alias("name"), F.col("value").alias("time"), (F.col("event_id") % 7 == 0).alias("failed")
    )
    m = mvcc.metrics(calls)
    return m.select("prefix", "name", "invocations", "success", "failed", F.round("total_time", 4).alias("total_time"), F.round("avg_time", 6).alias("avg_time"))


def txn28_attempts(spark, sf):
    attempts = table(spark, sf, "events").select(F.col("event_type").alias("site"), F.floor(F.col("event_id") / 3).alias("txn"), F.col("value").alias("time"), (F.col("event_id") % 5 != 0).alias("ok"))
    m = mvcc.transaction_metrics(attempts)
    return m.select("site", "executed", "attempts", "success", "failed", F.round("avg_time", 6).alias("avg_time"), F.round("avg_attempts", 6).alias("avg_attempts"))


QUERIES = {
    "txn2_times": (txn2_times, "SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) * 1000000000 + event_id % 1000 + user_id * 1000000 AS eff FROM events"),
    "txn4_first": (txn4_first, f"WITH {V} SELECT ptr, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY ptr ORDER BY eff, seq) AS rn FROM v) WHERE rn = 1"),
    "txn5_latest": (txn5_latest, f"WITH {V} SELECT ptr, eff, value FROM (SELECT *, row_number() OVER (PARTITION BY ptr ORDER BY eff DESC, seq DESC) AS rn FROM v) WHERE rn = 1 AND NOT deleted"),
    "txn6_asof_point": (txn6_asof_point, f"WITH {V} SELECT ptr, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY ptr ORDER BY eff DESC, seq DESC) AS rn FROM v WHERE eff <= {MID}) WHERE rn = 1 AND NOT deleted"),
    "txn6_asof_join": (txn6_asof_join, """WITH w AS (SELECT user_id AS ptr, epoch_us(ts) AS eff, event_id AS seq, value, event_type = 'error' AS deleted FROM events WHERE event_type IN ('purchase', 'error')),
  r AS (SELECT user_id AS ptr, epoch_us(ts) AS eff, event_id AS read_seq FROM events WHERE event_type = 'view')
  SELECT r.read_seq, r.ptr, CASE WHEN NOT w.deleted THEN w.seq END AS version_seq, CASE WHEN NOT w.deleted THEN w.value END AS value
  FROM r ASOF LEFT JOIN w ON r.ptr = w.ptr AND r.eff >= w.eff"""),
    "txn6_timed_reads": (txn6_timed_reads, f"WITH {OPS} SELECT ptr, txn, eff, seq, verdict FROM s WHERE rn > 0 AND NOT is_lock"),
    "txn7_conflicts": (txn7_conflicts, f"WITH {OPS} SELECT ptr, txn, eff, seq, verdict FROM s WHERE rn > 0 AND is_lock"),
    "txn10_published": (txn10_published, """WITH s AS (SELECT l_orderkey AS txn, l_partkey AS ptr, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
  j AS (SELECT s.*, epoch_us(o_orderdate) AS eff FROM s JOIN orders ON o_orderkey = txn WHERE o_orderstatus = 'F')
  SELECT ptr, eff, txn, value FROM (SELECT *, row_number() OVER (PARTITION BY ptr, eff ORDER BY txn DESC) AS rn FROM j) WHERE rn = 1"""),
    "txn12_recovery": (txn12_recovery, f"""WITH s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'COMMIT' WHEN 'P' THEN 'RESET' ELSE 'OPEN' END AS state, epoch_us(o_orderdate) AS eff FROM orders)
  SELECT CASE WHEN 906000000000000 - eff <= {30 * DAY} THEN 'held' WHEN state = 'COMMIT' THEN 'forward' ELSE 'back' END AS outcome, state, count(*) AS n FROM s GROUP BY 1, 2"""),
    "txn13_state": (txn13_state, """WITH l AS (SELECT event_id // 4 AS txn, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'reset' ELSE 'lock' END AS op FROM events),
  e AS (SELECT txn, min(seq) FILTER (op <> 'lock') AS at, arg_min(op, seq) FILTER (op <> 'lock') AS op FROM l GROUP BY 1)
  SELECT e.txn, CASE e.op WHEN 'commit' THEN 'COMMIT' WHEN 'reset' THEN 'RESET' ELSE 'OPEN' END AS state,
  count(*) FILTER (l.op = 'lock' AND (e.at IS NULL OR l.seq < e.at)) AS n_locks FROM e JOIN l ON l.txn = e.txn GROUP BY 1, 2"""),
    "txn14_gc": (txn14_gc, f"WITH {V} SELECT ptr, eff, seq FROM (SELECT *, row_number() OVER (PARTITION BY ptr ORDER BY eff DESC, seq DESC) AS rn FROM v) WHERE rn = 1 OR {MID + 10 * DAY} - eff <= {15 * DAY}"),
    "txn17_upsert": (txn17_upsert, f"""WITH {V}, l AS (SELECT ptr, value FROM (SELECT *, row_number() OVER (PARTITION BY ptr ORDER BY eff DESC, seq DESC) AS rn FROM v) WHERE rn = 1 AND NOT deleted)
  SELECT coalesce(l.ptr, c_custkey) AS ptr, coalesce(l.value, 0.0::DOUBLE) AS value, l.value IS NULL AS created FROM l FULL JOIN customer ON c_custkey = l.ptr"""),
    "txn21_noop": (txn21_noop, """WITH w AS (SELECT user_id AS ptr, event_id AS seq, CAST(floor(value) AS BIGINT) % 3 AS value FROM events)
  SELECT ptr, seq, value FROM (SELECT *, lag(value) OVER (PARTITION BY ptr ORDER BY seq) AS before FROM w) WHERE before IS NULL OR value <> before"""),
    "txn23_shards": (txn23_shards, "SELECT CAST(user_id % 8 AS INTEGER) AS shard, count(*) AS n, count(DISTINCT user_id) AS keys FROM events GROUP BY 1"),
    "txn24_replicas": (txn24_replicas, f"WITH {V}, u AS (SELECT * FROM v WHERE seq % 3 <> 0 UNION SELECT * FROM v WHERE seq % 3 <> 1) SELECT deleted, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM u GROUP BY 1"),
    "txn27_metrics": (txn27_metrics, """SELECT event_type AS prefix, event_type || '.' || (event_id % 3) AS name, count(*) AS invocations, count(*) FILTER (event_id % 7 <> 0) AS success,
  count(*) FILTER (event_id % 7 = 0) AS failed, round(sum(value), 4) AS total_time, round(avg(value), 6) AS avg_time FROM events GROUP BY 1, 2"""),
    "txn28_attempts": (txn28_attempts, """WITH t AS (SELECT event_type AS site, event_id // 3 AS txn, count(*) AS n, sum(value) AS t, bool_or(event_id % 5 <> 0) AS ok FROM events GROUP BY 1, 2)
  SELECT site, count(*) AS executed, CAST(sum(n) AS BIGINT) AS attempts, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failed,
  round(sum(t) / sum(n), 6) AS avg_time, round(sum(n) / count(*), 6) AS avg_attempts FROM t GROUP BY 1"""),
}
