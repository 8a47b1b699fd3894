"""Queries of scalar functions, text, codecs and streams, each with its equivalent in SQL."""

import uuid

from pyspark.sql import functions as F

from ..functions import scalars, text
from ..functions.time import age_us, epoch_us, iso_name
from ..sources import ingest
from ..sources.tables import VersionStore, shared_dir, table, versions


def event_time():
    return epoch_us("ts")


def scl1_mod(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", scalars.mod(F.floor("value") - 250, 7).cast("long").alias("m"))


def scl2_digits(spark, sf):
    n = F.col("event_id")
    digits = scalars.to_digits(n, 3)
    return table(spark, sf, "events").select("event_id", F.array_join(F.transform(digits, lambda d: d.cast("string")), "").alias("digits"))


def scl3_levenshtein(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", scalars.edit_distance(F.lower("p_name"), F.lower("p_type")).cast("long").alias("distance"))


def scl4_limited(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", scalars.edit_distance(F.lower("p_name"), F.lower("p_type"), 9).cast("long").alias("distance"))


def scl8_age(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", age_us("o_orderdate", 1_700_000_000_000_000).alias("age"))


def scl9_log_names(spark, sf):
    return table(spark, sf, "events").select("event_id", iso_name("ts").alias("name"))


def src6_json(spark, sf):
    docs = table(spark, sf, "events").select("event_id", "props")
    return ingest.json_documents(docs, "props", "k long").select("event_id", "k")


def src8_json_documents(spark, sf):
    docs = table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("props")), "\n").alias("body"))
    return ingest.json_documents(docs, "body", "k long").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


def src12_training_set(spark, sf):
    rows = ingest.training_set(table(spark, sf, "part").select("p_partkey", "p_size", "p_brand"), "p_brand")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"))


def src14_attributes(spark, sf):
    q = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("size="), "p_size", F.lit("&price="), "p_retailprice", F.lit("&brand="), "p_brand", F.lit("&odd=1e&none=")).alias("query"))
    return ingest.attributes(q, "query").select("p_partkey", "name", F.round("number", 2).alias("number"), "string")


def src17_log_search(spark, sf):
    lines = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("role") == "assistant", "\t").otherwise(""), F.col("text")).alias("line"))
    records = text.folded(lines, ["conv_id"], "turn", "line")
    return text.search(records, "text", "[Tt]h").groupBy("conv_id").agg(F.count("*").alias("records"), F.sum(F.length("text")).cast("long").alias("chars"))


def src17_masked(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(text.shown(F.col("text"))).cast("long").alias("chars"))


def rel_rollup(spark, sf):
    calls = table(spark, sf, "events").select(F.col("event_type").alias("prefix"), (F.col("event_id") % 3).alias("part"), "value")
    return calls.rollup("prefix", "part").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.grouping_id().alias("level"))


def str_tumbling(spark, sf):
    e = table(spark, sf, "events")
    hours = F.floor(event_time() / 3_600_000_000)
    return e.groupBy(hours.alias("hour"), "event_type").agg(F.count("*").alias("n"))


def str1_stream(spark, sf):
    """The same counts by a stream that is drained once: only windows that the watermark has closed come out."""
    from ..streaming.events import drained, windowed_counts

    schema = table(spark, sf, "events").schema
    # a path of its own file as a stream: the folder is the source, the file's name the filter
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    utc = stream.withColumn("time", F.timestamp_micros(event_time()))
    out = drained(windowed_counts(utc, "time", ["event_type"], "1 hour"))
    return out.select(F.floor(F.unix_micros("start") / 3_600_000_000).alias("hour"), "event_type", "n")


def str_sessions(spark, sf):
    """Sessions of a user: events within an hour of each other."""
    e = table(spark, sf, "events").withColumn("time", F.timestamp_micros(event_time()))
    s = e.groupBy(F.session_window("time", "1 hour"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_micros("session_window.start").alias("start"), "n")


def _kept(df, form, **options):
    """``df`` in files of another form in the shared folder, for the readers of that form."""
    path = f"{shared_dir(df.sparkSession)}/{form}-{uuid.uuid4().hex}"
    df.write.format(form).options(**options).save(path)
    return path


def src1_store(spark, sf):
    """All versions through the partitioned store: stored twice, the second time in vain."""
    store = VersionStore(spark, f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}")
    every = versions(table(spark, sf, "events"))
    store.store(every)
    store.store(every.withColumn("value", F.lit(-1.0)))
    return store.read()


def src3_store_key(spark, sf):
    store = VersionStore(spark, f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}")
    store.store(versions(table(spark, sf, "events")))
    return store.read(7).select("ptr", "eff", "seq")


def src9_json_lines(spark, sf):
    path = _kept(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), "json")
    return ingest.json_items(spark, path, "p_partkey long, p_name string, p_size int", "part")


def src11_delimited(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    items = ingest.delimited_items(spark, _kept(rows, "csv", compression="gzip"), ["quantity", "price", "discount", "tax"])
    return items.groupBy("label", "quantity").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"))


def src13_as_json(spark, sf):
    return ingest.as_json(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"))


def src15_settings(spark, sf):
    lines = table(spark, sf, "nation").select(F.concat("n_name", F.lit(" = "), "n_regionkey", F.lit(" // a nation")).alias("value"))
    found = ingest.settings(spark, _kept(lines, "text"), {"ATLANTIS": "9"})
    return spark.createDataFrame(list(found.items()), "name string, value string")


def str2_late_writes(spark, sf):
    """Events in the order of their ids as reads and writes of users at times out of step, judged by a stream."""
    from ..streaming.events import drained, judged_writes

    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    op = F.when(F.col("event_type") == "purchase", "write").otherwise("read")
    n = F.col("event_id")
    log = stream.select(F.col("user_id").alias("ptr"), n.alias("seq"), (n * 1000 + n * 7919 % 600_000).alias("eff"), op.alias("op"))
    return drained(judged_writes(log)).where("op = 'write'").select("ptr", "seq", "late")


QUERIES = {
    "scl1_mod": (scl1_mod, "SELECT event_id, CAST(((CAST(floor(value) AS BIGINT) - 250) % 7 + 7) % 7 AS BIGINT) AS m FROM events"),
    "scl2_digits": (scl2_digits, """WITH RECURSIVE d(event_id, rest, digits) AS (SELECT event_id, event_id, '' FROM events UNION ALL SELECT event_id, rest // 3, (rest % 3) || digits FROM d WHERE rest > 0)
  SELECT event_id, digits FROM d WHERE rest = 0"""),
    "scl3_levenshtein": (scl3_levenshtein, "SELECT p_partkey, levenshtein(lower(p_name), lower(p_type)) AS distance FROM part"),
    "scl4_limited": (scl4_limited, "SELECT p_partkey, CASE WHEN levenshtein(lower(p_name), lower(p_type)) > 9 THEN -1 ELSE levenshtein(lower(p_name), lower(p_type)) END AS distance FROM part"),
    "scl8_age": (scl8_age, "SELECT o_orderkey, 1700000000000000 - epoch_us(o_orderdate) AS age FROM orders"),
    "scl9_log_names": (scl9_log_names, "SELECT event_id, strftime(ts, '%Y-%m-%dT%H_%M_%S') AS name FROM events"),
    "src6_json": (src6_json, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
    "src8_json_documents": (src8_json_documents, "SELECT user_id, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1"),
    "src12_training_set": (src12_training_set, "SELECT p_brand AS label, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sizes FROM part GROUP BY 1"),
    "src14_attributes": (src14_attributes, """SELECT p_partkey, 'size' AS name, p_size::DOUBLE AS number, NULL::VARCHAR AS string FROM part UNION ALL SELECT p_partkey, 'price', round(p_retailprice, 2), NULL FROM part
  UNION ALL SELECT p_partkey, 'brand', NULL, p_brand FROM part UNION ALL SELECT p_partkey, 'odd', NULL, '1e' FROM part UNION ALL SELECT p_partkey, 'none', NULL, '' FROM part"""),
    "src17_log_search": (src17_log_search, r"""WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN chr(9) ELSE '' END || text AS line FROM conversations),
  n AS (SELECT *, sum(CASE WHEN line LIKE chr(9) || '%' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS record FROM l),
  r AS (SELECT conv_id, record, string_agg(line, chr(10) ORDER BY turn) AS text FROM n GROUP BY 1, 2)
  SELECT conv_id, count(*) AS records, CAST(sum(length(text)) AS BIGINT) AS chars FROM r WHERE regexp_matches(text, '(^|[^0-9a-z])[Tt]h') GROUP BY 1"""),
    "src17_masked": (src17_masked, "SELECT doc_id, length(regexp_replace(text, '[A-Za-z0-9+/=]{32,}', '...', 'g')) AS chars FROM documents"),
    "src1_store": (src1_store, "SELECT user_id AS ptr, epoch_us(ts) AS eff, min(event_id) AS seq, arg_min(value, event_id) AS value, arg_min(event_type = 'error', event_id) AS deleted FROM events GROUP BY 1, 2"),
    "src3_store_key": (src3_store_key, "SELECT user_id AS ptr, epoch_us(ts) AS eff, min(event_id) AS seq FROM events WHERE user_id = 7 GROUP BY 1, 2"),
    "src9_json_lines": (src9_json_lines, "SELECT p_partkey, p_name, p_size, 'part' AS label FROM part"),
    "src11_delimited": (src11_delimited, "SELECT l_returnflag AS label, l_quantity AS quantity, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1, 2"),
    "src13_as_json": (src13_as_json, "SELECT CAST(to_json({'p_partkey': p_partkey, 'p_name': p_name, 'p_size': p_size}) AS VARCHAR) AS json FROM part"),
    "src15_settings": (src15_settings, "SELECT n_name AS name, n_regionkey::VARCHAR AS value FROM nation UNION ALL SELECT 'ATLANTIS', '9'"),
    "str2_late_writes": (str2_late_writes, """WITH l AS (SELECT user_id AS ptr, event_id AS seq, event_id * 1000 + event_id * 7919 % 600000 AS eff, event_type = 'purchase' AS w FROM events)
  SELECT ptr, seq, late FROM (SELECT *, coalesce(max(eff) OVER (PARTITION BY ptr ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > eff, false) AS late FROM l) WHERE w"""),
    "rel_rollup": (rel_rollup, "SELECT event_type AS prefix, event_id % 3 AS part, count(*) AS n, round(sum(value), 4) AS total, grouping_id(event_type, event_id % 3) AS level FROM events GROUP BY ROLLUP (event_type, event_id % 3)"),
    "str_tumbling": (str_tumbling, "SELECT epoch_us(ts) // 3600000000 AS hour, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "str_sessions": (str_sessions, """WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS s FROM events),
  n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g) SELECT user_id, min(t) AS start, count(*) AS n FROM n GROUP BY user_id, k"""),
    "str1_stream": (str1_stream, "WITH h AS (SELECT epoch_us(ts) // 3600000000 AS hour, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM h WHERE (hour + 1) * 3600000000 <= (SELECT max(epoch_us(ts)) FROM events) - 15000000"),
}
