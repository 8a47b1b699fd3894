"""Queries over pages, rules and trees, each with its equivalent in SQL where there is one."""

from pyspark.sql import functions as F

from ..functions.fitness import accuracy, labeling_entropy, linear_entropy
from ..operators import pages as pag
from ..operators import rules, tree
from ..sources.tables import table, written

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: Rows without a quantity: they take the exception branch.
LACKS = 13


def items(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.withColumn("l_quantity", F.when(F.col("l_partkey") % LACKS != 0, F.col("l_quantity")))


def _candidates(spark, sf):
    return rules.candidates(items(spark, sf), "l_returnflag", FEATURES)


def rul1_best_rule(spark, sf):
    found = rules.best(_candidates(spark, sf), fitness=labeling_entropy(1.0))
    return found.select("field", "threshold", F.round("fitness", 6).alias("fitness"), "n_le", "n_gt")


def rul2_candidates(spark, sf):
    c = _candidates(spark, sf)
    k_le = sum(((F.col(n) > 0).cast("long") for n in c.columns if n.startswith("le_")), F.lit(0).cast("long"))
    return c.select("field", "threshold", *[rules.side(c, s).alias(f"n_{s}") for s in ("le", "gt", "ex")], k_le.alias("k_le"))


def _scores(spark, sf, fitness):
    return rules.scored(_candidates(spark, sf), fitness).select("field", "threshold", F.round("fitness", 6).alias("fitness"))


def rul4_labeling_entropy(spark, sf):
    return _scores(spark, sf, labeling_entropy(1.0))


def rul5_accuracy(spark, sf):
    return _scores(spark, sf, accuracy)


def rul6_linear_entropy(spark, sf):
    return _scores(spark, sf, linear_entropy())


def rul7_best_mix(spark, sf):
    found = rules.best(_candidates(spark, sf), fitness=linear_entropy())
    return found.select("field", "threshold", F.round("fitness", 6).alias("fitness"), "n_le", "n_gt")


def rul10_split(spark, sf):
    sizes = items(spark, sf).groupBy((F.col("l_suppkey") % 50).alias("node_id")).agg(F.count("*").alias("n"))
    return rules.splittable(sizes, 20)


def tre4_partition(spark, sf):
    bit = rules.branch(F.col("l_quantity"), F.lit(30.0))
    return items(spark, sf).groupBy(bit.cast("int").alias("branch"), F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"))


def _nodes(spark, sf):
    """Fixed thresholds for two levels: quantity, then discount or tax."""
    rows = [(1, 0, "l_quantity", 30.0, False), (2, 1, "l_discount", 0.05, False), (3, 1, "l_tax", 0.04, False), *[(i, 2 if i > 4 else 1, None, None, True) for i in range(4, 11)]]
    return spark.createDataFrame(rows, "node_id long, depth int, field string, threshold double, is_leaf boolean")


def _members(spark, sf):
    return tree.routed(items(spark, sf), _nodes(spark, sf), FEATURES)


def tre5_find(spark, sf):
    return _members(spark, sf).groupBy("node_id").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("orders"))


def tre9_ids(spark, sf):
    ids = spark.range(1, 365).select(F.col("id").alias("node_id"))
    n = F.col("node_id")
    return ids.select(
        "node_id", F.when(n > 1, tree.parent(n)).alias("parent"), F.when(n > 1, tree.bit(n).cast("long")).alias("branch"), tree.depth(n).cast("long").alias("depth"), tree.child(n, F.lit(0)).alias("first_child")
    )


def tre10_paths(spark, sf):
    ids = spark.range(1, 365).select(F.col("id").alias("node_id"))
    return ids.select("node_id", F.array_join(F.transform(tree.path(F.col("node_id")), lambda b: b.cast("string")), "").alias("path"))


def tre12_path(spark, sf):
    nodes = _nodes(spark, sf)
    return tree.path_of(nodes, nodes.where("is_leaf")).select("node_id", "ancestor", F.coalesce("rule", F.lit("")).alias("rule"))


def tre13_counts(spark, sf):
    return tree.subtree_counts(_members(spark, sf), "l_returnflag")


def tre15_walk(spark, sf):
    nodes = spark.range(1, 41).select(F.col("id").alias("node_id"), tree.walk_key(F.col("id")).alias("walk_key"))
    from ..operators.ordered import global_rank

    return global_rank(nodes, ["walk_key"], "place").select("node_id", "place")


LABELS, IDS_OF = ["A", "N", "R"], ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def tre16_walk_members(spark, sf):
    """How many members, and up to which place, each node has in the order of the walk."""
    placed = tree.in_walk_order(_members(spark, sf), IDS_OF)
    return placed.groupBy("node_id").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.sum(F.col("place") * (F.col("l_orderkey") % 1000)).alias("mix"))


def tre17_find(spark, sf):
    """Where each item comes to, and what is there; counted, as items have no key of their own."""
    out = tree.found(items(spark, sf), _nodes(spark, sf), _members(spark, sf), "l_returnflag", LABELS, FEATURES)
    return out.groupBy("l_orderkey", "path", *[f"n_{y}" for y in LABELS]).agg(F.count("*").alias("items"))


def tre18_info(spark, sf):
    return tree.info(_nodes(spark, sf), _members(spark, sf), "l_returnflag", LABELS)


def tre18_list(spark, sf):
    """The page of 40 members behind a cursor."""
    page = tree.listed(_members(spark, sf), IDS_OF, ("013", 1000, 0, 0, 0.0, 0.0), 40)
    return page.select("node_id", "walk_key", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


def tre20_accuracy(spark, sf):
    """Predictions from nine tenths of the orders, measured on the last tenth."""
    held_out = F.col("l_orderkey") % 10 == 0
    learned = written(_members(spark, sf).where(~held_out))
    a = tree.accuracy(items(spark, sf).where(held_out), _nodes(spark, sf), learned, "l_returnflag", FEATURES)
    return a.select("n", "hits", F.round("accuracy", 6).alias("accuracy"))


def tre7_level1(spark, sf):
    """Children of the root after one level of growth, by label."""
    strategy = tree.Strategy(max_depth=1)
    _, members = tree.grow(items(spark, sf), "l_returnflag", FEATURES, strategy)
    return members.groupBy("node_id", F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"))


def tre8_growth(spark, sf):
    """A whole tree over embeddings: leaves with their sizes and most frequent labels; no SQL, its levels depend on data."""
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    nodes, members = tree.grow(emb, "label", [f"e{i}" for i in range(64)])
    sizes = members.groupBy("node_id").agg(F.count("*").alias("n"))
    return nodes.join(sizes, "node_id", "left").join(tree.predictions(members, "label"), "node_id", "left").select(
        "node_id", "depth", "field", F.round("threshold", 6).alias("threshold"), "is_leaf", F.coalesce("n", F.lit(0)).alias("n"), "predicted"
    )


def pag1_schema(spark, sf):
    part = table(spark, sf, "part")
    return pag.inferred(pag.as_pairs(part, "p_partkey", ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]))


def pag3_union(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    u = pag.union(a, b)
    return u.select("name", "balance", "segment", F.isnan("nation").alias("no_nation"), F.when(~F.isnan("nation"), F.col("nation")).alias("nation"))


def pag4_label_counts(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return pag.label_counts(docs.select(F.col("lang").alias("label")))


def pag6_get_all(spark, sf):
    rows = table(spark, sf, "orders").where("o_orderkey % 7 = 0").select("o_orderkey")
    return pag.rows_at(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), rows.union(rows), "o_orderkey")


def pag8_as_map(spark, sf):
    part = table(spark, sf, "part")
    pairs = pag.as_pairs(part, "p_partkey", ["p_name", "p_size", "p_retailprice"])
    p = pag.page(pairs, pag.inferred(pairs))
    return p.select(F.col("row").alias("p_partkey"), F.col("num")["p_size"].alias("p_size"), F.round(F.col("num")["p_retailprice"], 2).alias("p_retailprice"), F.col("str")["p_name"].alias("p_name"))


def pag12_size(spark, sf):
    pages = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 128).alias("page")).agg(F.count("*").alias("size"))
    return pages.agg(F.count("*").alias("pages"), F.sum("size").alias("size"))


def pag14_next_block(spark, sf):
    return pag.next_block(table(spark, sf, "events").select("event_id", "event_type"), "event_id", 137, 50)


ITEMS = f"""i AS (SELECT *, CASE WHEN l_partkey % {LACKS} <> 0 THEN l_quantity END AS q FROM lineitem),
  u AS (SELECT 'l_quantity' AS field, q AS v, l_returnflag AS y FROM i UNION ALL SELECT 'l_extendedprice', l_extendedprice, l_returnflag FROM i UNION ALL SELECT 'l_discount', l_discount, l_returnflag FROM i UNION ALL SELECT 'l_tax', l_tax, l_returnflag FROM i),
  g AS (SELECT field, v, y, count(*) AS c FROM u WHERE v IS NOT NULL GROUP BY ALL),
  tot AS (SELECT field, y, sum(c) AS n FROM g GROUP BY ALL), ex AS (SELECT field, y, count(*) AS x FROM u WHERE v IS NULL GROUP BY ALL),
  grid AS (SELECT d.field, d.v, t.y, t.n, coalesce(g.c, 0) AS c FROM (SELECT DISTINCT field, v FROM g) d JOIN tot t USING (field) LEFT JOIN g ON g.field = d.field AND g.v = d.v AND g.y = t.y),
  cum AS (SELECT field, v, y, CAST(n AS DOUBLE) AS n, CAST(sum(c) OVER (PARTITION BY field, y ORDER BY v) AS DOUBLE) AS le FROM grid),
  s AS (SELECT field, v, sum(le) AS ls, sum(n - le) AS gs, count(*) FILTER (le > 0) AS kl, count(*) AS kg, max(le) AS ml, max(n - le) AS mg FROM cum GROUP BY ALL),
  xs AS (SELECT field, CAST(sum(x) AS DOUBLE) AS xs, count(*) AS kx, CAST(max(x) AS DOUBLE) AS mx FROM ex GROUP BY ALL),
  c AS (SELECT s.*, coalesce(xs, 0) AS xs, coalesce(kx, 0) AS kx, coalesce(mx, 0) AS mx FROM s LEFT JOIN xs USING (field))"""
ENTROPY = f"""{ITEMS}, le AS (SELECT c.field, c.v, sum(CASE WHEN m.le > 0 THEN m.le * ln((m.le + 1) / (c.ls + c.kl)) ELSE 0 END) + sum((m.n - m.le) * ln((m.n - m.le + 1) / (c.gs + c.kg))) AS t FROM c JOIN cum m USING (field, v) GROUP BY ALL),
  xe AS (SELECT ex.field, sum(x * ln((x + 1) / (xs.xs + xs.kx))) AS t FROM ex JOIN xs USING (field) GROUP BY ALL),
  fit AS (SELECT c.field, c.v, c.ls, c.gs, (le.t + coalesce(xe.t, 0)) / ((c.ls + c.gs + c.xs) * ln(2)) AS f FROM c JOIN le USING (field, v) LEFT JOIN xe USING (field)
    WHERE c.ls > 0.15 * (c.ls + c.gs + c.xs) AND c.gs > 0.15 * (c.ls + c.gs + c.xs))"""
ROUTE = f"""m AS (SELECT *, CASE WHEN q IS NULL THEN 4 WHEN q > 30 THEN CASE WHEN l_discount > 0.05 THEN 5 ELSE 6 END ELSE CASE WHEN l_tax > 0.04 THEN 8 ELSE 9 END END AS node_id
  FROM (SELECT *, CASE WHEN l_partkey % {LACKS} <> 0 THEN l_quantity END AS q FROM lineitem))"""
WALK = "CASE node_id WHEN 4 THEN '23' WHEN 5 THEN '003' WHEN 6 THEN '013' WHEN 8 THEN '103' ELSE '113' END"
HISTOGRAM = """a AS (SELECT node_id, l_returnflag AS y FROM m UNION ALL SELECT (node_id - 2) // 3 + 1, l_returnflag FROM m WHERE node_id > 4 UNION ALL SELECT 1, l_returnflag FROM m),
  h AS (SELECT node_id, count(*) FILTER (y = 'A') AS n_A, count(*) FILTER (y = 'N') AS n_N, count(*) FILTER (y = 'R') AS n_R FROM a GROUP BY 1)"""
IDS = """RECURSIVE t(node_id, parent, branch, depth, path) AS (SELECT 1::BIGINT, NULL::BIGINT, NULL::BIGINT, 0::BIGINT, ''
  UNION ALL SELECT 3 * (node_id - 1) + b + 2, node_id, b, depth + 1, path || b FROM t, (VALUES (0::BIGINT), (1::BIGINT), (2::BIGINT)) v(b) WHERE depth < 5)"""
MIX = f"""{ITEMS}, tt AS (SELECT field, sum(n) AS n FROM (SELECT field, n FROM tot UNION ALL SELECT field, x FROM ex) GROUP BY 1),
  lab AS (SELECT field, y, sum(n) AS n FROM (SELECT field, y, n FROM tot UNION ALL SELECT field, y, x FROM ex) GROUP BY ALL),
  sides AS (SELECT s.field, s.v, lab.y, coalesce(cum.le, 0) AS c, 0 AS side FROM s JOIN lab USING (field) LEFT JOIN cum ON cum.field = s.field AND cum.v = s.v AND cum.y = lab.y
    UNION ALL SELECT s.field, s.v, lab.y, coalesce(cum.n - cum.le, 0), 1 FROM s JOIN lab USING (field) LEFT JOIN cum ON cum.field = s.field AND cum.v = s.v AND cum.y = lab.y
    UNION ALL SELECT s.field, s.v, lab.y, coalesce(CAST(ex.x AS DOUBLE), 0), 2 FROM s JOIN lab USING (field) LEFT JOIN ex ON ex.field = s.field AND ex.y = lab.y),
  terms AS (SELECT d.field, d.v, CAST(tt.n AS DOUBLE) AS nn, d.c / tt.n AS x, CAST(lab.n AS DOUBLE) * (CASE side WHEN 0 THEN c.ls WHEN 1 THEN c.gs ELSE c.xs END) / (CAST(tt.n AS DOUBLE) * tt.n) AS y, c.ls, c.gs
    FROM sides d JOIN tt USING (field) JOIN lab ON lab.field = d.field AND lab.y = d.y JOIN c ON c.field = d.field AND c.v = d.v)"""

QUERIES = {
    "rul1_best_rule": (rul1_best_rule, f"WITH {ENTROPY} SELECT field, v AS threshold, round(f, 6) AS fitness, CAST(ls AS BIGINT) AS n_le, CAST(gs AS BIGINT) AS n_gt FROM fit ORDER BY round(f, 9) DESC, field, v LIMIT 1"),
    "rul2_candidates": (rul2_candidates, f"WITH {ITEMS} SELECT field, v AS threshold, CAST(ls AS BIGINT) AS n_le, CAST(gs AS BIGINT) AS n_gt, CAST(xs AS BIGINT) AS n_ex, kl AS k_le FROM c"),
    "rul4_labeling_entropy": (rul4_labeling_entropy, f"WITH {ENTROPY} SELECT field, v AS threshold, round(f, 6) AS fitness FROM fit"),
    "rul5_accuracy": (rul5_accuracy, f"WITH {ITEMS} SELECT field, v AS threshold, round(1 - (ls - ml + gs - mg + xs - mx) / (ls + gs + xs), 6) AS fitness FROM c WHERE ls > 0.15 * (ls + gs) AND gs > 0.15 * (ls + gs)"),
    "rul6_linear_entropy": (rul6_linear_entropy, f"WITH {MIX} SELECT field, v AS threshold, round(sum(-0.1 * x * ln(1 / nn + x) + x * ln(1 / nn + y) - y * ln(1 / nn + x)), 6) AS fitness FROM terms WHERE ls > 0 AND gs > 0 GROUP BY 1, 2"),
    "rul7_best_mix": (rul7_best_mix, f"""WITH {MIX}, f AS (SELECT field, v, sum(-0.1 * x * ln(1 / nn + x) + x * ln(1 / nn + y) - y * ln(1 / nn + x)) AS f, any_value(ls) AS ls, any_value(gs) AS gs FROM terms WHERE ls > 0 AND gs > 0 GROUP BY 1, 2)
  SELECT field, v AS threshold, round(f, 6) AS fitness, CAST(ls AS BIGINT) AS n_le, CAST(gs AS BIGINT) AS n_gt FROM f ORDER BY round(f, 9) DESC, field, v LIMIT 1"""),
    "rul10_split": (rul10_split, "SELECT l_suppkey % 50 AS node_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 20"),
    "tre4_partition": (tre4_partition, f"SELECT CAST(CASE WHEN l_partkey % {LACKS} = 0 THEN 2 WHEN l_quantity > 30 THEN 0 ELSE 1 END AS INTEGER) AS branch, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY ALL"),
    "tre5_find": (tre5_find, f"WITH {ROUTE} SELECT CAST(node_id AS BIGINT) AS node_id, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS orders FROM m GROUP BY 1"),
    "tre7_level1": (tre7_level1, f"""WITH {ENTROPY}, b AS (SELECT field, v FROM fit ORDER BY round(f, 9) DESC, field, v LIMIT 1),
  r AS (SELECT i.l_returnflag AS label, CASE b.field WHEN 'l_quantity' THEN i.q WHEN 'l_extendedprice' THEN i.l_extendedprice WHEN 'l_discount' THEN i.l_discount ELSE i.l_tax END AS x, b.v FROM i, b)
  SELECT CAST(CASE WHEN x IS NULL THEN 4 WHEN x > v THEN 2 ELSE 3 END AS BIGINT) AS node_id, label, count(*) AS n FROM r GROUP BY ALL"""),
    "tre8_growth": (tre8_growth, None),
    "tre9_ids": (tre9_ids, f"WITH {IDS} SELECT node_id, parent, branch, depth, 3 * (node_id - 1) + 2 AS first_child FROM t"),
    "tre10_paths": (tre10_paths, f"WITH {IDS} SELECT node_id, path FROM t"),
    "tre12_path": (tre12_path, """WITH RECURSIVE n(node_id, rule) AS (VALUES (1, 'l_quantity > 30.0'), (2, 'l_discount > 0.05'), (3, 'l_tax > 0.04'), (4, ''), (5, ''), (6, ''), (7, ''), (8, ''), (9, ''), (10, '')),
  a AS (SELECT node_id::BIGINT AS node_id, node_id::BIGINT AS ancestor FROM n WHERE node_id > 3 UNION ALL SELECT node_id, (ancestor - 2) // 3 + 1 FROM a WHERE ancestor > 1)
  SELECT a.node_id, a.ancestor, n.rule FROM a JOIN n ON n.node_id = a.ancestor"""),
    "tre13_counts": (tre13_counts, f"WITH {ROUTE}, a AS (SELECT node_id, l_returnflag FROM m UNION ALL SELECT (node_id - 2) // 3 + 1, l_returnflag FROM m WHERE node_id > 4 UNION ALL SELECT 1, l_returnflag FROM m) SELECT CAST(node_id AS BIGINT) AS node_id, l_returnflag AS label, count(*) AS n FROM a GROUP BY ALL"),
    "tre15_walk": (tre15_walk, f"WITH {IDS} SELECT node_id, row_number() OVER (ORDER BY path || '3') AS place FROM t WHERE node_id <= 40"),
    "tre16_walk_members": (tre16_walk_members, f"WITH {ROUTE}, w AS (SELECT *, row_number() OVER (ORDER BY {WALK}, l_orderkey, l_partkey, l_suppkey, l_extendedprice, q) AS place FROM m) SELECT CAST(node_id AS BIGINT) AS node_id, min(place) AS first, max(place) AS last, CAST(sum(place * (l_orderkey % 1000)) AS BIGINT) AS mix FROM w GROUP BY 1"),
    "tre17_find": (tre17_find, f"WITH {ROUTE}, {HISTOGRAM} SELECT l_orderkey, rtrim({WALK}, '3') AS path, n_A, n_N, n_R, count(*) AS items FROM m JOIN h USING (node_id) GROUP BY ALL"),
    "tre18_info": (tre18_info, f"""WITH {ROUTE}, {HISTOGRAM}, n(node_id, depth, field, threshold) AS (VALUES (1, 0, 'l_quantity', 30.0::DOUBLE), (2, 1, 'l_discount', 0.05), (3, 1, 'l_tax', 0.04), (4, 1, NULL, NULL), (5, 2, NULL, NULL), (6, 2, NULL, NULL), (7, 2, NULL, NULL), (8, 2, NULL, NULL), (9, 2, NULL, NULL), (10, 2, NULL, NULL))
  SELECT CAST(n.node_id AS BIGINT) AS node_id, depth, field, threshold, coalesce(n_A, 0) AS n_A, coalesce(n_N, 0) AS n_N, coalesce(n_R, 0) AS n_R FROM n LEFT JOIN h ON h.node_id = n.node_id"""),
    "tre18_list": (tre18_list, f"WITH {ROUTE}, w AS (SELECT *, {WALK} AS walk_key FROM m) SELECT CAST(node_id AS BIGINT) AS node_id, walk_key, l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM w WHERE walk_key > '013' OR walk_key = '013' AND l_orderkey >= 1000 ORDER BY walk_key, l_orderkey, l_partkey, l_suppkey, l_extendedprice, q LIMIT 40"),
    "tre20_accuracy": (tre20_accuracy, f"WITH {ROUTE}, k AS (SELECT node_id, l_returnflag AS y, count(*) AS n FROM m WHERE l_orderkey % 10 <> 0 GROUP BY ALL), p AS (SELECT node_id, y FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY n DESC, y DESC) AS rn FROM k) WHERE rn = 1) SELECT count(*) AS n, count(*) FILTER (m.l_returnflag = p.y) AS hits, round(avg(CASE WHEN m.l_returnflag = p.y THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM m LEFT JOIN p USING (node_id) WHERE l_orderkey % 10 = 0"),
    "pag1_schema": (pag1_schema, """WITH p AS (SELECT unnest([{'f': 'p_name', 'v': p_name}, {'f': 'p_brand', 'v': p_brand}, {'f': 'p_type', 'v': p_type}, {'f': 'p_size', 'v': p_size::VARCHAR}, {'f': 'p_retailprice', 'v': p_retailprice::VARCHAR}]) AS s FROM part)
  SELECT s.f AS field, CASE WHEN bool_and(try_cast(s.v AS DOUBLE) IS NOT NULL) THEN 'double' ELSE 'string' END AS kind, count(s.v) AS present FROM p GROUP BY 1"""),
    "pag3_union": (pag3_union, "SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, true AS no_nation, NULL::DOUBLE AS nation FROM customer UNION ALL SELECT s_name, s_acctbal, NULL, false, s_nationkey::DOUBLE FROM supplier"),
    "pag4_label_counts": (pag4_label_counts, "SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1"),
    "pag6_get_all": (pag6_get_all, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 = 0"),
    "pag8_as_map": (pag8_as_map, "SELECT p_partkey, p_size::DOUBLE AS p_size, round(p_retailprice, 2) AS p_retailprice, p_name FROM part"),
    "pag12_size": (pag12_size, "SELECT count(*) AS pages, CAST(sum(size) AS BIGINT) AS size FROM (SELECT event_id // 128 AS page, count(*) AS size FROM events GROUP BY 1)"),
    "pag14_next_block": (pag14_next_block, "SELECT event_id, event_type FROM events WHERE event_id > 137 ORDER BY event_id LIMIT 50"),
}
