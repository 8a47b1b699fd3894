"""The thin queries of this subpackage: each applies one operator to whole tables and derives the columns returned."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table
from .tokens import vocabulary


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find

    def joined(suffix: str) -> Column:
        def of_kind(kind: str) -> Column:
            return F.transform(kind + suffix, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

        return F.array_join(F.concat(*[of_kind(k) for k in KINDS]), ",")

    found = find(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(""), 256).alias("base_sha256"), joined("_all").alias("spans"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import NO_ID, differing_lines, edited, fingerprint, likeness

    rows = edited(table(spark, sf_dir, "documents"))
    return rows.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        fingerprint().alias("fingerprint"), fingerprint("edited_").alias("edited_fingerprint"),
        likeness("", "edited_").alias("near_edited"), likeness("", "next_").alias("near_next"),
        F.array_min(differing_lines("edited_", "")).cast("long").alias("first_edited_line"),
    )


def _joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import KINDS, find

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id", *[_of_kind("spans", k) for k in KINDS], F.sha2(_joined_spans(base), 256).alias("base_sha256"), _joined_spans(F.col("spans")).alias("spans")
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find

    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    items = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def _remainder(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    held_out = _remainder("doc_id", 10) == 0
    scored = score(table(spark, sf_dir, "documents"), held_out, word_orders=2)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score

    docs, rest = table(spark, sf_dir, "documents"), _remainder("doc_id", 5)
    model = fit(docs, table(spark, sf_dir, "labels"), training=rest != 0)
    return score(docs, model).select("doc_id", F.coalesce(rest == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfiles import read_token_files, write_token_files

    docs = table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, vocabulary("byte_bpe_50k.json"))
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import linked_components

    return linked_components(table(spark, sf_dir, "documents"), width=3, num=90).drop("first")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import histogram_sort

    rows = histogram_sort(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return rows.select(
        "doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_packing": op2_packing,
    "op3_fingerprints": op3_fingerprints,
    "op4_secrets": op4_secrets,
    "op5_decontamination": op5_decontamination,
    "op6_language_model": op6_language_model,
    "op7_quality": op7_quality,
    "op8_token_files": op8_token_files,
    "op9_jaccard": op9_jaccard,
    "op10_sharding": op10_sharding,
}
#: op5 and op9 in SQL, for tables small enough for it: a pair of documents for each shared shingle.
ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
  v AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
  h AS (SELECT v.doc_id, v.i, p.n, p.item_id FROM v JOIN p ON p.n = v.n AND p.x = v.x),
  k AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY 1),
  t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY 1)
  SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, k.n_hit IS NOT NULL AS contaminated
  FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op9_jaccard": r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 2], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), k AS (SELECT x FROM s GROUP BY 1 HAVING count(*) > 1),
  o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM (SELECT s.* FROM s SEMI JOIN k USING (x)) a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(doc_id, pos) AS (SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.pos),
  c AS (SELECT doc_id, min(pos) AS pos FROM r GROUP BY 1)
  SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.pos, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
}
