"""A training corpus from raw documents, stage by stage; each stage's result is written as Parquet and read again.

quality      documents that the quality classifier rejects go
near_copies  of each component of near copies (five-word shingles, similarity 0.8 or more) the document of the least id
             stays; where several rows have that id, one of them
benchmark    documents that hold a window of ten consecutive words of a benchmark item, or a whole shorter item, go
pii          personal data, base and discovered spans, is replaced by a mark of its kind
packing      the texts' token ids are packed into windows: a row for each piece, with its ids

The first four return the columns of ``documents``; ``n_chars`` follows the text.

Rows with a null or repeated id are documents like any other: no decision looks a document up by its id alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import decontamination, jaccard, packing, pii, quality
from ledgerleaf.llm.common import stored, table
from ledgerleaf.llm.tokens import vocabulary

#: Documents of a lower score are rejected; a text counts as good from here on in the classifier's own query too.
LEAST_QUALITY = 0.3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), training)
    return quality.kept(docs, model, LEAST_QUALITY).select(*COLUMNS)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows get numbers that are written with them
    numbered = stored(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    members = jaccard.linked_components(numbered, width=5, num=80, row_col="row")
    gone = stored(members.where("not first").select("row"), "copies")
    return numbered.join(gone, "row", "left_anti").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("benchmark", benchmark_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Scores of a trained model, components and token ids are beyond SQL: the tests hold each stage against brute force.
ORACLE_SQL = None
