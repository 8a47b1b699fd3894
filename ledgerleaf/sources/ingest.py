"""Items from JSON documents, delimited files, query strings and configuration files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import attribute_value


#: Settings are read by the driver: more of them are an error.
MOST_SETTINGS = 10_000


def json_items(spark: SparkSession, path: str, schema: T.StructType | str, label: str) -> DataFrame:
    """JSON lines under one label."""
    return spark.read.schema(schema).json(path).withColumn("label", F.lit(label))


def json_documents(texts: DataFrame, column: str, schema: str) -> DataFrame:
    """Columns of the JSON documents, one on each line, in a text column; text that doesn't parse gives nulls."""
    lines = texts.withColumn("_line", F.explode(F.split(column, r"\s*\n\s*"))).where("_line <> ''")
    return lines.withColumn("_doc", F.from_json("_line", schema)).drop("_line").select("*", "_doc.*").drop("_doc")


def as_json(df: DataFrame, pretty: bool = False) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"pretty": str(pretty).lower()}).alias("json"))


def delimited_items(spark: SparkSession, path: str, features: list[str], most: int | None = None, seed: int = 42) -> DataFrame:
    """A (compressed) file of numbers whose last column is the label; rows in an order fixed by the seed."""
    schema = T.StructType([T.StructField(f, T.DoubleType()) for f in features] + [T.StructField("label", T.StringType())])
    rows = spark.read.schema(schema).csv(path)
    return rows if most is None else rows.orderBy(F.xxhash64(F.lit(seed), *features, "label")).limit(most)


def training_set(items: DataFrame, attribute: str) -> DataFrame:
    """The attribute becomes the label and leaves the features."""
    return items.withColumn("label", F.col(attribute).cast("string")).drop(attribute)


def attributes(query: DataFrame, column: str) -> DataFrame:
    """(``name``, ``number``, ``string``) of ``name=value&...`` in a text column."""
    pairs = query.withColumn("_pair", F.explode(F.split(column, "&"))).withColumn("_cut", F.split("_pair", "=", 2))
    number, string = attribute_value(F.col("_cut")[1])
    return pairs.select(*query.columns, F.col("_cut")[0].alias("name"), number.alias("number"), string.alias("string"))


def settings(spark: SparkSession, path: str, defaults: dict[str, str] | None = None) -> dict[str, str]:
    """``key=value`` lines with ``//`` comments; the file wins over the defaults, a line without exactly one ``=`` is an
    error."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "//.*$", "")).alias("line")).where("line <> ''")
    out = dict(defaults or {})
    found = lines.limit(MOST_SETTINGS + 1).collect()
    if len(found) > MOST_SETTINGS:
        raise ValueError(f"more than {MOST_SETTINGS} settings")
    for r in found:
        parts = r.line.split("=")
        if len(parts) != 2:
            raise ValueError(f"not one key and one value: {r.line}")
        out[parts[0].strip()] = parts[1].strip()
    return out
