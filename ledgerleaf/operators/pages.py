"""Labelled items: schema inference, unions of differing schemas, counts, row access and block-wise reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_pairs(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """(``row``, ``field``, ``value`` as string) for every present value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.col(row).alias("row"), F.inline(pairs)).where("value is not null")


def inferred(pairs: DataFrame) -> DataFrame:
    """A field is numeric if every present value is a number, else a string."""
    numeric = F.bool_and(F.col("value").try_cast("double").isNotNull())
    return pairs.groupBy("field").agg(F.when(numeric, "double").otherwise("string").alias("kind"), F.count("*").alias("present"))


def page(pairs: DataFrame, schema: DataFrame) -> DataFrame:
    """Items as maps of numbers and of strings by the inferred kinds."""
    typed = pairs.join(schema.select("field", "kind"), "field")

    def of_kind(kind: str, value: Column) -> Column:
        return F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("field", value.alias("value"))))))

    return typed.groupBy("row").agg(of_kind("double", F.col("value").try_cast("double")).alias("num"), of_kind("string", F.col("value")).alias("str"))


def union(*pages: DataFrame) -> DataFrame:
    """All rows under the merged schema: a missing number is NaN, a missing string null; a column that is a number here
    and a string there is an error."""
    kinds: dict[str, T.DataType] = {}
    for p in pages:
        for f in p.schema.fields:
            kind = T.DoubleType() if isinstance(f.dataType, T.NumericType) else T.StringType()
            if kinds.setdefault(f.name, kind) != kind:
                raise ValueError(f"incompatible schema: {f.name}")
    filled = []
    for p in pages:
        columns = []
        for name, kind in sorted(kinds.items()):
            is_number = isinstance(kind, T.DoubleType)
            own = F.col(name).cast(kind) if name in p.columns else F.lit(None).cast(kind)
            columns.append((F.coalesce(own, F.lit(float("nan"))) if is_number else own).alias(name))
        filled.append(p.select(*columns))
    out = filled[0]
    for p in filled[1:]:
        out = out.union(p)
    return out


def label_counts(items: DataFrame, label: str = "label") -> DataFrame:
    return items.groupBy(label).agg(F.count("*").alias("n"))


def rows_at(items: DataFrame, rows: DataFrame, row: str) -> DataFrame:
    """The sub-page of the given row numbers, each once."""
    return items.join(rows.select(row).distinct(), row, "left_semi")


def next_block(items: DataFrame, order: str, cursor: int | None, n: int) -> DataFrame:
    """The ``n`` rows behind the cursor: reading goes on from the last key, so that no row is skipped or seen twice."""
    rest = items if cursor is None else items.where(F.col(order) > cursor)
    return rest.orderBy(order).limit(n)
