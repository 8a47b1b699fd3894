"""Logs: records folded from lines, searched and shown."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running_sums


def folded(lines: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Lines that start with a tab belong to the record before: (keys, ``record``, ``text``)."""
    starts = (~F.col(text).startswith("\t")).cast("long")
    numbered = running_sums(lines, keys, order, {"record": starts})
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "\n")
    return numbered.groupBy(*keys, "record").agg(joined.alias("text"))


def search(records: DataFrame, text: str, wanted: str) -> DataFrame:
    """Records with the search text where no lower-case letter or digit stands before it."""
    return records.where(F.col(text).rlike(f"(?<![0-9a-z]){wanted}"))


def shown(text: Column) -> Column:
    """Long base64 runs are masked."""
    return F.regexp_replace(text, "[A-Za-z0-9+/=]{32,}", "...")
