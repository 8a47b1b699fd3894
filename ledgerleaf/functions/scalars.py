"""Scalar functions as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def mod(a: Column, b: Column | int) -> Column:
    """Modulus that is never negative."""
    return F.pmod(a, b if isinstance(b, Column) else F.lit(b))


def to_digits(n: Column, radix: int) -> Column:
    """Digits of a whole number, most significant first; none for 0."""
    digits = F.split(F.conv(n.cast("string"), 10, radix), "")
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.filter(digits, lambda d: d != ""), lambda d: F.conv(d, radix, 10).cast("int"))
    )


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Levenshtein distance; -1 beyond ``most``; null if either is null."""
    return F.levenshtein(a, b) if most is None else F.levenshtein(a, b, most)


def attribute_value(text: Column) -> tuple[Column, Column]:
    """A query-string value as number and as string: numeric if it is made of digits, signs, dots and ``e`` and parses."""
    number = F.when(text.rlike("^[0-9.e+-]*$"), text.try_cast("double"))
    return number, F.when(number.isNull(), text)


def widened(c: Column) -> Column:
    """Any number as double; null where there is none, which is the exception branch of a rule."""
    return c.try_cast("double")
