"""Vector arithmetic on array columns, evaluated on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def width(vector: Column) -> Column:
    return F.size(vector)


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(vector: Column) -> Column:
    """Vector of length one; a zero vector stays zero, so its cosine is 0.

    The length is bound once, as the element of a one-entry array: inside the
    inner lambda it would be computed again for every entry.
    """
    scaled = F.transform(
        F.array(norm(vector)),
        lambda length: F.transform(vector, lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0))))
    return F.get(scaled, F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def mean(vector: Column) -> Column:
    return F.try_divide(total(vector), F.size(vector).cast("double"))


def first_half_mean(vector: Column) -> Column:
    return mean(F.slice(vector, F.lit(1), F.floor(F.size(vector) / 2).cast("int")))


def second_half_mean(vector: Column) -> Column:
    """Mean of the rest; for odd widths the middle entry belongs here."""
    start = F.floor(F.size(vector) / 2).cast("int") + 1
    return mean(F.slice(vector, start, F.size(vector)))


def rounded(value: Column, decimals: int = 6) -> Column:
    """Rounded for output, halves away from zero, without negative zero.

    Plain arithmetic on the scaled value, as most SQL engines round doubles;
    Spark's own `round` goes through a decimal number for each value.
    """
    scale = float(10**decimals)
    away = F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale
    return F.when(F.isnan(value), value).otherwise(away) + F.lit(0.0)
