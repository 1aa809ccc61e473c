"""Column expressions over feature arrays; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Thresholds up to which a search is written out.
SEARCHED = 256


def doubles(values: Sequence[float]) -> Column:
    """A literal array of doubles."""
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def squared_distance_to(a: Column, values: Sequence[float]) -> Column:
    """Squared distance of an array to fixed values, written out so that it stays inside generated code."""
    out = F.lit(0.0)
    for i, v in enumerate(values):
        d = F.get(a, F.lit(i)) - F.lit(float(v))
        out = out + d * d
    return out


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_norm(a: Column) -> Column:
    return total(F.transform(a, lambda x: x * x))


def find_bin(value: Column, thresholds: Column) -> Column:
    """How many thresholds lie strictly below the value: bins are (t[i-1], t[i]], the last one is open above."""
    return F.size(F.filter(thresholds, lambda t: t < value))


def find_bin_of(value: Column, thresholds: Sequence[float]) -> Column:
    """The same for fixed thresholds, as a binary search of nested comparisons inside generated code."""
    ts = sorted(float(t) for t in thresholds)

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(value > F.lit(ts[middle]), between(middle + 1, hi)).otherwise(between(lo, middle))

    return between(0, len(ts)) if len(ts) <= SEARCHED else find_bin(value, doubles(ts))


def as_array(df: DataFrame, column: str = "features") -> DataFrame:
    """Turns a vector column into an array of doubles; an array stays as it is."""
    if df.schema[column].dataType.typeName() == "array":
        return df
    return df.withColumn(column, vector_to_array(column))


def argmin(costs: Sequence[Column]) -> Column:
    """Position of the least of several columns, the first one on ties."""
    return F.array_min(F.array(*[F.struct(c.alias("cost"), F.lit(i).alias("at")) for i, c in enumerate(costs)]))["at"]
