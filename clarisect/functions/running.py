"""Running sums over sorted values that no single task has to make alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stretches into which a key's range of values is cut.
STRETCHES = 256


def running_sums(df: DataFrame, keys: Sequence[str], position: str, columns: Sequence[str], stretches: int = STRETCHES) -> DataFrame:
    """Replaces each column by its sum over the key's rows up to and at the position (one row for each position).

    The range of a key is cut in stretches; their totals give every stretch its start, so the windows that
    sort rows hold one stretch of one key.
    """
    keys = list(keys)
    ends = df.groupBy(*keys).agg(F.min(position).alias("__lo"), F.max(position).alias("__hi"))
    width = F.col("__hi") - F.col("__lo")
    cut = df.join(ends, keys).withColumn("__s", F.when(width > 0, F.least(F.lit(stretches - 1), F.floor((F.col(position) - F.col("__lo")) / width * stretches))).otherwise(0).cast("int")).drop("__lo", "__hi")
    before = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "__s").agg(*[F.sum(c).alias(f"__t_{c}") for c in columns])
    starts = totals.select(*keys, "__s", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in columns])
    inner = Window.partitionBy(*keys, "__s").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.select(*[c for c in cut.columns if c not in columns], *[F.sum(c).over(inner).alias(c) for c in columns])
    return summed.join(starts, [*keys, "__s"]).select(*[c for c in df.columns if c not in columns], *[(F.col(c) + F.col(f"__b_{c}")).alias(c) for c in columns])
