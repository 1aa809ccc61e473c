"""From raw tables to weighted feature arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_array


def cast_doubles(df: DataFrame, strict: bool = True) -> DataFrame:
    """Every column as double in one projection; unless ``strict``, what is no number becomes null."""
    return df.select(*[(F.col(c).cast("double") if strict else F.col(c).try_cast("double")).alias(c) for c in df.columns])


def assemble(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "features") -> DataFrame:
    """Columns to one array of doubles. A null raises where it is read, as the vector assembler does."""
    parts = [F.coalesce(F.col(c).cast("double"), F.raise_error(F.lit(f"null in feature {c}")).cast("double")) for c in columns]
    return df.select(*keep, F.array(*parts).alias(name))


def with_weight(df: DataFrame, weight: Column | float = 1.0) -> DataFrame:
    return df.withColumn("weight", weight.cast("double") if isinstance(weight, Column) else F.lit(float(weight)))


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers where they can be read, the column's mean elsewhere."""
    read = df.select(*[c for c in df.columns if c not in columns], *[F.col(c).cast("string").try_cast("double").alias(c) for c in columns])
    return Imputer(strategy="mean", inputCols=list(columns), outputCols=list(columns)).fit(read).transform(read).select(*df.columns)


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0. One aggregation gives all moments."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    scaled = {c: (F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"] or 1.0) for c in columns}
    return df.withColumns(scaled)


def one_hot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A column ``<name>_<i>`` for each category, most frequent first; null and unseen values have a category."""
    numbered = StringIndexer(inputCols=list(columns), outputCols=[f"{c}__i" for c in columns], handleInvalid="keep").fit(df).transform(df)
    model = OneHotEncoder(inputCols=[f"{c}__i" for c in columns], outputCols=[f"{c}__v" for c in columns], dropLast=False).fit(numbered)
    wide = model.transform(numbered)
    for c, size in zip(columns, model.categorySizes):
        wide = as_array(wide, f"{c}__v").select("*", *[F.col(f"{c}__v")[i].alias(f"{c}_{i}") for i in range(size)])
    return wide.drop(*columns, *[f"{c}__i" for c in columns], *[f"{c}__v" for c in columns])


def take(df: DataFrame, order: Sequence[str], rows: int, columns: Sequence[str]) -> DataFrame:
    """The first rows in a stated order and some of the columns."""
    return df.orderBy(*order).limit(rows).select(*columns)


def inflate(df: DataFrame, times: int) -> DataFrame:
    """The table once and ``times`` more, without reading it again."""
    return df.withColumn("__n", F.explode(F.sequence(F.lit(0), F.lit(times)))).drop("__n")


def instances(df: DataFrame, label: str = "prediction", weight: str | None = None) -> DataFrame:
    """The shape that all tree operators take: ``features, cluster_id, weight``, with further columns kept."""
    out = as_array(df).withColumn("cluster_id", F.col(label).cast("int"))
    return out.withColumn("weight", F.col(weight).cast("double") if weight else F.lit(1.0))
