"""Feature values and center values as bin numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import find_bin_of

Splits = Sequence[Sequence[float]]


def bins_of(features: Column, splits: Splits) -> Column:
    """Bin of each feature."""
    return F.array(*[find_bin_of(features[f], ts) for f, ts in enumerate(splits)])


def bin_instances(df: DataFrame, splits: Splits) -> DataFrame:
    """Adds ``bins``, at node 0 and valid."""
    return df.withColumns({"bins": bins_of(F.col("features"), splits), "node_id": F.lit(0).cast("long"), "is_valid": F.lit(True)})


def center_bins(centers: Sequence[Sequence[float]], splits: Splits) -> list[list[int]]:
    """The same rule for the k centers, on the driver."""
    return [[sum(t < v for t in ts) for v, ts in zip(c, splits)] for c in centers]


def bin_centers(spark: SparkSession, centers: Sequence[Sequence[float]], splits: Splits) -> DataFrame:
    """``cluster_id, feature, center_bin``; k rows for each feature."""
    rows = [(i, f, b) for i, bins in enumerate(center_bins(centers, splits)) for f, b in enumerate(bins)]
    return spark.createDataFrame(rows, "cluster_id int, feature int, center_bin int")
