"""Costs of a clustering: against the clusters' own means, and against given centers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles, squared_distance

Centers = Sequence[Sequence[float]]


def cluster_means(df: DataFrame, dimensions: int) -> DataFrame:
    """``prediction, mean``: one row per cluster."""
    return df.groupBy("prediction").agg(F.array(*[F.avg(F.col("features")[i]) for i in range(dimensions)]).alias("mean"))


def cost_per_cluster(df: DataFrame, dimensions: int) -> DataFrame:
    """``prediction, n, cost`` around each cluster's own mean."""
    joined = df.join(F.broadcast(cluster_means(df, dimensions)), "prediction")  # one row per leaf label
    return joined.groupBy("prediction").agg(F.count("*").alias("n"), F.sum(squared_distance(F.col("features"), F.col("mean"))).alias("cost"))


def score(df: DataFrame, dimensions: int) -> DataFrame:
    return cost_per_cluster(df, dimensions).agg(F.sum("cost").alias("score"))


def surrogate_score(df: DataFrame, centers: Centers) -> DataFrame:
    """Cost around the given center of the label each row has."""
    own = F.element_at(F.array(*[doubles(c) for c in centers]), F.col("prediction") + 1)
    return df.agg(F.sum(squared_distance(F.col("features"), own)).alias("score"))


def _exploded(points: DataFrame, centers: DataFrame, column: str) -> DataFrame:
    long = points.select("prediction", F.posexplode("features").alias("pos", "x"))
    own = centers.select("prediction", F.posexplode(column).alias("pos", "c"))
    return long.join(F.broadcast(own), ["prediction", "pos"]).groupBy("prediction").agg(F.sum((F.col("x") - F.col("c")) * (F.col("x") - F.col("c"))).alias("cost")).agg(F.sum("cost").alias("score"))


def score_sql(df: DataFrame, dimensions: int) -> DataFrame:
    """``score`` as a join of unpivoted rows and means on cluster and position."""
    return _exploded(df, cluster_means(df, dimensions), "mean")


def surrogate_score_sql(df: DataFrame, centers: Centers) -> DataFrame:
    table = df.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centers)], "prediction int, center array<double>")
    return _exploded(df, table, "center")
