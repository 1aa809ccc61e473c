"""Cluster labels and centers: fitted, supplied, or by nearest center."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import argmin, as_array, squared_distance_to

Centers = Sequence[Sequence[float]]


def fit_kmeans(df: DataFrame, k: int, seed: int = 42, max_iter: int = 20, weight: str | None = None) -> KMeansModel:
    vectors = df.withColumn("features", array_to_vector("features")) if df.schema["features"].dataType.typeName() == "array" else df
    means = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="prediction")
    return (means.setWeightCol(weight) if weight else means).fit(vectors)


def assign(df: DataFrame, model: KMeansModel) -> tuple[DataFrame, list[list[float]]]:
    """Rows with ``prediction`` and features as arrays, and the model's centers."""
    vectors = df.withColumn("features", array_to_vector("features")) if df.schema["features"].dataType.typeName() == "array" else df
    return as_array(model.transform(vectors)), [list(map(float, c)) for c in model.clusterCenters()]


def nearest_center(features: Column, centers: Centers) -> Column:
    """Number of the nearest center by squared distance, the lowest on ties."""
    return argmin([squared_distance_to(features, c) for c in centers])


def assign_nearest(df: DataFrame, centers: Centers) -> DataFrame:
    return df.withColumn("prediction", nearest_center(F.col("features"), centers))


def lloyd_step(df: DataFrame, centers: Centers) -> DataFrame:
    """New means of the rows nearest each center: ``prediction, n, center``."""
    d = len(centers[0])
    return assign_nearest(df, centers).groupBy("prediction").agg(F.count("*").alias("n"), F.array(*[F.avg(F.col("features")[i]) for i in range(d)]).alias("center"))


def center_table(spark: SparkSession, centers: Centers) -> DataFrame:
    """``cluster_id, center``; k rows."""
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centers)], "cluster_id int, center array<double>")


def labelled(df: DataFrame, labels: str, centers: Centers) -> tuple[DataFrame, list[list[float]]]:
    """A clustering made elsewhere: labels in a column, centers given."""
    return as_array(df).withColumn("prediction", F.col(labels).cast("int")), [list(map(float, c)) for c in centers]
