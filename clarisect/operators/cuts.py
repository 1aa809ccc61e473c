"""Mistakes of every candidate cut, and the best ones.

A cut at t parts x from its center c exactly when min(x, c) <= t < max(x, c). So mistakes are a count of
intervals over a point: +w at the lower end, -w at the upper one, and a running sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.running import running_sums
from .stats import center_bin_ranges, estimated_center_bins

ROUND = 1e-9


def mistakes_binned(histogram: DataFrame, centers: DataFrame, cut_range: str = "full", center_bins: str = "true") -> DataFrame:
    """``node_id, feature, bin, mistakes`` for each candidate bin.

    ``cut_range`` "full" tries min_bin..max_bin-1, "reference" leaves out min_bin; ``center_bins`` "true" scores
    with the centers' own bins, "estimated" with the rounded mean bin of their rows.
    """
    ranges = center_bin_ranges(histogram, centers)
    low = F.col("min_bin") + (1 if cut_range == "reference" else 0)
    tried = ranges.where(low < F.col("max_bin")).select("node_id", "feature", F.explode(F.sequence(low, F.col("max_bin") - 1)).alias("bin"))
    own = histogram.join(estimated_center_bins(histogram), ["node_id", "feature", "cluster_id"]) if center_bins == "estimated" else histogram.join(F.broadcast(centers), ["cluster_id", "feature"])
    apart = own.where("bin <> center_bin")
    ends = apart.select("node_id", "feature", F.least("bin", "center_bin").alias("bin"), F.col("w").alias("d"), F.lit(False).alias("tried")).unionByName(
        apart.select("node_id", "feature", F.greatest("bin", "center_bin").alias("bin"), (-F.col("w")).alias("d"), F.lit(False).alias("tried"))
    ).unionByName(tried.select("node_id", "feature", "bin", F.lit(0.0).alias("d"), F.lit(True).alias("tried")))
    summed = ends.groupBy("node_id", "feature", "bin").agg(F.sum("d").alias("d"), F.max("tried").alias("tried"))
    # a node and feature have one row for each bin, a few dozen
    order = Window.partitionBy("node_id", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return summed.withColumn("m", F.sum("d").over(order)).where("tried").select("node_id", "feature", "bin", F.floor(F.col("m") + ROUND).alias("mistakes"))


def best_cut_per_feature(mistakes: DataFrame, at: str = "bin") -> DataFrame:
    best = F.min(F.struct("mistakes", at))
    return mistakes.groupBy("node_id", "feature").agg(best.alias("b")).select("node_id", "feature", F.col(f"b.{at}"), F.col("b.mistakes"))


def best_cut_per_node(mistakes: DataFrame, at: str = "bin") -> DataFrame:
    """The fewest mistakes; ties go to the lower feature, then the lower cut."""
    best = F.min(F.struct("mistakes", "feature", at))
    return mistakes.groupBy("node_id").agg(best.alias("b")).select("node_id", F.col("b.feature"), F.col(f"b.{at}"), F.col("b.mistakes"))


def center_ranges(spark: SparkSession, centers: Sequence[Sequence[float]], valid: dict[int, Sequence[int]], features: Sequence[int] | None = None) -> DataFrame:
    """``node_id, feature, lo, hi`` over each node's valid centers, where they differ; a row per open node and feature."""
    rows = []
    for node, ids in valid.items():
        for f in features if features is not None else range(len(centers[0])):
            values = [float(centers[i][f]) for i in ids]
            if min(values) < max(values):
                rows.append((node, f, min(values), max(values)))
    return spark.createDataFrame(rows, "node_id long, feature int, lo double, hi double")


def valid_center_values(spark: SparkSession, centers: Sequence[Sequence[float]], valid: dict[int, Sequence[int]]) -> DataFrame:
    rows = sorted({(n, f, float(centers[i][f])) for n, ids in valid.items() for i in ids for f in range(len(centers[0]))})
    return spark.createDataFrame(rows, "node_id long, feature int, threshold double")


def mistakes_exact(rows: DataFrame, centers: Sequence[Sequence[float]], valid: dict[int, Sequence[int]], thresholds: DataFrame | None = None, features: Sequence[int] | None = None, right_side: bool = True, held: list[DataFrame] | None = None) -> DataFrame:
    """``node_id, feature, threshold, mistakes`` for every candidate from the least valid center up to the greatest.

    ``rows`` have ``node_id, features, cluster_id, weight``. Candidates are all data values and valid center
    values, or with ``thresholds`` (``feature, threshold``) these and the center values. With ``right_side`` a
    data candidate needs a row above it. Rows count against their own center even if it is not valid here.
    The rows are read once: what is left of them, a row for each distinct value, is cached, and with ``held`` added
    to that list for the caller to unpersist.
    """
    spark = rows.sparkSession
    ranges = F.broadcast(center_ranges(spark, centers, valid, features))  # open nodes times features
    own = spark.createDataFrame([(i, f, float(v)) for i, c in enumerate(centers) for f, v in enumerate(c)], "cluster_id int, feature int, center double")
    long = rows.select("node_id", "cluster_id", "weight", F.posexplode("features").alias("feature", "value"))
    # equal values of a cluster are one row from here on
    grouped = long.join(ranges, ["node_id", "feature"]).groupBy("node_id", "feature", "cluster_id", "value", "lo", "hi").agg(F.sum("weight").alias("w")).join(F.broadcast(own), ["cluster_id", "feature"])
    lo, hi, value = F.col("lo"), F.col("hi"), F.col("value")
    a, b = F.greatest(F.least("value", "center"), lo), F.greatest("value", "center")
    apart = F.when((value != F.col("center")) & (b > lo), F.col("w")).otherwise(0.0)
    takes_data = thresholds is None

    def end(at, d, tried=F.lit(False), row=F.lit(False)):
        return F.struct(at.alias("threshold"), d.alias("d"), tried.alias("tried"), row.alias("row"))

    # both ends of the interval of mistakes, and the value itself: a candidate, and a row above lower candidates
    ends = grouped.select("node_id", "feature", "hi", F.explode(F.array(
        end(F.least(a, hi), apart), end(F.least(b, hi), -apart), end(F.greatest(F.least(value, hi), lo), F.lit(0.0), (value >= lo) & (value < hi) & F.lit(takes_data), value > lo))).alias("e")).select("node_id", "feature", "hi", "e.*")
    more = valid_center_values(spark, centers, valid).join(ranges, ["node_id", "feature"]).where("threshold >= lo and threshold < hi")
    if not takes_data:
        more = more.unionByName(thresholds.select("feature", "threshold").join(ranges, "feature").where("threshold >= lo and threshold < hi").select(more.columns))
    tried = more.select("node_id", "feature", "hi", "threshold", F.lit(0.0).alias("d"), F.lit(True).alias("tried"), F.lit(False).alias("row"))
    summed = ends.unionByName(tried).groupBy("node_id", "feature", "hi", "threshold").agg(F.sum("d").alias("m"), F.max("tried").alias("tried"), F.max("row").alias("row")).persist()
    if held is not None:
        held.append(summed)
    out = running_sums(summed.where("threshold < hi").select("node_id", "feature", "threshold", "tried", "m"), ["node_id", "feature"], "threshold", ["m"]).where("tried")
    if takes_data and right_side:
        top = summed.where("row").groupBy("node_id", "feature").agg(F.max("threshold").alias("top"))
        out = out.join(F.broadcast(top), ["node_id", "feature"]).where("threshold < top")  # open nodes times features
    return out.select("node_id", "feature", "threshold", F.floor(F.col("m") + ROUND).alias("mistakes"))


def count_mistakes(rows: DataFrame, centers: Sequence[Sequence[float]], feature: int, threshold: float) -> DataFrame:
    """Both sides of one cut: ``side, n, mistakes, centers``."""
    left = [i for i, c in enumerate(centers) if c[feature] <= threshold]
    right = [i for i in range(len(centers)) if i not in left]
    goes_left = F.col("features")[feature] <= F.lit(float(threshold))
    own_left = F.col("cluster_id").isin(left)
    sides = rows.select(F.when(goes_left, "left").otherwise("right").alias("side"), (goes_left != own_left).alias("wrong"))
    found = sides.groupBy("side").agg(F.count("*").alias("n"), F.count_if("wrong").alias("mistakes"))
    names = rows.sparkSession.createDataFrame([("left", left), ("right", right)], "side string, centers array<int>")
    return names.join(found, "side", "left").select("side", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mistakes", F.lit(0)).alias("mistakes"), "centers")


def two_class_mistakes(rows: DataFrame, feature: int, threshold: float) -> DataFrame:
    """Labels other than 0 on the left and other than 1 on the right."""
    left = F.col("features")[feature] <= F.lit(float(threshold))
    return rows.agg(F.count_if((left & (F.col("cluster_id") != 0)) | (~left & (F.col("cluster_id") != 1))).alias("mistakes"))


def majority_label(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The most frequent label, the lowest on ties."""
    counts = rows.groupBy(*keys, "cluster_id").agg(F.count("*").alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col("cluster_id")).alias("neg"))).alias("b")
    return counts.groupBy(*keys).agg(best).select(*keys, (-F.col("b.neg")).alias("label"), F.col("b.n").alias("n"))
