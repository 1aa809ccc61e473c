"""What a level of the tree is decided from: weights by node, feature, cluster and bin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bin_histogram(binned: DataFrame) -> DataFrame:
    """``node_id, feature, cluster_id, bin, w, n`` over valid rows, by partial and final hash aggregation."""
    long = binned.where("is_valid").select("node_id", "cluster_id", "weight", F.posexplode("bins").alias("feature", "bin"))
    return long.groupBy("node_id", "feature", "cluster_id", "bin").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))


def center_bin_ranges(histogram: DataFrame, centers: DataFrame) -> DataFrame:
    """Least and greatest true center bin of the clusters that have valid rows at a node; 0 where none is known."""
    present = histogram.select("node_id", "feature", "cluster_id").distinct()
    joined = present.join(F.broadcast(centers), ["cluster_id", "feature"], "left")  # k rows a feature
    return joined.groupBy("node_id", "feature").agg(F.coalesce(F.min("center_bin"), F.lit(0)).alias("min_bin"), F.coalesce(F.max("center_bin"), F.lit(0)).alias("max_bin"))


def estimated_center_bins(histogram: DataFrame) -> DataFrame:
    """Rounded weighted mean bin of each cluster's valid rows, half up."""
    return histogram.groupBy("node_id", "feature", "cluster_id").agg(F.floor(F.sum(F.col("bin") * F.col("w")) / F.sum("w") + 0.5).cast("int").alias("center_bin"))


def node_stats(binned: DataFrame) -> DataFrame:
    """Rows and mistakes that stand at each node."""
    return binned.groupBy("node_id").agg(F.count("*").alias("samples"), F.count_if(~F.col("is_valid")).alias("mistakes"))


def node_clusters(binned: DataFrame) -> DataFrame:
    """The clusters with valid rows at each node, sorted."""
    return binned.where("is_valid").groupBy("node_id").agg(F.array_sort(F.collect_set("cluster_id")).alias("cluster_ids"))
