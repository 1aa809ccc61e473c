"""Explaining rows as they arrive: prediction is a stateless projection, counts are a windowed aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tree import Tree


def predict_stream(stream: DataFrame, tree: Tree) -> DataFrame:
    """Adds ``prediction`` and ``leaf_id`` to a streaming (or any) frame with ``features``."""
    return stream.withColumns({"prediction": tree.label(), "leaf_id": tree.leaf()})


def leaf_counts(stream: DataFrame, tree: Tree, time: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows per leaf and time window; rows later than ``late`` are left out, so state stays bounded."""
    placed = predict_stream(stream, tree).withWatermark(time, late)
    return placed.groupBy(F.window(time, window), "leaf_id").agg(F.count("*").alias("n")).select("window.start", "window.end", "leaf_id", "n")
