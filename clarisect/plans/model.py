"""The estimator: cluster, explain, predict, score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame

from ..functions.vectors import as_array
from ..operators import clustering, score
from ..operators.features import instances
from ..operators.splits import bernoulli_sample, find_splits, linspace_thresholds, value_weights
from .expand import expand
from .grow import grow_levelwise, grow_quartile, grow_recursive
from .tree import Node, Tree

STRATEGIES = ("levelwise", "recursive", "exact", "quartile")


class ExplainableKMeans:
    """A k-means clustering explained by a threshold tree.

    strategy: "levelwise" on binned features with mistakes frozen; "recursive" on histogram thresholds with all
    rows kept; "exact" on every value with mistakes taken out; "quartile" on quartiles of two clusters.
    max_leaves above k expands the tree by cost; base_tree "none" starts that from a single leaf.
    compat reproduces the published level-wise details: unscaled sample weights, no zero centers, candidate bins
    above the least center bin only, and estimated center bins for scoring.
    """

    def __init__(self, k: int, max_leaves: int | None = None, strategy: str = "levelwise", splits: int = 10, max_bins: int = 32, seed: int = 42, max_iter: int = 40, base_tree: str = "mistakes", compat: bool = False, sample: float | None = None):
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}")
        if max_leaves is not None and max_leaves < k:
            raise ValueError("max_leaves must be at least k")
        self.k, self.max_leaves, self.strategy, self.splits, self.max_bins = k, max_leaves or k, strategy, splits, max_bins
        self.seed, self.max_iter, self.base_tree, self.compat, self.sample = seed, max_iter, base_tree, compat, sample
        self.tree: Tree | None = None
        self.centers: list[list[float]] = []
        self.thresholds: list[list[float]] = []

    def fit(self, df: DataFrame, model: KMeansModel | None = None, labels: str | None = None, centers: Sequence[Sequence[float]] | None = None, weight: str | None = None) -> ExplainableKMeans:
        """Clusters ``features`` unless a model, or labels and centers, are given, and grows the tree."""
        df = as_array(df)
        if labels is not None:
            rows, self.centers = clustering.labelled(df, labels, centers)
        else:
            model = model or clustering.fit_kmeans(df, self.k, self.seed, self.max_iter, weight)
            rows, self.centers = clustering.assign(df.drop("prediction"), model)
        if len(self.centers) != self.k:
            raise ValueError(f"the clustering has {len(self.centers)} clusters, not {self.k}")
        data = instances(rows, weight=weight).select("features", "cluster_id", "weight").persist()
        if self.base_tree == "none":
            self.tree = Tree([Node(0, is_leaf=True, leaf_cluster=0, cluster_ids=list(range(self.k)))])
        elif self.strategy == "levelwise":
            self.thresholds = find_splits(data, self.centers, self.splits, self.max_bins, self.seed, compat=self.compat)
            self.tree = grow_levelwise(data, self.centers, self.thresholds, "reference" if self.compat else "full", "estimated" if self.compat else "true")
        elif self.strategy == "recursive":
            some = bernoulli_sample(data, self.sample or 0.1, self.seed)
            self.tree = grow_recursive(data, self.centers, linspace_thresholds(value_weights(some, drop_zero=False), self.splits))
        elif self.strategy == "exact":
            self.tree = grow_recursive(data, self.centers, drop_mistakes=True)
        else:
            self.tree = grow_quartile(data)
        if self.max_leaves > len(self.tree.leaves()) and (self.max_leaves > self.k or self.base_tree == "none"):
            expand(self.tree, data, self.centers, self.max_leaves)
        data.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``; a plain projection, so it serves a streaming frame too."""
        return as_array(df).withColumn("prediction", self.tree.label())

    def fit_predict(self, df: DataFrame, **options) -> DataFrame:
        return self.fit(df, **options).predict(df)

    def score(self, df: DataFrame) -> float:
        return score.score(self.predict(df), len(self.centers[0])).first()[0]

    def surrogate_score(self, df: DataFrame) -> float:
        return score.surrogate_score(self.predict(df), self.centers).first()[0]

    def score_sql(self, df: DataFrame) -> float:
        return score.score_sql(self.predict(df), len(self.centers[0])).first()[0]

    def surrogate_score_sql(self, df: DataFrame) -> float:
        return score.surrogate_score_sql(self.predict(df), self.centers).first()[0]

    def fill_stats(self, df: DataFrame, label: str = "prediction") -> Tree:
        return self.tree.fill_stats(as_array(df), label)

    def feature_importance(self) -> list[int]:
        return self.tree.feature_importance(len(self.centers[0]))

    def register(self, name: str = "explain_cluster", spark=None) -> str:
        """The prediction as SQL text over a column ``features``, for use inside queries."""
        def at(i: int) -> str:
            node = self.tree.nodes[i]
            if node.feature is None:
                return str(node.leaf_cluster)
            return f"CASE WHEN features[{node.feature}] <= {node.threshold!r}D THEN {at(2 * i + 1)} ELSE {at(2 * i + 2)} END"

        text = at(0)
        if spark is not None:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(features ARRAY<DOUBLE>) RETURNS INT RETURN {text}")
        return text
