"""Growing the tree level by level: one aggregation over the rows for each level, whatever the number of nodes.

Where a row stands is a function of its features and the tree so far, so it is compiled into one expression
over the cached rows; no chain of updates, and a lost executor only costs recomputing its part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.binning import bin_centers, bin_instances, center_bins
from ..operators.cuts import best_cut_per_node, mistakes_binned, mistakes_exact
from ..operators.stats import bin_histogram
from .tree import Node, Tree

Centers = Sequence[Sequence[float]]


def grow_levelwise(rows: DataFrame, centers: Centers, splits: Sequence[Sequence[float]], cut_range: str = "full", scoring: str = "true") -> Tree:
    """Binned growth in which a row that parts from its center stays where it did, as a mistake, for good.

    ``rows`` have ``features, cluster_id, weight``. A node is split by the bin with the fewest mistakes until no
    two center bins of its clusters leave a candidate. ``samples`` are arrivals, ``residual_samples`` the rows
    that stand at a node in the end.
    """
    spark = rows.sparkSession
    own = center_bins(centers, splits)
    own_table = bin_centers(spark, centers, splits).persist()
    binned = bin_instances(rows, splits).select("bins", "cluster_id", "weight").persist()
    tree = Tree([Node(0)])
    seen = {r["cluster_id"]: r["n"] for r in binned.groupBy("cluster_id").agg(F.count("*").alias("n")).collect()}
    tree.nodes[0].cluster_ids, tree.nodes[0].samples, tree.nodes[0].mistakes = sorted(seen), sum(seen.values()), 0
    open_nodes = [0] if len(seen) > 1 else []

    def left(node: Node):
        return F.col("bins")[node.feature] <= node.bin

    def own_left(node: Node) -> list[int]:
        return [i for i, b in enumerate(own) if b[node.feature] <= node.bin]

    while open_nodes:
        placed = binned.withColumn("at", tree.route_strict(left, own_left)).select("bins", "cluster_id", "weight", "at.*").where(F.col("node_id").isin(open_nodes))
        histogram = bin_histogram(placed).persist()  # nodes x features x clusters x bins
        cuts = best_cut_per_node(mistakes_binned(histogram, own_table, cut_range, scoring))
        found = {r["node_id"]: r for r in cuts.collect()}
        for i, r in found.items():
            f, b = r["feature"], r["bin"]
            tree.split(i, f, float(splits[f][b]) if b < len(splits[f]) else None, b, r["mistakes"])
        if found:
            sides = spark.createDataFrame([(i, r["feature"], r["bin"]) for i, r in found.items()], "node_id long, feature int, cut int")
            counts = histogram.join(F.broadcast(sides), ["node_id", "feature"]).groupBy("node_id", "cluster_id", (F.col("bin") <= F.col("cut")).alias("left")).agg(F.sum("n").alias("n")).collect()
            for i in found:
                for k in (1, 2):
                    child = tree.nodes[2 * i + k]
                    stays = set(own_left(tree.nodes[i])) if k == 1 else set(range(len(own))) - set(own_left(tree.nodes[i]))
                    mine = [r for r in counts if r["node_id"] == i and r["left"] == (k == 1)]
                    child.samples = sum(r["n"] for r in mine)
                    child.mistakes = sum(r["n"] for r in mine if r["cluster_id"] not in stays)
                    child.cluster_ids = sorted(r["cluster_id"] for r in mine if r["cluster_id"] in stays)
                    child.is_leaf = len(child.cluster_ids) <= 1
        histogram.unpersist()
        open_nodes = [2 * i + k for i in found for k in (1, 2) if not tree.nodes[2 * i + k].is_leaf]
    binned.unpersist()
    own_table.unpersist()
    for n in tree.ordered():
        reach = _reaching(tree, n, own)
        n.is_terminal = n.feature is None
        n.is_leaf = n.is_terminal and len(n.cluster_ids) <= 1
        n.residual_samples = n.samples if n.is_terminal else n.mistakes
        if n.is_terminal:
            n.leaf_cluster = (n.cluster_ids or reach or [0])[0]
    return tree


def _reaching(tree: Tree, node: Node, own: list[list[int]]) -> list[int]:
    """Centers whose own bins lead to a node."""
    path, i = [], node.node_id
    while i:
        up = (i - 1) // 2
        path.append((tree.nodes[up], i == 2 * up + 1))
        i = up
    return [c for c, b in enumerate(own) if all((b[n.feature] <= n.bin) == left for n, left in path)]


def grow_recursive(rows: DataFrame, centers: Centers, thresholds: DataFrame | None = None, drop_mistakes: bool = False, features: Sequence[int] | None = None) -> Tree:
    """Growth on raw thresholds with true centers.

    With ``thresholds`` (``feature, threshold``) candidates are these and the valid centers; without, every
    value. ``drop_mistakes`` takes rows that part from their center out of the growth; counts at the leaves are
    of all routed rows either way. A node without rows names cluster 0; with one valid center that one; with
    one label that one; without a cut its first valid center.
    """
    spark = rows.sparkSession
    base = rows.select("features", "cluster_id", "weight").persist()
    tree, valid = Tree([Node(0)]), {0: list(range(len(centers)))}
    open_nodes = [0]

    def own_left(node: Node) -> list[int]:
        return [i for i, c in enumerate(centers) if c[node.feature] <= node.threshold]

    def leaf(i: int, cluster: int) -> None:
        tree.nodes[i].is_leaf, tree.nodes[i].leaf_cluster = True, cluster

    fixed = thresholds.persist() if thresholds is not None else None
    while open_nodes:
        test = Tree.by_threshold()
        if drop_mistakes:
            placed = base.withColumn("at", tree.route_strict(test, own_left)).select("features", "cluster_id", "weight", "at.*").where("is_valid")
        else:
            placed = base.withColumn("node_id", tree.route(test))
        placed = placed.where(F.col("node_id").isin(open_nodes))
        facts = {r["node_id"]: r for r in placed.groupBy("node_id").agg(F.count("*").alias("n"), F.min("cluster_id").alias("a"), F.max("cluster_id").alias("b")).collect()}
        rest = []
        for i in open_nodes:
            tree.nodes[i].cluster_ids = valid[i]
            if i not in facts:
                leaf(i, 0)
            elif len(valid[i]) == 1:
                leaf(i, valid[i][0])
            elif facts[i]["a"] == facts[i]["b"]:
                leaf(i, facts[i]["a"])
            else:
                rest.append(i)
        if not rest:
            break
        held: list[DataFrame] = []
        cuts = best_cut_per_node(mistakes_exact(placed.where(F.col("node_id").isin(rest)), centers, {i: valid[i] for i in rest}, fixed, features, held=held), "threshold")
        found = {r["node_id"]: r for r in cuts.collect()}
        for frame in held:
            frame.unpersist()
        open_nodes = []
        for i in rest:
            if i not in found:
                leaf(i, valid[i][0])
                continue
            f, t = found[i]["feature"], found[i]["threshold"]
            for k, child in enumerate(tree.split(i, f, t, None, found[i]["mistakes"])):
                valid[child.node_id] = [c for c in valid[i] if (centers[c][f] <= t) == (k == 0)]
                open_nodes.append(child.node_id)
    tree.fill_stats(base, "cluster_id")
    base.unpersist()
    if fixed is not None:
        fixed.unpersist()
    return tree


def grow_quartile(rows: DataFrame, max_depth: int = 10, accuracy: int = 10_000) -> Tree:
    """Growth on the quartiles of each feature at each node, judged as if cluster 0 were left and 1 right.

    A pure node, or one at ``max_depth``, names its majority label.
    """
    base = rows.select("features", "cluster_id", "weight").persist()
    tree, open_nodes = Tree([Node(0)]), [0]
    while open_nodes:
        placed = base.withColumn("node_id", tree.route(Tree.by_threshold())).where(F.col("node_id").isin(open_nodes))
        labels: dict[int, list[tuple[int, int]]] = {}
        for r in placed.groupBy("node_id", "cluster_id").agg(F.count("*").alias("n")).collect():
            labels.setdefault(r["node_id"], []).append((-r["n"], r["cluster_id"]))
        for i in open_nodes:
            node = tree.nodes[i]
            node.is_leaf, node.leaf_cluster, node.cluster_ids = True, min(labels.get(i, [(0, 0)]))[1], sorted(c for _, c in labels.get(i, []))
        rest = [i for i in open_nodes if len(labels.get(i, [])) > 1 and tree.nodes[i].depth < max_depth]
        if not rest:
            break
        long = placed.where(F.col("node_id").isin(rest)).select("node_id", "cluster_id", F.posexplode("features").alias("feature", "value"))
        quartile = long.groupBy("node_id", "feature").agg(F.percentile_approx("value", [0.25, 0.5, 0.75], accuracy).alias("q"))
        tried = long.join(F.broadcast(quartile), ["node_id", "feature"]).select("node_id", "feature", "value", "cluster_id", F.explode(F.array_distinct("q")).alias("threshold"))  # open nodes x features
        goes_left = F.col("value") <= F.col("threshold")
        scored = tried.groupBy("node_id", "feature", "threshold").agg(
            F.count_if((goes_left & (F.col("cluster_id") != 0)) | (~goes_left & (F.col("cluster_id") != 1))).alias("mistakes"), F.count_if(~goes_left).alias("right"))
        found = {r["node_id"]: r for r in best_cut_per_node(scored.where("right > 0").drop("right"), "threshold").collect()}
        open_nodes = []
        for i, r in found.items():
            open_nodes += [c.node_id for c in tree.split(i, r["feature"], r["threshold"], None, r["mistakes"])]
            tree.nodes[i].leaf_cluster = None
    tree.fill_stats(base, "cluster_id")
    base.unpersist()
    return tree
