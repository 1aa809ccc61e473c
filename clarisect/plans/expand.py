"""Growing a tree beyond one leaf per cluster by the cut that saves the most cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import running_sums
from ..functions.vectors import dot, doubles
from .tree import Tree

Centers = Sequence[Sequence[float]]


def with_dots(rows: DataFrame, centers: Centers) -> DataFrame:
    """Adds a column ``dot_j`` for each center."""
    return rows.select("*", *[dot(F.col("features"), doubles(c)).alias(f"dot_{j}") for j, c in enumerate(centers)])


def _cheapest(n: Column, dots: Sequence[Column], centers: Centers) -> Column:
    """(cost, at): the center for which n rows with these dot sums cost least, without the rows' own squares."""
    norms = [sum(v * v for v in c) for c in centers]
    return F.array_min(F.array(*[F.struct((n * F.lit(float(q)) - 2 * d).alias("cost"), F.lit(j).alias("at")) for j, (q, d) in enumerate(zip(norms, dots))]))


def pre_split_cost(rows: DataFrame, centers: Centers) -> DataFrame:
    """``leaf_id, n, pre_cost``; rows have ``leaf_id, features``."""
    k = range(len(centers))
    sums = with_dots(rows, centers).groupBy("leaf_id").agg(F.count("*").alias("n"), *[F.sum(f"dot_{j}").alias(f"dot_{j}") for j in k])
    return sums.select("leaf_id", "n", _cheapest(F.col("n"), [F.col(f"dot_{j}") for j in k], centers)["cost"].alias("pre_cost"))


def surrogate_cuts(rows: DataFrame, centers: Centers) -> DataFrame:
    """``leaf_id, feature, threshold, cost, center_left, center_right`` between distinct values of every leaf.

    Prefix sums of the dot products over sorted distinct values give the left side; the right is the rest.
    """
    k = range(len(centers))
    names = [f"dot_{j}" for j in k]
    dotted = with_dots(rows, centers).select("leaf_id", *names, F.posexplode("features").alias("feature", "threshold"))
    distinct = dotted.groupBy("leaf_id", "feature", "threshold").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names])
    whole = distinct.groupBy("leaf_id", "feature").agg(F.sum("n").alias("all_n"), F.max("threshold").alias("top"), *[F.sum(c).alias(f"all_{c}") for c in names])
    left = running_sums(distinct, ["leaf_id", "feature"], "threshold", ["n", *names]).join(whole, ["leaf_id", "feature"]).where("threshold < top")
    a = _cheapest(F.col("n"), [F.col(c) for c in names], centers)
    b = _cheapest(F.col("all_n") - F.col("n"), [F.col(f"all_{c}") - F.col(c) for c in names], centers)
    return left.select("leaf_id", "feature", "threshold", a.alias("a"), b.alias("b")).select(
        "leaf_id", "feature", "threshold", (F.col("a.cost") + F.col("b.cost")).alias("cost"), F.col("a.at").alias("center_left"), F.col("b.at").alias("center_right"))


def best_surrogate_cut(rows: DataFrame, centers: Centers) -> DataFrame:
    """The cheapest cut of each leaf; ties go to the lower feature, then the lower threshold."""
    best = F.min(F.struct("cost", "feature", "threshold", "center_left", "center_right"))
    return surrogate_cuts(rows, centers).groupBy("leaf_id").agg(best.alias("b")).select("leaf_id", "b.*")


def expand(tree: Tree, rows: DataFrame, centers: Centers, max_leaves: int) -> Tree:
    """Splits the leaf with the lowest cost gain until there are ``max_leaves``; leaves without mistakes stay.

    All leaves not yet judged are judged in one pass, so a step costs one job over the new leaves' rows.
    """
    base = rows.select("features", "cluster_id").persist()
    judged: dict[int, dict] = {}
    if not tree.nodes:
        raise ValueError("an empty tree has no leaf to expand")
    while len(tree.leaves()) < max_leaves:
        new = [n.node_id for n in tree.leaves() if n.node_id not in judged]
        if new:
            mine = base.withColumn("leaf_id", tree.leaf()).where(F.col("leaf_id").isin(new))
            wrong = mine.withColumn("named", tree.label()).groupBy("leaf_id").agg(F.count_if(F.col("cluster_id") != F.col("named")).alias("wrong")).where("wrong > 0").select("leaf_id")
            mistaken = [r["leaf_id"] for r in wrong.collect()]
            for i in new:
                judged[i] = {}
            if mistaken:
                some = mine.where(F.col("leaf_id").isin(mistaken))
                for r in best_surrogate_cut(some, centers).join(pre_split_cost(some, centers), "leaf_id").collect():
                    judged[r["leaf_id"]] = r.asDict() | {"gain": r["cost"] - r["pre_cost"]}
        open_leaves = [(judged[n.node_id]["gain"], n.node_id) for n in tree.leaves() if judged[n.node_id]]
        if not open_leaves:
            break
        cut = judged.pop(min(open_leaves)[1])
        sides = tree.split(cut["leaf_id"], cut["feature"], cut["threshold"])
        tree.nodes[cut["leaf_id"]].leaf_cluster = None
        for child, center in zip(sides, (cut["center_left"], cut["center_right"])):
            child.is_leaf, child.leaf_cluster, child.cluster_ids = True, center, [center]
    tree.fill_stats(base, "cluster_id")
    base.unpersist()
    return tree
