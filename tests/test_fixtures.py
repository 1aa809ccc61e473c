"""Published fixtures: small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from clarisect.operators import binning, cuts, splits, stats
from clarisect.operators.features import instances
from clarisect.plans.grow import grow_levelwise
from clarisect.plans.tree import Node, Tree


def rows(spark, data, label=None):
    """(features, cluster) pairs as instances."""
    return spark.createDataFrame([([float(v) for v in x], c, 1.0) for x, c in data], "features array<double>, cluster_id int, weight double")


def binned(spark, data):
    return spark.createDataFrame([(list(b), c, n, 1.0, True) for b, c, n in data], "bins array<int>, cluster_id int, node_id long, weight double, is_valid boolean")


def centers_at(spark, bins):
    return spark.createDataFrame([(c, f, b) for c, bs in bins.items() for f, b in enumerate(bs)], "cluster_id int, feature int, center_bin int")


def test_bin_one_row(spark):
    cut = [[1.5, 3.0, 5.0], [2.0, 3.5]]
    assert binning.bin_instances(rows(spark, [((2.5, 3.0), 0)]), cut).first()["bins"] == [1, 1]
    assert binning.center_bins([[5.0, 3.5]], cut) == [[2, 1]]


def test_bin_many_rows(spark):
    cut = [[2.0, 4.0], [3.0, 4.0]]
    got = binning.bin_instances(rows(spark, [((1.0, 2.5), 0), ((4.0, 3.7), 1)]), cut).collect()
    assert [r["bins"] for r in got] == [[0, 0], [1, 1]]
    assert all(r["node_id"] == 0 and r["is_valid"] for r in got)
    table = {(r["cluster_id"], r["feature"]): r["center_bin"] for r in binning.bin_centers(spark, [[3.0, 3.5], [5.0, 4.5]], cut).collect()}
    assert table == {(0, 0): 1, (0, 1): 1, (1, 0): 2, (1, 1): 2}


def test_nan_goes_to_the_last_bin(spark):
    assert binning.bin_instances(rows(spark, [((float("nan"),), 0)]), [[1.0, 2.0]]).first()["bins"] == [2]


@pytest.mark.parametrize("compat", [True, False])
def test_find_splits(spark, compat):
    data = rows(spark, [((1, 3), 0), ((2, 2), 0), ((4, 1), 1), ((5, 4), 1)])
    assert splits.find_splits(data, [[1.5, 3.0], [4.5, 2.5]], 2, 5, compat=compat) == [[1.5, 4.5], [1.5, 2.5, 3.0, 3.5]]


def weights(spark, values, weight):
    return spark.createDataFrame([(0, float(v), float(weight), 1) for v in values], "feature int, value double, weight double, n long")


def test_stride_thresholds(spark):
    def got(w, n):
        full = splits.complete_zeros(weights(spark, range(1, 51), w), n, 1)
        return sorted(r["threshold"] for r in splits.stride_thresholds(full, 10, n).collect())

    assert got(1200, 60_000) == [5.5, 9.5, 14.5, 18.5, 23.5, 27.5, 32.5, 36.5, 41.5, 45.5]
    assert got(200, 60_000) == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 8.5, 23.5]


def test_dedup_keeps_the_first_of_near_equals(spark):
    t = spark.createDataFrame([(0, 1.0), (0, 1.0 + 5e-10), (0, 1.0 + 12e-10), (0, 2.0)], "feature int, threshold double")
    assert [r["threshold"] for r in splits.union_dedup(t).orderBy("bin").collect()] == [1.0, 1.0 + 12e-10, 2.0]


def test_sample_fraction():
    assert splits.sample_fraction(32, 9_999) == 1.0
    assert splits.sample_fraction(32, 40_000) == 0.25
    assert splits.sample_fraction(200, 80_000) == 0.5


def test_stats_of_one_node(spark):
    zero = [(0, 1), (1, 1), (1, 1), (0, 0), (0, 0), (1, 0), (0, 1)]
    one = [(2, 2), (3, 2), (3, 3), (2, 2), (3, 2), (2, 3), (3, 2), (3, 3)]
    h = stats.bin_histogram(binned(spark, [(b, 0, 0) for b in zero] + [(b, 1, 0) for b in one]))
    got = {(r["feature"], r["cluster_id"], r["bin"]): r["w"] for r in h.collect()}
    assert got[0, 0, 0] == 4 and got[0, 0, 1] == 3 and got[1, 1, 2] == 5 and got[1, 1, 3] == 3
    ranges = {r["feature"]: (r["min_bin"], r["max_bin"]) for r in stats.center_bin_ranges(h, centers_at(spark, {0: (1, 1), 1: (3, 2)})).collect()}
    assert ranges == {0: (1, 3), 1: (1, 2)}


def test_stats_of_two_nodes(spark):
    data = [((0, 1), 0, 0), ((1, 2), 0, 0), ((2, 3), 1, 0), ((3, 2), 1, 0), ((1, 0), 0, 1), ((2, 1), 0, 1), ((3, 3), 1, 1), ((2, 2), 1, 1)]
    h = stats.bin_histogram(binned(spark, data))
    ranges = {(r["node_id"], r["feature"]): (r["min_bin"], r["max_bin"]) for r in stats.center_bin_ranges(h, centers_at(spark, {0: (1, 2), 1: (3, 3)})).collect()}
    assert ranges == {(0, 0): (1, 3), (0, 1): (2, 3), (1, 0): (1, 3), (1, 1): (2, 3)}


def test_split_evaluation_with_estimated_centers(spark):
    h = spark.createDataFrame([(0, 0, 0, 0, 2.0, 2), (0, 0, 0, 1, 3.0, 3), (0, 0, 0, 2, 1.0, 1), (0, 0, 1, 3, 2.0, 2), (0, 0, 1, 4, 4.0, 4), (0, 0, 1, 5, 2.0, 2)],
                              "node_id long, feature int, cluster_id int, bin int, w double, n long")
    m = cuts.mistakes_binned(h, centers_at(spark, {0: (1,), 1: (5,)}), "reference", "estimated")
    assert {r["bin"]: r["mistakes"] for r in m.collect()} == {2: 0, 3: 2, 4: 2}
    assert cuts.best_cut_per_feature(m).first()["bin"] == 2


def test_best_cut_per_node_and_ties(spark):
    m = spark.createDataFrame([(0, 0, 1, 5), (0, 1, 3, 2), (1, 0, 2, 7), (1, 1, 4, 3), (2, 1, 1, 4), (2, 0, 9, 4), (2, 0, 8, 4)], "node_id long, feature int, bin int, mistakes long")
    got = {r["node_id"]: (r["feature"], r["bin"], r["mistakes"]) for r in cuts.best_cut_per_node(m).collect()}
    assert got == {0: (1, 3, 2), 1: (1, 4, 3), 2: (0, 8, 4)}


def test_reassign(spark):
    tree = Tree([Node(0)])
    tree.split(0, 0, None, 2)
    own = {0: (1, 2), 1: (4, 2)}
    at = tree.route_strict(lambda n: F.col("bins")[n.feature] <= n.bin, lambda n: [c for c, b in own.items() if b[n.feature] <= n.bin])
    got = binned(spark, [((1, 2), 0, 0), ((3, 2), 0, 0), ((3, 2), 1, 0)]).select(at.alias("at")).select("at.*").collect()
    assert [tuple(r) for r in got] == [(1, True), (2, False), (2, True)]


def test_one_full_iteration(spark):
    cut = [[0.5, 1.5, 2.5, 3.5], [0.5, 1.5, 2.5]]
    data = rows(spark, [((1, 2), 0), ((3, 2), 0), ((3, 2), 1)])
    for options, mistakes in ((("reference", "estimated"), 1), (("reference", "true"), 1)):
        tree = grow_levelwise(data, [[1, 2], [3, 2]], cut, *options)
        assert tree.nodes[0].feature == 0 and tree.nodes[0].bin == 2 and tree.nodes[0].scored_mistakes == mistakes
        assert (tree.nodes[1].cluster_ids, tree.nodes[2].cluster_ids) == ([0], [1])
        assert (tree.nodes[1].samples, tree.nodes[1].mistakes, tree.nodes[2].samples, tree.nodes[2].mistakes) == (1, 0, 2, 1)
        assert tree.nodes[1].is_leaf and tree.nodes[2].is_leaf and tree.nodes[0].residual_samples == 0


def test_adjacent_bins_need_the_full_range(spark):
    data, cut = rows(spark, [((0,), 0), ((0,), 0), ((1,), 1)]), [[0.5]]
    assert grow_levelwise(data, [[0], [1]], cut, "full").size == 3
    stuck = grow_levelwise(data, [[0], [1]], cut, "reference")
    assert stuck.size == 1 and not stuck.nodes[0].is_leaf and stuck.nodes[0].is_terminal
    assert "No split" in stuck.lines()[0]


def test_candidate_kernel(spark):
    x = [((1, 2), 0), ((1.5, 3), 0), ((3, 6), 1), ((2.5, 5), 1), ((2, 4.5), 0)]
    data = rows(spark, x).withColumn("node_id", F.lit(0).cast("long"))
    t = splits.split_table(spark, [[1.00, 2.45], [2.0, 5.0]])
    m = cuts.mistakes_exact(data, [[1.25, 2.5], [2.75, 5.5]], {0: [0, 1]}, t)
    got = sorted((r["feature"], r["threshold"], r["mistakes"]) for r in m.collect())
    assert got == [(0, 1.25, 2), (0, 2.45, 0), (1, 2.5, 2), (1, 5.0, 1)]
    best = cuts.best_cut_per_node(m, "threshold").first()
    assert (best["feature"], best["threshold"], best["mistakes"]) == (0, 2.45, 0)


def test_instances_from_vectors(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense(1.0, 2.0), 3)], ["features", "prediction"])
    r = instances(df).first()
    assert r["features"] == [1.0, 2.0] and r["cluster_id"] == 3 and r["weight"] == 1.0
