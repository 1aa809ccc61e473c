"""Growth against brute force, invariants, persistence and streams."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from clarisect.operators import cuts, features, score, splits
from clarisect.plans.expand import best_surrogate_cut, expand, pre_split_cost
from clarisect.plans.grow import grow_levelwise, grow_quartile, grow_recursive
from clarisect.plans.model import ExplainableKMeans
from clarisect.plans.tree import Node, Tree
from clarisect.sources import tables
from clarisect.streaming.scoring import leaf_counts, predict_stream


def sample(seed, n=120, d=3, k=4, top=12):
    r = random.Random(seed)
    centers = [[r.randint(0, top) for _ in range(d)] for _ in range(k)]
    data = []
    for _ in range(n):
        x = [r.randint(0, top) for _ in range(d)]
        y = min(range(k), key=lambda c: (sum((a - b) ** 2 for a, b in zip(x, centers[c])), c))
        data.append((x, y))
    return data, centers


def frame(spark, data):
    return spark.createDataFrame([([float(v) for v in x], y, 1.0) for x, y in data], "features array<double>, cluster_id int, weight double")


def brute_exact(data, centers, drop):
    """The tree of the exact strategy as {node: (feature, threshold) or cluster}."""
    out = {}

    def grow(i, rows, valid):
        if not rows:
            out[i] = 0
        elif len(valid) == 1:
            out[i] = valid[0]
        elif len({y for _, y in rows}) == 1:
            out[i] = rows[0][1]
        else:
            best = None
            for f in range(len(centers[0])):
                lo, hi = min(centers[c][f] for c in valid), max(centers[c][f] for c in valid)
                for t in sorted({x[f] for x, _ in rows} | {centers[c][f] for c in valid}):
                    if lo <= t < hi and t < max(x[f] for x, _ in rows):
                        m = sum((x[f] <= t) != (centers[y][f] <= t) for x, y in rows)
                        best = min(best or (m, f, t), (m, f, t))
            if best is None:
                out[i] = valid[0]
                return
            _, f, t = best
            out[i] = (f, float(t))
            for k in (1, 2):
                side = [(x, y) for x, y in rows if (x[f] <= t) == (k == 1) and (not drop or (x[f] <= t) == (centers[y][f] <= t))]
                grow(2 * i + k, side, [c for c in valid if (centers[c][f] <= t) == (k == 1)])

    grow(0, data, list(range(len(centers))))
    return out


def brute_levelwise(data, centers, cut):
    bins = [[sum(t < v for t in cut[f]) for f, v in enumerate(x)] for x, _ in data]
    own = [[sum(t < v for t in cut[f]) for f, v in enumerate(c)] for c in centers]
    at, ok, out, todo = [0] * len(data), [True] * len(data), {}, [0]
    while todo:
        nxt = []
        for i in todo:
            mine = [j for j in range(len(data)) if at[j] == i and ok[j]]
            here = {data[j][1] for j in mine}
            best = None
            for f in range(len(centers[0])):
                lo, hi = min((own[c][f] for c in here), default=0), max((own[c][f] for c in here), default=0)
                for b in range(lo, hi):
                    m = sum((bins[j][f] <= b) != (own[data[j][1]][f] <= b) for j in mine)
                    best = min(best or (m, f, b), (m, f, b))
            if best:
                _, f, b = best
                out[i] = best
                for j in mine:
                    left = bins[j][f] <= b
                    at[j], ok[j] = 2 * i + (1 if left else 2), left == (own[data[j][1]][f] <= b)
                nxt += [2 * i + 1, 2 * i + 2]
        todo = nxt
    counts = {i: (at.count(i), sum(a == i and not v for a, v in zip(at, ok))) for i in set(at)}
    return out, counts


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("drop", [True, False])
def test_exact_growth(spark, seed, drop):
    data, centers = sample(seed)
    tree = grow_recursive(frame(spark, data), centers, drop_mistakes=drop)
    got = {n.node_id: (n.feature, n.threshold) if n.feature is not None else n.leaf_cluster for n in tree.ordered()}
    assert got == brute_exact(data, centers, drop)
    assert sum(n.samples for n in tree.leaves()) == len(data) == tree.nodes[0].samples


@pytest.mark.parametrize("seed", [3, 4])
def test_levelwise_growth(spark, seed):
    data, centers = sample(seed)
    cut = [[1.5, 3.0, 4.5, 6.0, 8.5, 10.0]] * 3
    tree = grow_levelwise(frame(spark, data), centers, cut)
    want, counts = brute_levelwise(data, centers, cut)
    assert {n.node_id: (n.scored_mistakes, n.feature, n.bin) for n in tree.ordered() if n.feature is not None} == want
    for n in tree.ordered():
        stand = counts.get(n.node_id, (0, 0))
        assert n.residual_samples == stand[0] and n.mistakes == stand[1]
    assert sum(n.residual_samples for n in tree.ordered()) == len(data)
    assert len(tree.leaves()) <= len(centers)


def test_exact_is_no_worse_than_binned_at_the_root(spark):
    data, centers = sample(5)
    rows = frame(spark, data).withColumn("node_id", F.lit(0).cast("long"))
    exact = cuts.best_cut_per_node(cuts.mistakes_exact(rows, centers, {0: [0, 1, 2, 3]}), "threshold").first()["mistakes"]
    tree = grow_levelwise(frame(spark, data), centers, [[2.5, 5.5, 8.5]] * 3)
    assert exact <= tree.nodes[0].scored_mistakes


def test_running_sums_are_the_direct_definition(spark):
    data, centers = sample(6, n=60)
    rows = frame(spark, data).withColumn("node_id", F.lit(0).cast("long"))
    for r in cuts.mistakes_exact(rows, centers, {0: [0, 1, 2, 3]}).collect():
        f, t = r["feature"], r["threshold"]
        assert r["mistakes"] == sum((x[f] <= t) != (centers[y][f] <= t) for x, y in data)


def test_weights_count(spark):
    data, centers = sample(7, n=40)
    doubled = frame(spark, data).withColumn("weight", F.lit(2.0)).withColumn("node_id", F.lit(0).cast("long"))
    once = cuts.mistakes_exact(doubled.withColumn("weight", F.lit(1.0)), centers, {0: [0, 1, 2, 3]})
    twice = cuts.mistakes_exact(doubled, centers, {0: [0, 1, 2, 3]})
    a, b = ({(r["feature"], r["threshold"]): r["mistakes"] for r in x.collect()} for x in (once, twice))
    assert b == {k: 2 * v for k, v in a.items()}


def test_quartile_growth_stops(spark):
    data, _ = sample(8, k=2)
    tree = grow_quartile(frame(spark, data), max_depth=3)
    assert 1 <= tree.depth <= 3 and sum(n.samples for n in tree.leaves()) == len(data)
    one = grow_quartile(frame(spark, [([1, 2, 3], 1)] * 3))
    assert one.size == 1 and one.nodes[0].leaf_cluster == 1


def test_degenerate_inputs(spark):
    empty = frame(spark, [([1, 1], 0)]).limit(0)
    tree = grow_recursive(empty, [[0, 0], [1, 1]])
    assert tree.size == 1 and tree.nodes[0].leaf_cluster == 0
    assert grow_levelwise(empty, [[0, 0], [1, 1]], [[0.5], [0.5]]).size == 1
    same = frame(spark, [([1, 1], 0), ([1, 1], 1)])
    assert grow_recursive(same, [[1, 1], [1, 1]]).nodes[0].leaf_cluster == 0
    assert grow_recursive(frame(spark, [([1, 1], 1)] * 2), [[0, 0], [1, 1]]).nodes[0].leaf_cluster == 1


def test_surrogate_cuts_and_expansion(spark):
    data, centers = sample(9, n=60)
    rows = frame(spark, data)

    def side(xs):
        return min(sum(sum(v * v for v in c) - 2 * sum(a * b for a, b in zip(x, c)) for x in xs) for c in centers)

    best = min((side([x for x, _ in data if x[f] <= t]) + side([x for x, _ in data if x[f] > t]), f, t) for f in range(3) for t in sorted({x[f] for x, _ in data})[:-1])
    got = best_surrogate_cut(rows.withColumn("leaf_id", F.lit(0).cast("long")), centers).first()
    assert (got["cost"], got["feature"], got["threshold"]) == best
    assert pre_split_cost(rows.withColumn("leaf_id", F.lit(0).cast("long")), centers).first()["pre_cost"] == side([x for x, _ in data])
    tree = grow_recursive(rows, centers, drop_mistakes=True)
    before = sum(n.mistakes for n in tree.leaves())
    more = expand(tree, rows, centers, 8)
    assert len(more.leaves()) == 8 or not any(n.mistakes for n in more.leaves())
    assert sum(n.samples for n in more.leaves()) == len(data) and before >= 0


@pytest.mark.parametrize("strategy", ["levelwise", "recursive", "exact", "quartile"])
def test_estimator(spark, strategy):
    data = [([a + g * 10.0, b + g * 10.0], ) for g in range(2) for a, b in itertools.product(range(4), range(4))]
    df = spark.createDataFrame(data, "features array<double>")
    model = ExplainableKMeans(2, strategy=strategy, sample=1.0).fit(df)
    assert model.surrogate_score(df) >= model.score(df) - 1e-9
    assert model.score_sql(df) == pytest.approx(model.score(df)) and model.surrogate_score_sql(df) == pytest.approx(model.surrogate_score(df))
    assert len({r["prediction"] for r in model.predict(df).collect()}) == 2
    assert sum(model.feature_importance()) == model.tree.size // 2
    model.register("explain_cluster", spark)
    df.createOrReplaceTempView("points")
    assert spark.sql("SELECT count_if(explain_cluster(features) = 0) AS n FROM points").first()["n"] == 16


def test_supplied_labels_and_expansion(spark):
    data, centers = sample(10)
    df = frame(spark, data).withColumnRenamed("cluster_id", "mine")
    model = ExplainableKMeans(4, max_leaves=7, strategy="exact").fit(df, labels="mine", centers=centers)
    assert 4 <= len(model.tree.leaves()) <= 7
    from_one = ExplainableKMeans(4, max_leaves=5, strategy="exact", base_tree="none").fit(df, labels="mine", centers=centers)
    assert len(from_one.tree.leaves()) == 5
    with pytest.raises(ValueError):
        ExplainableKMeans(4, max_leaves=3)
    with pytest.raises(ValueError):
        ExplainableKMeans(3).fit(df, labels="mine", centers=centers)


def test_scores_of_two_groups(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 0), ([2.0, 3.0, 4.0], 0), ([3.0, 4.0, 5.0], 0), ([8.0, 9.0, 10.0], 1), ([9.0, 10.0, 11.0], 1)], "features array<double>, prediction int")
    centers = [[2.0, 3.0, 4.0], [8.5, 9.5, 10.5]]
    assert score.score(df, 3).first()[0] == 7.5 and score.surrogate_score(df, centers).first()[0] == 7.5
    assert score.score_sql(df, 3).first()[0] == 7.5 and score.surrogate_score_sql(df, centers).first()[0] == 7.5


def fixed():
    tree = Tree([Node(0)])
    tree.split(0, 2, 1.9)
    tree.split(2, 2, 5.1)
    for i, c in ((1, 1), (5, 2), (6, 0)):
        tree.nodes[i].is_leaf, tree.nodes[i].leaf_cluster = True, c
    return tree


def test_fixed_tree_statistics_texts_and_files(spark, tmp_path):
    df = spark.createDataFrame([([0.0, 0.0, v], p) for v, p in ((1.0, 1), (1.9, 1), (2.0, 2), (5.1, 0), (6.0, 0))], "features array<double>, prediction int")
    tree = fixed().fill_stats(df)
    assert {n.node_id: (n.samples, n.mistakes) for n in tree.ordered()} == {0: (5, 1), 1: (2, 0), 2: (3, 1), 5: (2, 1), 6: (1, 0)}
    assert tree.feature_importance(3) == [0, 0, 2] and (tree.size, tree.depth) == (5, 2) and Tree([]).depth == -1
    assert tree.lines()[0] == "Node 0: Node 0 | depth=0 | split=(f2 <= 1.900) | clusters=[] | samples=5 | mistakes=1"
    dot = tree.to_dot(["a", "b", "c"])
    assert dot.startswith("digraph ClusteringTree {") and 'n_0 [label="c <= 1.900\\nsamples=5"];' in dot and "n_2 -> n_4;" in dot
    assert Tree.from_json(tree.to_json()).to_json() == tree.to_json() and json.loads(Tree([]).to_json()) is None
    tables.write_tree(tree, spark, str(tmp_path / "tree"))
    assert tables.read_tree(spark, str(tmp_path / "tree")).lines() == tree.lines()
    tables.write_text(spark, tree.lines(), str(tmp_path / "text"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "text")).collect()] == tree.lines()


def test_unknown_bin_is_printed(spark):
    tree = Tree([Node(0)])
    tree.split(0, 1, None, 3)
    assert "[bin 3]" in tree.lines([[0.5], [1.0]])[0] and "(f1 <= 4.000)" in tree.lines([[], [1.0, 2.0, 3.0, 4.0]])[0]


def test_csv_cast_scan_reads_csv(spark):
    from clarisect import queries

    d = "/root/testdata/sf0.001"
    got = queries.csv_cast_scan(spark, d)
    assert got.inputFiles() and all(".csv" in f for f in got.inputFiles())
    want = spark.read.parquet(f"{d}/lineitem.parquet").select(*[F.col(c).cast("double") for c in ("l_orderkey", "l_quantity", "l_tax")])
    assert got.dtypes == want.dtypes and got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_csv_round_trips(spark, tmp_path):
    import gzip

    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,oops\n")
    (tmp_path / "b.csv").write_text("x,y\n5,6\n")
    raw = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert {t for _, t in raw.dtypes} == {"string"}
    assert [tuple(r) for r in features.cast_doubles(raw, strict=False).collect()] == [(1.0, 2.0), (3.0, None)]
    with pytest.raises(Exception):
        features.cast_doubles(raw).collect()
    assert dict(tables.read_csv(spark, str(tmp_path / "b.csv"), infer=True).dtypes) == {"x": "int", "y": "int"}
    tables.combine_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], str(tmp_path / "all"))
    assert tables.read_csv(spark, str(tmp_path / "all")).count() == 3
    with gzip.open(tmp_path / "s.csv.gz", "wt") as f:
        f.write("1,0.5,0.25\n0,1.5,2.5\n")
    assert tables.read_labelled(spark, str(tmp_path / "s.csv.gz")).columns == ["feature 1", "feature 2"]
    df = spark.createDataFrame([([1.0, 2.0], 1)], "features array<double>, prediction int")
    tables.write_clustered(df, str(tmp_path / "c"), kind="csv")
    assert tables.read_csv(spark, str(tmp_path / "c")).columns == ["feature_0", "feature_1", "Cluster"]


def test_assemble_refuses_nulls(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    with pytest.raises(Exception, match="null in feature b"):
        features.assemble(df, ["a", "b"]).collect()


def test_hash_sample_is_stable(spark):
    df = spark.range(10_000)
    a, b = (splits.bernoulli_sample(x, 0.1, 5, ["id"]) for x in (df, df.repartition(7)))
    assert {r[0] for r in a.collect()} == {r[0] for r in b.collect()} and 800 < a.count() < 1200


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([([0.0, 0.0, float(v)], f"2024-01-01 00:0{v}:00") for v in range(8)], "features array<double>, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    predict_stream(stream, fixed()).writeStream.format("memory").queryName("explained").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("explained").groupBy("prediction").count().count() == 3
    leaf_counts(stream, fixed(), "at", "4 minutes").writeStream.format("memory").outputMode("complete").queryName("counted").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == 8


def test_prediction_stays_in_generated_code(spark):
    df = spark.createDataFrame([([0.0, 0.0, 1.0],)], "features array<double>").select("features", fixed().label().alias("prediction"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
