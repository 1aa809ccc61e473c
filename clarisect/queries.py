"""Named queries over the driver's tables, each with DuckDB SQL where SQL can express it.

Frame F4 makes everything exact: four integer features of ``lineitem``, literal integer centers and thresholds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vectors import as_array
from .operators import binning, clustering, cuts, features, score, splits, stats
from .plans import expand as expansion
from .plans.grow import grow_levelwise, grow_quartile, grow_recursive
from .plans.model import ExplainableKMeans
from .plans.tree import Node, Tree
from .sources import tables
from .sources.scratch import shared_folder

CENTERS = [[10, 20, 2, 2], [25, 45, 8, 4], [40, 80, 3, 6], [35, 60, 9, 1]]
SPLITS = [
    [5.5, 10.0, 15.5, 20.5, 25.0, 30.5, 35.0, 40.0, 45.5],
    [10.5, 20.0, 30.5, 40.5, 45.0, 52.5, 60.0, 72.5, 80.0],
    [1.5, 2.0, 3.0, 5.5, 6.5, 8.0, 9.0],
    [1.0, 2.0, 3.5, 4.0, 6.0, 7.5],
]
KEY = ["l_orderkey", "l_linenumber"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---- frames

def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``l_orderkey, l_linenumber, features``."""
    l = read(spark, sf_dir, "lineitem")
    values = [F.col("l_quantity"), F.round(F.col("l_extendedprice") / 1000), F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100)]
    return l.select(*KEY, F.array(*[v.cast("double") for v in values]).alias("features"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 with the nearest center as ``prediction`` and ``cluster_id``, weight 1."""
    return features.instances(clustering.assign_nearest(f4(spark, sf_dir), CENTERS))


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.bin_instances(labelled(spark, sf_dir), SPLITS)


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bin_histogram(binned(spark, sf_dir))


def fixed_tree() -> Tree:
    """Price at most 52.5; left quantity at most 17.5; right discount at most 6: leaves name 0, 1, 2, 3."""
    tree = Tree([Node(0)])
    tree.split(0, 1, 52.5)
    tree.split(1, 0, 17.5)
    tree.split(2, 2, 6.0)
    for i, c in ((3, 0), (4, 1), (5, 2), (6, 3)):
        tree.nodes[i].is_leaf, tree.nodes[i].leaf_cluster, tree.nodes[i].cluster_ids = True, c, [c]
    return tree


_VALUES = ", ".join(f"({i}, {', '.join(map(str, c))})" for i, c in enumerate(CENTERS))
_DIST = ", ".join("+".join(f"(f{j}-{v})*(f{j}-{v})" for j, v in enumerate(c)) for c in CENTERS)
_THRESHOLDS = ", ".join(f"({f}, {b}, {t}::DOUBLE)" for f, ts in enumerate(SPLITS) for b, t in enumerate(ts))
BASE = f"""
f4 AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS f0, round(l_extendedprice / 1000)::BIGINT AS f1, round(l_discount * 100)::BIGINT AS f2, round(l_tax * 100)::BIGINT AS f3 FROM lineitem),
c(cluster_id, c0, c1, c2, c3) AS (VALUES {_VALUES}),
cl AS (SELECT cluster_id, unnest([0, 1, 2, 3]) AS feature, unnest([c0, c1, c2, c3]) AS center FROM c),
lab AS (SELECT *, (list_position(d, list_min(d)) - 1)::INT AS y FROM (SELECT *, [{_DIST}] AS d FROM f4)),
u AS (SELECT l_orderkey, l_linenumber, y, unnest([0, 1, 2, 3]) AS feature, unnest([f0, f1, f2, f3]) AS value FROM lab),
t(feature, bin, threshold) AS (VALUES {_THRESHOLDS}),
b AS (SELECT u.*, len(list_filter((SELECT list(threshold) FROM t WHERE t.feature = u.feature), lambda x: x < u.value))::INT AS bin FROM u),
cb AS (SELECT cluster_id, feature, (SELECT count(*) FROM t WHERE t.feature = cl.feature AND t.threshold < center)::INT AS center_bin FROM cl)
"""
_T = {f: "[" + ", ".join(f"{t}::DOUBLE" for t in ts) + "]" for f, ts in enumerate(SPLITS)}
BASE = BASE.replace("len(list_filter((SELECT list(threshold) FROM t WHERE t.feature = u.feature), lambda x: x < u.value))", "CASE feature " + " ".join(f"WHEN {f} THEN len(list_filter({l}, lambda x: x < u.value))" for f, l in _T.items()) + " END")


def sql(body: str) -> str:
    return f"WITH {BASE.strip()}, {body}" if not body.lstrip().startswith("SELECT") else f"WITH {BASE.strip()} {body}"


# ---- features and clusters

@query("SELECT l_orderkey::DOUBLE AS l_orderkey, l_quantity, l_tax FROM lineitem")
def csv_cast_scan(spark, sf_dir):
    """The whole table is written as CSV to the shared folder, scanned, and every column cast to double."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    tables.write_csv(read(spark, sf_dir, "lineitem"), path)
    return features.cast_doubles(tables.read_csv(spark, path), strict=False).select("l_orderkey", "l_quantity", "l_tax")


@query(sql("SELECT l_orderkey, l_linenumber, [f0::DOUBLE, f1::DOUBLE, f2::DOUBLE, f3::DOUBLE] AS features FROM f4"))
def assemble_features(spark, sf_dir):
    wide = f4(spark, sf_dir).select(*KEY, *[F.col("features")[i].alias(f"f{i}") for i in range(4)])
    return features.assemble(wide, ["f0", "f1", "f2", "f3"], KEY)


@query("""SELECT c_custkey, round((c_acctbal - m) / s, 6) AS z FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)""")
def standardize_features(spark, sf_dir):
    return features.standardize(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 6).alias("z"))


@query("""SELECT p_partkey, round(coalesce(x, avg(x) OVER ()), 6) AS x FROM (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS x FROM part)""")
def impute_mean(spark, sf_dir):
    some = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice").cast("string")).otherwise("n/a").alias("x"))
    return features.impute_mean(some, ["x"]).select("p_partkey", F.round("x", 6).alias("x"))


@query("""SELECT l_orderkey, l_linenumber, (l_returnflag = 'A')::INT AS is_a, (l_returnflag = 'N')::INT AS is_n, (l_returnflag = 'R')::INT AS is_r FROM lineitem""")
def one_hot_flags(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select(*KEY, "l_returnflag", F.col("l_returnflag").alias("flag"))
    wide = features.one_hot(l, ["flag"])
    columns = [c for c in wide.columns if c.startswith("flag_")]
    own = F.array(*columns)
    # each category has one column; a row's own column is the one that is set
    return wide.select(*KEY, *[((F.col("l_returnflag") == v) & (F.array_max(own) == 1)).cast("int").alias(f"is_{v.lower()}") for v in "ANR"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 100")
def slice_rows(spark, sf_dir):
    return features.take(read(spark, sf_dir, "lineitem"), KEY, 100, [*KEY, "l_quantity"])


@query(sql("SELECT l_orderkey, l_linenumber, y AS prediction FROM lab"))
def nearest_center_assign(spark, sf_dir):
    return clustering.assign_nearest(f4(spark, sf_dir), CENTERS).select(*KEY, "prediction")


@query(sql("SELECT y AS prediction, count(*) AS n, round(avg(f0), 6) AS m0, round(avg(f1), 6) AS m1, round(avg(f2), 6) AS m2, round(avg(f3), 6) AS m3 FROM lab GROUP BY y"))
def lloyd_step(spark, sf_dir):
    return clustering.lloyd_step(f4(spark, sf_dir), CENTERS).select("prediction", "n", *[F.round(F.col("center")[i], 6).alias(f"m{i}") for i in range(4)])


@query()
def kmeans_fit_sizes(spark, sf_dir):
    rows, _ = clustering.assign(f4(spark, sf_dir), clustering.fit_kmeans(f4(spark, sf_dir), 4, 42))
    return rows.groupBy("prediction").agg(F.count("*").alias("n"))


@query("SELECT label AS cluster_id, count(*) AS n, round(sum(list_aggregate(embedding::DOUBLE[], 'sum')), 3) AS total FROM embeddings GROUP BY label")
def precomputed_labels(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").withColumn("features", F.col("embedding").cast("array<double>"))
    rows = features.instances(as_array(e), "label")
    return rows.groupBy("cluster_id").agg(F.count("*").alias("n"), F.round(F.sum(F.aggregate("features", F.lit(0.0), lambda a, x: a + x)), 3).alias("total"))


@query("""SELECT region, nation, count(*) AS n FROM (SELECT n_regionkey AS region, n_name AS nation FROM nation, range(3)) GROUP BY ALL""")
def union_inflate(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("nation"))
    return features.inflate(n, 2).groupBy("region", "nation").agg(F.count("*").alias("n"))


# ---- split candidates

@query("SELECT CASE WHEN count(*) > 10000 THEN 10000.0::DOUBLE / count(*) ELSE 1.0::DOUBLE END AS fraction FROM lineitem")
def sample_fraction_rule(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").count()
    return spark.createDataFrame([(splits.sample_fraction(32, n),)], "fraction double")


@query()
def bernoulli_sample(spark, sf_dir):
    rows = f4(spark, sf_dir)
    return splits.bernoulli_sample(rows, splits.sample_fraction(32, rows.count()), 42, KEY)


@query(sql("SELECT l_orderkey, l_linenumber, feature, value::DOUBLE AS value FROM u WHERE value <> 0"))
def feature_unpivot(spark, sf_dir):
    return splits.unpivot(f4(spark, sf_dir), KEY, drop_zero=True)


@query(sql("SELECT feature, value::DOUBLE AS value, count(*)::DOUBLE AS weight, count(*) AS n FROM u WHERE value <> 0 GROUP BY ALL"))
def value_weight_histogram(spark, sf_dir):
    return splits.value_weights(labelled(spark, sf_dir))


@query(sql("SELECT feature, value::DOUBLE AS value, count(*)::DOUBLE AS weight, count_if(value <> 0) AS n FROM u GROUP BY ALL"))
def zero_completion(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return splits.complete_zeros(splits.value_weights(rows), float(rows.count()), 4)


@query(sql("SELECT DISTINCT feature, center::DOUBLE AS value FROM cl WHERE center <> 0"))
def center_candidate_values(spark, sf_dir):
    return splits.center_values(spark, CENTERS)


def _weights(spark, sf_dir):
    return splits.value_weights(labelled(spark, sf_dir), drop_zero=False)


@query(sql("SELECT feature, threshold FROM (SELECT feature, (value + lag(value) OVER (PARTITION BY feature ORDER BY value)) / 2.0::DOUBLE AS threshold FROM (SELECT DISTINCT feature, value FROM u)) WHERE threshold IS NOT NULL"))
def splits_midpoint(spark, sf_dir):
    return splits.midpoints(_weights(spark, sf_dir))


_STRIDE = """RECURSIVE {base},
v AS (SELECT feature, value::DOUBLE AS value, count(*)::DOUBLE AS w, row_number() OVER (PARTITION BY feature ORDER BY value) AS i FROM u GROUP BY feature, value),
s AS (SELECT sum(w) / 6 AS stride FROM v WHERE feature = 0),
r AS (
  SELECT feature, i, value, w AS cum, stride AS target, NULL::DOUBLE AS threshold FROM v, s WHERE i = 1
  UNION ALL
  SELECT v.feature, v.i, v.value, r.cum + v.w, CASE WHEN abs(r.cum - r.target) < abs(r.cum + v.w - r.target) THEN r.target + stride ELSE r.target END,
         CASE WHEN abs(r.cum - r.target) < abs(r.cum + v.w - r.target) THEN (r.value + v.value) / 2 END
  FROM r JOIN v ON v.feature = r.feature AND v.i = r.i + 1, s)
SELECT feature, threshold FROM r WHERE threshold IS NOT NULL"""


@query("WITH " + _STRIDE.format(base=BASE.strip()))
def splits_stride(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return splits.stride_thresholds(splits.value_weights(rows, drop_zero=False), 5, float(rows.count()))


_LINSPACE = """
v AS (SELECT feature, value::DOUBLE AS value, count(*) AS n FROM u GROUP BY feature, value),
r AS (SELECT feature, value, lag(value) OVER o AS before, sum(n) OVER o AS cum FROM v WINDOW o AS (PARTITION BY feature ORDER BY value)),
p AS (SELECT feature, min(cum) + (max(cum) - min(cum)) * j / 6.0::DOUBLE AS place FROM r, range(1, 6) AS x(j) GROUP BY feature, j)
SELECT DISTINCT feature, (SELECT arg_min((before + value) / 2, cum) FROM r WHERE r.feature = p.feature AND r.cum >= p.place) AS threshold FROM p"""


@query(sql(_LINSPACE))
def splits_linspace(spark, sf_dir):
    return splits.linspace_thresholds(_weights(spark, sf_dir), 5)


@query(sql("""a AS (SELECT feature, threshold FROM t UNION SELECT feature, center::DOUBLE FROM cl)
SELECT feature, (row_number() OVER (PARTITION BY feature ORDER BY threshold) - 1)::INT AS bin, threshold FROM a"""))
def splits_union_dedup(spark, sf_dir):
    own = splits.center_values(spark, CENTERS).select("feature", F.col("value").alias("threshold"))
    return splits.union_dedup(splits.split_table(spark, SPLITS), own)


@query()
def splits_quartile(spark, sf_dir):
    found = splits.quartiles(f4(spark, sf_dir).select(*[F.col("features")[i].alias(f"f{i}") for i in range(4)]), ["f0", "f1", "f2", "f3"])
    return splits.split_table(spark, found)


@query("WITH " + _STRIDE.format(base=BASE.strip()).replace("SELECT feature, threshold FROM r WHERE threshold IS NOT NULL", """, every AS (SELECT feature, threshold FROM r WHERE threshold IS NOT NULL UNION SELECT feature, center::DOUBLE FROM cl)
SELECT feature, (row_number() OVER (PARTITION BY feature ORDER BY threshold) - 1)::INT AS bin, threshold FROM every"""))
def find_splits_full(spark, sf_dir):
    return splits.split_table(spark, splits.find_splits(labelled(spark, sf_dir), CENTERS, 5, sampled=False))


@query()
def find_splits_sampled(spark, sf_dir):
    return splits.split_table(spark, splits.find_splits(labelled(spark, sf_dir), CENTERS, key=KEY))


# ---- bins and their statistics

_BINS = ", ".join(f"len(list_filter({l}, lambda x: x < f{f}))::INT" for f, l in _T.items())


@query(sql(f"SELECT l_orderkey, l_linenumber, y AS cluster_id, [{_BINS}] AS bins FROM lab"))
def bin_assign_instances(spark, sf_dir):
    return binned(spark, sf_dir).select(*KEY, "cluster_id", "bins")


@query(sql("SELECT cluster_id, feature, center_bin FROM cb"))
def bin_assign_centers(spark, sf_dir):
    return binning.bin_centers(spark, CENTERS, SPLITS)


HIST = "h AS (SELECT 0::BIGINT AS node_id, feature, y AS cluster_id, bin, count(*)::DOUBLE AS w, count(*) AS n FROM b GROUP BY ALL)"


@query(sql(f"{HIST} SELECT * FROM h"))
def bin_histogram(spark, sf_dir):
    return histogram(spark, sf_dir)


@query(sql(f"{HIST} SELECT 0::BIGINT AS node_id, feature, min(center_bin) AS min_bin, max(center_bin) AS max_bin FROM (SELECT DISTINCT cluster_id, feature FROM h) JOIN cb USING (cluster_id, feature) GROUP BY feature"))
def center_bin_ranges(spark, sf_dir):
    return stats.center_bin_ranges(histogram(spark, sf_dir), binning.bin_centers(spark, CENTERS, SPLITS))


EST = HIST + ", e AS (SELECT 0::BIGINT AS node_id, feature, cluster_id, floor(sum(bin * w) / sum(w) + 0.5)::INT AS center_bin FROM h GROUP BY feature, cluster_id)"


@query(sql(f"{EST} SELECT * FROM e"))
def estimated_center_bins(spark, sf_dir):
    return stats.estimated_center_bins(histogram(spark, sf_dir))


_RANGE = "r AS (SELECT feature, min(center_bin) AS lo, max(center_bin) AS hi FROM cb GROUP BY feature)"
MIST = f"""{HIST}, {_RANGE},
m AS (SELECT 0::BIGINT AS node_id, h.feature, s.s::INT AS bin, sum(CASE WHEN (h.bin <= s.s) <> (center_bin <= s.s) THEN n ELSE 0 END)::BIGINT AS mistakes
      FROM h JOIN cb USING (cluster_id, feature) JOIN r ON r.feature = h.feature, unnest(range(lo, hi)) AS s(s) GROUP BY h.feature, s.s)"""


def _binned_mistakes(spark, sf_dir, **options):
    return cuts.mistakes_binned(histogram(spark, sf_dir), binning.bin_centers(spark, CENTERS, SPLITS), **options)


@query(sql(f"{MIST} SELECT * FROM m"))
def mistakes_per_cut_binned(spark, sf_dir):
    return _binned_mistakes(spark, sf_dir)


@query(sql(f"""{EST}, {_RANGE}
SELECT 0::BIGINT AS node_id, h.feature, s.s::INT AS bin, sum(CASE WHEN (h.bin <= s.s) <> (center_bin <= s.s) THEN n ELSE 0 END)::BIGINT AS mistakes
FROM h JOIN e USING (cluster_id, feature) JOIN r ON r.feature = h.feature, unnest(range(lo + 1, hi)) AS s(s) GROUP BY h.feature, s.s"""))
def mistakes_per_cut_compat(spark, sf_dir):
    return _binned_mistakes(spark, sf_dir, cut_range="reference", center_bins="estimated")


@query(sql(f"{MIST} SELECT node_id, feature, arg_min(bin, (mistakes, bin)) AS bin, min(mistakes) AS mistakes FROM m GROUP BY node_id, feature"))
def best_cut_per_feature(spark, sf_dir):
    return cuts.best_cut_per_feature(_binned_mistakes(spark, sf_dir))


@query(sql(f"{MIST} SELECT node_id, feature, bin, mistakes FROM m ORDER BY mistakes, feature, bin LIMIT 1"))
def best_cut_per_node(spark, sf_dir):
    return cuts.best_cut_per_node(_binned_mistakes(spark, sf_dir))


EXACT = """
rg AS (SELECT feature, min(center) AS lo, max(center) AS hi FROM cl GROUP BY feature),
vc AS (SELECT feature, value, y, count(*) AS n FROM u GROUP BY ALL),
cand AS (SELECT DISTINCT feature, s FROM (SELECT feature, value AS s FROM vc UNION SELECT feature, center FROM cl) JOIN rg USING (feature) WHERE s >= lo AND s < hi),
x AS (SELECT 0::BIGINT AS node_id, cand.feature, s::DOUBLE AS threshold, sum(CASE WHEN (value <= s) <> (center <= s) THEN n ELSE 0 END)::BIGINT AS mistakes
      FROM cand JOIN vc USING (feature) JOIN cl ON cl.cluster_id = vc.y AND cl.feature = vc.feature GROUP BY cand.feature, s)"""


def _exact(spark, sf_dir, **options):
    rows = labelled(spark, sf_dir).select(F.lit(0).cast("long").alias("node_id"), "features", "cluster_id", "weight")
    return cuts.mistakes_exact(rows, CENTERS, {0: [0, 1, 2, 3]}, **options)


@query(sql(f"{EXACT} SELECT * FROM x"))
def mistakes_per_cut_exact(spark, sf_dir):
    return _exact(spark, sf_dir)


@query(sql(f"{EXACT} SELECT node_id, feature, threshold, mistakes FROM x ORDER BY mistakes, feature, threshold LIMIT 1"))
def root_best_cut(spark, sf_dir):
    return cuts.best_cut_per_node(_exact(spark, sf_dir), "threshold")


@query(sql("""rg AS (SELECT feature, min(center) AS lo, max(center) AS hi FROM cl GROUP BY feature),
cand AS (SELECT DISTINCT feature, s FROM (SELECT feature, threshold AS s FROM t UNION SELECT feature, center::DOUBLE FROM cl) JOIN rg USING (feature) WHERE s >= lo AND s < hi)
SELECT 0::BIGINT AS node_id, cand.feature, s AS threshold, sum(CASE WHEN (value <= s) <> (center <= s) THEN 1 ELSE 0 END)::BIGINT AS mistakes
FROM cand JOIN u USING (feature) JOIN cl ON cl.cluster_id = u.y AND cl.feature = u.feature GROUP BY cand.feature, s"""))
def mistakes_per_cut_histogram(spark, sf_dir):
    return _exact(spark, sf_dir, thresholds=splits.split_table(spark, SPLITS))


# ---- one level of the tree

LEVEL = f"""{MIST}, best AS (SELECT feature, bin AS cut FROM m ORDER BY mistakes, feature, bin LIMIT 1),
side AS (SELECT b.l_orderkey, b.l_linenumber, b.y AS cluster_id, b.bin <= cut AS l, center_bin <= cut AS cl FROM b JOIN best USING (feature) JOIN cb ON cb.cluster_id = b.y AND cb.feature = b.feature),
lv AS (SELECT l_orderkey, l_linenumber, cluster_id, CASE WHEN l THEN 1 ELSE 2 END::BIGINT AS node_id, l = cl AS is_valid FROM side)"""


def level1(spark, sf_dir) -> DataFrame:
    best = cuts.best_cut_per_node(_binned_mistakes(spark, sf_dir)).first()
    tree, own = Tree([Node(0)]), binning.center_bins(CENTERS, SPLITS)
    tree.split(0, best["feature"], None, best["bin"])
    at = tree.route_strict(lambda n: F.col("bins")[n.feature] <= n.bin, lambda n: [i for i, b in enumerate(own) if b[n.feature] <= n.bin])
    return binned(spark, sf_dir).select(*KEY, "cluster_id", at.alias("at")).select(*KEY, "cluster_id", "at.*")


@query(sql(f"{LEVEL} SELECT * FROM lv"))
def reassign_level1(spark, sf_dir):
    return level1(spark, sf_dir)


@query(sql(f"{LEVEL} SELECT node_id, count(*) AS samples, count_if(NOT is_valid) AS mistakes FROM lv GROUP BY node_id"))
def node_stats_level1(spark, sf_dir):
    return stats.node_stats(level1(spark, sf_dir))


@query(sql(f"{LEVEL} SELECT node_id, list_sort(list(DISTINCT cluster_id)) AS cluster_ids FROM lv WHERE is_valid GROUP BY node_id"))
def node_clusters_level1(spark, sf_dir):
    return stats.node_clusters(level1(spark, sf_dir))


@query(sql(f"{LEVEL} SELECT max(node_id) AS max_node_id FROM lv"))
def max_node_id(spark, sf_dir):
    return level1(spark, sf_dir).agg(F.max("node_id").alias("max_node_id"))


@query(sql("""SELECT CASE WHEN f1 <= 52.5 THEN 'left' ELSE 'right' END AS side, count(*) AS n, count_if((f1 <= 52.5) <> (c1 <= 52.5)) AS mistakes,
CASE WHEN f1 <= 52.5 THEN [0, 1] ELSE [2, 3] END AS centers FROM lab JOIN c ON c.cluster_id = y GROUP BY ALL"""))
def count_mistakes_split(spark, sf_dir):
    return cuts.count_mistakes(labelled(spark, sf_dir), CENTERS, 1, 52.5)


@query(sql("n AS (SELECT y AS label, count(*) AS n FROM lab GROUP BY y) SELECT label, n FROM n ORDER BY n DESC, label LIMIT 1"))
def majority_label(spark, sf_dir):
    return cuts.majority_label(labelled(spark, sf_dir))


@query(sql("SELECT count_if((f1 <= 52.5 AND y <> 0) OR (f1 > 52.5 AND y <> 1)) AS mistakes FROM lab"))
def two_class_mistakes(spark, sf_dir):
    return cuts.two_class_mistakes(labelled(spark, sf_dir), 1, 52.5)


# ---- trees

def levelwise_sql(estimated: bool, low: int, levels: int = 3) -> str:
    """Binned growth, one group of CTEs a level; rows that part from their center keep the node where they did."""
    parts = ["b0 AS (SELECT row_number() OVER () AS r, * FROM lab)",
             "bn AS (SELECT r, y, unnest([0, 1, 2, 3]) AS feature, unnest([" + ", ".join(f"len(list_filter({l}, lambda x: x < f{f}))" for f, l in _T.items()) + "]) AS bin FROM b0)",
             "s0 AS (SELECT r, y, 0 AS node, true AS ok FROM b0)"]
    for k in range(levels):
        own = "floor(sum(bin * n) / sum(n) + 0.5)" if estimated else "any_value(center_bin)"
        parts += [
            f"h{k} AS (SELECT node, feature, y, bin, count(*) AS n FROM s{k} JOIN bn USING (r, y) WHERE ok GROUP BY ALL)",
            f"g{k} AS (SELECT node, h.feature, min(center_bin) + {low} AS lo, max(center_bin) AS hi FROM h{k} AS h JOIN cb ON cb.cluster_id = h.y AND cb.feature = h.feature GROUP BY ALL)",
            f"e{k} AS (SELECT node, h.feature, y, {own} AS c FROM h{k} AS h JOIN cb ON cb.cluster_id = h.y AND cb.feature = h.feature GROUP BY ALL)",
            f"m{k} AS (SELECT node, feature, s.s AS cut, sum(CASE WHEN (bin <= s.s) <> (c <= s.s) THEN n ELSE 0 END) AS m FROM h{k} JOIN e{k} USING (node, feature, y) JOIN g{k} USING (node, feature), unnest(range(lo, hi)) AS s(s) GROUP BY ALL)",
            f"c{k} AS (SELECT node, feature, cut, m FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY m, feature, cut) AS i FROM m{k}) WHERE i = 1)",
            f"""s{k + 1} AS (SELECT s.r, s.y, CASE WHEN NOT ok OR c.node IS NULL THEN s.node WHEN bin <= cut THEN 2 * s.node + 1 ELSE 2 * s.node + 2 END AS node, ok AND (c.node IS NULL OR (bin <= cut) = (center_bin <= cut)) AS ok
              FROM s{k} AS s LEFT JOIN c{k} AS c ON s.ok AND c.node = s.node LEFT JOIN bn ON bn.r = s.r AND bn.feature = c.feature LEFT JOIN cb ON cb.cluster_id = s.y AND cb.feature = c.feature)""",
        ]
    moves = " UNION ".join(f"SELECT r, node, ok FROM s{k}" for k in range(levels + 1))
    cuts_made = " UNION ".join(f"SELECT node, feature, cut, m FROM c{k}" for k in range(levels))
    parts += [f"moves AS ({moves})", f"made AS ({cuts_made})", "counts AS (SELECT node, count(DISTINCT r) AS samples, count_if(NOT ok) AS mistakes FROM moves GROUP BY node)"]
    return sql(", ".join(parts) + " SELECT node::BIGINT AS node_id, feature::INT AS feature, cut::INT AS bin, m::BIGINT AS scored_mistakes, samples, mistakes FROM counts LEFT JOIN made USING (node)")


def recursive_sql(exact: bool, levels: int = 3) -> str:
    """Growth on raw thresholds; exact tries every value and takes mistaken rows out, else the literal thresholds."""
    tries = "SELECT DISTINCT node, feature, value AS s FROM vc{k} UNION " if exact else "SELECT DISTINCT node, t.feature, threshold AS s FROM vc{k} JOIN t ON t.feature = vc{k}.feature UNION "
    parts = ["b0 AS (SELECT row_number() OVER () AS r, * FROM lab)", "ur AS (SELECT r, y, unnest([0, 1, 2, 3]) AS feature, unnest([f0, f1, f2, f3])::DOUBLE AS value FROM b0)",
             "s0 AS (SELECT r, y, 0 AS node FROM b0)", "v0 AS (SELECT 0 AS node, cluster_id FROM c)"]
    for k in range(levels):
        drop = f"WHERE (value <= s) = (center <= s)" if exact else ""
        parts += [
            f"a{k} AS (SELECT node FROM s{k} GROUP BY node HAVING count(DISTINCT y) > 1 INTERSECT SELECT node FROM v{k} GROUP BY node HAVING count(*) > 1)",
            f"vc{k} AS (SELECT node, feature, y, value, count(*) AS n FROM s{k} JOIN a{k} USING (node) JOIN ur USING (r, y) GROUP BY ALL)",
            f"o{k} AS (SELECT node, feature, center::DOUBLE AS s FROM v{k} JOIN cl USING (cluster_id))",
            f"g{k} AS (SELECT node, feature, min(s) AS lo, max(s) AS hi FROM o{k} GROUP BY ALL)",
            f"top{k} AS (SELECT node, feature, max(value) AS top FROM vc{k} GROUP BY ALL)",
            f"t{k} AS (SELECT node, feature, s FROM ({tries.format(k=k)} SELECT node, feature, s FROM o{k} JOIN a{k} USING (node)) JOIN g{k} USING (node, feature) JOIN top{k} USING (node, feature) WHERE s >= lo AND s < hi" + (" AND s < top)" if exact else ")"),
            f"m{k} AS (SELECT node, vc.feature, s, sum(CASE WHEN (value <= s) <> (center <= s) THEN n ELSE 0 END) AS m FROM t{k} AS x JOIN vc{k} AS vc USING (node, feature) JOIN cl ON cl.cluster_id = vc.y AND cl.feature = vc.feature GROUP BY ALL)",
            f"c{k} AS (SELECT node, feature, s, m FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY m, feature, s) AS i FROM m{k}) WHERE i = 1)",
            f"s{k + 1} AS (SELECT r, s{k}.y, CASE WHEN value <= s THEN 2 * node + 1 ELSE 2 * node + 2 END AS node FROM s{k} JOIN c{k} USING (node) JOIN ur ON ur.r = s{k}.r AND ur.feature = c{k}.feature JOIN cl ON cl.cluster_id = s{k}.y AND cl.feature = c{k}.feature {drop})".replace("SELECT r,", f"SELECT s{k}.r,"),
            f"v{k + 1} AS (SELECT CASE WHEN center <= s THEN 2 * node + 1 ELSE 2 * node + 2 END AS node, cluster_id FROM v{k} JOIN c{k} USING (node) JOIN cl USING (cluster_id, feature))",
        ]
    made = " UNION ALL ".join(f"SELECT node, feature, s, m FROM c{k}" for k in range(levels))
    standing = " UNION ALL ".join(f"SELECT node, y FROM s{k}" for k in range(levels + 1))
    valid = " UNION ALL ".join(f"SELECT node, cluster_id FROM v{k}" for k in range(levels + 1))
    parts += [f"made AS ({made})", f"standing AS ({standing})", f"valid AS ({valid})", "one AS (SELECT node, count(*) AS n, min(cluster_id) AS lowest FROM valid GROUP BY node)",
              "lb AS (SELECT node, count(DISTINCT y) AS k, min(y) AS sole FROM standing GROUP BY node)"]
    return sql(", ".join(parts) + """ SELECT one.node::BIGINT AS node_id, feature::INT AS feature, s AS threshold, m::BIGINT AS scored_mistakes,
      CASE WHEN made.node IS NOT NULL THEN NULL WHEN lb.node IS NULL THEN 0 WHEN n = 1 THEN lowest WHEN k = 1 THEN sole ELSE lowest END::INT AS leaf_cluster
      FROM one LEFT JOIN made USING (node) LEFT JOIN lb USING (node)""")


BINNED_COLUMNS = ["node_id", "feature", "bin", "scored_mistakes", "samples", "mistakes"]
RAW_COLUMNS = ["node_id", "feature", "threshold", "scored_mistakes", "leaf_cluster"]


@query(levelwise_sql(False, 0))
def grow_tree_levelwise(spark, sf_dir):
    return grow_levelwise(labelled(spark, sf_dir), CENTERS, SPLITS).table(spark).select(*BINNED_COLUMNS)


@query(levelwise_sql(True, 1))
def grow_tree_levelwise_compat(spark, sf_dir):
    return grow_levelwise(labelled(spark, sf_dir), CENTERS, SPLITS, "reference", "estimated").table(spark).select(*BINNED_COLUMNS)


@query(recursive_sql(False))
def grow_tree_recursive(spark, sf_dir):
    return grow_recursive(labelled(spark, sf_dir), CENTERS, splits.split_table(spark, SPLITS)).table(spark).select(*RAW_COLUMNS)


@query(recursive_sql(True))
def grow_tree_exact(spark, sf_dir):
    return grow_recursive(labelled(spark, sf_dir), CENTERS, drop_mistakes=True).table(spark).select(*RAW_COLUMNS)


@query()
def grow_tree_quartile(spark, sf_dir):
    two = labelled(spark, sf_dir).withColumn("cluster_id", (F.col("cluster_id") % 2).cast("int"))
    return grow_quartile(two, max_depth=4).table(spark)


@query()
def fit_explainable_kmeans(spark, sf_dir):
    return ExplainableKMeans(4).fit(f4(spark, sf_dir)).tree.table(spark)


TREE = """RECURSIVE {base},
leafed AS (SELECT *, CASE WHEN f1 <= 52.5 THEN CASE WHEN f0 <= 17.5 THEN 3 ELSE 4 END ELSE CASE WHEN f2 <= 6 THEN 5 ELSE 6 END END AS leaf FROM lab),
named AS (SELECT *, leaf - 3 AS pred FROM leafed),
node(node_id, depth, test, cluster) AS (VALUES (0, 0, '(f1 <= 52.500)', NULL), (1, 1, '(f0 <= 17.500)', NULL), (2, 1, '(f2 <= 6.000)', NULL), (3, 2, NULL, 0), (4, 2, NULL, 1), (5, 2, NULL, 2), (6, 2, NULL, 3)),
up(leaf, node_id) AS (SELECT node_id, node_id FROM node WHERE cluster IS NOT NULL UNION ALL SELECT leaf, (node_id - 1) // 2 FROM up WHERE node_id > 0),
per AS (SELECT leaf, count(*) AS samples, count_if(y <> pred) AS mistakes FROM named GROUP BY leaf),
filled AS (SELECT node_id, sum(samples)::BIGINT AS samples, sum(mistakes)::BIGINT AS mistakes FROM up JOIN per USING (leaf) GROUP BY node_id)
"""


def tree_sql(body: str) -> str:
    return "WITH " + TREE.format(base=BASE.strip()) + body


@query(tree_sql("SELECT l_orderkey, l_linenumber, pred AS prediction FROM named"))
def predict_fixed_tree(spark, sf_dir):
    return f4(spark, sf_dir).select(*KEY, fixed_tree().label().alias("prediction"))


@query(tree_sql("SELECT node_id::BIGINT AS node_id, samples, mistakes FROM filled"))
def fill_stats_fixed_tree(spark, sf_dir):
    return fixed_tree().fill_stats(labelled(spark, sf_dir)).table(spark).select("node_id", "samples", "mistakes")


@query(tree_sql("""SELECT 'Node ' || node_id || ': ' || CASE WHEN cluster IS NULL THEN 'Node ' || node_id ELSE 'Leaf' END || ' | depth=' || depth || ' | split=' || coalesce(test, 'No split') ||
' | clusters=[' || coalesce(cluster::VARCHAR, '') || '] | samples=' || samples || ' | mistakes=' || mistakes AS line FROM node JOIN filled USING (node_id)"""))
def tree_print(spark, sf_dir):
    return spark.createDataFrame([(s,) for s in fixed_tree().fill_stats(labelled(spark, sf_dir)).lines()], "line string")


@query(tree_sql("SELECT count(*) AS size, max(depth)::INT AS depth, count(cluster) AS leaves FROM node"))
def tree_size_depth(spark, sf_dir):
    table = fixed_tree().table(spark)
    return table.agg(F.count("*").alias("size"), F.max("depth").alias("depth"), F.count_if(F.col("feature").isNull()).alias("leaves"))


@query(tree_sql("SELECT substr(test, 3, 1)::INT AS feature, count(*) AS splits FROM node WHERE test IS NOT NULL GROUP BY ALL"))
def feature_importance(spark, sf_dir):
    return fixed_tree().table(spark).where("feature IS NOT NULL").groupBy("feature").agg(F.count("*").alias("splits"))


@query(tree_sql("""x AS (SELECT 'n_' || node_id || ' [label="' || coalesce(replace(replace(replace(test, '(f', ''), ')', ''), '<=', '<='), cluster::VARCHAR) || '\\nsamples=' || samples || CASE WHEN cluster IS NULL THEN '' ELSE '\\nmistakes=' || mistakes END || '"];' AS line FROM node JOIN filled USING (node_id)
UNION ALL SELECT 'n_' || (node_id - 1) // 2 || ' -> n_' || node_id || ';' FROM node WHERE node_id > 0 UNION ALL SELECT 'digraph ClusteringTree {' UNION ALL SELECT '}') SELECT line FROM x""").replace("\nx AS", ", x AS"))
def tree_to_dot(spark, sf_dir):
    return spark.createDataFrame([(s,) for s in fixed_tree().fill_stats(labelled(spark, sf_dir)).to_dot().split("\n")], "line string")


@query("SELECT 7::BIGINT AS nodes, true AS same")
def tree_round_trip(spark, sf_dir):
    """The tree through its JSON text and its table."""
    tree = fixed_tree().fill_stats(labelled(spark, sf_dir))
    again = Tree.from_json(tree.to_json())
    same = Tree.from_table(tree.table(spark)).lines() == tree.lines() and again.to_json() == tree.to_json()
    return spark.createDataFrame([(again.size, same)], "nodes long, same boolean")


# ---- costs

def predicted(spark, sf_dir) -> DataFrame:
    return f4(spark, sf_dir).withColumn("prediction", fixed_tree().label())


_COST = """mean AS (SELECT pred, avg(f0) AS m0, avg(f1) AS m1, avg(f2) AS m2, avg(f3) AS m3 FROM named GROUP BY pred),
cost AS (SELECT pred AS prediction, count(*) AS n, sum((f0-m0)**2 + (f1-m1)**2 + (f2-m2)**2 + (f3-m3)**2) AS cost FROM named JOIN mean USING (pred) GROUP BY pred)
"""
_SURROGATE = "SELECT round(sum((f0-c0)**2 + (f1-c1)**2 + (f2-c2)**2 + (f3-c3)**2), 3) AS score FROM named JOIN c ON c.cluster_id = pred"


@query(tree_sql(", " + _COST + "SELECT prediction, n, round(cost, 3) AS cost FROM cost"))
def cost_per_cluster(spark, sf_dir):
    return score.cost_per_cluster(predicted(spark, sf_dir), 4).select("prediction", "n", F.round("cost", 3).alias("cost"))


@query(tree_sql(", " + _COST + "SELECT round(sum(cost), 3) AS score FROM cost"))
def score_cost(spark, sf_dir):
    return score.score(predicted(spark, sf_dir), 4).select(F.round("score", 3).alias("score"))


@query(tree_sql(_SURROGATE))
def surrogate_score(spark, sf_dir):
    return score.surrogate_score(predicted(spark, sf_dir), CENTERS).select(F.round("score", 3).alias("score"))


@query(tree_sql(", " + _COST + "SELECT round(sum(cost), 3) AS score FROM cost"))
def score_sql_form(spark, sf_dir):
    return score.score_sql(predicted(spark, sf_dir), 4).select(F.round("score", 3).alias("score"))


@query(tree_sql(_SURROGATE))
def surrogate_score_sql_form(spark, sf_dir):
    return score.surrogate_score_sql(predicted(spark, sf_dir), CENTERS).select(F.round("score", 3).alias("score"))


_DOTS = ", ".join("+".join(f"f{j}*{v}" for j, v in enumerate(c)) for c in CENTERS)
_NORM = [sum(v * v for v in c) for c in CENTERS]
_PRE = ", ".join(f"n * {q} - 2 * s{j}" for j, q in enumerate(_NORM))
DOTS = f", dots AS (SELECT leaf, f0, f1, f2, f3, [{_DOTS}] AS d FROM leafed)"


def leaf_rows(spark, sf_dir) -> DataFrame:
    return f4(spark, sf_dir).select(fixed_tree().leaf().alias("leaf_id"), "features")


@query(tree_sql(DOTS + f", s AS (SELECT leaf, count(*) AS n, sum(d[1]) AS s0, sum(d[2]) AS s1, sum(d[3]) AS s2, sum(d[4]) AS s3 FROM dots GROUP BY leaf) SELECT leaf::BIGINT AS leaf_id, n, least({_PRE})::DOUBLE AS pre_cost FROM s"))
def leaf_pre_split_cost(spark, sf_dir):
    return expansion.pre_split_cost(leaf_rows(spark, sf_dir), CENTERS)


_SIDE = ", ".join(f"n{{0}} * {q} - 2 * s{{0}}{j}" for j, q in enumerate(_NORM))
SUR = DOTS + f""", du AS (SELECT leaf, unnest([0, 1, 2, 3]) AS feature, unnest([f0, f1, f2, f3]) AS v, d FROM dots),
dv AS (SELECT leaf, feature, v, count(*) AS n, sum(d[1]) AS s0, sum(d[2]) AS s1, sum(d[3]) AS s2, sum(d[4]) AS s3 FROM du GROUP BY ALL),
run AS (SELECT leaf, feature, v, max(v) OVER g AS top, sum(n) OVER o AS nl, sum(n) OVER g - sum(n) OVER o AS nr,
  {', '.join(f'sum(s{j}) OVER o AS sl{j}, sum(s{j}) OVER g - sum(s{j}) OVER o AS sr{j}' for j in range(4))}
  FROM dv WINDOW o AS (PARTITION BY leaf, feature ORDER BY v), g AS (PARTITION BY leaf, feature)),
sur AS (SELECT leaf::BIGINT AS leaf_id, feature, v::DOUBLE AS threshold, [{_SIDE.format('l')}] AS a, [{_SIDE.format('r')}] AS z FROM run WHERE v < top),
costed AS (SELECT leaf_id, feature, threshold, (list_min(a) + list_min(z))::DOUBLE AS cost, (list_position(a, list_min(a)) - 1)::INT AS center_left, (list_position(z, list_min(z)) - 1)::INT AS center_right FROM sur)
"""


@query(tree_sql(SUR + "SELECT * FROM costed"))
def surrogate_cut(spark, sf_dir):
    return expansion.surrogate_cuts(leaf_rows(spark, sf_dir), CENTERS)


@query(tree_sql(SUR + "SELECT leaf_id, cost, feature, threshold, center_left, center_right FROM (SELECT *, row_number() OVER (PARTITION BY leaf_id ORDER BY cost, feature, threshold) AS k FROM costed) WHERE k = 1"))
def best_surrogate_cut(spark, sf_dir):
    return expansion.best_surrogate_cut(leaf_rows(spark, sf_dir), CENTERS)


@query(tree_sql(SUR + f""", pre AS (SELECT leaf::BIGINT AS leaf_id, least({_PRE})::DOUBLE AS pre FROM (SELECT leaf, count(*) AS n, sum(d[1]) AS s0, sum(d[2]) AS s1, sum(d[3]) AS s2, sum(d[4]) AS s3 FROM dots GROUP BY leaf)),
one AS (SELECT leaf_id, feature, threshold, center_left, center_right FROM costed JOIN pre USING (leaf_id) JOIN per ON per.leaf = leaf_id WHERE mistakes > 0 ORDER BY cost - pre, leaf_id, cost, feature, threshold LIMIT 1),
placed AS (SELECT y, CASE WHEN leaf <> leaf_id THEN leaf WHEN [f0, f1, f2, f3][feature + 1] <= threshold THEN 2 * leaf + 1 ELSE 2 * leaf + 2 END AS leaf,
  CASE WHEN leaf <> leaf_id THEN leaf - 3 WHEN [f0, f1, f2, f3][feature + 1] <= threshold THEN center_left ELSE center_right END AS name FROM leafed, one)
SELECT leaf::BIGINT AS node_id, name::INT AS leaf_cluster, count(*) AS samples, count_if(y <> name) AS mistakes FROM placed GROUP BY ALL"""))
def expand_tree_one_step(spark, sf_dir):
    tree = expansion.expand(fixed_tree(), labelled(spark, sf_dir), CENTERS, 5)
    return tree.table(spark).where("feature IS NULL").select("node_id", "leaf_cluster", "samples", "mistakes")


@query()
def expand_tree_full(spark, sf_dir):
    return expansion.expand(fixed_tree(), labelled(spark, sf_dir), CENTERS, 8).table(spark)
