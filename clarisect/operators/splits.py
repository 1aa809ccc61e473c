"""Split candidates: value weights per feature and the thresholds drawn from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def sample_fraction(max_bins: int, rows: int) -> float:
    """The share of rows that split finding needs."""
    need = max(max_bins * max_bins, 10_000)
    return need / rows if need < rows else 1.0


def bernoulli_sample(df: DataFrame, fraction: float, seed: int, key: Sequence[str] = ()) -> DataFrame:
    """A sample by chance, or by the hash of a key, which any cluster draws alike."""
    if fraction >= 1:
        return df
    if not key:
        return df.sample(False, fraction, seed)
    return df.where(F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) < F.lit(int(fraction * 2**53)))


def unpivot(df: DataFrame, keep: Sequence[str] = (), drop_zero: bool = False) -> DataFrame:
    """A row per feature: ``feature, value`` beside the kept columns."""
    long = df.select(*keep, F.posexplode("features").alias("feature", "value"))
    return long.where("value <> 0") if drop_zero else long


def value_weights(df: DataFrame, drop_zero: bool = True) -> DataFrame:
    """``feature, value, weight, n``: partial sums first, so a frequent value is no burden."""
    return unpivot(df, ["weight"], drop_zero).groupBy("feature", "value").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def center_values(spark: SparkSession, centers: Sequence[Sequence[float]], keep_zero: bool = False) -> DataFrame:
    """Distinct center values as candidates: ``feature, value``."""
    rows = sorted({(f, float(v)) for c in centers for f, v in enumerate(c) if keep_zero or v != 0})
    return spark.createDataFrame(rows, "feature int, value double")


def complete_zeros(weights: DataFrame, weighted_rows: float, features: int, fraction: float = 1.0) -> DataFrame:
    """Gives the weight that the dropped zeros held back to value 0, unless it is within rounding.

    With ``fraction`` the total is that of the sample. Left at 1 on a sample, all unsampled weight lands on 0.
    """
    expected = weighted_rows * fraction
    spark = weights.sparkSession
    sums = weights.groupBy("feature").agg(F.sum("weight").alias("held"), F.sum("n").alias("rows"))
    missing = (
        spark.range(features).select(F.col("id").cast("int").alias("feature")).join(sums, "feature")
        .where(F.abs(F.lit(float(expected)) - F.col("held")) > 1e-4 * F.col("rows"))
        .select("feature", F.lit(0.0).alias("value"), (F.lit(float(expected)) - F.col("held")).alias("weight"), F.lit(0).cast("long").alias("n"))
    )
    return weights.unionByName(missing)


def midpoints(weights: DataFrame) -> DataFrame:
    """Middles of neighbouring values: ``feature, threshold``."""
    order = Window.partitionBy("feature").orderBy("value")
    return weights.select("feature", ((F.lag("value").over(order) + F.col("value")) / 2).alias("threshold")).where("threshold is not null")


def stride_thresholds(weights: DataFrame, splits: int, weighted_rows: float) -> DataFrame:
    """Thresholds near equal strides of the cumulative weight, at most one between two neighbouring values.

    A threshold's target is the next stride after the last threshold given, so the choice is sequential: one
    fold over a feature's sorted distinct values, which come from a sample of bounded size.
    """
    stride = float(weighted_rows) / (splits + 1)
    points = F.array_sort(F.collect_list(F.struct("value", "weight")))
    start = F.struct(
        F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("sum"), F.lit(stride).alias("target"),
        F.array().cast("array<double>").alias("out"),
    )

    def step(s, p):
        now = s["sum"] + p["weight"]
        cut = s["last"].isNotNull() & (F.abs(s["sum"] - s["target"]) < F.abs(now - s["target"]))
        return F.struct(
            p["value"].alias("last"), now.alias("sum"), F.when(cut, s["target"] + stride).otherwise(s["target"]).alias("target"),
            F.when(cut, F.concat(s["out"], F.array((s["last"] + p["value"]) / 2))).otherwise(s["out"]).alias("out"),
        )

    return weights.groupBy("feature").agg(F.aggregate(points, start, step)["out"].alias("t")).select("feature", F.explode("t").alias("threshold"))


def data_thresholds(weights: DataFrame, splits: int, weighted_rows: float) -> DataFrame:
    """Midpoints where a feature has few values, strides where it has many."""
    sizes = weights.groupBy("feature").agg(F.count("*").alias("values"))
    few = weights.join(sizes.where(F.col("values") - 1 <= splits).select("feature"), "feature", "left_semi")
    many = weights.join(sizes.where(F.col("values") - 1 > splits).select("feature"), "feature", "left_semi")
    return midpoints(few).unionByName(stride_thresholds(many, splits, weighted_rows))


def linspace_thresholds(weights: DataFrame, splits: int) -> DataFrame:
    """Midpoints at equally spaced inner positions of the cumulative count between its first and last value."""
    order = Window.partitionBy("feature").orderBy("value")
    all_rows = Window.partitionBy("feature")
    run = weights.select(
        "feature", "value", F.lead("value").over(order).alias("next"), F.lag("value").over(order).alias("before"),
        F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.count("*").over(all_rows).alias("values"),
    )
    few = run.where((F.col("values") - 1 <= splits) & F.col("next").isNotNull()).select("feature", ((F.col("value") + F.col("next")) / 2).alias("threshold"))
    spaced = run.where(F.col("values") - 1 > splits).groupBy("feature").agg(F.min("cum").alias("a"), F.max("cum").alias("b")).select(
        "feature", F.explode(F.transform(F.sequence(F.lit(1), F.lit(splits)), lambda j: F.col("a") + (F.col("b") - F.col("a")) * j / (splits + 1))).alias("place"))
    steps = run.select("feature", "value", "before", "cum", F.coalesce(F.lag("cum").over(order), F.lit(-1)).alias("low"))
    at = spaced.join(steps, "feature").where((F.col("place") > F.col("low")) & (F.col("place") <= F.col("cum")) & F.col("before").isNotNull())
    return few.unionByName(at.select("feature", ((F.col("before") + F.col("value")) / 2).alias("threshold"))).distinct()


def quartiles(df: DataFrame, columns: Sequence[str], error: float = 0.01) -> list[list[float]]:
    return df.approxQuantile(list(columns), [0.25, 0.5, 0.75], error)


def union_dedup(*tables: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """All thresholds of a feature in order, without those within the tolerance of the last one kept; with their bin."""
    every = tables[0].select("feature", "threshold")
    for t in tables[1:]:
        every = every.unionByName(t.select("feature", "threshold"))
    kept = F.aggregate(
        F.array_sort(F.collect_set("threshold")), F.array().cast("array<double>"),
        lambda a, t: F.when((F.size(a) == 0) | (F.abs(F.get(a, F.size(a) - 1) - t) > tolerance), F.concat(a, F.array(t))).otherwise(a),
    )
    return every.groupBy("feature").agg(kept.alias("t")).select("feature", F.posexplode("t").alias("bin", "threshold"))


def find_splits(df: DataFrame, centers: Sequence[Sequence[float]], splits: int = 10, max_bins: int = 32, seed: int = 42, sampled: bool = True, compat: bool = False, key: Sequence[str] = ()) -> list[list[float]]:
    """Thresholds of every feature from a sample of the data and from the centers; a small table for the driver.

    ``compat`` leaves the sample's weight unscaled (so the unsampled weight falls to value 0) and drops centers
    at 0; the default does neither.
    """
    rows, weight = df.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    features = len(centers[0])
    fraction = sample_fraction(max_bins, rows) if sampled else 1.0
    sums = value_weights(bernoulli_sample(df, fraction, seed, key))
    counted = float(weight) if compat else float(weight) * fraction
    if not compat and fraction < 1:  # what the sample holds, zeros included
        counted = float(bernoulli_sample(df, fraction, seed, key).agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0])
    sums = complete_zeros(sums, counted, features)
    drawn = data_thresholds(sums, splits, counted)
    own = center_values(df.sparkSession, centers, keep_zero=not compat).select("feature", F.col("value").alias("threshold"))
    out: list[list[float]] = [[] for _ in range(features)]
    for r in union_dedup(drawn, own).orderBy("feature", "bin").collect():
        out[r["feature"]].append(r["threshold"])
    return out


def split_table(spark: SparkSession, splits: Sequence[Sequence[float]]) -> DataFrame:
    return spark.createDataFrame([(f, b, float(t)) for f, ts in enumerate(splits) for b, t in enumerate(ts)], "feature int, bin int, threshold double")
