"""Sharding by sampled splitters: near-equal bytes, whole ranges, no single hot task."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import as_table, numbered
from ..sources.scratch import slim as slim_side
from .shared import Scratch, text_or_empty

LOWEST = -(2**63)
SHARDS = 16
#: Fine ranges aimed at per shard, and sampled keys per range: both bound what the driver sees.
RANGES_PER_SHARD = 64
SAMPLES_PER_RANGE = 16
#: Copies of one text stay together unless they hold more than this share of a shard.
GROUP_SHARE = 0.05
#: Bits of a key that tell repeated rows of one text and id apart; the others are the id's.
ROW_BITS = 24


def _range_udf(cut_h: np.ndarray, cut_d: np.ndarray, bytes_before: np.ndarray, rows_before: np.ndarray):
    """Range number of a key (h, d), what lies before that range, and whether equal texts span ranges."""

    @F.pandas_udf("range int, bytes_before long, rows_before long, spans boolean")
    def find(h: pd.Series, d: pd.Series) -> pd.DataFrame:
        hv, dv = h.to_numpy(np.int64), d.to_numpy(np.int64)
        lo, hi = np.searchsorted(cut_h, hv, "left"), np.searchsorted(cut_h, hv, "right")
        at, spans = hi.copy(), np.zeros(len(hv), bool)
        tied = np.flatnonzero(hi > lo)
        for low in np.unique(lo[tied]):
            rows = tied[lo[tied] == low]
            cuts = cut_d[low : hi[rows[0]]]
            at[rows] = low + np.searchsorted(cuts, dv[rows], "right")
            spans[rows] = bool((cuts > LOWEST).any())
        return pd.DataFrame({"range": at.astype(np.int32), "bytes_before": bytes_before[at], "rows_before": rows_before[at], "spans": spans})

    return find


def _quantiles(keys: list[tuple[int, int]], weights: list[float], pieces: int) -> list[tuple[int, int]]:
    """Boundaries that cut the weighted keys into about equal pieces."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    total, run, out = sum(weights), 0.0, []
    for i in order:
        if run >= total * (len(out) + 1) / pieces and (not out or keys[i] > out[-1]):
            out.append(keys[i])
            while len(out) < pieces - 1 and run >= total * (len(out) + 1) / pieces:
                out.append(keys[i])
        run += weights[i]
    return sorted(set(out))


def shard_by_splitters(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, ranges_per_shard: int = RANGES_PER_SHARD, group_share: float = GROUP_SHARE) -> DataFrame:
    """Deals records into ``shards`` of near-equal bytes along one sorted key space.

    The key is (hash of the text, hash of the id, then of the row), so equal texts are neighbours. A size-weighted key sample
    of bounded size gives quantile boundaries for fine ranges; ranges that turn out overfull are subdivided by
    a fresh sample of their own, within a group of equal texts by id. Exact range sums then place every record
    in the global order, and a record's middle byte decides its shard, so a shard misses its share by less than
    the documents or small groups at its two ends.

    Returns ``carry`` (the id by default) plus ``size, text_crc32, law, shard, slot, grown_shard, range``.
    Size is UTF-8 bytes plus 1, a null text counting as empty. Null ids are ordinary;
    repeated rows have keys of their own, so that any group can be cut. An empty table gives an empty result. A carried column whose
    name is one of the result's is replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = text_or_empty(text_col)
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "range")
    carry = [c for c in (carry or [id_col]) if c not in made]
    docs = as_table(docs, scratch)
    slim = scratch.put(numbered(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("h"),
    ), scratch).withColumn("d", F.xxhash64(F.lit("id"), "id").bitwiseAND(F.lit(-1 << ROW_BITS)).bitwiseOR(F.xxhash64("rid").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))), "keys")
    total, count = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    pieces = shards * ranges_per_shard
    expected = total / pieces

    def sample(rows: DataFrame, rate: float, salt: int) -> tuple[list, list]:
        """Keys drawn with chance size * rate, at most 1, and the weight that makes up for it."""
        chance = F.shiftrightunsigned(F.xxhash64(F.lit(salt), "h", "d"), 11) / F.lit(float(2**53))
        found = rows.where(chance < F.col("size") * F.lit(rate)).select("h", "d", "size").collect()
        return [(r.h, r.d) for r in found], [max(r.size, 1 / rate) for r in found]

    cuts: list[tuple[int, int]] = []
    if count:
        keys, weights = sample(slim, pieces * SAMPLES_PER_RANGE / total, 0)
        cuts = _quantiles([(h, LOWEST) for h, _ in keys], weights, pieces)
    tried: set[tuple] = set()
    salt = 0
    while True:
        salt += 1
        cut_h, cut_d = (np.array([c[k] for c in cuts], np.int64) for k in (0, 1))
        find = _range_udf(cut_h, cut_d, np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1, np.int64))
        sums = {r["range"]: (r["bytes"], r["n"]) for r in slim.groupBy(find("h", "d")["range"].alias("range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        edges = [(LOWEST, LOWEST), *cuts]
        full = [r for r, (size, n) in sums.items() if size > 4 * expected and n > 1 and (edges[r], (edges + [None])[r + 1]) not in tried]
        if not full:
            break
        fresh = set()
        for r in full:
            tried.add((edges[r], (edges + [None])[r + 1]))
        rate = 4 * SAMPLES_PER_RANGE / expected
        keys, weights = sample(slim.where(find("h", "d")["range"].isin(full)), rate, salt)
        by_range: dict[int, list[int]] = {}
        for i, key in enumerate(keys):
            by_range.setdefault(bisect_right(cuts, key), []).append(i)
        for r, rows in by_range.items():
            fresh |= set(_quantiles([keys[i] for i in rows], [weights[i] for i in rows], max(2, round(sums.get(r, (0, 0))[0] / expected))))
        cuts = sorted(set(cuts) | fresh)
    sizes = np.array([sums.get(r, (0, 0)) for r in range(len(cuts) + 1)], np.int64)
    before = np.cumsum(sizes, axis=0) - sizes
    place = _range_udf(cut_h, cut_d, np.ascontiguousarray(before[:, 0]), np.ascontiguousarray(before[:, 1]))

    in_range = Window.partitionBy("p.range").orderBy("h", "d", "rid")
    so_far = in_range.rowsBetween(Window.unboundedPreceding, 0)
    alike = Window.partitionBy("p.range", "h")
    ordered = (
        slim.withColumn("p", place("h", "d"))
        .withColumn("begin", F.col("p.bytes_before") + F.sum("size").over(so_far) - F.col("size"))
        .withColumn("at", F.col("p.rows_before") + F.row_number().over(in_range) - 1)
        .withColumn("group_begin", F.min("begin").over(alike))
        .withColumn("group_size", F.sum("size").over(alike))
    )
    whole = ~F.col("p.spans") & (F.col("group_size") <= group_share * total / shards)
    middle = F.when(whole, 2 * F.col("group_begin") + F.col("group_size")).otherwise(2 * F.col("begin") + F.col("size"))
    shard = F.least(F.lit(shards - 1), F.floor(middle / F.lit(2.0 * max(total, 1)) * shards)).cast("int")
    placed = scratch.put(ordered.select("rid", "id", "size", "crc", "at", F.col("p.range").alias("range"), shard.alias("shard")), "placed")
    starts = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("at").alias("first")).collect()}
    first = F.element_at(F.create_map(*[F.lit(x) for k, v in sorted(starts.items()) for x in (k, v)]), F.col("shard")) if starts else F.lit(0)
    if carry == [id_col]:
        out = placed.withColumn(f"c_{id_col}", F.col("id"))
    else:  # whole records are read again and meet their place once
        out = numbered(docs.select(*[F.col(c).alias(f"c_{c}") for c in carry]), scratch).join(slim_side(placed.drop("id")), "rid")
    return out.select(
        *[F.col(f"c_{c}").alias(c) for c in carry], "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("at") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "range",
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes whole records as Parquet, one folder per shard, a shard's ranges in several tasks."""
    dealt = shard_by_splitters(docs, carry=docs.columns, **options)
    dealt.repartition("shard", "range").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_by_splitters(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("range")
