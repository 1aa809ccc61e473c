"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import as_table, numbered, slim
from .shared import Scratch

#: Words in a block; the schedule gives one block per slot.
BLOCK_WORDS = 256
#: The weights dealt to the sources in turn, the share of all words that the mix takes, and how often a word may be used.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
REPEATS = 2
#: Documents in one sorted piece of a source's shuffled stream, and slots in one ranked piece of the schedule.
PIECE_DOCS = 2_000
PIECE_SLOTS = 1 << 16
#: Tables of sources up to this many rows are broadcast, larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def fill(sizes: list[int], weights: list[float], budget: float, repeats: float) -> list[float]:
    """Targets by weight; one that would pass ``repeats`` times its size stops there and the rest is shared again."""
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), budget
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > repeats * sizes[i]]
        if not over:
            for i in free:
                targets[i] = unit * weights[i]
            break
        for i in sorted(over):
            targets[i] = float(repeats * sizes[i])
            left -= targets[i]
            free.discard(i)
    return targets


def golden(i: Column) -> Column:
    """The i-th golden-ratio point in [0, 1), exact enough for i up to 2^40."""
    ratio, cut = 0.6180339887498949, 1 << 20
    return F.pmod(F.pmod((F.shiftright(i, 20)).cast("double") * (ratio * cut % 1.0), F.lit(1.0)) + (i % cut).cast("double") * ratio, F.lit(1.0))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def schedule(spark: SparkSession, targets: list[float], sizes: list[int], block_words: int, scratch: Scratch) -> DataFrame:
    """Slots of the mix in order: ``slot, src, rank``; the rank counts a source's slots from 0.

    Slot i goes to the source whose stretch of the cumulative targets holds golden-ratio point i. A source
    leaves the schedule once its target is met, and the few slots it may lack by then follow at the end.
    """
    quota = [int(t) // s * -(-s // block_words) + -(-(int(t) % s) // block_words) if s else 0 for t, s in zip(targets, sizes)]
    whole = sum(targets)
    n = -(-int(round(whole)) // block_words)
    edges, run = [], 0.0
    for t in targets[:-1]:
        run += t
        edges.append(run / whole if whole else 0.0)
    i = F.col("id")
    source = F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), lambda e: e <= F.col("u"))) if edges else F.lit(0)
    points = spark.range(n).select(i.alias("slot"), golden(i).alias("u")).select("slot", source.cast("int").alias("src"), F.expr(f"slot div {PIECE_SLOTS}").alias("piece"))
    counts = points.groupBy("piece", "src").agg(F.count("*").alias("n"))
    offsets = scratch.put(counts.select("piece", "src", "n", (F.sum("n").over(Window.partitionBy("src").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before")), "offsets")
    ranked = points.withColumn("k", F.row_number().over(Window.partitionBy("piece", "src").orderBy("slot"))).join(offsets, ["piece", "src"])
    got = {r["src"]: r["n"] for r in offsets.groupBy("src").agg(F.sum("n").alias("n")).collect()}
    rest, at = [], n
    for s, q in enumerate(quota):
        if q > got.get(s, 0):
            rest.append((s, got.get(s, 0), q - 1, at))
            at += q - got.get(s, 0)
    tail = (
        spark.createDataFrame(rest, "src int, a long, b long, at long")
        .select("src", "a", "at", F.explode(F.sequence("a", "b")).alias("rank"))
        .select((F.col("at") + F.col("rank") - F.col("a")).alias("slot"), "src", "rank")
    )
    return ranked.select("slot", "src", (F.col("before") + F.col("k") - 1).alias("rank")).unionByName(tail)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, seed: int = 7, carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Plans a mix of the sources; returns (documents with what is taken of each, slots with their word ranges).

    The documents of a source are shuffled by a seeded hash into one stream of words, cut into equal blocks;
    slot after slot takes the next block of the source it falls to, starting over after the last one. The
    last slot of a source is cut so that the source meets its target to the word.

    Documents: ``carry`` (the id by default), ``size, source_size, target, taken``, one row per input row.
    Slots: ``slot, src, block, words``. A null text has no words and is never taken; a null source is a
    source of its own, last in order; null ids and repeated rows are ordinary. An empty table gives empty
    results. Carried columns whose names are the result's are replaced. The driver sees one row per source.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    made = ("size", "source_size", "target", "taken")
    carry = [c for c in (carry or [id_col]) if c not in made]
    docs = as_table(docs, scratch)
    keyed = numbered(docs.select(
        F.col(id_col).alias("id"), word_count(text_col).alias("size"),
        F.coalesce(F.col(source_col), F.lit("")).alias("name"), F.col(source_col).isNull().alias("unnamed"),
    ), scratch).withColumn("h", F.xxhash64(F.lit(seed), "id", "size", "rid"))
    keyed = scratch.put(keyed, "sizes")
    found = sorted(keyed.groupBy("unnamed", "name").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect(), key=lambda r: (r["unnamed"], r["name"]))
    sizes = [r["size"] for r in found]
    targets = fill(sizes, [weights[i % len(weights)] for i in range(len(found))], budget * sum(sizes), repeats)
    takes = [min(int(round(t)), repeats * s) for t, s in zip(targets, sizes)]
    sources = _small(spark.createDataFrame(
        [(r["unnamed"], r["name"], i, s, t, k, max(1, -(-s // block_words)), -(-r["n"] // PIECE_DOCS)) for i, (r, s, t, k) in enumerate(zip(found, sizes, targets, takes))],
        "unnamed boolean, name string, src int, source_size long, target double, take long, blocks long, buckets long",
    ), len(found))
    streams = keyed.join(sources.select("unnamed", "name", "src", "buckets"), ["unnamed", "name"]).withColumn("bucket", F.pmod("h", "buckets"))
    sums = streams.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    starts = scratch.put(sums.select("src", "bucket", (F.sum("words").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).alias("before")), "starts")
    order = Window.partitionBy("src", "bucket").orderBy("h", "id", "size", "rid")
    placed = scratch.put(
        streams.withColumn("words", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, ["src", "bucket"])
        .select("rid", "id", "size", "src", (F.col("before") + F.col("words") - F.col("size")).alias("begin")),
        "placed",
    )

    size_of = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words)
    epoch = F.expr("rank div blocks")
    slots = (
        schedule(spark, [float(t) for t in takes], sizes, block_words, scratch)
        .join(sources.drop("unnamed", "name", "buckets"), "src")
        .withColumn("block", F.col("rank") % F.col("blocks"))
        .withColumn("words", F.greatest(F.lit(0), F.least(size_of, F.col("take") - epoch * F.col("source_size") - F.col("block") * block_words)))
        .where("words > 0")
        .select("slot", "src", "block", "words", size_of.alias("full"))
    )
    taken = slots.groupBy("src", "block").agg(F.count_if(F.col("words") == F.col("full")).alias("times"), F.coalesce(F.max(F.when(F.col("words") < F.col("full"), F.col("words"))), F.lit(0)).alias("part"))
    first, last = F.expr(f"begin div {block_words}"), F.expr(f"(begin + size - 1) div {block_words}")
    pieces = placed.withColumn("block", F.explode(F.sequence(first, F.greatest(first, last))))
    low = F.greatest(F.col("begin") - F.col("block") * block_words, F.lit(0))
    high = F.least(F.col("begin") + F.col("size") - F.col("block") * block_words, F.lit(block_words))
    used = F.col("times") * (high - low) + F.greatest(F.lit(0), F.least(F.col("part"), high) - low)
    out = (
        pieces.join(taken, ["src", "block"], "left").groupBy("rid", "id", "size", "src").agg(F.sum(F.coalesce(F.when(F.col("size") > 0, used), F.lit(0))).cast("long").alias("taken"))
        .join(sources.select("src", "source_size", "target"), "src")
    )
    if carry == [id_col]:
        out = out.withColumn(f"c_{id_col}", F.col("id"))
    else:  # texts and other columns are read again and meet their row's figures once
        out = numbered(docs.select(*[F.col(c).alias(f"c_{c}") for c in carry]), scratch).join(slim(scratch.put(out.drop("id"), "out")), "rid")
    out = out.select(*[F.col(f"c_{c}").alias(c) for c in carry], "size", "source_size", "target", "taken")
    return out, slots.select("slot", "src", "block", "words")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
