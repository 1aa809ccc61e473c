"""Exact duplicates by deterministic block naming, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Bytes in a block. Larger blocks mean fewer levels, smaller ones more sharing of names.
BLOCK_BYTES = 4096


def _cells(docs: DataFrame, text_col: str, block_bytes: int, *more) -> DataFrame:
    """One row per block of each text, texts as bytes; an empty text is one empty block."""
    size = F.octet_length("__b")
    count = F.greatest(F.lit(1), F.ceil(size / block_bytes)).cast("int")
    return (
        docs.select(*more, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("__b"))
        .withColumn("nb", count)
        .select(
            *[c for c in ("rid", "id") if more],
            "nb",
            *([F.sha2("__b", 256).alias("sha")] if more else []),
            F.posexplode(F.expr(f"transform(sequence(0, nb - 1), i -> substring(__b, i * {block_bytes} + 1, {block_bytes}))")).alias("pos", "block"),
        )
    )


def _prints(salt: int, bits: int):
    """A 128-bit fingerprint of a block (``bits`` of each half are kept; tests lower it to force clashes)."""
    shift = 64 - bits
    return [F.shiftright(F.xxhash64(F.lit(f"{half}-{salt}"), F.col("block")), shift).alias(half) for half in ("f1", "f2")]


def _ranked(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names in sorted order of the keys."""
    return counted.orderBy(*keys).withColumn("name", F.monotonically_increasing_id())


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, print_bits: int = 64) -> DataFrame:
    """Names every text by its blocks and keeps one row of each group of equal texts.

    Level 0 sorts the distinct blocks into integer names. So that texts cross the network once, occurrences
    carry a 128-bit fingerprint; it stands for the block only after the distinct blocks themselves have shown
    that no two of them share it, else another salt is tried. Each further level names adjacent pairs of
    names until a document has one name, its collision-free identity. A document with a block (or pair) that
    occurs once in the corpus equals no other and stops early.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``. Null texts count as
    empty and equal each other. A null id ranks below all others. Of repeated rows with the winning id
    exactly one is kept. An empty table gives an empty result. Further input columns are not returned, so
    names that clash with the result's do no harm.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "blocknames")
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    salt, names = 0, None
    while names is None:
        blocks = _cells(source, "__t", block_bytes).select(*_prints(salt, print_bits), "block")
        counted = (
            blocks.groupBy("f1", "f2", "block").agg(F.count("*").alias("n"))
            .groupBy("f1", "f2").agg(F.count("*").alias("variants"), F.sum("n").alias("n"))
        )
        names = scratch.put(_ranked(counted, ["f1", "f2"]), "names")
        if names.agg(F.max("variants")).first()[0] not in (None, 1):
            scratch.drop(names)
            salt, names, print_bits = salt + 1, None, 64

    occurrences = (
        _cells(source, "__t", block_bytes, F.monotonically_increasing_id().alias("rid"), F.col("__id").alias("id"))
        .select("rid", "nb", "pos", *_prints(salt, print_bits), *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("id", "sha")])
    )

    def named(rows: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
        """Rows with their name, and the rarest count among the names of their document."""
        return (
            rows.join(names.select(*keys, "name", "n"), keys)
            .select("rid", "nb", "pos", "name", "id", "sha", F.min("n").over(Window.partitionBy("rid")).alias("rarest"))
        )

    current = scratch.put(named(occurrences, names, ["f1", "f2"]), "level")
    scratch.drop(names)
    lone, done, level = [], [], 0
    while True:
        lone.append(current.where((F.col("rarest") == 1) & (F.col("pos") == 0)).select("id", "sha"))
        shared = current.where(F.col("rarest") > 1)
        done.append(shared.where("nb = 1").select("rid", "id", "sha", F.lit(level).alias("level"), "name"))
        open_docs = shared.where("nb > 1")
        if open_docs.isEmpty():
            break
        level += 1
        even = F.col("pos") % 2 == 0
        pairs = scratch.put(
            open_docs.groupBy("rid", F.shiftright("pos", 1).alias("pos"), F.shiftright(F.col("nb") + 1, 1).alias("nb")).agg(
                F.max(F.when(even, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1).cast("long")).alias("right"),
                F.max("id").alias("id"), F.max("sha").alias("sha"),
            ),
            "pairs",
        )
        names = scratch.put(_ranked(pairs.groupBy("left", "right").agg(F.count("*").alias("n")), ["left", "right"]), "names")
        current = scratch.put(named(pairs, names, ["left", "right"]), "level")
        scratch.drop(pairs, names)

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    identities = union(done)
    best = F.max(F.struct(F.col("id"), (-F.col("rid")).alias("r")))
    groups = scratch.put(identities.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    alike = identities.join(groups, ["level", "name"]).select(
        F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("rid") == -F.col("best.r")).alias("kept"), F.col("sha").alias("text_sha256"),
    )
    single = union(lone).select(
        F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"),
    )
    return single.unionByName(alike)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""
