"""A corpus pipeline: quality filter, near duplicates, benchmark leaks, source mix and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarisect.llm.decontaminate import contamination
from clarisect.llm.mixing import mix
from clarisect.llm.ngramjoin import similar_groups
from clarisect.llm.quality import fit_quality, score_quality
from clarisect.llm.sharding import shard_by_splitters
from clarisect.llm.shared import Scratch
from clarisect.sources.scratch import as_table, numbered, slim


def guarded(docs: DataFrame) -> DataFrame:
    """The columns under names that no operator uses for its own results."""
    return docs.select(*[F.col(c).alias(f"d_{c}") for c in docs.columns])


def restored(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[F.col(f"d_{c}").alias(c) for c in columns])


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose numbers are not in ``gone``, a written table, which is broadcast if it is small."""
    rows = numbered(guarded(docs), Scratch(docs.sparkSession, "rows"))
    return restored(rows.join(slim(gone), "rid", "left_anti"), docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rule ensemble, fitted on ``labels``, predicts to be of quality.

    Empty and null texts are scored like any other; so is a row without an id. Without usable labels of both
    kinds all scores are alike.
    """
    scratch = Scratch(spark, "quality")
    docs = as_table(docs, scratch)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(numbered(docs.select("doc_id", "text"), scratch), model).select("rid", "predicted")
    return without(docs, scratch.put(scored, "scored").where("predicted = 0").select("rid"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links at a similarity of 0.8 over five-word shingles.

    The document whose id names the group stays; of repeated rows with that id one stays, and so does one of a
    group without ids. Groups are told apart by their links only, so documents with equal ids, or none, are one
    group only if their texts link. Documents without words are in no group and stay.
    """
    scratch = Scratch(spark, "near")
    docs = as_table(docs, scratch)
    groups = scratch.put(similar_groups(docs).where("n_shingles > 0"), "groups")
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"))
    best = scratch.put(groups.groupBy("comp").agg(F.min(first).alias("f")).select(F.col("f.rid").alias("rid")), "best")
    return without(docs, scratch.put(groups.select("rid").join(best, "rid", "left_anti"), "gone"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a ten-word window of a benchmark item occurs, or a shorter item as a whole.

    Rows are judged one by one, whatever their ids; texts without words stay.
    """
    scratch = Scratch(spark, "leaks")
    docs = as_table(docs, scratch)
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), numbered=True)
    return without(docs, scratch.put(found.where("contaminated").select("rid"), "gone"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out whole documents as the schedule uses them: as often as it takes their words, rounded.

    Documents without words weigh nothing in a mix and stay once.
    """
    rows = guarded(docs)
    mixed = mix(rows, "d_doc_id", "d_text", "d_source", carry=rows.columns)[0]
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    return restored(mixed.where(times > 0).withColumn("time", F.explode(F.sequence(F.lit(1), times))), docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents into 16 shards of near-equal bytes; adds ``size, text_crc32, law, shard, slot, range``."""
    return shard_by_splitters(docs, carry=docs.columns).drop("grown_shard")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: The classifier, the hashed shuffle of the mix and the sampled splitters have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next stage's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return docs
