"""Written intermediate tables in the folder that all executors share, and row numbers that outlive any executor."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Plan nodes that hand on rows of files as they are.
_HANDS_ON = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "View"}
#: Rows of a file that a number can tell apart, as a power of 2.
_FILE_BITS = 40
#: Rows of a few numbers up to which the slim side of a join is broadcast; more are joined by shuffle.
SLIM_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can see.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset a folder of the warehouse serves on a
    local master, as in tests; on a cluster that may be one machine's own disk, which is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return named.rstrip("/")


class Scratch:
    """Written intermediate tables: they cut lineage and survive the loss of any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` as Parquet and read it back."""
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished queries, which it does as the driver collects garbage."""
        for _ in range(2):  # what the first round finds lets go of more
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.3)


def _is_scan(docs: DataFrame) -> bool:
    left = [docs._jdf.queryExecution().analyzed()]
    while left:
        plan = left.pop()
        if plan.nodeName() not in _HANDS_ON or not plan.deterministic():
            return False
        left += [plan.children().apply(i) for i in range(plan.children().size())]
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        return False
    return True


def as_table(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` if it reads Parquet files as they are, else a written copy; either reads the same rows each time."""
    return docs if _is_scan(docs) else scratch.put(docs, "rows")


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with a number ``rid`` of their own, alike whenever and however the table is read.

    The number is the row's place in its file, and its file's place among all files, so it depends on no cut of
    the table into tasks. ``docs`` is written first unless it reads Parquet files as they are.
    """
    spark, docs = docs.sparkSession, as_table(docs, scratch)
    meta = docs.metadataColumn("_metadata")
    place = docs.select(F.xxhash64(meta["file_path"]).alias("__file"), meta["row_index"].alias("rid"), *[docs[f"`{c}`"] for c in docs.columns if c != "rid"])
    files = sorted(r[0] for r in place.select("__file").distinct().collect())  # one row a file
    if len(files) < 2:
        return place.drop("__file")
    numbers = spark.createDataFrame([(f, i << _FILE_BITS) for i, f in enumerate(files)], "__file long, __first long")
    numbers = F.broadcast(numbers) if len(files) <= SLIM_ROWS else numbers
    return place.join(numbers, "__file").withColumn("rid", F.col("__first") + F.col("rid")).drop("__file", "__first")


def slim(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if its counted size allows."""
    return F.broadcast(df) if df.count() <= SLIM_ROWS else df
