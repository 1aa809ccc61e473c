"""Reading feature tables and writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tree import Tree


def read_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, infer: bool = False, header: bool = True) -> DataFrame:
    """CSV from any path Spark reads. All columns are strings unless inferred; with names and no header, these name them."""
    reader = spark.read.option("header", header).option("inferSchema", infer)
    if columns and not header:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
        columns = None
    df = reader.csv(path)
    return df.select(*columns) if columns else df


def read_doubles(spark: SparkSession, path: str | list[str], columns: Sequence[str]) -> DataFrame:
    """CSV with a header and a stated schema of doubles: one scan, nothing inferred."""
    return spark.read.option("header", True).schema(T.StructType([T.StructField(c, T.DoubleType()) for c in columns])).csv(path)


def read_labelled(spark: SparkSession, path: str | list[str], prefix: str = "feature ") -> DataFrame:
    """A CSV without header, gzip or not, whose first column is a label: drops it and numbers the rest from 1."""
    df = spark.read.option("header", False).option("inferSchema", True).csv(path)
    return df.drop(df.columns[0]).toDF(*[f"{prefix}{i}" for i in range(1, len(df.columns))])


def from_rows(spark: SparkSession, rows: Sequence[Sequence], columns: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(rows), list(columns))


def write_csv(df: DataFrame, path: str, one_file: bool = False, mode: str = "overwrite") -> None:
    """CSV with header; ``one_file`` is for results of a few rows."""
    (df.coalesce(1) if one_file else df).write.mode(mode).option("header", True).csv(path)


def combine_csv(spark: SparkSession, paths: Sequence[str], path: str, one_file: bool = True) -> None:
    """Several CSV files with the same header as one."""
    write_csv(spark.read.option("header", True).csv(list(paths)), path, one_file)


def write_clustered(df: DataFrame, path: str, names: Sequence[str] | None = None, kind: str = "parquet", label: str = "prediction") -> None:
    """Features as columns with the label as ``Cluster``."""
    n = len(names) if names else len(df.select("features").first()[0])
    wide = df.select(*[F.col("features")[i].alias(names[i] if names else f"feature_{i}") for i in range(n)], F.col(label).alias("Cluster"))
    wide.write.mode("overwrite").format(kind).options(**({"header": True} if kind == "csv" else {})).save(path)


def write_tree(tree: Tree, spark: SparkSession, path: str) -> None:
    tree.table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def read_tree(spark: SparkSession, path: str) -> Tree:
    return Tree.from_table(spark.read.parquet(path))


def write_text(spark: SparkSession, lines: Sequence[str], path: str) -> None:
    """A few lines, such as a tree's print or its DOT text, to any path Spark writes."""
    spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)
