"""python -m clarisect --data PATH [--k 3] [--strategy levelwise] [--out DIR]: explains a k-means of a CSV table."""

import argparse
import time

from pyspark.sql import SparkSession

from .operators.features import assemble, cast_doubles
from .plans.model import STRATEGIES, ExplainableKMeans
from .sources.tables import read_csv, write_text, write_tree


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="clarisect", description=__doc__)
    p.add_argument("--data", required=True, help="CSV with a header; every column is a feature")
    p.add_argument("--k", type=int, default=3)
    p.add_argument("--max-leaves", type=int)
    p.add_argument("--strategy", choices=STRATEGIES, default="levelwise")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--compat", action="store_true")
    p.add_argument("--master", help="Spark master; the session's own by default")
    p.add_argument("--out", help="folder for the node table and the texts")
    a = p.parse_args(argv)
    builder = SparkSession.builder.appName("clarisect")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    raw = cast_doubles(read_csv(spark, a.data))
    began = time.time()
    model = ExplainableKMeans(a.k, a.max_leaves, a.strategy, seed=a.seed, compat=a.compat).fit(assemble(raw, raw.columns))
    print(f"fitted in {time.time() - began:.2f} s")
    print("\n".join(model.tree.lines(model.thresholds)))
    if a.out:
        write_tree(model.tree, spark, f"{a.out}/tree")
        write_text(spark, model.tree.lines(model.thresholds), f"{a.out}/print")
        write_text(spark, model.tree.to_dot(raw.columns).split("\n"), f"{a.out}/dot")


if __name__ == "__main__":
    main()
