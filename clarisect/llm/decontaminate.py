"""Benchmark decontamination over a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import numbered as with_numbers
from .shared import Scratch, hashed_words, text_bytes

#: Words in a window of a benchmark item, and the words by which a proximity match may be wider.
WINDOW = 10
SLOP = 5
#: Terms looked up at once; a larger benchmark vocabulary is handled in slices of about this many.
TERMS_AT_ONCE = 2_000_000


def _windows(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """One row for each window of each item: ``item, terms`` (64-bit hashes of its words)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            items, rows = batch.column(0).to_pylist(), []
            for first, counts, hashes in hashed_words(text_bytes(batch.column(1)), alnum=True):
                ends = np.cumsum(counts)
                for k, n in enumerate(counts):
                    words = hashes[ends[k] - n : ends[k]].astype(np.int64)
                    rows += [(items[first + k], words[i : i + size].tolist()) for i in range(max(1, n - size + 1)) if n]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["item", "terms"])

    return benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "item string, terms array<long>")


def _term_counts(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """How often each of the given terms (sorted) occurs in all texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for _, _, hashes in hashed_words(text_bytes(batch.column(0)), alnum=True):
                at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                total += np.bincount(at[terms[at] == hashes], minlength=len(terms))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms[found].astype(np.int64)), pa.array(total[found])], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _postings(docs: DataFrame, terms: np.ndarray, anchors: np.ndarray, reach: int) -> DataFrame:
    """A row per document: ``rid, id, n_words`` and the postings of ``terms`` within ``reach`` words of an anchor."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sizes, ends, all_terms, all_places = [], [0], [], []
            for _, counts, hashes in hashed_words(text_bytes(batch.column(2)), alnum=True):
                n = len(hashes)
                if len(anchors) and n:
                    at = np.minimum(np.searchsorted(anchors, hashes), len(anchors) - 1)
                    near = np.flatnonzero(anchors[at] == hashes)
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.maximum(near - reach, 0), 1)
                    np.add.at(edge, np.minimum(near + reach + 1, n), -1)
                    here = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                    at = np.minimum(np.searchsorted(terms, hashes[here]), len(terms) - 1)
                    here = here[terms[at] == hashes[here]]
                else:
                    here = np.zeros(0, np.int64)
                stops = np.cumsum(counts)
                owner = np.searchsorted(stops, here, side="right")
                all_terms.append(hashes[here].astype(np.int64))
                all_places.append(here - (stops - counts)[owner])
                sizes += counts.tolist()
                ends += (ends[-1] + np.cumsum(np.bincount(owner, minlength=len(counts)))).tolist()
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x) if x else [], pa.int64())) for x in (all_terms, all_places)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["rid", "n_words", "terms", "places"])

    return docs.select("rid", F.lit(0), "text").mapInArrow(run, "rid long, n_words long, terms array<long>, places array<long>")


def _search(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, slop: int, carry: list[str], terms_at_once: int, scratch: Scratch):
    """(texts with ``rid``, their word counts, exact hits, near hits, owners of windows); hits are rows of win and rid."""
    spark = docs.sparkSession
    texts = with_numbers(docs.select(*[F.col(c).alias(f"c_{c}") for c in carry], F.col(text_col).cast("string").alias("text")), scratch)
    found = scratch.put(_windows(benchmark, item_col, item_text_col, window).select(F.xxhash64("terms").alias("win"), "item", "terms"), "windows")
    windows = scratch.put(found.groupBy("win").agg(F.first("terms").alias("terms")), "distinct")
    slots = windows.select("win", F.posexplode("terms").alias("offset", "term"))

    vocabulary = slots.select("term").distinct()
    slices = max(1, -(-vocabulary.count() // terms_at_once))
    counts = None
    for k in range(slices):
        part = vocabulary.where(F.pmod("term", F.lit(slices)) == k) if slices > 1 else vocabulary
        known = np.sort(np.array([r["term"] for r in part.collect()], np.int64).astype(np.uint64))
        if len(known):
            n = _term_counts(texts, known)
            counts = n if counts is None else counts.unionByName(n)
    counts = scratch.put(counts if counts is not None else spark.createDataFrame([], "term long, n long"), "counts")

    ranked = slots.join(counts, "term", "left").groupBy("win").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("t"))
    pick = [F.element_at("t", F.least(F.lit(k), F.size("t"))) for k in (1, 2, 3)]
    plans = scratch.put(
        ranked.where(F.col("t")[0]["n"] > 0)
        .select("win", "t", *[p["term"].alias(f"t{k}") for k, p in enumerate(pick, 1)], *[p["offset"].cast("long").alias(f"o{k}") for k, p in enumerate(pick, 1)], F.size("t").alias("len")),
        "plans",
    )
    slices = max(1, -(-plans.select(F.coalesce(F.sum("len"), F.lit(0))).first()[0] // terms_at_once))
    if slices > 1:
        texts = scratch.put(texts, "texts")
    reach = window - 1 + slop
    documents, exact, near = None, [], []
    for k in range(slices):
        plan = plans.where(F.pmod("win", F.lit(slices)) == k) if slices > 1 else plans
        terms, anchors = (np.sort(np.array([r[0] for r in x.distinct().collect()], np.int64).astype(np.uint64)) for x in (plan.select(F.explode("t.term")), plan.select("t1")))
        rows = scratch.put(_postings(texts, terms, anchors, reach), "index")
        documents = rows.select("rid", "n_words") if documents is None else documents
        index = rows.select("rid", F.explode(F.arrays_zip("terms", "places")).alias("p")).select("rid", F.col("p.terms").alias("term"), F.col("p.places").alias("place"))

        def of(name: str, index=index) -> DataFrame:
            return index.select(F.col("rid"), F.col("term").alias(f"t{name}"), F.col("place").alias(f"p{name}"))

        first = scratch.put(plan.drop("t").join(of("1"), "t1"), "rarest")
        begun = first.withColumn("start", F.col("p1") - F.col("o1")).where("start >= 0")
        for c in ("2", "3"):
            begun = begun.withColumn(f"p{c}", F.col("start") + F.col(f"o{c}")).join(of(c), ["rid", f"t{c}", f"p{c}"], "left_semi")
        three = scratch.put(begun.select("win", "rid", "start", "len"), "three")
        want = three.join(plan.select("win", F.explode("t").alias("x")), "win").select("win", "rid", "start", "len", F.col("x.term").alias("t"), (F.col("start") + F.col("x.offset")).alias("p"))
        exact.append(want.join(of(""), ["rid", "t", "p"], "left_semi").groupBy("win", "rid", "start", "len").agg(F.count("*").alias("n")).where("n = len").drop("n"))
        # of the postings of a term, the first and last in each stretch of a text tell whether one is close
        wide = reach + 1
        stretches = scratch.put(index.groupBy("rid", "term", F.expr(f"place div {wide}").alias("at")).agg(F.min("place").alias("lo"), F.max("place").alias("hi")), "stretches")
        close = first.select("win", "rid", "p1", "t2", "t3")
        for c in ("2", "3"):
            around = close.withColumn("at", F.explode(F.array(*[F.expr(f"p1 div {wide}") + step for step in (-1, 0, 1)])))
            met = around.join(stretches.withColumnRenamed("term", f"t{c}"), ["rid", f"t{c}", "at"])
            close = met.where((F.col("lo") <= F.col("p1") + reach) & (F.col("hi") >= F.col("p1") - reach)).select("win", "rid", "p1", "t2", "t3").distinct()
        near.append(close.select("win", "rid", "p1"))

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    owners = found.select("win", "item").where("item is not null").distinct()
    return texts, documents, scratch.put(union(exact), "hits"), scratch.put(union(near), "near"), owners


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = SLOP, terms_at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """The matches themselves: ``doc_id, item, kind, place, length``, places counting words from 0.

    A "phrase" is a whole window at its place; "near" is a window's rarest term with its two next rarest within
    ``window - 1 + slop`` words. Items and documents as in ``contamination``; null item ids have no rows.
    """
    scratch = Scratch(docs.sparkSession, "matches")
    texts, _, hits, near, owners = _search(docs, benchmark, text_col, item_col, item_text_col, window, slop, [id_col], terms_at_once, scratch)
    found = hits.select("win", "rid", F.lit("phrase").alias("kind"), F.col("start").alias("place"), "len").unionByName(near.select("win", "rid", F.lit("near").alias("kind"), F.col("p1").alias("place"), F.lit(1).alias("len")))
    return found.join(owners, "win").join(texts.select("rid", F.col(f"c_{id_col}").alias("doc_id")), "rid").select("doc_id", "item", "kind", "place", F.col("len").cast("long").alias("length")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = SLOP, carry: list[str] | None = None, terms_at_once: int = TERMS_AT_ONCE, numbered: bool = False) -> DataFrame:
    """Finds the windows of benchmark items in training documents by intersecting positional postings.

    Terms are words of digits, letters a-z (A-Z lower-cased) and non-ASCII characters, held as 64-bit hashes.
    Corpus counts order the terms of each window from the rarest. The index stores, for every document, the
    postings of test terms that lie near some window's rarest term; nothing else can take part in a match.
    Lists are intersected offset-adjusted: the rarest term's, the second's, the third's, then all the rest.
    A proximity match needs the three rarest terms within ``window - 1 + slop`` words of the rarest.

    Returns ``carry`` (the id by default) plus ``n_words, n_hit, n_items, items_sha256, contaminated,
    n_near_items``, one row per input row (and ``rid``, the row's number, if ``numbered``). Null texts have no words; null or wordless items match nothing;
    null item ids count as no item in the list but their words are hit; null document ids, repeated rows and
    repeated items are ordinary; empty tables give no rows, or clean ones. A carried column whose name is one
    of the result's is replaced.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    made = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items")
    carry = [c for c in (carry or [id_col]) if c not in made]
    texts, documents, hits, near, owners = _search(docs, benchmark, text_col, item_col, item_text_col, window, slop, carry, terms_at_once, scratch)
    ends = Window.partitionBy("rid").orderBy("start", "len")
    covered = (
        hits.select("rid", "start", (F.col("start") + F.col("len")).alias("end"), "len")
        .withColumn("done", F.coalesce(F.max("end").over(ends.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .groupBy("rid").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "done"))).alias("n_hit"))
    )
    items = (
        hits.select("win", "rid").distinct().join(owners, "win").select("rid", "item").distinct()
        .groupBy("rid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    nearby = near.select("win", "rid").distinct().join(owners, "win").select("rid", "item").distinct().groupBy("rid").agg(F.count("*").alias("n_near_items"))
    marks = scratch.put(covered.join(items, "rid", "left").join(nearby, "rid", "full"), "marks")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (
        texts.drop("text").join(documents, "rid").join(marks, "rid", "left")
        .select(
            *(["rid"] if numbered else []), *[F.col(f"c_{c}").alias(c) for c in carry], "n_words", n_hit.alias("n_hit"), F.coalesce(F.size(F.coalesce("items", F.array().cast("array<string>"))), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near_items", F.lit(0)).alias("n_near_items"),
        )
    )


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark)


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
spot AS (
  SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM d, (SELECT DISTINCT n FROM win) AS l, unnest(range(1, len(w) - n + 2)) AS t(i)),
occ AS (SELECT rid, i, n, item_id FROM spot JOIN win USING (n, s)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + n)) AS t(p) GROUP BY rid),
pos AS (SELECT rid, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
cnt AS (SELECT t, count(*) AS c FROM pos GROUP BY t),
term AS (
  SELECT s, row_number() OVER (PARTITION BY s ORDER BY coalesce(c, 0), o) AS k, t, coalesce(c, 0) AS c
  FROM (SELECT s, unnest(string_split(s, ' ')) AS t, unnest(range(0, n)) AS o FROM (SELECT DISTINCT s, n FROM win)) LEFT JOIN cnt USING (t)),
rare AS (
  SELECT s, max(t) FILTER (k = 1) AS t1, max(t) FILTER (k = least(2, l)) AS t2, max(t) FILTER (k = least(3, l)) AS t3
  FROM (SELECT *, count(*) OVER (PARTITION BY s) AS l FROM term) GROUP BY s HAVING min(c) > 0),
near1 AS (SELECT s, t3, a.rid, a.p FROM rare JOIN pos AS a ON a.t = t1 WHERE EXISTS (SELECT 1 FROM pos AS b WHERE b.rid = a.rid AND b.t = rare.t2 AND b.p BETWEEN a.p - 14 AND a.p + 14)),
near AS (SELECT DISTINCT s, rid FROM near1 WHERE EXISTS (SELECT 1 FROM pos AS b WHERE b.rid = near1.rid AND b.t = near1.t3 AND b.p BETWEEN near1.p - 14 AND near1.p + 14)),
nearby AS (SELECT rid, count(DISTINCT item_id) AS n_near FROM near JOIN win USING (s) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM occ) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_near, 0)::BIGINT AS n_near_items, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid) LEFT JOIN nearby USING (rid)
"""
