"""N-gram Jaccard join with a token-group matrix: exact links, linear in the size of groups of near copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import numbered, slim
from .shared import Scratch, bitmap, hashed_words, in_bitmap, mix64, text_bytes

SHINGLE = 5
#: Least similarity, in hundredths.
SIMILARITY = 80
#: Hash functions of the grouping step: so many bands of so many minima.
BANDS, ROWS = 8, 3
#: Bits of the sketch that tells frequent shingles, and the count in one task from which a bucket is reported.
SKETCH_BITS, REPORT = 22, 8
#: Entries of a document in the matrix beyond those that a link needs, in hundredths of its set.
SPARE = 10
#: Ratio of the sizes of neighbouring size classes.
SIZE_STEP = 1.05
#: Documents and shingles in a block of a cluster, about; a task compares two blocks.
BLOCK, BLOCK_SHINGLES = 128, 1 << 19
#: Rounds in which a document, then a group, is compared with one leader.
ROUNDS = 2
#: Bits that tell which texts a comparison needs; more texts than bits only make the filter idle.
NEED_BITS = 24

_RNG = np.random.default_rng(77)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MINIMA = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(sizes: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a run of texts, sorted by text: (text numbers, hashes)."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if len(words) >= k:
        sums = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            sums += words[j : len(words) - k + 1 + j] * _PLACE[j]
        inside = owner[: len(sums)] == owner[k - 1 :]
        text, value = owner[: len(sums)][inside], mix64(sums[inside])
    else:
        text, value = owner[:0], words[:0]
    ends = np.cumsum(sizes)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        one = [np.sum(words[ends[i] - sizes[i] : ends[i]] * _PLACE[k : k + sizes[i]], dtype=np.uint64) for i in short]
        text, value = np.concatenate([text, short]), np.concatenate([value, mix64(np.array(one, np.uint64))])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[fresh], value[fresh]


def _listed(n: np.ndarray, similarity: int) -> np.ndarray:
    """How many of its rarest shingles a set of n has in the matrix."""
    return np.minimum(n, n - (similarity * n + 99) // 100 + 1 + SPARE * n // 100)


def _sketch(texts: DataFrame, k: int, scratch: Scratch) -> np.ndarray:
    """About the log2 of each hash bucket's shingle count where it is large; any values keep the join exact."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            for _, sizes, words in hashed_words(text_bytes(batch.column(0))):
                bucket, n = np.unique(shingles(sizes, words, k)[1] >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                counts[bucket] += n.astype(np.int32)
        often = np.flatnonzero(counts >= REPORT)
        yield pa.RecordBatch.from_arrays([pa.array(often), pa.array(counts[often].astype(np.int64))], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = found.select("bucket", F.least(F.floor(F.log2("n")), F.lit(60)).cast("int").alias("w")).toArrow()  # at most one row a bucket
    weights = np.zeros(1 << SKETCH_BITS, np.uint8)
    weights[rows.column("bucket").to_numpy()] = rows.column("w").to_numpy()
    return weights


def _profiles(texts: DataFrame, weights: np.ndarray, k: int, similarity: int) -> DataFrame:
    """A row per text: size of its set, the set's 128-bit name, bands of minima, and its rarest shingles in order."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            total = batch.num_rows
            n, f1, f2 = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64)
            bands = np.zeros((total, BANDS), np.int64)
            tokens, sizes_out = [], np.zeros(total, np.int64)
            for first, sizes, words in hashed_words(text_bytes(batch.column(1))):
                text, value = shingles(sizes, words, k)
                count = np.bincount(text, minlength=len(sizes))
                have = np.flatnonzero(count)
                n[first : first + len(sizes)] = count
                if not len(have):
                    continue
                starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                rows = first + have
                f1[rows] = np.add.reduceat(mix64(value ^ _PLACE[60]), starts).astype(np.int64)
                f2[rows] = np.add.reduceat(mix64(value ^ _PLACE[61]), starts).astype(np.int64)
                for b in range(BANDS):
                    name = np.full(len(have), _PLACE[b], np.uint64)
                    for r in range(b * ROWS, (b + 1) * ROWS):
                        name = mix64(name ^ np.minimum.reduceat(value * _MINIMA[r], starts))
                    bands[rows, b] = name.astype(np.int64)
                weight = weights[(value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
                order = np.lexsort(((weight << np.uint64(56)) | (value >> np.uint64(8)), text))
                own = count[have]
                prefix = _listed(own, similarity)
                rank = np.arange(len(text)) - np.repeat(starts, own)
                taken = rank < np.repeat(prefix, own)
                tokens.append(value[order][taken].astype(np.int64))
                sizes_out[rows] = prefix
            ends = np.append(0, np.cumsum(sizes_out))
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64), pa.int64()))
            band = pa.ListArray.from_arrays(pa.array(np.arange(total + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(f1), pa.array(f2), band, prefix], names=["rid", "id", "n", "f1", "f2", "bands", "prefix"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("rid", "text", "id").mapInArrow(run, f"rid long, id {kind}, n long, f1 long, f2 long, bands array<long>, prefix array<long>")


def _needed(texts: DataFrame, need: DataFrame) -> DataFrame:
    """The texts whose numbers a written table lists; a bit map drops most others before they are dealt out."""
    bit = F.pmod(F.xxhash64("rid"), F.lit(1 << NEED_BITS))
    marks = np.zeros(1 << NEED_BITS, bool)
    marks[need.select(bit.alias("bit")).distinct().toArrow().column("bit").to_numpy()] = True
    packed = np.packbits(marks)

    @F.pandas_udf("boolean")
    def may_need(bits: pd.Series) -> pd.Series:
        at = bits.to_numpy(np.int64)
        return pd.Series((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

    return texts.select("rid", "text").where(may_need(bit)).join(need, "rid")


def _linked(texts: DataFrame, pairs: DataFrame, scratch: Scratch, k: int, similarity: int) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets are similar enough, compared in full."""
    found = scratch.put(_needed(texts, scratch.put(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "need")), "texts")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, held = None, None
        for batch in batches:
            left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = text_bytes(batch.column(2)), text_bytes(batch.column(3))
            ok = np.zeros(len(left), bool)
            sets = np.zeros(0, np.uint64)
            for i in range(len(left)):
                if left[i] != last:
                    last = left[i]
                    held = np.concatenate([shingles(s, w, k)[1] for _, s, w in hashed_words([ta[i]])] or [sets])
                other = np.concatenate([shingles(s, w, k)[1] for _, s, w in hashed_words([tb[i]])] or [sets])
                both = len(np.intersect1d(held, other, assume_unique=True))
                ok[i] = 100 * both >= similarity * (len(held) + len(other) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    right = pairs.join(found.select(F.col("rid").alias("b"), F.col("text").alias("tb")), "b")
    return right.join(found.select(F.col("rid").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, comp): the least vertex reachable from each vertex of the edges (a, b), by hooking and shortcuts."""
    both = scratch.put(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "both")
    labels = scratch.put(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("c"))
        met = labels.join(near, "v").select("v", F.least("comp", "c").alias("comp"), F.col("comp").alias("old"))
        # what a vertex has found its old root is told too, and then every vertex takes its root's label
        told = met.groupBy(F.col("old").alias("v")).agg(F.min("comp").alias("c"))
        hooked = scratch.put(met.join(told, "v", "left").select("v", F.least("comp", F.coalesce("c", "comp")).alias("comp"), "old"), "hooked")
        jumped = scratch.put(
            hooked.join(hooked.select(F.col("v").alias("comp"), F.col("comp").alias("c")), "comp", "left").select("v", F.least("comp", F.coalesce("c", "comp")).alias("comp"), "old"), "jumped")
        changed = not jumped.where("comp <> old").isEmpty()
        scratch.drop(labels, hooked)
        labels = jumped
        if not changed:
            return labels.select("v", "comp")


def _crossing(rows: DataFrame, packed: np.ndarray, similarity: int) -> DataFrame:
    """Of each document (rid, n, comp, prefix) the entries whose bit is set, one row each; documents that cannot have
    enough of them are closed here."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n, prefix = batch.column(1).to_numpy(), batch.column(3)
            sizes = np.diff(prefix.offsets.to_numpy())
            value = prefix.flatten().to_numpy()
            owner = np.repeat(np.arange(len(n)), sizes)
            there = in_bitmap(packed, value)
            enough = np.bincount(owner[there], minlength=len(n)) >= _at_least(n, similarity)
            there &= enough[owner]
            at = pa.array(owner[there])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (0, 1, 2)), pa.array(value[there])], names=["rid", "n", "comp", "tok"])

    return rows.select("rid", "n", "comp", "prefix").mapInArrow(run, "rid long, n long, comp long, tok long")


def _at_least(n: np.ndarray, similarity: int) -> np.ndarray:
    """How many of its listed shingles a set of n shares at least with any set that links: a link lacks at most
    n - needed of them."""
    return _listed(n, similarity) - (n - (similarity * n + 99) // 100)


def _bounds(similarity: int) -> tuple[Column, Column]:
    """The same as columns of ``n``: (the least overlap of a link, the least number of listed shingles shared)."""
    needed = F.ceil(F.lit(similarity) * F.col("n") / F.lit(100) - F.lit(1e-9))
    return needed, F.least(F.col("n"), F.col("n") - needed + 1 + F.expr(f"{SPARE} * n div 100")) - (F.col("n") - needed)


def _leaders(texts: DataFrame, reps: DataFrame, scratch: Scratch, k: int, similarity: int) -> tuple[DataFrame, DataFrame]:
    """(links, components) from bands of minima: each document is compared with one leader of its bands, then each
    group that has formed with one document of each other group that a band still joins it to."""
    keyed = scratch.put(reps.select("rid", "n", F.explode("bands").alias("band")), "bands")
    leaders = scratch.put(keyed.groupBy("band").agg(F.min(F.struct("rid", "n")).alias("l"), F.count("*").alias("c")).where("c > 1").select("band", F.col("l.rid").alias("a"), F.col("l.n").alias("m")), "leaders")
    close = 100 * F.least("n", "m") >= similarity * F.greatest("n", "m")
    offers = scratch.put(keyed.join(leaders, "band").where((F.col("a") != F.col("rid")) & close).groupBy("a", F.col("rid").alias("b")).agg(F.count("*").alias("bands")), "offers")
    best = F.max(F.struct("bands", (-F.col("a")).alias("a")))
    tried = scratch.put(offers.groupBy("b").agg(best.alias("x")).select((-F.col("x.a")).alias("a"), "b"), "pairs")
    links = scratch.put(_linked(texts, tried, scratch, k, similarity), "links")
    groups = components(links, scratch)
    for _ in range(1, ROUNDS):
        a, b = (slim(groups).select(F.col("v").alias(c), F.col("comp").alias(f"c{c}")) for c in "ab")
        apart = offers.join(tried, ["a", "b"], "left_anti").join(a, "a", "left").join(b, "b", "left").withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b")).where("ca <> cb")
        sides = [F.least("ca", "cb").alias("one"), F.greatest("ca", "cb").alias("other")]
        more = scratch.put(apart.groupBy(*sides).agg(F.max(F.struct("bands", "a", "b")).alias("x")).select("x.a", "x.b"), "pairs")
        if more.isEmpty():
            break
        found = scratch.put(_linked(texts, more, scratch, k, similarity), "links")
        links = links.unionByName(found)
        groups = components(links, scratch)
    return links, groups


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """Joins documents whose sets of k-word shingles have at least the given Jaccard similarity, into components.

    Equal sets are one class, of which one row is compared. Bands of minima partition the classes into groups
    of similar documents, each linked to one leader after full comparison. The token-group matrix holds the rarest
    shingles of every document by group. A document that links outside its group finds all but a few of these
    among the tokens of other groups, of documents of its size; one that does not is closed, and so, step by
    step, are those that only closed documents made look alike. What is still connected is opened: blocks of
    different groups are compared in full. Of the links that a pair of blocks has, those of a spanning forest of the
    groups are kept, as the result is the components: no pairs within a group are formed or given out.
    No partners or candidates are dropped, so no two groups that a link joins stay apart.

    Returns ``doc_id, n_shingles, component_id``, one row per input row, plus ``rid`` to tell rows apart and
    ``comp``, the number of a row that stands for the component: names may be null or repeated, it is not. Words
    are as in the contract of the query; A-Z count as a-z. A text without words, or null, has an empty set and
    is linked with nothing, so its component is its own id. Null ids are ordinary and rank after all others for
    the component's name; repeated rows have equal sets; an empty table gives an empty result; further columns
    are not returned.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngramjoin")
    texts = numbered(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), scratch)
    weights = _sketch(texts, k, scratch)
    profiles = scratch.put(_profiles(texts, weights, k, similarity), "profiles")
    classes = scratch.put(profiles.where("n > 0").groupBy("f1", "f2").agg(F.min("rid").alias("rep"), F.min("id").alias("least")), "classes")
    reps = profiles.select("rid", "n", "bands", "prefix").join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi")
    reps = scratch.put(reps, "reps")
    links, groups = _leaders(texts, reps, scratch, k, similarity)
    scratch.release()

    # a document that links misses at most n - needed of its own entries in the other one
    needed, at_least = _bounds(similarity)

    def shared_cells(rows: DataFrame) -> DataFrame:
        """Tokens in the unions of two groups or more."""
        return scratch.put(rows.groupBy("tok").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("tok"), "cells")

    def qualifying(rows: DataFrame, cells: DataFrame) -> DataFrame:
        """Entries shared with another group, of documents that have enough of them."""
        crossed = scratch.put(rows.join(cells, "tok", "left_semi"), "crossed")
        enough = crossed.groupBy("rid", "n").agg(F.count("*").alias("c")).where(F.col("c") >= at_least).select("rid")
        return crossed.join(scratch.put(enough, "enough"), "rid", "left_semi").select("rid", "n", "comp", "tok")

    def sized(rows: DataFrame) -> DataFrame:
        """Entries of documents that have enough of them among documents of some one size.

        Sets of n and m shingles that link share at least P(n) - n + o and P(m) - m + o of their rarest P, with
        o the least overlap of a link; within a class of sizes the first grows with m and the second falls.
        """
        level = F.floor(F.ln("n") / float(np.log(SIZE_STEP))).cast("int")
        span = int(np.ceil(np.log(100 / similarity) / np.log(SIZE_STEP))) + 1
        placed = rows.withColumn("level", level)
        found = scratch.put(placed.groupBy("tok", "level").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).withColumnRenamed("level", "other"), "levels")
        low, high = F.pow(F.lit(SIZE_STEP), F.col("other")), F.pow(F.lit(SIZE_STEP), F.col("other") + 1)
        low = F.greatest(F.floor(low), F.floor(F.lit(similarity) * F.col("n") / 100))
        share, spare = similarity / (100 + similarity), SPARE / 100
        first = at_least + (F.floor(F.lit(share) * (F.col("n") + low)) - needed)
        second = F.floor((1 - similarity / 100 + spare - 1 + share) * high + share * F.col("n")) - 2
        met = placed.join(found, "tok").where((F.abs(F.col("other") - F.col("level")) <= span) & ((F.col("c1") != F.col("comp")) | (F.col("c2") != F.col("comp"))))
        counts = met.groupBy("rid", "n", "other").agg(F.count("*").alias("c")).where(F.col("c") >= F.least(first, second))
        return rows.join(scratch.put(counts.select("rid").distinct(), "stay"), "rid", "left_semi")

    # the few documents in groups of several are told by a table; every other one is a group of its own
    matrix = reps.join(slim(groups).select(F.col("v").alias("rid"), "comp"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    cells = shared_cells(matrix.select("comp", F.explode("prefix").alias("tok")))
    entries = scratch.put(qualifying(_crossing(matrix, bitmap(cells), similarity), cells), "entries")
    scratch.release()
    # groups whose entries cannot add up to a link are closed, which may close others
    size = entries.count()
    before = 2 * size
    while 0 < size < 0.8 * before:
        last, before = entries, size
        rows = scratch.put(sized(entries), "sized")
        entries = scratch.put(qualifying(rows, shared_cells(rows)), "entries")
        scratch.drop(last, rows)
        size = entries.count()
    if size:
        links = links.unionByName(_opened(texts, entries, scratch, k, similarity))
        groups = components(scratch.put(links, "links"), scratch)

    named = classes.join(slim(groups).select(F.col("v").alias("rep"), "comp"), "rep", "left").select("f1", "f2", "least", F.coalesce("comp", "rep").alias("comp"))
    names = scratch.put(named.groupBy("comp").agg(F.min("least").alias("component_id")), "names")
    final = scratch.put(named.join(names, "comp").select("f1", "f2", "comp", "component_id"), "final")
    linked = profiles.where("n > 0").join(final, ["f1", "f2"]).select("rid", F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "comp")
    empty = profiles.where("n = 0").select("rid", F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.col("rid").alias("comp"))
    return linked.unionByName(empty)


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of edges that connect what all edges (a, b) connect, fewer than there are vertices."""
    ends = np.stack([np.minimum(a, b), np.maximum(a, b)])
    _, fresh = np.unique(ends, axis=1, return_index=True)
    _, ends = np.unique(ends[:, fresh], return_inverse=True)
    ends = ends.reshape(2, -1)
    up, kept = list(range(int(ends.max(initial=-1)) + 1)), []

    def root(v: int) -> int:
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    for i, x, y in zip(fresh.tolist(), *ends.tolist()):
        x, y = root(x), root(y)
        if x != y:
            up[y] = x
            kept.append(i)
    return np.array(kept, np.int64)


def _telling(entries: DataFrame, scratch: Scratch, similarity: int) -> DataFrame:
    """(rid, tok, f): the entries by which documents of different groups that link are sure to meet, f the first
    document with that entry.

    Two such documents share at least ``at_least`` of the entries left to either. By one order of all entries, the
    rarest of what they share has that many less one after it in both, so either may leave out so many of its most
    frequent ones. Counts are exact here, other than those of the sketch, which orders the shingles of all documents.
    """
    often = scratch.put(entries.groupBy("tok").agg(F.count("*").alias("f")), "often")
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.col("f").desc(), F.col("tok").desc()))
    rare = entries.join(often, "tok").withColumn("rank", rank).where(F.col("rank") >= _bounds(similarity)[1])
    rare = scratch.put(rare.select("rid", "comp", "tok"), "rare")
    first = rare.groupBy("tok").agg(F.min("rid").alias("f"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2")
    return rare.select("rid", "tok").join(scratch.put(first.select("tok", "f"), "first"), "tok")


def _opened(texts: DataFrame, entries: DataFrame, scratch: Scratch, k: int, similarity: int) -> DataFrame:
    """Links that connect all groups that common entries still connect and that have a link.

    Documents that their telling entries connect form a cluster. A large group of a cluster is cut into blocks of its own, all
    small ones share blocks; each pair of blocks that does not lie in one group goes to a task of its own, which
    counts the common shingles of its pairs in a matrix and gives out links that connect the groups that any connect.
    """
    scratch.release()
    # a document meets the least of its firsts, and that one the others: as connected, and few edges in groups alike
    met = _telling(entries, scratch, similarity).groupBy("rid", "f").agg(F.lit(1)).withColumn("m", F.min("f").over(Window.partitionBy("rid")))
    ends = F.array(F.struct(F.col("rid").alias("a"), F.col("m").alias("b")), F.struct(F.col("f").alias("a"), F.col("m").alias("b")))
    edges = met.select(F.explode(ends).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
    clusters = components(scratch.put(edges, "edges"), scratch).select(F.col("v").alias("rid"), F.col("comp").alias("cluster"))
    members = scratch.put(entries.select("rid", "n", "comp").distinct().join(clusters, "rid"), "members")

    def blocks(rows: str, shingles: str):
        return F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")

    parts = members.groupBy("cluster", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("words")).withColumn("large", blocks("rows", "words") > 1)
    owner = F.when(F.col("large"), F.col("comp")).otherwise(F.lit(-1))
    parts = scratch.put(parts.withColumn("owner", owner), "parts")
    cut = scratch.put(parts.groupBy("cluster", "owner").agg(F.sum("rows").alias("rows"), F.sum("words").alias("words")).select("cluster", "owner", blocks("rows", "words").alias("blocks")), "cut")
    block = F.xxhash64("cluster", "owner", "i")
    own = cut.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", "owner", block.alias("x"))
    other = own.select("cluster", F.col("owner").alias("owner2"), F.col("x").alias("y"))
    pairs = own.join(other, "cluster").where("(x < y AND owner <> owner2) OR (x <= y AND owner = -1 AND owner2 = -1)").select("x", "y")
    pairs = scratch.put(pairs.withColumn("pair", F.monotonically_increasing_id()), "block_pairs")
    sides = pairs.select("pair", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    placed = members.join(parts.select("cluster", "comp", "owner"), ["cluster", "comp"]).join(cut, ["cluster", "owner"]).withColumn("i", F.pmod(F.xxhash64("rid"), "blocks").cast("int"))
    placed = scratch.put(placed.select("rid", "n", "comp", block.alias("block")), "placed")
    rows = scratch.put(_needed(texts, placed), "rows")
    dealt = rows.join(sides, "block").select("pair", "block", "rid", "n", "comp", "text")

    def compare(found):
        import pyarrow as pa

        order = np.argsort(found.column("block").to_numpy(), kind="stable")
        found = found.take(pa.array(order))
        rid, n, comp, side = (found.column(c).to_numpy() for c in ("rid", "n", "comp", "block"))
        middle = int(np.searchsorted(side, side[-1], "left"))  # 0: a block with itself
        owner, token = [], []
        for first, sizes, words in hashed_words(text_bytes(found.column("text").combine_chunks())):
            text, value = shingles(sizes, words, k)
            owner.append(text + first)
            token.append(value)
        owner, (_, token, times) = np.concatenate(owner), np.unique(np.concatenate(token), return_inverse=True, return_counts=True)
        owner, token = owner[times[token] > 1], token[times[token] > 1]  # what one document has alone counts in n
        kinds, token = np.unique(token, return_inverse=True)
        left = len(rid) if middle == 0 else middle
        common = np.zeros((left, len(rid) - middle), np.float32)
        by = np.argsort(token, kind="stable")
        for at in range(0, len(kinds), 2048):
            lo, hi = np.searchsorted(token[by], (at, at + 2048))
            part = np.zeros((len(rid), 2048), np.float32)
            part[owner[by[lo:hi]], token[by[lo:hi]] - at] = 1
            common += part[:left] @ part[middle:].T
        a, b = np.nonzero(np.triu(common, 1) if middle == 0 else common)
        both = common[a, b].astype(np.int64)
        b = b + middle
        keep = (comp[a] != comp[b]) & (100 * both >= similarity * (n[a] + n[b] - both))
        a, b = a[keep], b[keep]
        one = _forest(comp[a], comp[b])
        return pa.table([pa.array(rid[a[one]]), pa.array(rid[b[one]])], names=["a", "b"])

    return scratch.put(dealt.groupBy("pair").applyInArrow(compare, "a long, b long"), "more")


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid", "comp")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s AS x JOIN s AS y USING (s) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM inter JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach AS r JOIN both_ways AS e ON e.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) AS c USING (doc_id)
"""
