"""Long repeated byte strings, found from a cover of sampled positions and their names.

Two equal strings of ``length`` bytes hold the same sampled position: the one whose ``gram``-byte string has the
least hash among those inside. So the sampled positions, about one in a hundred bytes, cover every comparison that
matters, as the residues of a difference cover do for suffixes, with fewer of them. Names (128-bit fingerprints) of
the strings around sampled positions are sorted and counted; only stretches whose surroundings are partly alike are
named again in smaller nodes, down to single start positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import numbered
from ..sources.scratch import slim
from .shared import BYTE, STEP, STEP_INVERSE, Scratch, bitmap, hashed_words, in_bitmap, mix64, powers, text_bytes

LENGTH = 400
GRAM = 200
#: Start positions in a node of the first round; the second round has single ones.
NODE = 16
#: Bytes of a text handled at once.
PART = 2 << 20
#: Words of a passage that is reported however few bytes it has, and of the strings compared for it.
PASSAGE, PASSAGE_GRAM = 50, 40


class Prefix:
    """Hashes of any stretch of some bytes."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE[raw] * powers(STEP, len(raw), "up"), dtype=np.uint64, out=self.sums[1:])
        self.down = powers(STEP_INVERSE, len(raw) + 1, "down")

    def of(self, lo, hi) -> np.ndarray:
        return mix64((self.sums[hi] - self.sums[lo]) * self.down[lo])


def sampled(data: bytes, length: int, gram: int) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Sampled positions of one part of a text.

    Returns the runs of starts that share a sampled position, as arrays (first start, steps from it to the
    sampled position, further starts, hash of the gram, hash of the whole stretch), and ranges of starts whose
    strings repeat inside this part.
    """
    count, width = len(data) - length + 1, length - gram + 1
    h = Prefix(data)
    grams = h.of(np.arange(len(data) - gram + 1), np.arange(gram, len(data) + 1))
    padded = np.concatenate([grams, np.full(-len(grams) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(first[1:], count) - 1
    # where in the window the least gram stands; a run with several places (a period) is taken start by start
    value = least[first]
    ends = last + width - 1
    at, several = _places(grams, first, ends, value)
    local: list[tuple[int, int]] = []
    extra: list[np.ndarray] = []
    for r in np.flatnonzero(several):
        starts = np.arange(first[r], last[r] + 1)
        _, back, inverse, n = np.unique(h.of(starts, starts + length), return_index=True, return_inverse=True, return_counts=True)
        own = starts[n[inverse] > 1]
        if len(own):
            cut = np.flatnonzero(np.diff(own) > 1)
            local += list(zip(own[np.append(0, cut + 1)].tolist(), own[np.append(cut, len(own) - 1)].tolist()))
        kept = starts[np.sort(back)]
        where = np.flatnonzero(grams[first[r] : ends[r] + 1] == value[r]) + first[r]
        extra.append(np.stack([kept, where[np.searchsorted(where, kept)] - kept, np.zeros(len(kept), np.int64)]))
    one = ~several
    runs = np.concatenate([np.stack([first[one], at[one] - first[one], last[one] - first[one]]), *extra], axis=1)
    begin, step, more = runs
    return [begin, step, more, grams[begin + step], h.of(begin, begin + more + length)], local


def _places(grams: np.ndarray, first: np.ndarray, ends: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each run's least gram from its first start on, and whether the run holds several."""
    spots = np.flatnonzero(np.isin(grams, value))
    order = np.lexsort((spots, grams[spots]))
    spots = spots[order]
    keys = grams[spots]
    lo, hi = np.searchsorted(keys, value, "left"), np.searchsorted(keys, value, "right")
    at, several = spots[lo], np.zeros(len(first), bool)
    for r in np.flatnonzero(hi - lo > 1):
        mine = spots[lo[r] : hi[r]]
        a, b = np.searchsorted(mine, first[r]), np.searchsorted(mine, ends[r], "right")
        at[r], several[r] = mine[a], b - a > 1
    return at, several


def _anchors(rows: DataFrame, length: int, gram: int, part: int) -> DataFrame:
    """A row per text: ``rid``, its runs as arrays, and the ranges of starts that repeat inside."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ("p", "x", "more", "hk", "hu")
        for batch in batches:
            n, lists, ends, ranges, stops = 0, [[] for _ in names], [0], [[], []], [0]
            for text in text_bytes(batch.column(1)):
                for base in range(0, max(1, len(text) - length + 1), part):
                    data = text[base : base + part + length - 1]
                    if len(data) >= length:
                        found, local = sampled(data, length, gram)
                        n += len(found[0])
                        for k, x in enumerate(found):
                            lists[k].append(x + base if k == 0 else x.astype(np.int64))
                        for lo, hi in local:
                            ranges[0].append(lo + base)
                            ranges[1].append(hi + base)
                ends.append(n)
                stops.append(len(ranges[0]))
            columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())) for x in lists]
            columns += [pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(x, pa.int64())) for x in ranges]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["rid", *names, "lo", "hi"])

    return rows.mapInArrow(run, "rid long, p array<long>, x array<long>, more array<long>, hk array<long>, hu array<long>, lo array<long>, hi array<long>")


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """The bytes around each open run, cut from its text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = {k: [] for k in ("rid", "p", "x", "more", "hk", "n", "bytes")}
            for rid, text, runs in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()):
                for r in runs:
                    for k in ("p", "x", "more", "hk", "n"):
                        out[k].append(r[k])
                    out["rid"].append(rid)
                    out["bytes"].append(text[r["p"] : r["p"] + r["more"] + length])
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "bytes" else pa.int64()) for k, v in out.items()], names=list(out))

    return texts.mapInArrow(run, "rid long, p long, x long, more long, hk long, n long, bytes binary")


def _nodes(contexts: DataFrame, length: int, size: int, chosen: bool) -> DataFrame:
    """Nodes of ``size`` steps to the sampled position for each run: names of what all their strings share, and of all they span.

    With ``chosen`` only within the nodes of the larger size listed in the column ``parts``.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                h = Prefix(row["bytes"])
                low, high = row["x"] - row["more"], row["x"]  # steps of the last and the first start
                lo = np.arange(low // size, high // size + 1) * size
                if chosen:
                    lo = lo[np.isin(lo // NODE * NODE, [q["node"] for q in row["parts"]])]
                    wanted = {q["node"]: q["open"] for q in row["parts"]}
                hi = lo + size - 1
                # what all strings of the node share: it lies inside the run's bytes, as the run has one of them
                core = h.of(row["x"] - lo, row["x"] - hi + length)
                whole = (lo >= low) & (hi <= high)
                union = np.zeros(len(lo), np.uint64)
                union[whole] = h.of(row["x"] - hi[whole], row["x"] - lo[whole] + length)
                for k in range(len(lo)):
                    out.append((row["rid"], row["p"], row["x"], row["more"], row["hk"], row["n"], int(lo[k]), int(core[k].astype(np.int64)), int(union[k].astype(np.int64)) if whole[k] else None, wanted[int(lo[k]) // NODE * NODE] if chosen else True))
            columns = list(zip(*out)) or [[]] * 10
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:9]), pa.array(columns[9], pa.bool_())], names=["rid", "p", "x", "more", "hk", "n", "node", "core", "union", "open"])

    return contexts.mapInArrow(run, "rid long, p long, x long, more long, hk long, n long, node long, core long, union long, open boolean")


def repeated_starts(rows: DataFrame, scratch: Scratch, length: int, gram: int, part: int) -> DataFrame:
    """Ranges of starts (``rid, lo, hi``, inclusive) whose strings of ``length`` bytes also start elsewhere."""
    anchors = scratch.put(_anchors(rows, length, gram, part), "anchors")
    inside = anchors.select("rid", F.explode(F.arrays_zip("lo", "hi")).alias("r")).select("rid", "r.lo", "r.hi")
    every = anchors.select("rid", F.explode(F.arrays_zip("p", "x", "more", "hk", "hu")).alias("a")).select("rid", "a.*")
    # counts are written before they are joined, so that both sides of a join are dealt anew and hot keys can be split
    often = scratch.put(every.groupBy("hk").agg(F.count("*").alias("c")).where("c > 1").select("hk"), "often")
    candidates = scratch.put(every.join(often, "hk", "left_semi"), "candidates")
    groups = scratch.put(candidates.groupBy("hk", "hu").agg(F.count("*").alias("n"), F.min(F.struct("rid", "p", "x", "more")).alias("r")), "groups")
    alike = candidates.join(groups.where("n > 1").select("hk", "hu"), ["hk", "hu"], "left_semi").select("rid", F.col("p").alias("lo"), (F.col("p") + F.col("more")).alias("hi"))
    mixed = groups.groupBy("hk").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1 and least = 1").select("hk")
    open_runs = groups.join(mixed, "hk", "left_semi").select("r.*", "hk", "n")
    by_text = open_runs.groupBy("rid").agg(F.collect_list(F.struct("p", "x", "more", "hk", "n")).alias("runs"))
    contexts = scratch.put(_contexts(rows.join(by_text, "rid").select("rid", "text", "runs"), length), "contexts")

    nodes = scratch.put(_nodes(contexts, length, NODE, False), "nodes")
    shared = scratch.put(nodes.groupBy("hk", "node", "core").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "shared")
    equal = scratch.put(nodes.where("union is not null").groupBy("hk", "node", "union").agg(F.count("*").alias("c")).where("c > 1").drop("c").withColumn("settled", F.lit(True)), "equal")
    judged = scratch.put(nodes.drop("open").join(shared, ["hk", "node", "core"], "left_semi").join(equal, ["hk", "node", "union"], "left").withColumn("settled", F.coalesce("settled", F.lit(False)) | (F.col("n") > 1)), "judged")
    settled = judged.where("settled and n = 1").select(
        "rid", (F.col("p") + F.col("x") - F.least(F.col("node") + NODE - 1, F.col("x"))).alias("lo"),
        (F.col("p") + F.col("x") - F.greatest(F.col("node"), F.col("x") - F.col("more"))).alias("hi"),
    )
    unclear = judged.where("not settled").select("hk", "node", "core").distinct()
    again = judged.join(unclear, ["hk", "node", "core"], "left_semi")
    # of settled nodes that span equal bytes one stands for all
    partners = again.where("settled and union is not null").groupBy("hk", "node", "union").agg(F.min(F.struct("rid", "p")).alias("r")).select("r.rid", "r.p", "node", F.lit(False).alias("open"))
    partners = partners.unionByName(again.where("settled and union is null").select("rid", "p", "node", F.lit(False).alias("open"))).unionByName(again.where("not settled").select("rid", "p", "node", F.lit(True).alias("open")))
    parts = partners.groupBy("rid", "p").agg(F.collect_list(F.struct("node", "open")).alias("parts"))
    single = scratch.put(_nodes(contexts.join(parts, ["rid", "p"]), length, 1, True), "single")
    twice = scratch.put(single.groupBy("hk", "node", "core").agg(F.count("*").alias("c")).where("c > 1").select("hk", "node", "core"), "twice")
    start = F.col("p") + F.col("x") - F.col("node")
    one = single.where("open").join(twice, ["hk", "node", "core"], "left_semi").select("rid", start.alias("lo"), start.alias("hi"))
    return inside.unionByName(alike).unionByName(settled).unionByName(one)


def _least_grams(sizes: np.ndarray, words: np.ndarray, passage: int, gram: int) -> np.ndarray:
    """Places of the strings of ``gram`` words that are the least by hash in any run of ``passage`` words of a text."""
    if len(words) < passage:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(STEP, len(words), "up"), dtype=np.uint64, out=total[1:])
    starts = np.arange(len(words) - gram + 1)
    grams = mix64((total[gram:] - total[:-gram]) * powers(STEP_INVERSE, len(words) + 1, "down")[starts])
    width, count = passage - gram + 1, len(words) - passage + 1
    padded = np.concatenate([grams, np.full(-len(grams) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = owner[:count] == owner[passage - 1 :]
    found = np.zeros(len(grams), bool)
    for j in range(width):
        found[j : j + count] |= inside & (grams[j : j + count] == least)
    at = np.flatnonzero(found)
    return at, grams[at]


def repeated_passages(rows: DataFrame, scratch: Scratch, passage: int = PASSAGE, gram: int = PASSAGE_GRAM) -> DataFrame:
    """(rid, n_passage_words): words of a text in strings of ``gram`` words that also start elsewhere.

    Of each run of ``passage`` words the string with the least hash is compared, so every run of so many words that
    occurs elsewhere, in any case and with any white space, is seen; texts without any are not listed.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ends, places, keys = [np.zeros(1, np.int64)], [], []
            for _, sizes, words in hashed_words(text_bytes(batch.column(1))):
                at, key = _least_grams(sizes, words, passage, gram)
                stops = np.cumsum(sizes)
                owner = np.searchsorted(stops, at, side="right")
                places.append(at - (stops - sizes)[owner])
                keys.append(key.astype(np.int64))
                ends.append(ends[-1][-1] + np.cumsum(np.bincount(owner, minlength=len(sizes))))
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(x) if x else [], pa.int64())) for x in (places, keys)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["rid", "place", "key"])

    def pruned(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            key = batch.column(2).flatten()
            at = np.flatnonzero(in_bitmap(marks, key.to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)[at])), *(x.take(pa.array(at)) for x in (batch.column(1).flatten(), key))], names=["rid", "place", "key"])

    found = scratch.put(rows.select("rid", "text").mapInArrow(run, "rid long, place array<long>, key array<long>").where("size(key) > 0"), "passages")
    often = scratch.put(found.select(F.explode("key").alias("key")).groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "often")
    marks = bitmap(often)
    hits = found.mapInArrow(pruned, "rid long, place long, key long").join(often, "key", "left_semi")
    later = F.lead("place").over(Window.partitionBy("rid").orderBy("place"))
    words = hits.select("rid", "place").withColumn("words", F.coalesce(F.least(F.lit(gram), later - F.col("place")), F.lit(gram)))
    return scratch.put(words.groupBy("rid").agg(F.sum("words").alias("n_passage_words")), "passage_words")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int | None = None, part: int = PART, keep_text: bool = False) -> DataFrame:
    """Removes every byte covered by a string of ``length`` bytes that also starts anywhere else.

    Strings are judged on the input, within or across texts, never across the end of one. Returns ``doc_id,
    n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the remaining bytes, with ``keep_text``), one row
    per input row, and ``n_passage_words``: words in passages of PASSAGE words that occur elsewhere, which may have
    fewer bytes; of these nothing is removed. A null text counts as empty; null ids and repeated rows are ordinary, so a repeated row's
    long strings repeat; an empty table gives an empty result; further columns are not returned.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    gram = gram or max(1, length // 2)
    rows = numbered(docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).alias("id")), scratch)
    ranges = repeated_starts(rows.select("rid", "text"), scratch, length, gram, part)
    passages = repeated_passages(rows, scratch)
    scratch.release()
    per_text = scratch.put(ranges.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "ranges")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long" + (", kept binary" if keep_text else "")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            lists = batch.column(2)
            for i, text in enumerate(text_bytes(batch.column(1))):
                kept, removed, spans = [], 0, 0
                if lists[i].is_valid:
                    inner = lists[i].values
                    lo, hi = (inner.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    order = np.argsort(lo, kind="stable")
                    lo, end = lo[order], np.maximum.accumulate(hi[order] + length)
                    fresh = np.flatnonzero(np.append(True, lo[1:] > end[:-1]))
                    at = 0
                    for b, e in zip(lo[fresh].tolist(), end[np.append(fresh[1:], len(lo)) - 1].tolist()):
                        kept.append(text[at:b])
                        removed, spans, at = removed + e - b, spans + 1, e
                    kept.append(text[at:])
                    rest = b"".join(kept)
                else:
                    rest = text
                out.append((len(text), removed, spans, hashlib.sha256(rest).hexdigest(), *([rest] if keep_text else [])))
            columns = list(zip(*out)) or [[]] * (5 if keep_text else 4)
            first, *more = (pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))
            columns = [batch.column(0), first, *more[:3], batch.column(3), *more[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", *(["kept"] if keep_text else [])])

    met = rows.join(per_text, "rid", "left").join(slim(passages), "rid", "left")
    return met.select(F.col("id"), "text", "ranges", F.coalesce("n_passage_words", F.lit(0)).alias("n_passage_words")).mapInArrow(run, schema)


def op7_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
