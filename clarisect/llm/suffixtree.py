"""Language-model scores from a probabilistic suffix tree over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import numbered, slim
from .shared import BATCH, STEP, Scratch, bitmap, flat, give_back, hashed_words, in_bitmap, lean, mix64, text_bytes

#: Longest context, in words.
DEPTH = 2
#: Uses from which a context may be a state, and a next word has a figure of its own, whatever the input's size.
LEAST_USES = 2
#: Nats by which a state's next-word distribution must diverge from its parent's: per word, and over all its uses.
LEAST_DIVERGENCE, LEAST_EVIDENCE = 0.01, 16.0
#: Words, and longer sequences, whose figures are broadcast, most frequent first; all others are looked up by a join.
HEAD_WORDS = 400_000
#: Bits that tell which contexts and sequences may be looked up; more of them only make the filter idle.
MARK_BITS = 27
#: Bits that tell which contexts are states; fewer let more other contexts through, which are then listed.
STATE_BITS = 25
#: Places of a text that a task gathers before it gives out its sums, and places that one part of a table stands for,
#: about: the memory of a task, whatever the input's size.
GATHERED, PART_PLACES = 1 << 20, 1 << 20
#: Sequences of a part that meet its figures at once.
MEETING = 1 << 18
#: Parts of the figures' table at least, so that small tables are dealt like larger ones.
LOOKUP_PARTS = 24
#: Keys of the places before and after a text's words.
BEGIN, STOP = np.uint64(0x6A09E667F3BCC909), np.uint64(0x3C6EF372FE94F82B)
TEXTS, WORDS = 0, 1


class Sums:
    """Counts by key, merged now and then so that memory stays near the number of different keys."""

    def __init__(self, limit: int = 1 << 21):
        self.limit, self.keys, self.counts, self.pending, self.size = limit, np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.pending.append(np.unique(keys, return_counts=True))
        self.size += len(self.pending[-1][0])
        if self.size > self.limit:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.pending]])
        counts = np.concatenate([self.counts, *[n for _, n in self.pending]])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.pending, self.size = [], 0

    def taken(self):
        """All sums, in batches of rows; starts anew."""
        self.merge()
        keys, counts = self.keys, self.counts
        self.keys, self.counts = self.keys[:0], self.counts[:0]
        for at in range(0, len(keys), 1 << 17):
            yield keys[at : at + (1 << 17)].astype(np.int64), counts[at : at + (1 << 17)]


def _count_words(texts: DataFrame) -> DataFrame:
    """Word counts and the number of texts, each task's own sums first."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums, n = Sums(), 0

        def rows():
            for keys, counts in sums.taken():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), WORDS, np.int8)), pa.array(keys), pa.array(counts)], names=["kind", "key", "n"])

        for batch in batches:
            n += batch.num_rows
            for _, _, hashes in hashed_words(text_bytes(batch.column(0))):
                sums.add(hashes)
            if len(sums.keys) > 1 << 22:
                yield from rows()  # memory stays bounded; the shuffle completes the sums
        yield from rows()
        yield pa.RecordBatch.from_arrays([pa.array([TEXTS], pa.int8()), pa.array([0], pa.int64()), pa.array([n], pa.int64())], names=["kind", "key", "n"])

    return texts.mapInArrow(lean(run), "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class HashTable:
    """Open addressing over 64-bit keys, looked up a whole array at a time."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        at, left = self._home(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.slots[at[left]] < 0
            tried = left[free]
            self.slots[at[tried]] = tried
            left = left[self.slots[at[left]] != left]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for keys that are not there."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        at, left = self._home(keys), None
        while left is None or len(left):
            slot = self.slots[at]
            same = self.keys[slot] == (keys if left is None else keys[left])
            same &= slot >= 0
            if left is None:
                np.copyto(out, slot, where=same)
            else:
                out[left[same]] = slot[same]
            on = np.flatnonzero((slot >= 0) & ~same)
            left, at = on if left is None else left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


class Head:
    """Figures of the most frequent keys, known by heart."""

    def __init__(self, keys: np.ndarray, *figures: np.ndarray):
        self.keys, self.figures = keys, figures

    def __reduce__(self):
        return Head, (self.keys, *self.figures)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = HashTable(self.keys)
        return self._table.find(hashes)


def sequences(sizes: np.ndarray, words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each place of a run of texts, beginnings and ends included: its text, its number in it, and the keys of
    the sequences of 1, 2, ... words that end there, valid from the place at which that many have passed."""
    n = len(sizes)
    stream = np.full(len(words) + 2 * n, BEGIN, np.uint64)
    ends = np.cumsum(sizes + 2)
    stream[np.arange(len(words)) + 2 * np.repeat(np.arange(n), sizes) + 1] = words
    stream[ends - 1] = STOP
    owner = np.repeat(np.arange(n), sizes + 2)
    place = np.arange(len(stream)) - (ends - sizes - 2)[owner]
    keys = [stream]
    for _ in range(longest - 1):
        longer = np.zeros_like(stream)
        longer[1:] = mix64(keys[-1][:-1] * STEP + stream[1:])
        keys.append(longer)
    return owner, place, keys


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((mix64(keys ^ STEP) >> np.uint64(16)) % np.uint64(parts)).astype(np.int16 if parts < 1 << 15 else np.int32)


def _blobs(part: np.ndarray, columns: list[np.ndarray]):
    """(part, slices) of columns whose rows lie by part."""
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(part[lo]), [c[lo:hi] for c in columns]


def _together(part: np.ndarray, parts: int, *columns: np.ndarray) -> np.ndarray:
    """An order by part in which equal rows lie together, but for rows whose bits happen to be shared.

    The order decides only how well runs pack: a run that is cut in two says the same.
    """
    left = 64 - (parts - 1).bit_length()
    key = part.astype(np.uint64) << np.uint64(left) if left < 64 else np.zeros(len(part), np.uint64)
    width = left // len(columns)
    for column in columns:
        left -= width
        key |= (mix64(column) >> np.uint64(64 - width)) << np.uint64(left)
    return np.argsort(key)


def _by_pair(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """An order in which rows of one c, and in these rows of one x, lie together."""
    order = np.argsort(c)
    rank = np.zeros(len(c), np.uint64)
    rank[order[1:]] = np.cumsum(c[order[1:]] != c[order[:-1]], dtype=np.uint64)
    bits = max(1, int(rank.max(initial=0)).bit_length())
    key = (rank << np.uint64(64 - bits)) | (mix64(x) >> np.uint64(bits))
    order = np.argsort(key)
    key, x = key[order], x[order]
    shared = (key[1:] == key[:-1]) & (x[1:] != x[:-1])
    return np.lexsort((x[np.argsort(order)], c)) if shared.any() else order


def _in_batches(batch) -> list:
    """A PyArrow batch or table cut into batches near BATCH bytes: the executor's JVM holds one at a time."""
    at_once = max(1, batch.num_rows * BATCH // max(1, batch.nbytes))
    return [batch] if batch.num_rows <= at_once else [batch.slice(at, at_once) for at in range(0, batch.num_rows, at_once)]


def _count_grams(texts: DataFrame, d: int, marks: np.ndarray | None, hot: np.ndarray, parts: int, base: Head | None) -> DataFrame:
    """Grams of a context of d words and the word that follows: those with LEAST_USES, with the context's figures.

    Each task gives out its own sums, packed by parts of the contexts, so that a part has all grams of a context;
    those of the ``hot`` contexts (sorted), which have more uses than a part, are dealt over all parts. Columns: g
    (the gram), s (the gram without its first word), c (the context), u (the context without its first word), n; m,
    t, r: the context's uses, different next words with LEAST_USES, and uses before other words; n1: uses of the word
    where it is in ``base``. For a hot context these are null, and rows without g hold what a part has of them.
    """
    names = ("u", "j", "c", "k", "x", "n")  # suffixes, their contexts' number, contexts, their grams' number, words, uses

    def is_hot(c: np.ndarray) -> np.ndarray:
        if not len(hot):
            return np.zeros(len(c), bool)
        return hot[np.minimum(np.searchsorted(hot, c), len(hot) - 1)] == c

    def packed(gathered: list):
        import pyarrow as pa

        c, u, x = (np.concatenate(a) for a in zip(*gathered))
        gathered.clear()
        part, some = _part_of(c, parts), np.flatnonzero(is_hot(c))
        part[some] = _part_of(x[some], parts)
        order = _together(part, parts, *([u, c, x] if d > 1 else [c, x]))
        c, x = c[order], x[order]
        at = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (x[1:] != x[:-1]))) if len(c) else order
        n, order = np.diff(np.append(at, len(c))).astype(np.uint32), order[at]
        out = [[] for _ in range(7)]
        for p, (c, u, x, n) in _blobs(part[order], [c[at], u[order], x[at], n]) if len(at) else ():
            at = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            k, c, u = np.diff(np.append(at, len(c))).astype(np.uint32), c[at], u[at]
            at = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
            j = np.diff(np.append(at, len(u))).astype(np.uint32)
            for held, value in zip(out, (p, u[at].tobytes(), j.tobytes(), c.tobytes(), k.tobytes(), x.tobytes(), n.tobytes())):
                held.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(v, pa.binary()) for v in out[1:])], names=["part", *names])

    def run(batches: Iterator) -> Iterator:
        gathered, size = [], 0
        for batch in batches:
            for _, sizes, hashes in hashed_words(text_bytes(batch.column(0))):
                _, place, keys = sequences(sizes, hashes, d)
                at = np.flatnonzero(place >= d)
                if marks is not None:
                    at = at[in_bitmap(marks, keys[d - 1][at - 1])]
                gathered.append((keys[d - 1][at - 1], keys[d - 2][at - 1] if d > 1 else np.zeros(len(at), np.uint64), keys[0][at]))
                size += len(at)
                if size >= GATHERED:
                    yield from _in_batches(packed(gathered))
                    gathered, size = [], 0
        if size:
            yield from _in_batches(packed(gathered))

    def merge(found):
        import pyarrow as pa

        u, j, c, k, x, n = (flat(found.column(name), np.uint32 if name in "jkn" else np.uint64) for name in names)
        c, u = np.repeat(c, k), np.repeat(np.repeat(u, j), k)
        order = _by_pair(c, x)
        c, u, x, n = c[order], u[order], x[order], n[order].astype(np.int64)
        at = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (x[1:] != x[:-1])))
        c, u, x, n = c[at], u[at], x[at], np.add.reduceat(n, at)
        first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(c))))
        keep = n >= LEAST_USES
        m, t = np.add.reduceat(n, first), np.add.reduceat(keep.astype(np.int64), first)
        r = m - np.add.reduceat(np.where(keep, n, 0), first)
        split = is_hot(c[first])
        own, whole = of[keep], split[of[keep]]
        c1, u1, x1 = c[keep], u[keep], x[keep]
        g, s = mix64(c1 * STEP + x1), x1 if d == 1 else mix64(u1 * STEP + x1)
        n1, known = np.zeros(len(g)), np.zeros(len(g), bool)
        if base is not None:
            there = base.find(x1)
            known = there >= 0
            n1 = base.figures[0][np.maximum(there, 0)]
        h = np.flatnonzero(split)

        def column(values: np.ndarray, gone: np.ndarray | None, more: np.ndarray | None) -> pa.Array:
            """Values of the grams, null where ``gone``, then of the hot contexts, null without."""
            values = pa.array(values.astype(np.int64), mask=gone)
            return pa.concat_arrays([values, pa.nulls(len(h), pa.int64()) if more is None else pa.array(more.astype(np.int64))])

        columns = {"g": column(g, None, None), "s": column(s, None, None), "c": column(c1, None, c[first][h]), "u": column(u1, None, u[first][h]), "n": column(n[keep], None, None)}
        columns |= {name: column(v[own], whole, v[h]) for name, v in (("m", m), ("t", t), ("r", r))} | {"n1": column(n1, ~known, None)}
        return pa.concat_tables(_in_batches(pa.table(columns)))

    def merged(found):
        try:
            return merge(found)
        finally:
            give_back()

    dealt = texts.mapInArrow(lean(run), "part int, u binary, j binary, c binary, k binary, x binary, n binary")
    return dealt.groupBy("part").applyInArrow(merged, "g long, s long, c long, u long, n long, m long, t long, r long, n1 long")


def _grow(training: DataFrame, words: DataFrame, total: int, texts: int, below: float, head: Head, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """Written tables of contexts, where ``own`` tells the states, and of their grams, by context length from 1.

    A context is a state if it has LEAST_USES, its next-word distribution diverges enough from its suffix's, and the
    most that its uses could gain, n ln(m / n) nats for n uses and m of its suffix, reaches the evidence; so are all
    suffixes of a state. The distributions are compared over the next words with LEAST_USES and all others as one.
    Longer contexts are counted only where they can be states; their suffixes have e times the evidence in uses, so
    nothing that decides is left out.

    A state gives a word it has seen LEAST_USES times n / (m + t), of m uses and t such words, and every word besides
    its suffix's probability times what is left; the shortest states' suffix is the base score. Grams have p, so
    smoothed; states have fall, the log10 of what is left.
    """
    parts = -(-max(1, total) // PART_PLACES)
    stop = int(STOP)
    ends = training.sparkSession.range(1 if texts else 0).select(F.lit(stop).cast("long").alias("s"), F.lit(texts).cast("long").alias("n1"))
    up = words.select(F.col("word").alias("s"), F.col("n").alias("n1")).unionByName(ends)
    scale = F.lit(10.0**below)
    tables, contexts, marks, known = [], [], None, None
    for d in range(1, DEPTH + 1):
        uses = words.select(F.col("word").alias("c"), "n") if d == 1 else tables[-1].select(F.col("g").alias("c"), "n")
        crowded = uses.where(F.col("n") > PART_PLACES // 4).select("c").collect()  # at most four for each part
        hot = np.sort(np.array([r["c"] for r in crowded] + ([int(BEGIN)] if d == 1 else []), np.int64).astype(np.uint64))
        counted = scratch.put(_count_grams(training, d, marks, hot, parts, head if d == 1 else None), "counted")
        scratch.release()
        sums = counted.where("g is null").groupBy("c").agg(*[F.sum(x).alias(f"h{x}") for x in "mtr"])
        grams = counted.where("g is not null").join(F.broadcast(sums), "c", "left").select("g", "s", "c", "u", "n", "n1", *[F.coalesce(x, f"h{x}").alias(x) for x in "mtr"])
        if d == 1:
            rare = grams.where("n1 is null").drop("n1").join(up, "s")
            met = grams.where("n1 is not null").unionByName(rare).withColumn("p1", (F.col("n1") + F.lit(0.1)) / scale).withColumn("m1", F.lit(total).cast("long"))
        else:
            met = grams.drop("n1").join(known, "s")
        may = F.col("m") * F.log(F.col("m1") / F.col("m")) >= LEAST_EVIDENCE - 1e-6
        share = (F.col("r") + F.col("t")) / (F.col("m") + F.col("t"))
        tables.append(scratch.put(met.withColumn("p", F.col("n") / (F.col("m") + F.col("t")) + share * F.col("p1")).drop("s"), "grams"))
        scratch.drop(counted)
        rest = F.greatest(F.lit(1e-12), 1 - F.sum("p1"))
        m, r = F.min("m"), F.min("r")
        evidence = F.sum(F.col("n") * F.log(F.col("n") / (F.col("m") * F.col("p1")))) + F.when(r > 0, r * F.log(r / m / rest)).otherwise(0.0)
        found = tables[-1].groupBy("c").agg(m.alias("m"), F.min("t").alias("t"), r.alias("r"), F.min("u").alias("u"), F.min("m1").alias("m1"), evidence.alias("e"))
        own = may & (F.col("e") >= LEAST_EVIDENCE) & (F.col("e") >= LEAST_DIVERGENCE * F.col("m"))
        contexts.append(scratch.put(found.select("c", "m", "u", F.log10(share).alias("fall"), own.alias("own")), "contexts"))
        scratch.release()
        known = tables[-1].select(F.col("g").alias("s"), F.col("n").alias("n1"), F.col("p").alias("p1"), F.col("m").alias("m1"))
        longer = F.col("n") * F.log(F.col("n1") / F.col("n")) >= LEAST_EVIDENCE - 1e-6
        if d + 1 < DEPTH:
            longer = longer | (F.col("n") >= int(LEAST_EVIDENCE * np.e))
        if d < DEPTH:
            marks = bitmap(tables[-1].where(longer).select("g"), MARK_BITS)
    judged, longer = [], None
    for found in contexts[::-1]:
        if longer is not None:
            found = found.join(longer.select(F.col("u").alias("c")).distinct().withColumn("up", F.lit(True)), "c", "left").withColumn("own", F.col("own") | F.coalesce("up", F.lit(False)))
        judged.append(scratch.put(found.select("c", "m", "u", "fall", "own"), "states"))
        longer = judged[-1].where("own")
    return judged[::-1], tables


def _of_states(grams: DataFrame, judged: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``grams`` whose context c is a state.

    A bit map of the states lets few other contexts through; these are listed and taken out. So a table of sequences
    is dealt by its contexts only where the list is long.
    """
    marks = bitmap(judged.where("own").select("c"), STATE_BITS)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(marks, batch.column("c").to_numpy())))

    others = scratch.put(judged.where("not own").select("c").mapInArrow(run, "c long"), "others")
    return grams.mapInArrow(run, grams.schema).join(slim(others), "c", "left_anti")


def _head(table: DataFrame, key: str, room: int) -> DataFrame:
    """The rows of the greatest n, from 2, that fit the room; equal counts are taken or left together."""
    least, fit = 2, 0
    for r in table.where("n > 1").groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).toLocalIterator():
        if fit + r["c"] > room:
            least = r["n"] + 1
            break
        fit += r["c"]
    return table.where(F.col("n") >= least).toArrow().sort_by(key)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))


def _looked_up(rows: DataFrame, figures: DataFrame, head: Head, marks: np.ndarray, parts: int) -> DataFrame:
    """(rid, gain): the sum of the figures of a text's sequences, over several rows a text.

    Sequences that may have a figure and are not in the head are packed by parts of their keys and meet the part's
    figures there.
    """

    def packed(gathered: list, sums: list, turn: int):
        import pyarrow as pa

        rid, key = (np.concatenate(a) for a in zip(*gathered))
        part, out = _part_of(key, parts), [[] for _ in range(5)]

        def put(p: int, rid: np.ndarray, k: np.ndarray, key: np.ndarray, gain: np.ndarray) -> None:
            for held, value in zip(out, (p, rid.tobytes(), k.astype(np.uint32).tobytes(), key.tobytes(), gain.tobytes())):
                held.append(value)

        order = np.argsort(part, kind="stable")
        for p, (r, x) in _blobs(part[order], [rid[order], key[order]]) if len(key) else ():
            at = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            put(p, r[at], np.diff(np.append(at, len(r))), x, np.zeros(len(at)))
        own, gain = (np.concatenate(a) for a in zip(*sums))
        put(turn % parts, own, np.zeros(len(own)), key[:0], gain)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(v, pa.binary()) for v in out[1:])], names=["part", "rid", "k", "key", "gain"])

    def run(batches: Iterator) -> Iterator:
        gathered, sums, size, turn = [], [], 0, 0
        for batch in batches:
            rids = batch.column(0).to_numpy()
            for first, sizes, hashes in hashed_words(text_bytes(batch.column(1))):
                text, place, keys = sequences(sizes, hashes, DEPTH + 1)
                at, key = [], []
                for k in range(1, DEPTH + 1):  # sequences of k + 1 words
                    here = np.flatnonzero(place >= k)
                    value = keys[k][here]
                    may = in_bitmap(marks, value)
                    at.append(text[here[may]])
                    key.append(value[may])
                at, key = np.concatenate(at), np.concatenate(key)
                there = head.find(key)
                hit = there >= 0
                sums.append((rids[first : first + len(sizes)], np.bincount(at[hit], head.figures[0][there[hit]], len(sizes))))
                at, key = at[~hit], key[~hit]
                order = np.argsort(at, kind="stable")
                gathered.append((rids[first + at[order]], key[order]))
                size += len(at) + len(sizes)
                if size >= GATHERED:
                    yield from _in_batches(packed(gathered, sums, turn))
                    gathered, sums, size, turn = [], [], 0, turn + 1
        if sums:
            yield from _in_batches(packed(gathered, sums, turn))

    def meet(lookups, table):
        import pyarrow as pa

        kinds = {"rid": np.int64, "k": np.uint32, "key": np.uint64, "gain": np.float64}
        rid, k, key, gain = (flat(lookups.column(c), kind) for c, kind in kinds.items())
        own, first = np.unique(flat(table.column("key"), np.uint64), return_inverse=True)
        value = np.bincount(first, flat(table.column("v"), np.float64), len(own)) if len(own) else np.zeros(0)
        ends = np.zeros(len(key) + 1)
        for lo in range(0, len(key) if len(own) else 0, MEETING):
            asked = key[lo : lo + MEETING]
            order = np.argsort(asked)  # near keys are near in the table
            asked = asked[order]
            at = np.minimum(np.searchsorted(own, asked), len(own) - 1)
            ends[lo + 1 + order] = np.where(own[at] == asked, value[at], 0.0)
        np.cumsum(ends, out=ends)
        stops = np.cumsum(k.astype(np.int64))
        names, of = np.unique(rid, return_inverse=True)
        return pa.table({"rid": names, "gain": np.bincount(of, gain + ends[stops] - ends[stops - k], len(names)) if len(names) else np.zeros(0)})

    def met(lookups, table):
        try:
            return meet(lookups, table)
        finally:
            give_back()

    lookups = rows.select("rid", "text").mapInArrow(lean(run), "part int, rid binary, k binary, key binary, gain binary")
    parted = figures.mapInArrow(lean(_parted(parts)), "part int, key binary, v binary")
    return lookups.groupBy("part").cogroup(parted.groupBy("part")).applyInArrow(met, "rid long, gain double")


def _parted(parts: int):
    """Figures packed by parts of their keys."""

    def packed(gathered: list):
        import pyarrow as pa

        key, v = (np.concatenate(a) for a in zip(*gathered))
        part = _part_of(key, parts)
        order = np.argsort(part, kind="stable")
        found = [(p, k.tobytes(), x.tobytes()) for p, (k, x) in _blobs(part[order], [key[order], v[order]])] if len(key) else []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["part", "key", "v"])

    def run(batches: Iterator) -> Iterator:
        gathered, size = [], 0
        for batch in batches:
            gathered.append((batch.column("key").to_numpy().view(np.uint64), batch.column("v").to_numpy()))
            size += batch.num_rows
            if size >= GATHERED:
                yield from _in_batches(packed(gathered))
                gathered, size = [], 0
        if size:
            yield from _in_batches(packed(gathered))

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, head_words: int = HEAD_WORDS) -> DataFrame:
    """Trains on the texts that are not held out and scores all texts.

    Tokens are lower-cased words and one end per text; each word is a symbol of its own. The tree predicts the
    next word from the longest suffix of the text so far that is a state. A state multiplies the suffix's
    probability of any word by its fall, and of the words it has seen by a gain besides; so a score is the
    base score and one figure for each sequence of up to DEPTH + 1 words in the text. Figures are in written
    tables and meet the sequences' 64-bit keys in parts; those of the most frequent sequences (``head_words`` at
    most, and as many words) are broadcast, which changes no score. An unknown word, as in the base score, is one
    token however it is spelled. Word counts cover every training text.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mean_gain``, one row per input
    row; ``mean_gain`` is what the tree adds to the base score for each token, high for texts that the corpus repeats.
    A null text counts as empty and has one token, the end; a null id counts as training; repeated rows are
    ordinary; an empty table gives an empty result; further columns are not returned.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixtree")
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), (held if held is not None else held_out(id_col)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), scratch)
    training = rows.where(~F.col("held_out")).select("text")
    counts = scratch.put(_count_words(training), "words")
    sums = {r["kind"]: (r["kinds"], r["n"]) for r in counts.groupBy("kind").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect()}
    (kinds, tokens), trained = sums.get(WORDS, (0, 0)), sums.get(TEXTS, (0, 0))[1]
    words = counts.where(F.col("kind") == WORDS).select(F.col("key").alias("word"), "n")
    total, types = tokens + trained, kinds + (1 if trained else 0)
    below = float(np.log10(total + 0.1 * (types + 1))) if total else 0.0

    def arrays(table, key: str, *names: str) -> Head:
        keys, of = np.unique(table.column(key).to_numpy().view(np.uint64), return_inverse=True)
        return Head(keys, *[np.bincount(of, table.column(x).to_numpy(), len(keys)) if len(keys) else np.zeros(0) for x in names])

    frequent = _head(words, "word", head_words)
    judged, grams = _grow(training, words, total, trained, below, arrays(frequent, "word", "n"), scratch)
    states = [x.where("own") for x in judged]
    falls = states[0].select(F.col("c").alias("word"), "fall")
    words = scratch.put(words.join(slim(falls), "word", "left").select("word", "n", F.coalesce("fall", F.lit(0.0)).alias("fall")), "falls")
    begun = falls.where(F.col("word") == F.lit(int(BEGIN))).first()
    begun = begun["fall"] if begun else 0.0
    figures = [s.select(F.col("c").alias("key"), F.col("m").alias("n"), F.col("fall").alias("v")) for s in states[1:]]
    for s, g in zip(judged, grams):
        gain = F.log10(1 + F.col("n") / ((F.col("r") + F.col("t")) * F.col("p1")))
        figures.append(_of_states(g.select("c", F.col("g").alias("key"), "n", gain.alias("v")), s, scratch).drop("c"))
    union = figures[0]
    for f in figures[1:]:
        union = union.unionByName(f)
    figures = scratch.put(union, "figures")
    scratch.drop(*grams)
    scratch.release()
    head = arrays(_head(words, "word", head_words), "word", "n", "fall")
    gains = _looked_up(rows, figures.select("key", "v"), arrays(_head(figures, "key", head_words), "key", "v"), bitmap(figures.select("key"), MARK_BITS), max(LOOKUP_PARTS, -(-total // (4 * PART_PLACES))))
    gains = scratch.put(gains.groupBy("rid").agg(F.sum("gain").alias("gain")), "gains")
    scratch.release()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        base_logs, end_log = np.log10(head.figures[0] + 0.1) - below, np.log10(trained + 0.1) - below
        for batch in batches:
            n_tokens, n_seen, base, fall, tail, left = [], [], [], [], [], []
            for _, sizes, hashes in hashed_words(text_bytes(batch.column(1))):
                found = head.find(hashes)
                seen = found >= 0
                owner = np.repeat(np.arange(len(sizes)), sizes)
                base.append(np.bincount(owner[seen], base_logs[found[seen]], len(sizes)) + end_log)
                fall.append(np.bincount(owner[seen], head.figures[1][found[seen]], len(sizes)) + begun)
                n_tokens.append(sizes + 1)
                n_seen.append(np.bincount(owner[seen], minlength=len(sizes)))
                tail.append(hashes[~seen].astype(np.int64))
                left.append(sizes - n_seen[-1])

            def flat(x: list, kind) -> pa.Array:
                return pa.array(np.concatenate(x) if x else np.zeros(0), kind)

            tails = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(left) if left else [])), pa.int32()), flat(tail, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 2, 3)), flat(n_tokens, pa.int64()), flat(n_seen, pa.int64()), flat(base, pa.float64()), flat(fall, pa.float64()), tails], names=["rid", "doc_id", "held_out", "n_tokens", "seen", "base", "fall", "tail"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = scratch.put(rows.select("rid", "text", "doc_id", "held_out").mapInArrow(lean(run), f"rid long, doc_id {kind}, held_out boolean, n_tokens long, seen long, base double, fall double, tail array<long>"), "scored")
    rare = scored.select("rid", F.explode("tail").alias("word")).groupBy("rid", "word").agg(F.count("*").alias("times"))
    count = F.coalesce(F.col("n"), F.lit(0))
    tails = (
        rare.join(words, "word", "left").groupBy("rid")
        .agg(F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * (F.log10(count + F.lit(0.1)) - F.lit(below))).alias("rest"), F.sum(F.col("times") * F.coalesce("fall", F.lit(0.0))).alias("rest_fall"))
    )
    end_known = 1 if trained else 0
    base_score = F.col("base") + F.coalesce("rest", F.lit(0.0))
    added = F.col("fall") + F.coalesce("rest_fall", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))
    return scored.drop("tail").join(tails, "rid", "left").join(gains, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("more", F.lit(0)) + end_known).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), base_score.alias("base_score"), (base_score + added).alias("score"), (added / F.col("n_tokens")).alias("mean_gain"),
    )


def op5_suffix_tree_scores(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
