"""Word hashing and small helpers used by the operators here."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch as Tables


#: Bytes of rows that go to a Python worker at once; Spark's own limit is sixteen times as much.
BATCH = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the memory of Python workers small, however long the texts are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") == "67108864b":
        spark.conf.set(key, f"{BATCH}b")


class Scratch(Tables):
    """Scratch tables of an operator, whose Python workers get small batches."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, name)
        bounded_batches(spark)


def give_back() -> None:
    """Hands the memory that this Python worker has freed to the system, which an idle worker would keep."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # only the GNU library has it
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, giving back its memory as a task ends."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def flat(column, kind) -> np.ndarray:
    """The numbers that the values of a PyArrow binary column without nulls hold, one value after another."""
    import pyarrow as pa

    held = [np.zeros(0, np.uint8)]
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk):
            _, offsets, data = chunk.buffers()
            offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            if offsets[-1] > offsets[0]:
                held.append(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]])
    return np.concatenate(held).view(kind)


#: Bits of a map that tells which keys a table may hold; more keys than bits only make the filter idle.
MAP_BITS = 24


def bitmap(keys: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """A bit map, of a fixed size, of a table's one column of 64-bit keys, by their upper bits; null keys set none.

    Each task sets its bits and gives out the stretches of the map that have some.
    """
    stretch = min(1 << 12, 1 << (bits - 3))

    def run(batches):
        import pyarrow as pa

        own = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            places = np.unique(batch.column(0).drop_null().to_numpy().view(np.uint64) >> np.uint64(64 - bits))
            at, bit = (places >> np.uint64(3)).astype(np.int64), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8)
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
            if len(at):
                own[at[first]] |= np.bitwise_or.reduceat(bit, first)
        rows = own.reshape(-1, stretch)
        some = np.flatnonzero(rows.any(axis=1))
        for i in range(0, len(some), 256):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 256], pa.int32()), pa.array([rows[k].tobytes() for k in some[i : i + 256]], pa.binary())], names=["bucket", "bits"])

    found = keys.select(F.col(keys.columns[0]).cast("long")).mapInArrow(run, "bucket int, bits binary").groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).collect()
    packed = np.zeros(1 << (bits - 3), np.uint8)
    for r in found:
        packed[r["bucket"] * stretch :][:stretch] = np.frombuffer(r["bits"], np.uint8)[:stretch]
    return packed


def in_bitmap(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key (64-bit integers) is set."""
    bit = keys.view(np.uint64) >> np.uint64(61 - (len(packed).bit_length() - 1))
    return (packed[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# ---- words as 64-bit hashes, vectorised over the bytes of many texts -------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_MIX = np.random.default_rng(20240229)
BYTE = _MIX.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_BYTE, _IN_WORD, _IN_ALNUM = BYTE[_LOWER], ~_SPACE, _ALNUM[_LOWER]
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes of text handled at once, so that the 64-bit temporaries stay near 10 MB each.
SLICE_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, n: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, 1024), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 2 * SLICE_BYTES:
            _powers[key] = have
    return have[:n]


def word_hashes(texts: list[bytes], alnum: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and the words' hashes, one text after another.

    Words are runs of bytes that are not white space, or with ``alnum`` runs of digits, letters a-z and
    bytes from 0x80; A-Z count as a-z. A hash depends on the word alone, not on its place.
    """
    data = np.frombuffer(b"".join((b" ", b" ".join(texts), b" ")), np.uint8)
    inside = _IN_ALNUM[data] if alnum else _IN_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # the last places before words, and of words
    before, last = edges[0::2], edges[1::2]
    total = _LOWER_BYTE[data]
    total *= powers(STEP, len(data), "up")
    np.cumsum(total, out=total)
    hashes = total[last]
    hashes -= total[before]
    hashes *= powers(STEP_INVERSE, len(data), "down")[before + 1]
    hashes ^= (last - before).view(np.uint64)
    ends = np.cumsum([len(x) + 1 for x in texts])
    return np.diff(np.searchsorted(before, ends), prepend=0), mix64(hashes)


def text_bytes(column) -> list[bytes]:
    """A PyArrow string column as UTF-8 bytes; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: A longer text is hashed in parts, cut where a word ends.
LONG_TEXT = 4 << 20


def _parts(text: bytes, alnum: bool):
    """Parts of a long text that no word crosses."""
    at = 0
    while len(text) - at > LONG_TEXT:
        end = at + LONG_TEXT
        while True:
            found = np.flatnonzero(~_ALNUM[_LOWER[np.frombuffer(text[at:end], np.uint8)]] if alnum else _SPACE[np.frombuffer(text[at:end], np.uint8)])
            if len(found) or end >= len(text):
                break
            end += LONG_TEXT
        end = at + int(found[-1]) + 1 if len(found) else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def hashed_words(texts: list[bytes], alnum: bool = False):
    """Runs of texts as (number of the first, how many words each has, the words' hashes one after another)."""
    def run(first, held):
        return first, *word_hashes(held, alnum)

    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > SLICE_BYTES:
            yield run(first, held)
            held, size = [], 0
        if not held:
            first = i
        if len(t) > LONG_TEXT:
            if held:
                yield run(first, held)
                held, size = [], 0
            parts = [run(0, [part])[2] for part in _parts(t, alnum)]
            hashes = np.concatenate(parts)
            yield i, np.array([len(hashes)]), hashes
            continue
        held.append(t)
        size += len(t)
    if held:
        yield run(first, held)
