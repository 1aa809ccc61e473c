"""Token counts; huge documents are encoded in overlapping chunks and spliced at proven boundaries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, text_or_empty

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Characters of a chunk and of the first overlap tried; longer texts than a chunk are encoded in chunks.
CHUNK = 1 << 16
OVERLAP = 1 << 10
#: Characters at either end of a chunk where no boundary is trusted: more than the longest special string.
MARGIN = 64
#: Bytes of small texts handed to the library at once.
BATCH_BYTES = 1 << 20


def load(name: str):
    """A tokenizer of the library ``tokenizers``, by path or by its name in ``public_tokenizers``."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task is one thread
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if os.path.sep in name else public_tokenizers.path(name))


def _pieces(tokenizer, text: str, offset: int) -> dict[int, int]:
    """Where pre-tokens start: place in the whole text -> number of tokens before it in this chunk; -1: all."""
    encoded = tokenizer.encode(text, add_special_tokens=False)
    starts, last = {-1: len(encoded)}, None
    for i, (word, (begin, _)) in enumerate(zip(encoded.word_ids, encoded.offsets)):
        if word != last or word is None:
            starts.setdefault(offset + begin, i)
            last = word
    return starts


def spliced_count(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    """Tokens of one text from chunks that overlap.

    A pre-tokenizer that reads from left to right and looks ahead only goes on alike from any place where
    both chunks start a pre-token, if both see whole what lies ``margin`` characters to either side. The
    counts are spliced at such a place of the overlap; where there is none, as inside one endless word, the
    left chunk grows by a wider overlap until there is, or to the end of the text.
    """
    n, total, at, wide = len(text), 0, 0, overlap
    end = min(n, chunk + overlap)
    left = _pieces(tokenizer, text[:end], 0)
    while end < n:
        begin = end - wide
        right_end = min(n, begin + chunk + wide)
        right = _pieces(tokenizer, text[begin:right_end], begin)
        common = [p for p in left.keys() & right.keys() if max(at + 1, begin + margin) <= p <= end - margin]
        if common:
            splice = max(common)
            total += left[splice] - left.get(at, 0)
            at, left, end, wide = splice, right, right_end, overlap
        else:
            wide *= 2
            end = min(n, end + wide)
            left = _pieces(tokenizer, text[at:end], at)
    return total + left[-1] - left.get(at, 0)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Counts the tokens of every whole text, as the library gives them without begin, end or added tokens.

    Returns ``doc_id, n_bytes, n_tokens, over_limit``, one row per input row. A null text counts as empty and
    has no tokens; null ids and repeated rows are ordinary; an empty table gives an empty result; further
    columns are not returned. ``tokenizer`` is a path or a name known to ``public_tokenizers``.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder = load(tokenizer)
        for batch in batches:
            ids, sizes, texts = batch.column(0), batch.column(1), batch.column(2)
            counts = [0] * len(texts)
            held, size = [], 0

            def flush():
                for i, e in zip(held, coder.encode_batch_fast([texts[i].as_py() for i in held], add_special_tokens=False)):
                    counts[i] = len(e)

            for i, n in enumerate(sizes.to_pylist()):
                if n > chunk:
                    text = texts[i].as_py()
                    counts[i] = spliced_count(coder, text, chunk, overlap) if len(text) > chunk + overlap else len(coder.encode(text, add_special_tokens=False))
                elif n:
                    held.append(i)
                    size += n
                    if size >= BATCH_BYTES:
                        flush()
                        held, size = [], 0
            flush()
            yield pa.RecordBatch.from_arrays([ids, sizes, pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names=schema.names)

    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, schema)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
