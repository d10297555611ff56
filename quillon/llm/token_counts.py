"""Token counts by an exact length histogram.

Documents are encoded whole, batch by batch, and aggregated by encoded length. Suffix sums over
the histogram answer totals, quantiles and truncated totals for every context limit.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed

#: Default vocabulary; a path that the driver can read.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this vocabulary's texts are split before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose lengths a task remembers.
PIECES = 500_000
#: Lengths of one bucket of the suffix sums.
BUCKET = 1024


class _Lengths(dict):
    """Encoded length of a piece of text; known pieces are kept up to a bound."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(self) < PIECES and len(piece) < 64:
            self[piece] = n
        return n


def _counter(packed: bytes):
    """The function that splits a text as the vocabulary asks, and the lengths of its pieces."""
    import regex
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, packed.splitlines())}
    encode = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return regex.compile(PATTERN).findall, _Lengths(encode).__getitem__


def encoded_length(text: str | Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text; null and empty texts have 0 tokens, whatever looks like a special token is text.

    A text is split whole by the vocabulary's pattern; merges never cross its pieces, so the length
    of a text is the sum of the lengths of its pieces.
    """
    with open(vocabulary, "rb") as file:
        packed = file.read()

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces, length = _counter(packed)
        for batch in batches:
            yield pa.array([sum(map(length, pieces(t.as_py()))) if t.is_valid else 0 for t in batch], pa.int64())

    return count(text)


def token_pieces(text: str | Column, size: int, vocabulary: str = VOCABULARY) -> Column:
    """The runs of at most `size` tokens that a text is cut into, as (tokens, words that begin in the run); null and empty texts are one run of none."""
    with open(vocabulary, "rb") as file:
        packed = file.read()

    @F.arrow_udf("array<struct<tokens:bigint,words:bigint>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces, length = _counter(packed)
        starts = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]")

        def runs(text: str) -> list[dict]:
            out, at, total = [0], 0, 0
            begun = [m.start() for m in starts.finditer(text)]
            told = 0
            for piece in pieces(text):
                at += len(piece)
                end = bisect_left(begun, at, told)
                out[-1] += end - told  # words count where their first token is
                told, total = end, total + length(piece)
                while total > size * len(out):
                    out.append(0)
            return [{"tokens": min(size, total - size * k), "words": n} for k, n in enumerate(out)]

        kind = pa.list_(pa.struct([("tokens", pa.int64()), ("words", pa.int64())]))
        for batch in batches:
            yield pa.array([runs(t.as_py()) if t.is_valid else [{"tokens": 0, "words": 0}] for t in batch], kind)

    return cut(text)


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) for every row."""
    return docs.select("doc_id", encoded_length("text", vocabulary).alias("n_tokens"))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each encoded length, with sums over longer ones.

    length, n_docs, n_tokens; docs_up_to and tokens_up_to count documents of this length at most,
    docs_over those beyond; truncated_tokens is the total when each document is cut to `length`.
    Sums are taken within buckets of lengths and over bucket totals, so no task reads more than a
    bucket or one row for each bucket. The counts are written once, since two sums read them. An empty table gives an empty histogram.
    """
    h = lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))
    h = checkpointed(h).withColumns({"n_tokens": F.col("length") * F.col("n_docs"), "bucket": F.floor(F.col("length") / BUCKET)})
    totals = h.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    after = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.select("bucket", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for c, w, n in (("d", after, "d_after"), ("d", before, "d_before"), ("t", before, "t_before"))])
    below = Window.partitionBy("bucket").orderBy("length")
    above = Window.partitionBy("bucket").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(F.broadcast(sums), "bucket").select(
        "length", "n_docs", "n_tokens",
        (F.col("d_before") + F.sum("n_docs").over(below)).alias("docs_up_to"),
        (F.col("t_before") + F.sum("n_tokens").over(below)).alias("tokens_up_to"),
        (F.col("d_after") + F.coalesce(F.sum("n_docs").over(above), F.lit(0))).alias("docs_over"),
    )
    return out.withColumn("truncated_tokens", F.col("tokens_up_to") + F.col("length") * F.col("docs_over"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For any limits: (limit, docs_up_to, tokens_up_to, docs_over, truncated_tokens), in one pass over the histogram."""

    def answer(limit: int) -> Column:
        short = F.col("length") <= limit
        total = lambda c, x: F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0))
        tokens, over = total(short, "n_tokens"), total(~short, "n_docs")
        return F.struct(F.lit(limit).cast("bigint").alias("limit"), total(short, "n_docs").alias("docs_up_to"), tokens.alias("tokens_up_to"), over.alias("docs_over"), (tokens + limit * over).alias("truncated_tokens"))

    return histogram.agg(F.array(*[answer(int(x)) for x in limits]).alias("a")).select(F.inline("a"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least this share of the documents does not exceed; null without documents."""
    reached = lambda share: F.col("docs_up_to") >= F.ceil(F.lit(share) * (F.col("docs_up_to") + F.col("docs_over")))
    least = [F.struct(F.lit(float(x)).alias("share"), F.min(F.when(reached(float(x)) & (F.col("docs_up_to") > 0), F.col("length"))).alias("length")) for x in shares]
    return histogram.agg(F.array(*least).alias("a")).select(F.inline("a"))
