"""Columns computed by models: a caller's model, or feature hashing, in Arrow batches.

A model is given by a factory that each task calls once; the function it returns maps a list of
inputs to a list of outputs. A batch that fails gives nulls, not a failed job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T

#: Rows that a model gets at once, dimensions of hashed vectors, characters of a passage that is scored, words whose digests a task keeps.
BATCH, DIMENSIONS, PASSAGE, KNOWN = 8, 64, 1800, 500_000


def _column(factory: Callable, kind: str, batch: int):
    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for part in parts:
            out: list = []
            for at in range(0, len(part), batch):
                piece = part.iloc[at : at + batch].tolist()
                try:
                    got = list(model(piece))
                except Exception:  # noqa: BLE001 - whatever a model raises, its batch is null
                    got = []
                out += got if len(got) == len(piece) else [None] * len(piece)
            yield pd.Series(out, index=part.index, dtype=object)

    return run


def embed_column(text: Column, factory: Callable, batch: int = BATCH) -> Column:
    """Vectors of texts."""
    return _column(factory, "array<float>", batch)(text)


def generate_column(prompt: Column, factory: Callable, batch: int = BATCH) -> Column:
    """Answers to prompts."""
    return _column(factory, "string", batch)(prompt)


def score_column(query: Column, passage: Column, factory: Callable, batch: int = BATCH) -> Column:
    """Scores of (query, passage) pairs; the model gets JSON objects with these two keys."""
    pair = F.to_json(F.struct(query.alias("query"), F.substring(passage, 1, PASSAGE).alias("passage")))
    return _column(factory, "double", batch)(pair)


def hashed_vectors(rows: DataFrame, key: str, text: Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, dim, weight): unit vectors of signed word counts, one row for each dimension that is not zero.

    A digest of the word gives dimension and sign. Tasks sum the words of each text, so no word is a row of its own;
    rows of one key are added up. A text without a word has no row.
    """
    kind = rows.schema[key].dataType.simpleString()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        for batch in batches:
            n = pc.fill_null(pc.list_value_length(batch["w"]), 0).to_numpy(zero_copy_only=False)
            coded = batch["w"].flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            known = known if len(known) < KNOWN else {}
            for w in words:
                if w not in known:
                    m = hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()
                    known[w] = int(m[:2], 16) % dimensions, 1 - 2 * (int(m[2], 16) % 2)
            dim, sign = np.array([known[w] for w in words], dtype=np.int64).reshape(-1, 2).T
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.bincount(np.repeat(np.arange(len(n)), n) * dimensions + dim[code], weights=sign[code], minlength=len(n) * dimensions).astype(np.int64)
            ends = pa.array(np.arange(len(n) + 1, dtype=np.int32) * dimensions)
            yield pa.RecordBatch.from_arrays([batch["key"], pa.ListArray.from_arrays(ends, pa.array(sums))], names=["key", "s"])

    told = rows.select(rows[key].alias("key"), T.index_tokens(text).alias("w")).mapInArrow(summed, f"key {kind}, s array<bigint>")
    sums = told.groupBy("key").agg(F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(dimensions)]).alias("s"))
    sums = sums.withColumn("norm", F.sqrt(F.aggregate("s", F.lit(0).cast("bigint"), lambda n, x: n + x * x)))
    each = sums.filter("norm > 0").select(F.col("key").alias(key), "norm", F.posexplode("s").alias("dim", "s")).filter("s <> 0")
    return each.select(key, F.col("dim"), F.round(F.col("s") / F.col("norm"), 6).alias("weight"))


def refreshed(rows: DataFrame, stored: DataFrame, key: str, encode: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """Stored vectors with those of rows that lack one (with force: of all rows); `fresh` marks what was computed."""
    todo = rows if force else rows.join(stored.select(key).distinct(), key, "left_anti")
    new = encode(todo).withColumn("fresh", F.lit(True))
    kept = stored.join(rows.select(key).distinct(), key, "left_semi")
    kept = kept.limit(0) if force else kept
    return new.unionByName(kept.withColumn("fresh", F.lit(False)))
