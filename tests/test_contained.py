"""Tokens looked for in texts by tasks against Python's `in`."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillon.operators import contained, search

TEXTS = ["the heat kernel", "", None, "kernel the", "ünïcode 能量 x", "a", "xyzw" * 9 + "the heat kernel of a long passage", "heat\nkernel"]
TOKENS = ["the", "heat kernel", "a", "kernel", "能量", "xyzwxyzwxyzwxyzwxyzwxyz!", "the heat kernel of a long passage", "ü", "rne", "", "nowhere", "xyzw" * 9]


def test_tokens_are_found_as_python_finds_them():
    rng = np.random.default_rng(5)
    texts = TEXTS + ["".join(rng.choice(list("ab é"), size=rng.integers(0, 60))) for _ in range(300)]
    tokens = TOKENS + sorted({"".join(rng.choice(list("ab é"), size=n)) for n in range(1, 24) for _ in range(8)} - set(TOKENS))
    column = pa.array(["cut off", *texts], pa.string()).slice(1)
    for piece in (contained.PIECE, 7):
        contained.PIECE, kept = piece, contained.PIECE
        try:
            got = {*zip(*(x.tolist() for x in contained.Tokens(tokens, contained.flat(column)[0][:50]).found(column)), strict=True)}
        finally:
            contained.PIECE = kept
        assert got == {(i, j) for i, t in enumerate(tokens) for j, x in enumerate(texts) if x is not None and t in x}


def test_first_rows_of_each_query_and_what_tasks_cannot_hold(spark, monkeypatch):
    texts = [(f"{i * 7919 % 1000:03}", "alpha beta"[: i % 11] + (" rare" if i % 97 == 0 else "")) for i in range(1000)]
    asks = [(1, ["alpha", "beta"]), (2, ["rare"]), (3, ["nothing"]), (4, ["a"]), (5, [])]
    rows = spark.createDataFrame(texts, "id string, t string").repartition(5)
    queries = spark.createDataFrame(asks, "query_id int, tokens array<string>")
    want = {q: sorted(i for i, t in texts if any(x in t for x in tokens)) for q, tokens in asks}
    every = {(q, i) for q, found in want.items() for i in found}
    least = {(q, i) for q, found in want.items() for i in found[:6]}
    found = lambda **k: [(r[0], r[1]) for r in search.containing(queries, rows, F.col("t"), ["id"], **k).collect()]
    assert sorted(found()) == sorted(every)
    some = found(first=6, order=(F.col("id"),))
    assert least <= {*some} <= every and len(some) == len({*some}) <= 5 * 6 * len(asks)
    items = queries.select("query_id", F.get("tokens", 0).alias("item"))
    docs = rows.select(F.col("id").alias("paper_id"), F.col("t").alias("text"))
    held = sorted(tuple(r) for r in search.holding(items, docs).collect())
    monkeypatch.setattr(search, "WANTED", 2)
    assert sorted(found()) == sorted(every)
    assert held == sorted(tuple(r) for r in search.holding(items, docs).collect()) and held
