"""Dense retrieval by cells against a scan of all vectors."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import cells, search
from quillon.plans import retrieval

SF = "/root/testdata/sf0.1"
SCHEMA = "chunk_id string, paper_id string, vector array<double>"


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], "nan" if math.isnan(r["score"]) else r["score"]) for r in df.collect())


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
def test_recall_and_exact_result_on_the_given_vectors(spark):
    want = rows_of(retrieval.dense_topk(spark, SF))
    got = rows_of(retrieval.dense_cells_topk(spark, SF))
    recall = len({(q, c) for q, _, c, _ in want} & {(q, c) for q, _, c, _ in got}) / len(want)
    part = spark.read.parquet(f"{retrieval.stored_cells(spark, SF)}/cells").agg(F.max("probes"), F.count("*")).first()
    print(f"recall {recall:.4f} with {part[0]} of {part[1]} cells read")
    assert recall >= 0.9
    assert rows_of(retrieval.dense_exact_topk(spark, SF)) == want


def test_odd_vectors_copies_and_later_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    some = [(f"c{i:04}", "p", (centres[i % 12] + 0.2 * rng.normal(size=8)).tolist()) for i in range(600)]
    copies = [(f"d{i:04}", "p", some[0][2]) for i in range(300)]
    odd = [("n", None, None), ("z", "p", [0.0] * 8), ("e", "p", []), ("s", "p", [1.0] * 3), ("f", "p", [float("nan")] * 8), ("h", "p", [None] * 8)]
    early, late = spark.createDataFrame(some + odd, SCHEMA), spark.createDataFrame(copies, SCHEMA)
    cells.build(spark, early, str(tmp_path / "c"))
    cells.add(spark, late, str(tmp_path / "c"))
    ask = spark.createDataFrame([(i, some[i * 7][2]) for i in range(20)] + [(90, (-centres[3]).tolist()), (91, [0.0] * 8), (92, None)], "query_id int, vector array<double>")
    want = rows_of(search.ranked(search.dense(ask, early.unionByName(late)), F.col("score"), 10))
    assert rows_of(cells.topk(spark, str(tmp_path / "c"), ask, 10, read=2, exact=True)) == want
    got = rows_of(cells.topk(spark, str(tmp_path / "c"), ask, 10, read=2))
    assert {q for q, *_ in got} == {*range(20), 90} and not {c for _, _, c, _ in got} & {"n", "z", "e", "s", "f", "h"}


def test_no_vectors_or_only_odd_ones(spark, tmp_path):
    ask = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    for name, rows in (("a", []), ("b", [("n", "p", None)]), ("c", [("x", "p", [2.0, 0.0])])):
        vectors = spark.createDataFrame(rows, SCHEMA)
        cells.build(spark, vectors, str(tmp_path / name))
        want = rows_of(search.ranked(search.dense(ask, vectors), F.col("score"), 10))
        assert rows_of(cells.topk(spark, str(tmp_path / name), ask, 10, exact=True)) == want


def test_held_queries_meet_the_same_cells_as_joined_ones(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([(f"c{i:04}", "p", v.tolist()) for i, v in enumerate(rng.normal(size=(900, 6)))] + [("z", "p", [0.0] * 6)], SCHEMA)
    cells.build(spark, vectors, str(tmp_path / "c"))
    ask = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(37, 6)))] + [(90, None)], "query_id int, vector array<double>")
    monkeypatch.setattr(cells, "ANGLES", 300)
    found = [rows_of(cells.topk(spark, str(tmp_path / "c"), ask, 10, read=3, exact=e)) for e in (False, True)]
    assert found[0] and found[0] != found[1]
    plan = cells.topk(spark, str(tmp_path / "c"), ask, 10, read=3)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan
    monkeypatch.setattr(search, "HELD", 12)
    assert [rows_of(cells.topk(spark, str(tmp_path / "c"), ask, 10, read=3, exact=e)) for e in (False, True)] == found
