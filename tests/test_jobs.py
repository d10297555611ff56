"""Models, streams into tables, databases and vectors on small inputs."""

import datetime as dt
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.functions import models
from quillon.functions import text as T
from quillon.operators import chunking
from quillon.sources import files, sinks
from quillon.streaming import tasks


def fails_on_bad():
    def model(texts):
        if "bad" in texts:
            raise ValueError("bad")
        return [[float(len(t))] for t in texts]

    return model


def test_a_failed_batch_gives_nulls(spark):
    rows = spark.createDataFrame([("a",), ("bcd",), ("bad",), ("x",)], "t string").coalesce(1)
    got = {r["t"]: r["v"] for r in rows.select("t", models.embed_column(F.col("t"), fails_on_bad, 2).alias("v")).collect()}
    assert got == {"a": [1.0], "bcd": [3.0], "bad": None, "x": None}


def test_hashed_vectors_are_unit_and_only_missing_ones_are_made(spark):
    rows = spark.createDataFrame([("p", "one two two"), ("q", "three"), ("r", " ")], "id string, body string")
    encode = lambda part: models.hashed_vectors(part, "id", F.col("body"))
    norms = {r["id"]: r["n"] for r in encode(rows).groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()}
    assert norms == {"p": pytest.approx(1, abs=1e-5), "q": pytest.approx(1, abs=1e-5)}
    stored = encode(rows.filter("id = 'p'"))
    fresh = {r["id"]: r["fresh"] for r in models.refreshed(rows, stored, "id", encode).collect()}
    assert fresh == {"p": False, "q": True}
    assert {r["fresh"] for r in models.refreshed(rows, stored, "id", encode, force=True).collect()} == {True}


def test_diacritics_are_folded(spark):
    row = spark.range(1).select(T.index_tokens(F.lit("Été Straße ñandú 能量")).alias("t")).first()
    assert row["t"] == ["ete", "straße", "nandu", "能量"]


def test_paths_resolve_in_order(spark):
    rows = spark.createDataFrame([(1, "/old/storage/ABCDEFGH/a.pdf"), (2, "/old/storage/ABCDEFGH/b.pdf"), (3, "/old/storage/ABCDEFGH/c.pdf"), (4, "/old/d.pdf"), (5, None)], "id int, path string")
    there = spark.createDataFrame([("/old/storage/ABCDEFGH/a.pdf",), ("/new/storage/ABCDEFGH/a.pdf",), ("/new/storage/ABCDEFGH/b.pdf",), ("/root/ABCDEFGH/c.pdf",)], "path string")
    got = {r["id"]: r["path"] for r in files.resolve_paths(rows, there, "/old", "/new", "/root").collect()}
    assert got == {1: "/old/storage/ABCDEFGH/a.pdf", 2: "/new/storage/ABCDEFGH/b.pdf", 3: "/root/ABCDEFGH/c.pdf", 4: None, 5: None}


def test_tables_of_a_database(spark):
    url, driver = "jdbc:derby:memory:biblio;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(10).write.format("jdbc").options(url=url, dbtable="items", **driver).mode("overwrite").save()
    read = files.jdbc_tables(spark, url, ("items",), driver, {"items": ("id", 0, 10, 3)})
    assert read["items"].count() == 10 and read["items"].rdd.getNumPartitions() == 3
    with pytest.raises(ValueError, match="tags"):
        files.jdbc_tables(spark, url, ("items", "tags"), driver)


def test_vectors_are_backfilled(spark, tmp_path):
    rows = spark.createDataFrame([("p", "a", [1.0]), ("p", "b", None), ("q", "c", None)], "paper_id string, chunk_id string, vector array<double>")
    papers = spark.createDataFrame([("p",), ("q",), ("z",)], "paper_id string")
    got = sinks.backfill_vectors(spark, papers, rows, str(tmp_path / "v"))
    assert got == {"matched": 3, "synced": 1, "rows": 1, "failed": 2, "errors": ["q", "z"]}
    assert [r["chunk_id"] for r in sinks.table(spark, str(tmp_path / "v")).collect()] == ["a"]


def files_stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_phases_close_across_batches(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema = "user_id bigint, ts timestamp, event_id bigint, event_type string"
    for part in ([(1, at(2), 2, "a"), (1, at(1), 1, "a"), (2, at(1), 9, "x")], [(1, at(3), 3, "a"), (1, at(4), 4, "b"), (1, at(5), 5, "a")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    got = tasks.drained(tasks.phase_spans(files_stream(spark, tmp_path / "e", schema)), "append").orderBy("span").collect()
    assert [(r["user_id"], r["span"], r["phase"], r["started_at"], r["ended_at"], r["n"]) for r in got] == [(1, 1, "a", at(1), at(4), 3), (1, 2, "b", at(4), at(5), 1)]


def test_texts_stream_into_an_index(spark, tmp_path):
    schema = "doc_id bigint, text string"
    for part in ([(1, "first text"), (2, "other")], [(1, "second text"), (3, None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    run = tasks.stream_index(files_stream(spark, tmp_path / "d", schema), str(tmp_path / "index"), str(tmp_path / "state"))
    run.awaitTermination()
    assert sorted((r["paper_id"], r["body"]) for r in sinks.table(spark, str(tmp_path / "index")).collect()) == [("1", "second text"), ("2", "other")]


def test_scans_replace_a_root(spark, tmp_path):
    schema = "root string, path string, size bigint"
    for part in ([("r", "a", 1), ("r", "b", 1), ("s", "c", 1)], [("r", "a", 2)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    tasks.stream_inventory(files_stream(spark, tmp_path / "d", schema), str(tmp_path / "t"), str(tmp_path / "state")).awaitTermination()
    assert sorted((r["root"], r["path"], r["size"]) for r in sinks.table(spark, str(tmp_path / "t")).collect()) == [("r", "a", 2), ("s", "c", 1)]


def test_hashed_vectors_sum_the_words_of_a_key(spark, monkeypatch):
    texts = [("a", "one two one Three"), ("a", "two four"), ("b", ""), ("c", None), ("d", "ünï 能量 " * 50), ("e", "x y"), (None, "x")]
    monkeypatch.setattr(models, "KNOWN", 1)
    want = {}
    for key, words in (("a", "one two one three two four"), ("d", "uni 能量 " * 50), ("e", "x y"), (None, "x")):
        sums = Counter()
        for w in words.split():
            m = hashlib.md5(w.encode()).hexdigest()
            sums[int(m[:2], 16) % 64] += 1 if int(m[2], 16) % 2 == 0 else -1
        norm = sum(s * s for s in sums.values()) ** 0.5
        want |= {(key, d): round(s / norm, 6) for d, s in sums.items() if s}
    made = models.hashed_vectors(spark.createDataFrame(texts, "k string, t string").repartition(3), "k", F.col("t"))
    assert {(r["k"], r["dim"]): r["weight"] for r in made.collect()} == want
    assert "Generate explode(" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_plain_texts_lose_repeated_chunks_without_a_shuffle(spark):
    page = "".join(f"word{i % 9} " for i in range(3000))[:3100]
    docs = spark.createDataFrame([(1, page * 4), (2, "a b"), (3, ""), (4, None), (5, page * 2 + "tail")], "doc_id bigint, text string")
    want = chunking.dedupe_chunks(chunking.chunks(docs))
    made = chunking.chunks(docs, once=True)
    rows = lambda df: sorted(tuple(r) for r in df.select(*want.columns).collect())
    assert rows(made) == rows(want) and made.count() < chunking.chunks(docs).count()
    assert "Exchange" not in chunking.indexed(docs)._jdf.queryExecution().executedPlan().toString()
