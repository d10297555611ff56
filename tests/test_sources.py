"""Readers and sinks on small file trees."""

import json

import pytest

from quillon.operators import search
from quillon.sources import files, sinks


def test_inventory_hashes_only_what_changed(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"one")
    (tmp_path / "y.pdf").write_bytes(b"three")
    (tmp_path / "z.txt").write_bytes(b"no")
    first = files.file_inventory(spark, str(tmp_path))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in first.collect()}
    assert {k: r["size"] for k, r in rows.items()} == {"x.pdf": 3, "y.pdf": 5}
    known = spark.createDataFrame([(*rows["x.pdf"][:3], "kept")], first.schema)
    again = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in files.file_inventory(spark, str(tmp_path), known=known).collect()}
    assert again == {"x.pdf": "kept", "y.pdf": rows["y.pdf"]["sha256"]}


def test_markdown_is_chosen_by_name(spark, tmp_path):
    for paper, name, text in (("p", "other.md", "o" * 200), ("p", "full.md", "f" * 200), ("p", "document.md", "short"), ("q", "longer.md", "l" * 100), ("q", "b.md", "b" * 100), ("r", "full.md", " " * 500)):
        (tmp_path / paper).mkdir(exist_ok=True)
        (tmp_path / paper / name).write_text(text)
    got = {r["paper_id"]: r["markdown"][0] for r in files.load_markdown(spark, str(tmp_path)).collect()}
    assert got == {"p": "f", "q": "b"}


def test_rules_questions_logs_and_tables(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({" Heat ": ["warmth", "heat", " "], "net": "network", "bad": []}))
    rules = files.synonym_rules(spark, str(tmp_path / "rules.json")).select("term", "alt").collect()
    assert sorted(map(tuple, rules)) == [("heat", "warmth"), ("net", "network")]
    (tmp_path / "q.jsonl").write_text('# no\n\n{"query": "a", "expected_terms": ["t"]}\n')
    assert [(r["query"], r["expected_terms"]) for r in files.eval_queries(spark, str(tmp_path / "q.jsonl")).collect()] == [("a", ["t"])]
    (tmp_path / "run_17.log").write_text("x\ny\n")
    assert sorted((r["job"], r["line"]) for r in files.job_logs(spark, str(tmp_path)).collect()) == [("17", "x"), ("17", "y")]
    spark.range(3).write.parquet(str(tmp_path / "items.parquet"))
    assert files.biblio_tables(spark, str(tmp_path), ("items",), ("tags",))["items"].count() == 3
    with pytest.raises(ValueError, match="tags"):
        files.biblio_tables(spark, str(tmp_path), ("items", "tags"))


def test_replacing_papers_leaves_others(spark, tmp_path):
    path, make = str(tmp_path / "t"), lambda rows: spark.createDataFrame(rows, "paper_id string, chunk int, vector array<float>")
    sinks.replace_papers(spark, make([("a", 0, [1.0]), ("a", 1, [1.0]), ("b", 0, [2.0]), ("c", 0, [3.0])]), path, buckets=2)
    sinks.replace_papers(spark, make([("a", 5, [4.0])]), path, buckets=2)
    sinks.write_vectors(spark, make([("b", 0, None), ("d", 0, [5.0])]), path, buckets=2)
    got = sorted((r["paper_id"], r["chunk"]) for r in sinks.table(spark, path).collect())
    assert got == [("a", 5), ("c", 0), ("d", 0)]


def test_newest_report_sets_the_score(spark, tmp_path):
    path = str(tmp_path / "r")
    make = lambda rows: spark.createDataFrame(rows, "paper_id string, score double, created_at int")
    sinks.append(make([("a", 0.1, 1)]), path)
    sinks.append(make([("a", 0.9, 2)]), path)
    papers = spark.createDataFrame([("a", 0.5), ("b", 0.3)], "id string, score double")
    assert sorted(map(tuple, sinks.with_latest_score(papers, spark.read.parquet(path)).collect())) == [("a", 0.9), ("b", 0.3)]


def test_synonyms_replace_the_first_hit(spark):
    queries = spark.createDataFrame([(1, "Heat kernel and heat"), (2, "preheat")], "query_id int, query string")
    rules = spark.createDataFrame([("heat kernel", "$K\\"), ("heat", "warmth"), ("heat", "HEAT")], "term string, alt string")
    got = sorted(map(tuple, search.synonyms(queries, rules).collect()))
    assert got == [(1, "$K\\ and heat"), (1, "warmth kernel and heat")]
