"""Rules of single columns and operators on rows in which they decide."""

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunking, search


def values(spark, rows, schema, column):
    return [r["v"] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column.alias("v")).collect()]


def test_storage_keys(spark):
    paths = ["/lib/KEY1/a.pdf", "/lib/KEY1/deep/a.pdf", "/lib/a.pdf", "/lib/.x/a.pdf", "/other/KEY1/a.pdf", "/library/KEY1/a.pdf", None]
    assert values(spark, [(p,) for p in paths], "p string", T.storage_key(F.col("p"), "/lib")) == ["KEY1", "KEY1", None, None, None, None, None]


def test_creators(spark):
    rows = [("Ann", "Lee", False), ("Ann", "Lee", True), (" ", "Lee", False), ("Ann", None, False), (None, "", True)]
    assert values(spark, rows, "f string, l string, s boolean", T.creator_name(F.col("f"), F.col("l"), F.col("s"))) == ["Lee, Ann", "Lee", "Lee", "Ann", ""]


def test_titles(spark):
    texts = ["# A title \nmore", "#  \nmore", "\n# later", None, "## second level"]
    assert values(spark, [(t,) for t in texts], "t string", T.title_guess(F.col("t"), F.lit("file"), F.lit("old"))) == ["A title", "old", "file", "file", "file"]


def test_an_empty_scope_holds_all_and_nulls_are_outside_of_others(spark):
    rows = [("1", ["a"], ["c"], 2000), ("2", ["b"], None, None), ("3", None, ["c"], 1990)]
    held = lambda **scope: values(spark, rows, "id string, tags array<string>, collections array<string>, year int", T.within_scope(**scope))
    assert held() == [True, True, True]
    assert held(ids=("1", "2"), tags=("b", "x")) == [False, True, False]
    assert held(collections=("c",), year_from=1995) == [True, False, False]
    assert held(year_to=1995) == [False, False, True]


def test_seconds(spark):
    rows = [("2024-01-01T00:00:00", "2024-01-01T00:01:30"), ("2024-01-01T00:01:30", "2024-01-01T00:00:00"), ("bad", "2024-01-01T00:00:00"), (None, "2024-01-01T00:00:00"), ("2024-01-01T00:00:00", "")]
    assert values(spark, rows, "a string, b string", T.seconds_between(F.col("a"), F.col("b"))) == [90.0, 0.0, 0.0, 0.0, 0.0]


def test_a_cached_answer_loses_its_translation(spark):
    rows = [('{"answer":"a","answer_other":"b","answer_other_lang":"fr"}',), ('{"answer":"a","answer_other":""}',), ('{"answer":"a"}',), (None,)]
    assert values(spark, rows, "p string", T.clear_translation(F.col("p"))) == ['{"answer":"a"}', None, None, None]


def test_long_references_are_read(spark):
    assert values(spark, [("see [1234567890] and [3]",)], "t string", T.citation_refs(F.col("t"))) == [[1234567890, 3]]


def test_index_of_sections(spark):
    text = "before\n# Methods\nfirst\n## Data\nrows of data\n# Proof\nfirst"
    rows = chunking.indexed_sections(spark.createDataFrame([("p", text), ("q", "plain"), ("e", None)], "paper_id string, markdown string")).orderBy("paper_id", "chunk_index").collect()
    assert [(r["paper_id"], r["path"], r["chunk_index"], r["body"], r["chunk_type"]) for r in rows] == [
        ("p", "全文", 0, "before", "unknown"), ("p", "Methods", 1, "first", "method"), ("p", "Methods › Data", 2, "rows of data", "method"), ("q", "全文", 0, "plain", "unknown"),
    ]


def test_quotas_of_zero_set_no_bound(spark):
    rows = spark.createDataFrame([(1, f"p{i // 5}", f"c{i:03}", i) for i in range(60)], "query_id int, paper_id string, chunk_id string, rank int")
    n = lambda *quota: search.paper_quota(rows, *quota).count()
    assert (n(), n(0, 0, 0), n(3, 0, 0), n(0, 2, 0), n(0, 0, 7)) == (8, 60, 36, 10, 7)


def test_math_outside_closed_fences(spark):
    rows = [r"a \( b \) c", "```\n\\(b\\) \uff0a\n``` \\(c\\) \uff0a", "``` \\(b\\)", r"\[ x" + "\n" + r"\] \(\)", "```a``` \\(x\\) ```\\(b\\)```", "", None]
    want = ["a $b$ c", "```\n\\(b\\) \uff0a\n``` $c$ *", "``` $b$", "\n\n$$\nx\n$$\n\n $$", "```a``` $x$ ```\\(b\\)```", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r["m"] for r in df.select(T.normalize_math(F.col("t")).alias("m")).collect()] == want


def test_query_fields_of_all_names(spark):
    rows = ['{"en_query": "a", "zh_query": "b"}', '{"\u82f1\u6587": " c ", "\u4e2d\u6587": ""}', "\u4e2d\u6587: 'd'", "none"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = df.select(T.query_json(F.col("t"), *T.ENGLISH_KEYS).alias("en"), T.query_json(F.col("t"), *T.CHINESE_KEYS).alias("zh")).collect()
    assert [tuple(r) for r in got] == [("a", "b"), ("c", None), (None, "d"), (None, None)]


def test_locks_in_any_case_are_taken_out(spark):
    from quillon.plans.claims import normalized_locks

    key = "0a" * 16
    rows = spark.createDataFrame([(1, 1, f"x [CHUNK:{key}] y [chunk:{key.upper()}] z [Chunk:{key}]")], "conv_id bigint, turn bigint, answer string")
    evidence = spark.createDataFrame([(1, key, 3)], "conv_id bigint, chunk_id string, ref bigint")
    row = normalized_locks(rows, evidence).first()
    assert (row["answer"], row["invalid"]) == ("x [3] y  z [3]", key.upper())
