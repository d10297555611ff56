"""Small exact cases of the operators."""

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunking, search


def test_sections_follow_heading_levels(spark):
    text = "intro\n# A\na1\n## B\nb1\n# C\n### D\nd1"
    rows = chunking.section_split(spark.createDataFrame([("p", text)], "paper_id string, markdown string")).orderBy("section").collect()
    assert [(r["path"], r["body"]) for r in rows] == [("全文", "intro"), ("A", "a1"), ("A › B", "b1"), ("C › D", "d1")]


def test_chunks_overlap_and_cover(spark):
    text = "".join(chr(97 + i % 26) for i in range(8000))
    rows = chunking.chunks(spark.createDataFrame([(1, text), (2, None), (3, "x")], "doc_id bigint, text string")).orderBy("paper_id", "chunk_index").collect()
    assert [(r["paper_id"], r["chunk_index"], len(r["body"])) for r in rows] == [("1", 0, 3500), ("1", 1, 3500), ("1", 2, 1800), ("3", 0, 1)]
    assert rows[0]["body"][3100:] == rows[1]["body"][:400]


def test_quota_equals_the_greedy_choice(spark):
    papers = ["a", "a", "b", "a", "c", "a", "b", "d"]
    rows = spark.createDataFrame([(0, f"c{i}", p, i + 1) for i, p in enumerate(papers)], "query_id int, chunk_id string, paper_id string, rank int")
    got = [r["chunk_id"] for r in search.paper_quota(rows, 2, 3, 5).orderBy("place").collect()]
    assert got == ["c0", "c1", "c2", "c4", "c6"]


def test_fusion_prefers_what_both_lists_hold(spark):
    rows = spark.createDataFrame([(0, 0, 1, "x"), (0, 0, 2, "y"), (0, 1, 1, "y"), (0, 1, 2, "z")], "query_id int, list_no int, rank int, chunk_id string")
    assert [r["chunk_id"] for r in search.fuse(rows).orderBy("rank").collect()] == ["y", "x", "z"]


def test_text_functions(spark):
    row = spark.range(1).select(
        T.fix_hyphens(F.lit("inter-\nnal")).alias("h"), T.drop_page_numbers(F.lit("a\n 12 \nb")).alias("p"), T.trim_references(F.lit("body\nReferences\n[1] x")).alias("r"),
        T.citation_refs(F.lit("see [2] and [11]")).alias("c"), T.keyword_overlap(F.lit("the deep net"), F.lit("A deep sea")).alias("k"), T.is_mostly_cjk(F.lit("能量 ab")).alias("z"),
        T.search_tokens(F.lit("The heat-kernel of 能量 a")).alias("t"), T.normalize_math(F.lit(r"\(x\) \[y\]")).alias("m"),
    ).first()
    assert (row["h"], row["p"], row["r"]) == ("internal", "a\nb", "body")
    assert row["c"] == [2, 11] and row["k"] == 0.5 and row["z"] and row["m"] == "$x$ $$y$$"
    assert row["t"] == ["heat", "kernel", "能量"]


def test_cleaning_and_kinds(spark):
    lines = ["Journal of Heat"] + ["a  b"] * 4 + [f"line number {i}" for i in range(8)]
    text = "\n".join([*lines[:5], " Journal  of Heat ", *lines[5:9], "Journal of Heat", *lines[9:], "Journal of\tHeat", ""])
    few = "\n".join(["Journal of Heat"] * 11)
    rows = [(text,), (few,), (few + "\n",), (few + "\n\n\n",), ("",), ("  ",), (None,), ("x\n## Works  Cited\ny",), ("x\nReferences to y",)]
    found = spark.createDataFrame(rows, "t string").select(T.drop_repeated_lines(F.col("t")).alias("d"), T.clean_markdown(F.col("t")).alias("c"), T.clean_markdown(F.col("t"), False).alias("k")).collect()
    assert found[0]["d"] == "\n".join(lines[1:]) and found[0]["c"] == found[0]["d"] + "\n"  # short lines stay however often they occur
    assert [r["d"] for r in found[1:4]] == [few, few + "\n", "\n"]  # eleven lines are too few to tell, thirteen are not
    assert [r["c"] for r in found[4:7]] == ["", "  ", None]
    assert [(r["c"], r["k"]) for r in found[7:]] == [("x\n## Works  Cited\ny\n", "x\n"), ("x\nReferences to y\n",) * 2]
    tasks = [(None, None), ("", "{}"), ("  ", None), (" index ", '{"parse_only": true, "reindex_only": true}'), ("index", '{"reindex_only": 1, "parse_only": false}'), ("index", "[1]"), ("index", "{bad"), ("summarize", '{"parse_only": true}'), ("index", '{"download_only": true, "parse_only": true}')]
    kinds = spark.createDataFrame(tasks, "t string, p string").select(T.task_kind(F.col("t"), F.col("p")).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["index", "index", "", "parse", "reindex", "index", "index", "summarize", "download"]


def test_estimates_need_work_and_completions(spark):
    from datetime import datetime, timedelta

    from quillon.plans.operations import estimates, throughput

    t = datetime(2024, 1, 1)
    schema = "kind string, status string, created_at timestamp_ntz, updated_at timestamp_ntz, took double"
    done = throughput(spark.createDataFrame([("a", "queued", t, t, 0.0), ("a", "completed", t, t + timedelta(seconds=9), 8.0), ("b", "completed", t, t, 0.0), ("c", "completed", t - timedelta(1), t - timedelta(1), 7.0)], schema))
    assert {(r["kind"], r["g_kind"], r["done"], r["mean_seconds"]) for r in done.collect()} == {(None, 1, 2, 4.0), ("a", 0, 1, 8.0), ("b", 0, 1, 0.0)}
    left = spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", 1.0), (None, 0.0)], "kind string, remaining double")
    eta = lambda s: {r["kind"]: r["eta"] for r in estimates(left, done.filter("g_kind = 0"), ["kind"], spark.createDataFrame([(t + timedelta(seconds=s),)], "now timestamp_ntz")).collect()}
    assert eta(10) == {"a": 12.0, "b": 30.0, "c": None, None: None} and eta(4)["b"] is None
    assert throughput(spark.createDataFrame([("a", "completed", t, t, 1.0)], schema)).count() == 0


def test_holding_matches_every_text(spark):
    from quillon.operators import search

    items = ["one two three four five six", "a b c d", "wo b c", "two three", "x", " lead space word", "p q r s t u", "tail ", None, "", "line\nbreak here now"]
    texts = ["zero one two three four five sixty", "aa b c dd", "two b cc", "twotwo three", "p q r s t", "a lead space words", "tail x", None, "", "line break here now", "line\nbreak here now", "p q r s t u p q r s t u"]
    asked = spark.createDataFrame([*enumerate(items)], "query_id bigint, item string")
    docs = spark.createDataFrame([*enumerate(texts)], "paper_id bigint, text string")
    found = sorted(tuple(r) for r in search.holding(asked, docs).select("query_id", "paper_id").collect())
    assert found == [(i, d) for i, item in enumerate(items) for d, text in enumerate(texts) if item is not None and text is not None and item in text]
    assert search.holding(asked.limit(0), docs).count() == 0 and search.holding(asked, docs.limit(0)).count() == 0


def test_dense_in_blocks(spark):
    from quillon.operators import search

    ask = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)], "query_id bigint, vector array<double>")
    rows = spark.createDataFrame([(str(i), "p", [1.0, float(i)]) for i in range(5)], "chunk_id string, paper_id string, vector array<double>")
    one, many = (sorted(map(tuple, search.dense(ask, rows, n).collect())) for n in (100, 2))
    assert one == many and len(one) == 35 and search.dense(ask.limit(0), rows).count() == 0


def test_nearest_holds_the_best_of_dense(spark):
    vectors = [(f"c{i}", f"p{i % 3}", [float(i % 7 - 3), float(i % 5), 1.0]) for i in range(60)]
    odd = [("z", "p", [0.0, 0.0, 0.0]), ("n", "p", None), ("s", "p", [1.0]), ("f", "p", [float("nan"), 1.0, 1.0]), ("x", "p", [None, 1.0, 1.0])]
    rows = spark.createDataFrame(vectors + odd, "chunk_id string, paper_id string, vector array<float>").repartition(3)
    ask = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [-1.0, 0.5, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [1.0])], "query_id bigint, vector array<float>")
    best = lambda df: sorted(map(str, search.ranked(df, F.col("score"), 4).collect()))
    found = search.nearest(ask, rows, 4)
    assert best(found) == best(search.dense(ask, rows))
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    good = spark.createDataFrame(vectors, "chunk_id string, paper_id string, vector array<float>").coalesce(1)
    assert search.nearest(ask.limit(1), good, 4).count() < 60
