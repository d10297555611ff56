"""License scan of long texts, full texts, ties, repeats and empty tables."""

import time

from pyspark.sql import functions as F

from quillon.llm import license_scan as L
from tests.llm.test_operators import docs, prose


def long_text(words, seed):
    parts = []
    for k in range(words // 1000):
        parts += [prose(seed + k, 1000, 5000), L.TEMPLATES["mit"]]
    return " ".join(parts)


def test_full_texts_and_odd_inputs(spark):
    full = L.TEMPLATES["mit-full"]
    words = full.split()
    cut = " ".join(words[: len(words) * 9 // 10])
    half = " ".join(words[: len(words) // 2])
    texts = [f"{prose(1)} {full} {prose(2)}", f"{prose(3)} {cut}", f"{half} {prose(4)}", None, "", "one two", L.TEMPLATES["bsd-2-full"].lower(), full, full]
    df = docs(spark, texts).withColumns({"w": F.lit(1), "text_hash": F.lit("x"), "size": F.lit(2), "tile": F.lit(0)})
    got = {(r["doc_id"], r["license_id"]): r["containment"] for r in L.scan(df.unionByName(df)).collect()}
    assert {d for d, k in got if k == "mit-full"} == {0, 1, 7, 8} and got[0, "mit-full"] == got[7, "mit-full"] == 1.0
    assert 0.8 <= got[1, "mit-full"] < 1 and (2, "mit-text") in got and {(6, "bsd"), (6, "bsd-2-full")} <= set(got)
    assert L.scan(df.limit(0)).count() == 0
    assert [r["license_id"] for r in L.scan(docs(spark, ["a b c d e f"]), {"own": "b c d e", "no": "x y z", "short": "a b"}).collect()] == ["own"]


def test_work_grows_with_the_length_of_a_text(spark):
    took = []
    for words in (10_000, 20_000, 80_000):
        began = time.time()
        rows = L.scan(docs(spark, [long_text(words, words)])).collect()
        took.append(time.time() - began)
        assert [(r["doc_id"], r["license_id"]) for r in rows] == [(0, "mit")]
    print(took)
    assert took[2] < 4 * took[1] + 5
