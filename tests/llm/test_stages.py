"""Packing against the optimum of small inputs, token pieces, ablations, and the pipeline's stages against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import language_id, packing, quality_rules, token_counts
from tests.llm.test_decontaminate import ITEMS, brute
from tests.llm.test_operators import brute_pii, docs, prose
from tests.llm.test_whole_job import alike


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for k in range(len(rest)):
            yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]


def test_best_fit_is_near_the_optimum_and_sizes_differ():
    rng, worst, sizes = random.Random(3), 1.0, set()
    least = lambda n: next((packing.cost_of(c) for c in packing.CAPACITIES if c >= n), 1e18)
    for _ in range(60):
        lengths = [rng.choice((rng.randint(1, 300), rng.randint(1, 2048))) for _ in range(rng.randint(1, 7))]
        best = min(sum(least(sum(b)) for b in p) for p in partitions(lengths))
        of, capacity = packing.best_fit(lengths)
        used = [sum(n for n, b in zip(lengths, of, strict=True) if b == k) for k in range(len(capacity))]
        assert all(u <= c for u, c in zip(used, capacity, strict=True))
        worst = max(worst, sum(map(packing.cost_of, capacity)) / best)
        sizes |= set(capacity)
    assert worst < 1.2 and sizes == set(packing.CAPACITIES)
    many = [rng.randint(1, 400) for _ in range(4000)] + [rng.randint(900, 2048) for _ in range(500)]
    of, capacity = packing.best_fit(many)
    assert len(set(capacity)) >= 3 and sum(map(packing.cost_of, capacity)) < 1.15 * sum(many)
    assert packing.best_fit([]) == ([], [])


def test_token_pieces_agree_with_lengths(spark):
    pytest.importorskip("tiktoken")
    texts = [prose(1), "漢字" * 3000, "QUJD" * 2000, None, "", " \n ", "a b c", prose(2, 3000), "x y z " * 700]
    df = docs(spark, texts).select("doc_id", token_counts.encoded_length("text").alias("n"), token_counts.token_pieces("text", 100).alias("p"))
    for r in df.collect():
        assert sum(x["tokens"] for x in r["p"]) == r["n"] and all(x["tokens"] == 100 for x in r["p"][:-1]) and r["p"][-1]["tokens"] <= 100
        assert sum(x["words"] for x in r["p"]) == len([w for w in (texts[r["doc_id"]] or "").replace("\n", " ").split(" ") if w])
    twice = docs(spark, texts).unionByName(docs(spark, texts)).withColumn("bin", F.lit(1))
    rows = corpus_pipeline.packed_sequences(spark, twice, "").collect()
    assert sum(r["tokens"] for r in rows) == 2 * sum(r["n"] for r in df.collect())
    used = {}
    for r in rows:
        if r["tokens"]:
            used.setdefault((r["shard"], r["bin"], r["capacity"]), []).append(r["tokens"])
    assert all(sum(n) <= k[2] for k, n in used.items())
    assert corpus_pipeline.packed_sequences(spark, twice.limit(0), "").count() == 0


def test_all_ablations(spark):
    rows = quality_rules.ledger(quality_rules.measured(docs(spark, [None, "", "a b", prose(1, 200, 6), prose(2, 60), prose(3, 90)])))
    got = {(r["policy"], r["rule"]): (r["failed"], r["only"]) for r in quality_rules.all_ablations(rows).collect()}
    for p in quality_rules.POLICIES:
        assert {k[1]: v for k, v in got.items() if k[0] == p} == {r["rule"]: (r["failed"], r["only"]) for r in quality_rules.ablations(rows, p).collect()}


def test_stages_against_brute_force(spark, tmp_path):
    """All stages after the network, whose own verdict is read from the operator, on planted rows with nulls, repeats and a further column."""
    letters = lambda seed, n: " ".join("".join(chr(97 + int(c) % 26) * 2 for c in w[1:]) for w in prose(seed, n, 9000).split())
    base = [letters(k, 60) for k in range(30)]
    texts = [*base, *[b + " extra" for b in base[:6]], f"{letters(90, 30)} {ITEMS[4]} {letters(91, 30)}", f"{letters(92, 40)} a.b@c.de +1 (988) 555-2485", None, "", "123 456", base[7], base[7]]
    df = docs(spark, texts).withColumn("sid", F.lit(1))
    spark.createDataFrame([*ITEMS.items()], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = language_id.fit(df)
    sure = language_id.classify(model, texts)
    first = {r["doc_id"] for r in corpus_pipeline.language(spark, df, str(tmp_path)).collect()}
    assert first == {i for i, (lang, p) in enumerate(sure) if lang != "und" and p >= language_id.FLOOR} and not {38, 39, 40} & first
    kept = corpus_pipeline.near_duplicates(spark, df, str(tmp_path))
    want = {i for i, t in enumerate(texts) if not any(t and u and alike(t, u, 5) >= 0.8 for u in texts[:i])}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == df.columns
    clean = corpus_pipeline.benchmark_leaks(spark, df, str(tmp_path))
    assert sorted(r["doc_id"] for r in clean.collect()) == [i for i, t in enumerate(texts) if not any(brute(t, x) for x in ITEMS.values())]
    for r in corpus_pipeline.personal_data(spark, df, str(tmp_path)).collect():
        text = texts[r["doc_id"]]
        if not text or not any(brute_pii(text).values()):
            assert r["text"] == text
        else:
            assert not any(brute_pii(r["text"]).values()) and r["text"].endswith("[EMAIL] [PHONE]")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
