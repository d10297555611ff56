"""What the operators once left out, against brute force on small rows."""

import datetime as dt

import pytest

import corpus_pipeline
from quillon.llm import decontaminate, packing, queries, token_counts, url_filter
from tests.llm.test_operators import WORD, docs, prose


def alike(a, b, width):
    """Jaccard similarity of the sets of word shingles."""
    sets = []
    for text in (a, b):
        w = WORD.findall(text.lower())
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_pipeline_keeps_one_of_near_copies_at_five_words(spark):
    texts = [None, "", "a", "b a"]
    for seed in range(4):
        words = prose(seed, 100, 5000).split()
        texts.append(" ".join(words))
        texts.append(" ".join([*words[:50], "new", *words[51:]]))  # 0.9 at five words
        texts.append(" ".join(words + prose(seed + 50, 15, 5000).split()))  # 0.86
        texts.append(" ".join([*words[:30], "new", *words[31:60], "new", *words[61:]]))  # 0.81
        texts.append(" ".join([*words[:20], "other", *words[21:40], "other", *words[41:60], "other", *words[61:]]))  # below
    low = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(texts):
            for j, b in enumerate(texts):
                if a and b and alike(a, b, 5) >= 0.8:
                    low[i] = low[j] = min(low[i], low[j])
    between = [(a, b) for k, a in enumerate(texts) for b in texts[:k] if a and b and alike(a, b, 5) >= 0.8 and alike(a, b, 3) < 0.9]
    assert len(between) >= 4
    kept = corpus_pipeline.near_duplicates(spark, docs(spark, texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(low))


def test_packing_query_measures_tokens(spark, tmp_path):
    pytest.importorskip("tiktoken")
    texts = [prose(1), "漢字" * 3000, "QUJD" * 2000, None, "", "a b c", prose(2, 3000)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    want = {r["doc_id"]: r["n_tokens"] for r in token_counts.encoded_lengths(docs(spark, texts)).collect()}
    assert want[1] > 2048 and want[2] > 2048 and want[3] == want[4] == 0
    rows = queries.op8_best_fit_packing(spark, str(tmp_path)).collect()
    assert {i: sum(r["length"] for r in rows if r["doc_id"] == i) for i in want} == want
    used = {}
    for r in rows:
        if r["length"]:
            used.setdefault((r["shard"], r["bin"], r["capacity"]), []).append(r["length"])
    assert all(sum(n) <= size for (_, _, size), n in used.items()) and len({k[:2] for k in used}) == len(used)
    assert sum(k[2] for k in used) < sum(want.values()) + 2 * max(packing.CAPACITIES)


def test_url_filter_matches_any_number_of_labels(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    entries = [("localhost", "block", day(0)), ("x.b.c.d.e.f.com", "allow", day(5)), ("f.com", "block", day(0)), ("a.b.c.d.e.g.org", "block", day(0)), ("zone", "block", day(0))]
    hosts = ["localhost", "x.b.c.d.e.f.com", "y.x.b.c.d.e.f.com", "b.c.d.e.f.com", "a.b.c.d.e.g.org", "b.c.d.e.g.org", "any.where.zone", "notzone"]
    captures = [(f"http://{h}/", h, day(n)) for h in hosts for n in (1, 9)]
    df = spark.createDataFrame(captures, "url string, host string, fetched date")
    listed = spark.createDataFrame(entries, "domain string, action string, day date")
    for bound in (1000, 0):
        rows = url_filter.judge(df, listed, bound=bound).collect()
        assert len(rows) == len(captures)
        for r in rows:
            host, when = r["capture"]["host"], r["capture"]["fetched"]
            best = max(((len(d), d, a) for d, a, since in entries if (host == d or host.endswith("." + d)) and since <= when), default=(0, None, None))
            assert (r["host"], r["matched_domain"], r["action"], r["blocked"]) == (host, *best[1:], best[2] == "block")
    assert not any(r["blocked"] for r in url_filter.judge(df, listed.limit(0)).collect())


def test_clean_finds_short_first_word_and_placeholder_items(spark):
    short, middle = "Which river crosses the old town?", "Which river crosses the old town near that long bridge"
    sums = "12 + 7 = 19 and 19 - 4 = 15 and 15 * 2 = 30"
    told = "On the table there are 12 apples and 7 pears which weigh 12 kg when put together by old farmers today"
    twice = told.replace("12 apples", "31 apples")
    texts = [
        f"{prose(1)} {short} {prose(2)}",
        f"{prose(3)} heading {middle} {prose(4)}",
        f"{prose(5)} {sums} {prose(6)}",
        f"{twice}. {prose(7)}. {told.replace('12', '40')}",
        f"{prose(8)} 1 2 3 4 5 6 7 8 9 {prose(9)}",
        f"{prose(10)} {twice}",
        prose(11), None, "", "Which river crosses",
    ]
    bench = spark.createDataFrame([(1, short), (2, middle), (3, sums), (4, told), (5, None), (6, "")], "item_id bigint, text string")
    kept = decontaminate.clean(docs(spark, texts), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 7, 8, 9]
    for k, item in enumerate((short, middle, sums, told), 1):  # each by itself
        left = decontaminate.clean(docs(spark, texts), bench.filter(f"item_id = {k}"))
        assert k - 1 not in {r["doc_id"] for r in left.collect()}, item
    assert decontaminate.clean(docs(spark, texts), bench.limit(0)).count() == len(texts)
