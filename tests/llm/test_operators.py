"""Each training-data operator against a brute-force version on small rows: nulls, empty and long texts, repeats, clashing columns, empty tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat_format, decontaminate, jaccard_join, language_id, license_scan, packing, pii, quality_rules, token_counts, url_filter
from quillon.llm.components import components
from quillon.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i, "en"), "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def prose(seed, n=80, vocabulary=400):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, vocabulary, n))


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "user", None), (1, 2, "assistant", r"a <\| b <|im_sep|>"), (1, 3, "assistant", ""), (2, 0, "a\nb|c", "x"), (3, 1, None, "<"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, segments string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == own
        assert got[conv]["loss_text"] == "".join(t for role, t in own if role == "assistant")
    assert got[1]["formatted"].count("<|im_start|>") == 2
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_decontaminate_finds_verbatim_and_changed_items(spark):
    item = "On the table there are 12 apples and 7 pears which weigh 12 kg when put together by old farmers today"
    other = item.replace("12", "31").replace("7", "5")
    crossed = item.replace("12 apples", "31 apples")
    texts = [f"{prose(1)} {item} {prose(2)}", f"{prose(3)}. {other}", f"{prose(4)} {crossed}", prose(5), None, "", item[:30]]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    assert sorted(got) == [0, 1, 2]
    assert (got[0]["leak"], got[0]["n_changed"]) == (True, 0)
    assert (got[1]["leak"], got[1]["n_changed"]) == (True, 3)
    assert not got[2]["leak"]
    kept = decontaminate.clean(docs(spark, texts).withColumn("_h", F.lit(1)), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5, 6] and "_h" in kept.columns


def brute_components(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        sets.append({" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    low = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 90 * len(a | b):
                    low[i] = low[j] = min(low[i], low[j])
    return [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, low, strict=True))]


def test_jaccard_join_equals_all_pairs(spark):
    texts = [None, "", "  ", "a", "A", "a b", "b a"]
    rng = np.random.default_rng(3)
    for seed in range(6):
        words = prose(seed, int(rng.integers(8, 300))).split()
        for _ in range(5):
            copy = list(words)
            for k in rng.integers(0, len(copy), int(rng.integers(0, 1 + len(copy) // 25))):
                copy[k] = "new"
            texts.append(" ".join(copy))
    df = docs(spark, texts)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect())
    assert got == brute_components(texts)
    wordless = [0, 1, 2]
    assert sorted(r["doc_id"] for r in jaccard_join.keep_one(df.withColumn("low", F.lit(0))).collect()) == sorted(wordless + list({c for _, n, c in got if n}))
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_signatures_lose_no_link():
    rng = np.random.default_rng(5)
    for n in (9, 12, 20, 33, 60, 150, 700):
        base = rng.choice(1 << 60, n + n // 8 + 2, replace=False).astype(np.uint64)
        for _ in range(15):
            a, b = (np.unique(rng.choice(base, n, replace=False)) for _ in range(2))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (2 * n - both) and both < n:
                first, second = jaccard_join.signatures([a, b], 90)
                assert len(np.intersect1d(first, second))


def test_long_and_odd_texts_hash_alike():
    long = " ".join(f"x{i}" for i in range(500_000))
    sets = [*shingle_sets(["a b c d", long, None, "A\tB\x0bc  d", "y" * 3_000_000])]
    assert [len(s) for s in sets] == [2, 499_998, 0, 2, 1]
    assert (sets[0] == sets[3]).all()


def test_components_join_chains(spark):
    links = [(i, i + 1) for i in range(30)] + [(50, 51), (51, 51), (60, 50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 51: 50, 60: 50}


def brute_pii(text):
    out = {k: [] for k in pii.KINDS}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0:
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            out["phone"].append(m.span())
    return out


PRIVATE = [
    "mail a.b@c.d_x@e.f and g@h.co.uk, x@y no", "10.0.0.256 1.2.3.4.5.6.7.8 001.02.3.255 9999.1.1.1", "4111 1111-1111 1111 and 4111111111111112 41111111111111111111111", "call +1 (988) 555-2485 or +44 1 or +123456789012345678",
    "é€𝄞 +49 30 1234567 é x@y.zz", None, "", "clean text", "@@@ +++ 1.1.1 12", "a" * 5000 + "@b.c",
]


def test_pii_base_spans_equal_the_plain_patterns(spark):
    rows = pii.detected(docs(spark, PRIVATE), F.coalesce("text", F.lit(""))).select("doc_id", pii.span_list(F.col("base")).alias("b"), pii.span_list(F.col("spans")).alias("s")).collect()
    for r in rows:
        want = [f"{k}:{a}:{b}" for k, spans in brute_pii(PRIVATE[r["doc_id"]] or "").items() for a, b in spans]
        assert r["b"] == ",".join(want) and set(want) <= set(r["s"].split(",")) | {""}
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(docs(spark, PRIVATE)).collect()}
    assert clean[5] is None and clean[6] == "" and clean[7] == "clean text" and "@h.co" not in clean[0] and clean[3].startswith("call [PHONE] or")


def test_boosting_separates_cells():
    cells = [(pii.PHONE, 2, f, 500, 495) for f in (0, 1)] + [(pii.PHONE, 16, f, 500, 5) for f in (0, 1)]
    trees, thresholds = pii.boost(cells)
    assert pii._margin(trees, 2) >= thresholds[pii.PHONE] > pii._margin(trees, 16)
    assert pii.boost([]) == ([], {})


def test_token_histogram(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    texts = ["hello world", None, "", "hello <|endoftext|> world", prose(1), "  a\n\n b", "don't é 123456"] + ["hello world"] * 3
    with open(token_counts.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = sorted(len(encode(t)) if t else 0 for t in texts)
    lengths = token_counts.encoded_lengths(docs(spark, texts))
    assert sorted(r["n_tokens"] for r in lengths.collect()) == want
    lengths = lengths.unionByName(spark.createDataFrame([(99, 5000)], "doc_id bigint, n_tokens bigint"))
    want.append(5000)
    h = token_counts.length_histogram(lengths)
    for r in h.collect():
        assert r["truncated_tokens"] == sum(min(x, r["length"]) for x in want) and r["docs_over"] == sum(x > r["length"] for x in want)
    for r in token_counts.at_limits(h, [0, 3, 1024, 9999]).collect():
        assert r["truncated_tokens"] == sum(min(x, r["limit"]) for x in want) and r["docs_up_to"] == sum(x <= r["limit"] for x in want)
    assert {r["share"]: r["length"] for r in token_counts.quantiles(h, [0.5, 1.0]).collect()} == {0.5: want[-(-len(want) // 2) - 1], 1.0: 5000}


def test_license_scan(spark):
    mit, gpl = license_scan.TEMPLATES["mit"], license_scan.TEMPLATES["gpl-3.0"]
    texts = [f"{prose(1)} {mit} {prose(2)}", gpl.upper(), f"{prose(3)} Released under the", None, "", f"{mit}\n{prose(4, 3000)}\n{gpl}"]
    got = sorted((r["doc_id"], r["license_id"]) for r in license_scan.scan(docs(spark, texts)).collect())
    assert got == [(0, "mit"), (1, "gpl-3.0"), (5, "gpl-3.0"), (5, "mit")]
    assert license_scan.miss_probability() < 1e-3


def test_url_filter_as_of(spark):
    import datetime as dt

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    entries = [("b.com", "block", day(10)), ("b.com", "allow", day(40)), ("a.b.com", "block", day(200)), ("b.com", "block", day(10)), (None, "block", day(1)), ("x.org", "block", None)]
    urls = ["http://u@A.b.com:80/x", "https://b.com", "http://xb.com/", None, "nonsense", "http://c.a.b.com/"]
    captures = [(f"{i}-{n}", u, day(n)) for i, u in enumerate(urls) for n in (0, 10, 39, 40, 199, 200, 400)] + [("none", urls[0], None)]
    df = spark.createDataFrame(captures, "key string, url string, fetched date")
    listed = spark.createDataFrame(entries, "domain string, action string, day date")
    for bound in (1000, 0):
        got = {r["capture"]["key"]: r["blocked"] for r in url_filter.judge(df, listed, bound=bound).collect()}
        assert len(got) == len(captures)
        for key, url, when in captures:
            host = {0: "a.b.com", 1: "b.com", 2: "xb.com", 5: "c.a.b.com"}.get(urls.index(url), "")
            active = [(len(d), max(x for x in entries if x[0] == d and x[2] and when and x[2] <= when)) for d in ("b.com", "a.b.com") if (host == d or host.endswith("." + d)) and when and any(x[0] == d and x[2] <= when for x in entries if x[0] and x[2])]
            last = max(active, default=None)
            if last:
                d = last[1][0]
                action = max((x[2], x[1]) for x in entries if x[0] == d and x[2] <= when)[1]
            assert got[key] == bool(last and action == "block"), (key, url, when)


def test_packing_places_every_word_once(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(1, 600, 300)] + [None, "", " ".join(["w"] * 5000), " ".join(["w"] * 2048)]
    rows = packing.pack(docs(spark, texts), shard=64).collect()
    for i, t in enumerate(texts):
        own = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == i)
        assert sum(n for _, n in own) == len((t or "").split()) and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
    bins = {}
    for r in rows:
        if r["length"]:
            bins.setdefault((r["shard"], r["bin"]), []).append(r)
    for own in bins.values():
        used, size = sum(r["length"] for r in own), own[0]["capacity"]
        assert used <= size and not any(used <= c < size for c in packing.CAPACITIES)
        assert sorted(r["bin_start"] for r in own) == [0, *np.cumsum([r["length"] for r in sorted(own, key=lambda r: r["bin_start"])])[:-1].tolist()]
    assert sum(len((t or "").split()) for t in texts) > 0.9 * sum(own[0]["capacity"] for own in bins.values())


def test_network_gradient_and_accuracy(spark):
    alphabets = {"aa": "abcde ", "bb": "vwxyz ", "cc": "äöüßé "}
    rng = np.random.default_rng(0)
    made = [(k, "".join(rng.choice(list(a), int(rng.integers(20, 300))))) for _ in range(60) for k, a in alphabets.items()]
    texts = [t for _, t in made] + [None, "", "123 !!"]
    df = docs(spark, texts, {i: k for i, (k, _) in enumerate(made)})
    rows = language_id.identify(df).collect()
    out = {r["doc_id"]: r for r in rows}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in range(len(made), len(texts)))
    held = [i for i in range(len(made)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i in range(len(texts)) if out[i]["held_out"]] == [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([out[i]["lang_pred"] == made[i][0] for i in held]) > 0.95
    assert language_id.classify({"names": []}, ["abc"]) == [("und", 0.0)]
    model = language_id.train([t for _, t in made[:6]], [k for k, _ in made[:6]], epochs=1)
    x = rng.integers(97, 120, (5, 3))
    (f, sf), grad = language_id._run(model, "f", x, True), {k: np.zeros_like(v) for k, v in model.items() if k != "names"}
    language_id._back(model, "f", x, sf, np.ones_like(f), grad)
    for name, at in (("whf", (1, 2)), ("whf", (3, 20)), ("wxf", (int(x[0, 0]), 4))):
        moved = []
        for step in (1e-2, -1e-2):
            m = {k: v.copy() if k != "names" else v for k, v in model.items()}
            m[name][at] += step
            moved.append(float(language_id._run(m, "f", x).sum()))
        assert abs((moved[0] - moved[1]) / 2e-2 - grad[name][at]) < 2e-2


def brute_quality(text):
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g in grams if grams.count(g) > 1}
    repeat = len({i + k for i, g in enumerate(grams) if g in twice for k in range(3)})
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat


def test_quality_measures(spark, monkeypatch):
    texts = [None, "", "a b", "a b c a b c", "x\nx\n\nx | #y", prose(1, 200, 6), prose(2, 60), "é 𝄞\x0bz " * 40]
    for bound in (10**9, 0):
        monkeypatch.setattr(quality_rules, "_SEARCH", bound)
        rows = quality_rules.verdicts(quality_rules.ledger(quality_rules.measured(docs(spark, texts).withColumn("_w", F.lit(1)))))
        for r in rows.collect():
            n = brute_quality(texts[r["doc_id"]] or "")
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
            assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r["base_failed"] and r["kept"])
    table = {r["rule"]: (r["failed"], r["only"]) for r in quality_rules.ablations(rows).collect()}
    assert table["too_few_words"][0] == 5 and set(table) == {name for name, _ in quality_rules.RULES}


def test_digest_of_nothing(spark):
    assert spark.range(1).select(F.sha2(F.lit(""), 256).alias("x")).first()["x"] == hashlib.sha256(b"").hexdigest()
