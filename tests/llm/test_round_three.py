"""Clusters, collocations and line dedup against brute-force versions: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import centroids, collocations, line_dedup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i, "en"), "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


# Lines


def brute_lines(rows, documents, least=1):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc_id)
    frequent = {k for k, v in holders.items() if len(k) >= least and len(v) >= documents}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in frequent]
        out.append((doc_id, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=str)


LINES = ["Share this\nown one\n\n", " share THIS \t\nÄ own\nshare this", "a\n\n\nSHARE THIS\r", None, "", "\n", "own four\nÄ OWN\nä own ", "x\n" * 3000 + "share this", "only"]


def found_lines(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("documents", [1, 2, 3, 4])
def test_lines_equal_brute_force(spark, documents):
    rows = [(i, t) for i, t in enumerate(LINES)] + [(0, LINES[0]), (None, "only\nshare this"), (None, "only")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found_lines(line_dedup.without_frequent_lines(df, documents)) == brute_lines(rows, documents)


def test_lines_with_few_broadcast_names(spark, monkeypatch):
    """Beyond HEAVY names most lines meet them by a shuffle; the rows are the same."""
    monkeypatch.setattr(line_dedup, "HEAVY", 3)
    words = np.random.default_rng(3).integers(0, 12, (60, 9))
    rows = [(i, "\n".join(f"line {x}" if x else "hot" for x in w) + "\nhot") for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found_lines(line_dedup.without_frequent_lines(df, 20)) == brute_lines(rows, 20)


def test_lines_columns_and_empty_table(spark):
    df = docs(spark, LINES).selectExpr("*", "1 as n_lines", "2 as _row_key", "3 as h1")
    out = line_dedup.without_frequent_lines(df, 3)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "docs_n_lines", "_row_key", "h1", "n_lines", "n_dropped"]
    for r in out.collect():
        assert r["n_chars"] == len(r["text"] or "") and (r["docs_n_lines"], r["_row_key"], r["h1"]) == (1, 2, 3)
    assert line_dedup.without_frequent_lines(df.limit(0)).count() == 0


# Clusters


def nearest(vectors, middle):
    far = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in middle] for v in vectors]
    return [min(range(len(middle)), key=lambda c: (d[c], c)) for d in far], [min(d) for d in far]


def brute_clusters(rows, k, rounds, seed=2):
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [list(v) for _, v in order[:k]]
    vectors = [v for _, v in rows]
    for _ in range(rounds):
        best, _ = nearest(vectors, middle)
        for c in set(best):
            own = [v for v, b in zip(vectors, best, strict=True) if b == c]
            middle[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    best, far = nearest(vectors, middle)
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle]
    per = Counter()
    for b, d in zip(best, far, strict=True):
        per[b] += d
    return sorted((i, b, d, per[b], sum(far), digest[b]) for (i, _), b, d in zip(rows, best, far, strict=True))


def clusters(df, **how):
    rows = centroids.clustered(df, **how)
    return sorted(tuple(r[c] for c in ("vec_id", *centroids.ADDED)) for r in rows.collect())


@pytest.mark.parametrize("spread", [3, 40, 1 << 30])
def test_clusters_equal_brute_force(spark, spread):
    """Narrow grids are full of ties; wide ones pass what 64-bit squares hold before the sums are taken."""
    grid = np.random.default_rng(spread % 97).integers(-spread, spread, (90, 4)) // (1 if spread < 100 else 8)
    rows = [(i, [int(x) for x in v]) for i, v in enumerate(grid)] + [(3, [int(x) for x in grid[3]])] * 5
    df = spark.createDataFrame([(i, [x / 256 + 0.001 / 256 for x in v]) for i, v in rows], "vec_id bigint, embedding array<double>")
    assert clusters(df, k=7, rounds=3, components=4) == brute_clusters(rows, 7, 3)


def test_orchard_skips_and_is_exact():
    rng = np.random.default_rng(5)
    middle = rng.integers(-1000, 1000, (40, 8))
    vectors = middle[rng.integers(0, 40, 500)] + rng.integers(-20, 20, (500, 8))
    best, dist, tried = centroids.orchard(vectors, middle, *centroids.neighbour_lists(middle))
    far = ((vectors[:, None] - middle[None]) ** 2).sum(axis=2)
    assert (best == far.argmin(axis=1)).all() and (dist == far.min(axis=1)).all()
    assert tried < far.size * 0.7


def test_clusters_leave_out_what_is_no_vector(spark):
    good = [(1, [0.5, 1.0]), (2, [-0.5, 3.0])]
    bad = [(3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, "mine") for i, v in good + bad], "vec_id bigint, embedding array<float>, cluster string")
    out = centroids.clustered(df, k=5, rounds=2, components=2)
    assert out.columns == ["vec_id", "docs_cluster", *centroids.ADDED]
    assert sorted((r["vec_id"], r["docs_cluster"], r["distance"]) for r in out.collect()) == [(1, "mine", 0), (2, "mine", 0)]
    assert centroids.clustered(df.limit(0), components=2).count() == 0
    alone = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert [r["distance"] for r in centroids.clustered(alone, components=2).collect()] == [0, 0]


# Collocations


def brute_collocations(rows, often, longest=5, inside=100, first=2000):
    count, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = (lang, tuple(w[i : i + k]))
                    count[key] = count.get(key, 0) + 1
    found = {p: a for p, a in count.items() if len(p[1]) > 1 and a >= often}
    most = {}
    for (lang, p), a in found.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p):
                    most[lang, p[i:j]] = max(a, most.get((lang, p[i:j]), 0))
    out = []
    for (lang, p), a in found.items():
        if 100 * most.get((lang, p), -1) >= inside * a:
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = count[lang, p[:k]], count[lang, p[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), left, right, n[lang]))
    out.sort()
    ranks, rows = Counter(), []
    for lang, score, a, phrase, left, right, total in out:
        ranks[lang] += 1
        if ranks[lang] <= first:
            rows.append((lang, ranks[lang], phrase.decode(), -a, left, right, total, -score))
    return sorted(rows)


NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def prose(seed, n, vocabulary=9):
    rng = np.random.default_rng(seed)
    marks = rng.choice(["", "", "", "", ",", ".", "\n", "?"], n)
    return " ".join(f"{'W' if x % 2 else 'ü'}{x}{m}" for x, m in zip(rng.zipf(1.4, n) % vocabulary, marks, strict=True))


@pytest.mark.parametrize(("often", "inside", "first"), [(3, 100, 2000), (6, 80, 2000), (4, 100, 5)])
def test_collocations_equal_brute_force(spark, often, inside, first):
    rows = [(lang, prose(i, 150)) for i, lang in enumerate(["en", "de", None, "und", "en"])]
    rows += [("en", None), ("de", ""), ("fr", " \t. "), ("en", "New York City, new york city"), ("en", "New\tYork  City new york city\x0bnew york")] * 4
    rows += [("en", "a-very-long-word-of-its-own stays a-very-long-word-of-its-own stays")] * 3 + [("en", "one one one one one one one")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, n int")
    got = collocations.mined(df, often=often, inside=inside, first=first)
    assert got.columns == list(NAMES)
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, often, inside=inside, first=first)
    assert collocations.mined(df.limit(0)).count() == 0


def test_collocations_with_cut_stripes_and_small_pieces(spark, monkeypatch):
    """Cut stripes, full bit tables, many merges in a task and cut long texts change no row."""
    rows = [("en", prose(i, 200)) for i in range(6)]
    for name, value in (("HOT", 4), ("PARTS", 3), ("BITS", 64), ("PIECE", 64), ("HELD", 40), ("HASHES", 50), ("RANGES", 4)):
        monkeypatch.setattr(collocations, name, value)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in collocations.mined(df, often=4).collect()) == brute_collocations(rows, 4)


def test_tasks_send_stripes_by_group():
    """However many prefixes are frequent, a task sends a row for each group of a language; merged groups have all counts."""
    words = [f"w{x}" for x in range(3000)]
    text = " ".join(words * 2)
    bits, hot = [np.full(collocations.BITS // 64, -1, np.int64).tobytes()] * 3, [[], [], []]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array([text, text])], names=["lang", "text"])
    made = pa.Table.from_batches([*collocations._stripes(3, bits, hot)(iter([batch]))] * 2)
    assert made.num_rows <= 2 * 2 * 512
    rows = made.sort_by([("lang", "ascending"), ("group", "ascending")]).to_batches(max_chunksize=7)
    merged = pa.Table.from_batches([*collocations._merged(4)(iter(rows))]).to_pylist()
    assert sum(r["total"] for r in merged if r["prefix"] == "" and r["lang"] == "de") == 12000
    found = {(r["lang"], r["prefix"], e["word"]): e["n"] for r in merged for e in r["next"]}
    follow = list(zip(words, words[1:], words[2:], strict=False))
    want = {(lang, "", w): 4 for lang in ("en", "de") for w in words} | {(lang, a, b): 4 for lang in ("en", "de") for a, b in zip(words, words[1:], strict=False)}
    assert found == want | {(lang, f"{a} {b}", c): 4 for lang in ("en", "de") for a, b, c in follow}


def test_scores_pass_64_bits(spark):
    """floor(1000 * a * n / (l * r)) with products beyond 64 bits stays exact."""
    a, n, left, right = 9_000_000_000_007, 90_000_000_000_000_003, 9_000_000_000_011, 77_000_000_000_017
    wide = "decimal(38,0)"
    expr = f"(cast(1000 as {wide}) * cast(a as {wide}) * cast(n as {wide})) div (cast(l as {wide}) * cast(r as {wide}))"
    df = spark.createDataFrame([(a, n, left, right)], "a bigint, n bigint, l bigint, r bigint")
    assert df.selectExpr(f"{expr} as s").first()["s"] == 1000 * a * n // (left * right)
