"""Benchmark items of every shape against a brute-force scan of all alignments."""

import re

from pyspark.sql import functions as F

from quillon.llm import decontaminate as D
from tests.llm.test_operators import docs, prose

ITEMS = {
    1: "12 15 18 21 24 27 30 33 36 39 42 45",
    2: "3 + 5 = 8 and 9 + 4 = 13 and 6 + 1 = 7",
    3: "Tom has 5 apples and Ann has 7 pears",
    4: "On the table there are 12 apples and 7 pears which weigh 12 kg when put together by old farmers today",
    5: "Der Bauer verkauft am Markt 14 Kisten Birnen und kauft vom Erlös 3 Säcke Mehl für seine Familie",
    6: "Which river crosses the old town?",
    7: "minutes pass slowly when the kettle boils on the stove at night for tea",
    8: None,
    9: "",
    10: "... !!",
}
CHANGED = {2: "2 + 4 = 6 and 7 + 1 = 9 and 5 + 3 = 10", 3: "Eve has 9 apples and Bob has 4 pears", 4: ITEMS[4].replace("12", "31").replace("7", "5"), 5: ITEMS[5].replace("14", "20").replace("Bauer", "Gärtner").replace("Birnen", "Nelken")}


def tokens(text):
    """(template word, plain word) of each word of a text."""
    out, number = [], False
    for raw in re.split(r"[\x20\x09-\x0D]+", text or ""):
        bare = "".join(c for c in raw if c.isalnum() or c == " ")
        word = bare.lower()
        digit = word[:1].isdigit()
        canon = "<n>" if bare[:1].isupper() else "<q>" if digit else "<u>" if number and word in D.UNITS else word
        number = digit and not bare[:1].isupper()
        if word:
            out.append((canon, word))
    return out


def brute(text, item):
    """Whether an alignment of item and text has enough windows and consistent slots."""
    t, i = tokens(text), tokens(item)
    n = min(len(i), D.WIDTH)
    if not n:
        return False
    windows = []  # (place, forms, light)
    for p in range(len(i) - n + 1):
        forms, light = set(), False
        for first in {i[p][0]} | ({"<u>"} if p == 0 and i[0][1] in D.UNITS else set()):
            canon = [first, *[c for c, _ in i[p + 1 : p + n]]]
            own = sum(c[0] != "<" for c in canon) >= D.telling(n)
            light |= own
            forms |= {(True, tuple(canon))} if own else set()
            forms.add((False, tuple(w for _, w in i[p : p + n])))
        windows.append((p, forms, light))
    need = min(D.RUN, sum(x[2] for x in windows) or len(windows))
    for shift in range(-len(i), len(t)):
        met = []
        for p, forms, _ in windows:
            at = t[p + shift : p + shift + n] if p + shift >= 0 else []
            if len(at) == n:
                own = sum(c[0] != "<" for c, _ in at) >= D.telling(n)
                if own and (True, tuple(c for c, _ in at)) in forms or (False, tuple(w for _, w in at)) in forms:
                    met.append(p)
        if len(met) >= need:
            pairs = {(a, b, t[k + shift][1]) for k in range(met[0], met[-1] + n) for a, b in [i[k]] if a[0] == "<" and t[k + shift][0] == a}
            if len(pairs) == len({x[:2] for x in pairs}):
                return True
    return False


def texts():
    out = [None, "", "  ", "one", " ".join(["Tom has"] * 40), "1 2 3 4 5 6 7 8 9 10 11 12 13 14"]
    for k, item in ITEMS.items():
        for n, body in enumerate([item, CHANGED.get(k)]):
            if body:
                out += [f'{prose(k)} he asked: "{body}" and left', f"({body})", f"{prose(k)} „{body}“ {prose(k)}", f"{prose(k)} {body.lower()} {prose(n + 20)}", f"so: [{body.upper()}]"]
                out += [f"{prose(k)} {body} {prose(n + 20)}", f"Heading\n{body}\n{body}", f"{prose(k)} it took 5 {body}", body, body.split(" ", 1)[1]]
    crossed = ITEMS[4].replace("12 apples", "31 apples")
    return [*out, crossed, f"{crossed} {prose(5)} {ITEMS[4]}", f"{prose(7, 40_000, 5000)} {ITEMS[3]} {prose(8, 40_000, 5000)}", out[8], out[8]]


def test_every_item_is_found_as_brute_force_finds_it(spark):
    rows = texts()
    bench = spark.createDataFrame([*ITEMS.items()], "item_id bigint, text string").withColumn("w", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs(spark, rows).withColumns({"w": F.lit(1), "text_hash": F.lit("x")}), bench).collect() if r["leak"]}
    short = {k: v for k, v in enumerate(rows) if len(v or "") < 20_000}
    want = {(d, k) for d, text in short.items() for k, item in ITEMS.items() if brute(text, item)}
    assert {x for x in got if x[0] in short} == want
    assert {d for d, k in got if d not in short and k == 3} == set(range(len(rows))) - set(short)
    for k, item in ITEMS.items():  # verbatim copies of all in any case, changed ones of all but plain lists of numbers
        if k < 8:
            assert sum(item.casefold() in (text or "").casefold() for text in rows) >= 9
            assert all((d, k) in got for d, text in enumerate(rows) if item.casefold() in (text or "").casefold())
            assert all((d, k) in got for d, text in enumerate(rows) if CHANGED.get(k, "\0") in (text or ""))
    kept = {r["doc_id"] for r in D.clean(docs(spark, rows), bench).collect()}
    assert kept == set(range(len(rows))) - {d for d, _ in got} and {0, 1, 2, 3} <= kept


def test_recall_against_a_scan_of_real_documents(spark):
    """Every document of the given table that holds an item, whatever its case, is found."""
    folder = "/root/testdata/sf0.01"
    rows, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    items = [(r["item_id"], r["text"].casefold()) for r in bench.collect()]
    held = {(r["doc_id"], k) for r in rows.collect() for k, item in items if item in (r["text"] or "").casefold()}
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(rows, bench).collect() if r["leak"]}
    print(f"{len(held & got)} of {len(held)} held items found, {len(got - held)} changed ones besides")
    assert held and held <= got


def test_repeats_nulls_and_empty_tables(spark):
    bench = spark.createDataFrame([*ITEMS.items()], "item_id bigint, text string")
    one = docs(spark, [f"{prose(1)} {ITEMS[3]}"])
    twice = one.unionByName(one).unionByName(one.withColumn("doc_id", F.lit(None).cast("bigint")))
    assert sorted((r["doc_id"] is None, r["item_id"]) for r in D.leaks(twice, bench).collect()) == [(False, 3), (True, 3)]
    assert D.clean(twice, bench).count() == 0
    assert D.leaks(one.limit(0), bench).count() == D.leaks(one, bench.limit(0)).count() == D.clean(one.limit(0), bench).count() == 0
    assert D.clean(twice, bench.limit(0)).count() == 3


def test_items_that_share_a_stem(spark):
    stem = "which of the following statements about the growth of plants in a dry garden is true if"
    items = [(k, f"{stem} {prose(k, 12)}") for k in range(60)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [f"{prose(100)} {items[7][1]}", f"{prose(101)} {stem} {prose(102)}"]
    got = [(r["doc_id"], r["item_id"], r["n_matched"] == r["n_windows"]) for r in D.leaks(docs(spark, rows), bench).collect()]
    assert (0, 7, True) in got and {d for d, _, _ in got} == {0, 1}  # the stem alone is a run of RUN windows
