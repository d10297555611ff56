"""The boosted part of the PII operator: planted spans of other forms than the base patterns, thresholds by brute force, odd inputs."""

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import pii
from tests.llm.test_operators import brute_pii, docs

WORDS = "river garden window letter paper mountain street kitchen music evening winter bread ship market forest".split()


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def luhn(digits):
    """The check digit of digits."""
    d = [int(c) for c in digits][::-1]
    return -(sum(x * 2 - 9 * (x > 4) for x in d[::2]) + sum(d[1::2])) % 10


def planted(n=600, seed=4):
    """(text, {(kind, start, end)} that no base pattern finds, spans that are nothing): base forms teach, other forms ask."""
    rng, out = np.random.default_rng(seed), []
    digits = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    for i in range(n):
        phone = f"({rng.integers(200, 999)}) 555-{digits(4)}"
        name, host = f"ann.{digits(2)}", f"mail{i % 9}.example.com"
        card = str(rng.integers(4, 6)) + digits(14)
        mark = "".join(rng.choice(list("0123456789abcdef"), 38)) + "a7"
        ten = str(rng.integers(3, 5)) + digits(13)
        base = [f"+1 {phone}", f"{name}@{host}", card + str(luhn(card)), ".".join(str(x) for x in rng.integers(1, 255, 4))]
        other = [("phone", phone), ("email", f"{name} (at) {host}"), ("card", ten + str(luhn(ten))), ("secret", mark)]  # the last one stands in quotes
        bad = [f"x{digits(9)}y", "2024-01-%02d" % (1 + i % 28), "300.1.2.999", card + str((luhn(card) + 1) % 10), f"{digits(4)}.{digits(2)}", "internationalizations"]
        text, found = prose(i, 6), set()
        if i % 3:
            text += f" {base[i % 4]} {prose(i + 1, 5)} token = \"{mark[::-1]}\" {prose(i + 5, 3)} {bad[i % 6]} {prose(i, 3)} {bad[(i + 1) % 6]} {prose(i, 3)}"
        else:
            kind, span = other[(i // 3) % 4]
            text += ' say "'
            found.add((kind, len(text), len(text) + len(span)))
            text += f'{span}" {prose(i + 2, 4)} {bad[i % 6]} {prose(i + 3, 2)}'
        out.append((text, found))
    return out


def test_trees_add_spans_of_other_forms(spark):
    made = planted()
    rows = pii.detected(docs(spark, [t for t, _ in made]), F.col("text")).collect()
    added, right, wanted = 0, 0, sum(len(f) for _, f in made)
    for r in rows:
        text, want = made[r["doc_id"]]
        base = {(k, *s) for k, spans in brute_pii(text).items() for s in spans}
        got = {(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["spans"]}
        assert base == {(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["base"]} and base <= got
        new = {x for x in got - base if not (x[0] == "secret" and 'token = "' in text[max(0, x[1] - 9) : x[1]])}
        added, right = added + len(new), right + len(new & want)
    print(f"recall {right / wanted:.2f}, precision {right / max(1, added):.2f}")
    assert right >= 0.9 * wanted and right >= 0.95 * added


def test_thresholds_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        cells = [(k, int(rng.integers(0, 64)), f, int(n := rng.integers(1, 60)), int(rng.integers(0, n + 1)) if rng.random() < 0.5 else int(n)) for k in range(4) for f in (0, 1) for _ in range(8)]
        trees, thresholds = pii.boost(cells)
        for k in range(4):
            held = [(pii._margin(trees, b), n, good) for kind, b, f, n, good in cells if kind == k and f]
            fit = [t for t, _, _ in held if (rows := sum(n for m, n, _ in held if m >= t)) >= pii.LEAST and sum(g for m, _, g in held if m >= t) >= pii.PRECISION * rows]
            assert thresholds.get(k) == min(fit, default=None)


def test_hidden_features_are_never_split_on():
    wide = [i for i, (name, _) in enumerate(pii.FEATURES) if name == "digits_16"][0]
    cells = [(pii.CARD, bits, f, 50, 50 * (bits >> wide & 1)) for bits in range(1 << (wide + 1)) if bits.bit_count() < 3 for f in (0, 1)]
    assert all(wide not in (root, low[0], high[0]) for root, low, high in pii.boost(cells, pii.HIDDEN[pii.CARD])[0])


def test_odd_inputs(spark):
    texts = [None, "", "a@b.c " * 10_000, "+1 (988) 555-2485", "+1 (988) 555-2485", "x" * 100_000 + "7"]
    df = docs(spark, texts).withColumns({"base": F.lit("b"), "spans": F.lit(3), "_text": F.lit("t"), "_m": F.lit(1), "wide": F.lit(2), "_row": F.lit(0)})
    rows = {r["doc_id"]: r for r in pii.detected(df, F.coalesce("text", F.lit(""))).collect()}
    assert rows[0].asDict().keys() == {*df.columns, "docs_base", "docs_spans"}
    assert all((r["docs_base"], r["docs_spans"], r["_text"], r["_m"], r["wide"], r["_row"]) == ("b", 3, "t", 1, 2, 0) for r in rows.values())
    assert [len(rows[i]["base"]) for i in range(6)] == [0, 0, 10_000, 1, 1, 0] and rows[3]["spans"] == rows[4]["spans"]
    assert pii.detected(df.limit(0), F.col("text")).count() == pii.redacted(df.limit(0)).count() == 0
    out = {r["doc_id"]: r for r in pii.redacted(df).collect()}
    assert out[3]["text"] == "[PHONE]" == out[4]["text"] and out[0]["text"] is None and out[3]["spans"] == 3 and out[3].asDict().keys() == set(df.columns)


def test_long_secrets_and_addresses_go_whole(spark):
    """A key of 800 characters and an address with a long local part leave nothing behind."""
    made = [t for t, _ in planted()]
    key = "".join(np.random.default_rng(9).choice(list("0123456789abcdef"), 798)) + "a7"
    long_name = "ann." * 30 + "lee"
    texts = [*made, f'{prose(1, 5)} token = "{key}" {prose(2, 4)}', f'{prose(3, 5)} say "{long_name} (at) mail3.example.com" {prose(4, 4)}']
    out = {r["doc_id"]: r["text"] for r in pii.redacted(docs(spark, texts)).collect()}
    assert out[len(made)] == f'{prose(1, 5)} token = "[SECRET]" {prose(2, 4)}'
    assert out[len(made) + 1] == f'{prose(3, 5)} say "[EMAIL]" {prose(4, 4)}'


def test_neighbouring_numbers_are_told_apart(spark):
    """Two phones side by side are two spans; a stretch over both is none; numbers judged never overlap."""
    made = [t for t, _ in planted()] + [f"{prose(i, 5)} +1-555-{200 + i}-{1000 + 7 * i} {prose(i + 1, 5)}" for i in range(120)]
    asked = ["(555) 123-4567 (555) 987-6543", "555-123-4567 555-987-6543", "(212) 555-0101 (212) 555-0199 (212) 555-0170"]
    rows = {r["doc_id"]: r for r in pii.detected(docs(spark, [*made, *[f'say "{a}" {prose(7, 4)}' for a in asked]]), F.col("text")).collect()}
    got = {a: [a[s["start"] - 5 : s["end"] - 5] for s in rows[len(made) + i]["spans"]] for i, a in enumerate(asked)}
    assert got == {asked[0]: ["(555) 123-4567", "(555) 987-6543"], asked[1]: ["555-123-4567", "555-987-6543"], asked[2]: ["(212) 555-0101", "(212) 555-0199", "(212) 555-0170"]}
    for r in rows.values():
        numbers = sorted((s["start"], s["end"]) for s in r["spans"] if pii.KINDS[s["kind"]] in ("ip", "card", "phone") and s not in r["base"])
        assert all(a[1] <= b[0] for a, b in zip(numbers, numbers[1:]))


def test_stretches_of_pieces_by_brute_force(spark):
    import re

    texts = ["030 1234 5678 now", "1 2 3 4 5 6 7 8", "4111 1111 1111 1111, 12.", "+49 (30) 1234-5678 +1 (988) 555-2485", "1 - 2 3456 78", "", "10.0.0.1 2024-01-02", "((1234567))", "9" * 40 + " 1"]
    df = pii.with_spans(docs(spark, texts).withColumn("_text", F.col("text")), "p", pii.PIECE, F.lit(True)).select("doc_id", pii._numbers(F.col("p")).alias("n"))
    for r in df.collect():
        text, want = texts[r["doc_id"]], set()
        pieces = [(m.start(), m.group()) for m in re.finditer(pii.PIECE, text)]
        for i in range(len(pieces)):
            for j in range(i, len(pieces)):
                if all(re.search(r" [ .-]{0,2}$", p) for _, p in pieces[i:j]):
                    match = re.sub(r"[ .-]+$", "", "".join(p for _, p in pieces[i : j + 1]))
                    n = sum(c.isdigit() for c in match)
                    if 7 <= n <= 19 if " " in match else len(match) >= 7:
                        want.add((pieces[i][0], pieces[i][0] + len(match), match))
        assert {(x["start"], x["end"], x["match"]) for x in r["n"]} == want and all(text[a:b] == m for a, b, m in want)
