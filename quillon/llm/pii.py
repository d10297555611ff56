"""Personal data by boosted trees over candidate spans, with DataFrame expressions only.

Base patterns give certain spans. Wider generators propose further, overlapping candidates: every stretch
of linked pieces of digits that holds 7 to 19 digits, addresses with a spelled at, long mixed strings. Each is described by binary
features of its form and its context. Labels do not follow the features alone: a candidate counts as
positive where it is a base span (an address: meets one; a secret: follows a word such as "token"), as negative
where its form rules it out or where it is a mere part or extension of a base span of its kind, and as unlabelled else; what the vouching itself looks at (the plus, the at
sign, sixteen digits, the word) is hidden from the trees. So a phone without plus or an address with
"(at)" is judged by what it shares with certain ones. Labelled candidates of the corpus are counted by
feature cell, a table bounded by the number of cells; on these counts trees of depth two are boosted
for each kind, and a threshold is calibrated on the held-out half. Trees and thresholds become Column
expressions that select spans among all candidates that overlap no base span; of selected numbers that
overlap each other one that is no loose cut stays, then the one furthest above its threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import packed, text_or_empty, unpacked

#: The kinds with base patterns, then those that only the trees find.
KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
#: The base patterns, written so that no start is tried twice within a run; matches are those of the plain forms.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    EMAIL: rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[ -]?[0-9]){15,}+",
    PHONE: r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators of high recall: pieces of digits, each with the space that links it to the next, addresses with a spelled at, long strings of letters and digits.
PIECE = r"(?<![0-9])[+(]{0,2}+[0-9](?:[0-9().-]*[0-9])?\)?(?: [ .-]{0,2}(?=[+(]{0,2}[0-9]))?"
#: A number has so many digits, thus at most so many pieces.
FEWEST, MOST = 7, 19
ADDRESS = rf"(?<![{_LOCAL}])[{_LOCAL}]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9.-]{{2,}}+"
STRING = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+"
#: Characters before a candidate that are read, and words that vouch for a secret there.
LEFT = 24
VOUCHED = "(?i)(?:token|secret|passw|api.?key|auth|credential)[^\\p{L}]*$"
ROUNDS, RATE, PRECISION, LEAST = 24, 0.3, 0.98, 5
#: Spans looked at together in texts with many.
SPANS = 128


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    turned = F.split(F.reverse(digits), "")
    value = lambda c, i: F.when(i % 2 == 1, F.get(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.filter(turned, lambda c: c != ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: int, match: Column) -> Column:
    if kind == IP:
        return F.forall(F.split(match, "[.]"), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(match))
    if kind == CARD:
        return n.between(16, 19) & _luhn(_digits(match))
    return n.between(8, 15) if kind == PHONE else F.lit(True)


def with_spans(df: DataFrame, out: str, pattern: str, may: Column) -> DataFrame:
    """df with `out`: spans (start, end, match) of the leftmost matches in `_text`; `may` is a cheap necessary condition.

    A match starts where the pieces between matches and the earlier matches end.
    """
    df = df.withColumn("_m", F.when(may, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    sizes = F.zip_with(F.split("_text", pattern, -1), "_m", lambda gap, m: F.length(gap) + F.coalesce(F.length(m), F.lit(0)))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n)
    df = df.withColumn("_z", F.when(F.size("_m") > 0, sizes))
    # Sums of blocks of sizes, and of the blocks before each, so that many matches take no quadratic time.
    df = df.withColumn("_sums", F.when(F.size("_z") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("_z") - 1) / SPANS).cast("int")), lambda k: total(F.slice("_z", k * SPANS + 1, SPANS)))))
    df = df.withColumn("_before", F.transform("_sums", lambda _, k: total(F.slice("_sums", 1, k))))

    def span(m: Column, i: Column) -> Column:
        block = F.floor(i / SPANS).cast("int")
        end = F.get("_before", block) + total(F.slice("_z", block * SPANS + 1, i - block * SPANS + 1))
        return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match"))

    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return df.withColumn(out, F.when(F.size("_z") > 0, F.transform("_m", span)).otherwise(empty)).drop("_m", "_z", "_sums", "_before")


def _plain(kind: int, found: Column) -> Column:
    """The valid spans of a kind as (kind, start, end)."""
    return F.transform(F.filter(found, lambda x: _valid(kind, x["match"])), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def with_base(df: DataFrame) -> DataFrame:
    text = F.col("_text")
    may = {EMAIL: F.contains(text, F.lit("@")), IP: text.rlike("[0-9]\\.[0-9]"), CARD: text.rlike("[0-9]"), PHONE: F.contains(text, F.lit("+"))}
    for kind, pattern in PATTERNS.items():
        df = with_spans(df, f"_s{kind}", pattern, may[kind])
    return df.withColumn("base", F.concat(*[_plain(kind, F.col(f"_s{kind}")) for kind in PATTERNS])).drop(*[f"_s{kind}" for kind in PATTERNS])


def _near(words: str):
    return lambda x: x["left"].rlike(f"(?i)(?:{words})[^\\p{{L}}]*$")


def _luhn_length(x: Column) -> Column:
    return F.length(_digits(x["match"])).between(12, 19) & _luhn(_digits(x["match"]))


_GLUED_LEFT = lambda x: x["left"].rlike("[\\p{L}0-9_=/-]$")
_GLUED_RIGHT = lambda x: x["right"].rlike("^[\\p{L}0-9_]")
_DATE = lambda x: x["match"].rlike("^[(]?[12][0-9]{3}([-.])[01]?[0-9]\\1[0-3]?[0-9]")
_QUAD = "^[0-9]{1,3}(?:\\.[0-9]{1,3}){3}$"
_NAMED = lambda x: x["match"].rlike("[A-Za-z0-9-]\\.[A-Za-z]{2,}$")
_PARTED = lambda x: x["match"].rlike("[0-9][ ().-]+[0-9]")
#: A number of several pieces that is cut off from further ones, unless a bracket or a plus begins the next number after four digits.
_LOOSE = lambda x: F.contains(x["match"], F.lit(" ")) & (
    (x["left"].rlike("[0-9)] [ .-]{0,2}$") & ~(x["match"].rlike("^[(+]") & x["left"].rlike("[0-9]{4} $")))
    | (x["right"].rlike("^ [0-9(+]") & ~(x["right"].rlike("^ [(+]") & x["match"].rlike("[0-9]{4}$")))
)
#: Binary features of a candidate `x` (start, end, match) with the characters before (left) and after it (right).
FEATURES = (
    ("phone_word", _near("phone|tel|call|mobile|cell|fax|number")),
    ("card_word", _near("card|visa|mastercard|amex|account|iban")),
    ("mail_word", _near("mail|contact|write|reach|address")),
    ("host_word", _near("host|ip|server|client|from")),
    ("glued_left", _GLUED_LEFT),
    ("glued_right", _GLUED_RIGHT),
    ("quoted", lambda x: x["left"].rlike("[\"']$")),
    ("bracket", lambda x: F.contains(x["match"], F.lit("("))),
    ("dashes", lambda x: F.contains(x["match"], F.lit("-"))),
    ("parted", _PARTED),
    ("date", _DATE),
    ("digits_8", lambda x: F.length(_digits(x["match"])) >= 8),
    ("digits_16", lambda x: F.length(_digits(x["match"])) > 15),
    ("luhn", _luhn_length),
    ("octets", lambda x: x["match"].rlike(_QUAD) & _valid(IP, x["match"])),
    ("domain", _NAMED),
    ("hex", lambda x: x["match"].rlike("^[0-9a-fA-F]+$")),
    ("long", lambda x: F.length(x["match"]) >= 32),
    ("mixed", lambda x: x["match"].rlike("[0-9]") & x["match"].rlike("[A-Za-z]")),
    ("loose_cut", _LOOSE),
)
LOOSE_BIT = 1 << [name for name, _ in FEATURES].index("loose_cut")
#: For each kind the features that its vouching looks at, which its trees do not see.
HIDDEN = {CARD: ("digits_16",)}


def _ruled_out(kind: int, x: Column) -> Column:
    """Whether the form of a candidate rules its kind out."""
    n, glued = F.length(_digits(x["match"])), _GLUED_LEFT(x) | _GLUED_RIGHT(x)
    if kind == EMAIL:
        return ~_NAMED(x)
    if kind == IP:
        return glued | ~_valid(IP, x["match"])
    if kind == CARD:
        return glued | ~_luhn(_digits(x["match"]))
    if kind == PHONE:
        return glued | (n < 8) | (n > 15) | _DATE(x) | ~(_PARTED(x) | FEATURES[0][1](x))
    return ~(x["match"].rlike("[0-9]") & x["match"].rlike("[A-Za-z]")) | x["left"].rlike("[./@:]$") | x["right"].rlike("^[./@]") | x["match"].rlike("[/-].*[/-]")


def _numbers(pieces: Column) -> Column:
    """The stretches (start, end, match) of linked pieces that hold FEWEST to MOST digits, and single pieces of that many characters or more."""

    def from_piece(p: Column, i: Column) -> Column:
        def stretch(n: Column) -> Column:
            own = F.slice(pieces, i + 1, n)
            match = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["match"]), ""), "[ .-]+$", "")
            joined = F.forall(F.slice(own, 1, n - 1), lambda x: x["match"].rlike(" [ .-]{0,2}$"))
            return F.struct(p["start"].alias("start"), (p["start"] + F.length(match)).alias("end"), match.alias("match"), (joined & (F.size(own) == n)).alias("joined"))

        lengths = F.sequence(F.lit(1), F.when(p["match"].rlike(" [ .-]{0,2}$"), F.lit(MOST)).otherwise(F.lit(1)))
        fits = lambda x: x["joined"] & F.when(F.contains(x["match"], F.lit(" ")), F.length(_digits(x["match"])).between(FEWEST, MOST)).otherwise(F.length(x["match"]) >= FEWEST)
        return F.transform(F.filter(F.transform(lengths, stretch), fits), lambda x: F.struct(x["start"], x["end"], x["match"]))

    return F.flatten(F.transform(pieces, from_piece))


def candidates(docs: DataFrame) -> DataFrame:
    """docs with `_text` with `base` (spans of certain kinds) and `wide` (candidates: kind, start, end, bits, label, free).

    label is 1 for a candidate that is vouched for, 0 for one that is ruled out, else null; free ones overlap no base span.
    """
    rows = with_base(docs)
    rows = with_spans(rows, "_piece", PIECE, F.col("_text").rlike("[0-9][0-9 ().-]{5}"))
    rows = rows.withColumn("_number", _numbers(F.col("_piece"))).drop("_piece")
    spelled = F.contains(F.col("_text"), F.lit("@")) | F.contains(F.col("_text"), F.lit("(at)")) | F.contains(F.col("_text"), F.lit("[at]"))
    rows = with_spans(rows, "_address", ADDRESS, spelled)
    rows = with_spans(rows, "_string", STRING, F.col("_text").rlike("[0-9]") & F.col("_text").rlike("(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20}"))

    def drawn(found: str, kind: int | None):
        around = lambda x: F.struct(
            F.lit(kind).cast("int").alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"),
            F.substring("_text", F.greatest(F.lit(1), x["start"] + 1 - LEFT), F.least(F.lit(LEFT), x["start"])).alias("left"), F.substring("_text", x["end"] + 1, F.lit(2)).alias("right"),
        )
        return F.transform(found, around)

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("base") - 1) / SPANS).cast("int")), lambda k: F.slice("base", k * SPANS + 1, SPANS))
    blocks = F.transform(cut, lambda b: F.struct(F.array_min(F.transform(b, lambda x: x["start"])).alias("low"), F.array_max(F.transform(b, lambda x: x["end"])).alias("high"), b.alias("spans")))
    rows = rows.withColumn("_blocks", F.when(F.size("base") > 0, blocks).otherwise(F.array().cast("array<struct<low:int,high:int,spans:array<struct<kind:int,start:int,end:int>>>>")))
    wide = F.concat(drawn("_number", None), drawn("_address", EMAIL), drawn("_string", SECRET))
    rows = rows.withColumn("_wide", wide).drop("_number", "_address", "_string")

    def described(x: Column) -> Column:
        n = F.length(_digits(x["match"]))
        kind = F.coalesce(x["kind"], F.when(x["match"].rlike(_QUAD), IP).when(n >= 13, CARD).otherwise(PHONE))
        bits = sum((F.when(test(x), F.lit(1 << i)).otherwise(0) for i, (_, test) in enumerate(FEATURES)), F.lit(0))
        over = lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])
        met = lambda test: F.exists("_blocks", lambda b: (b["low"] < x["end"]) & (x["start"] < b["high"]) & F.exists(b["spans"], test))
        same = lambda b: over(b) & (b["kind"] == kind)
        whole = lambda b: same(b) & (b["start"] == x["start"]) & (b["end"] == x["end"])
        vouched = F.when(kind == SECRET, x["left"].rlike(VOUCHED)).when(kind == EMAIL, met(same)).otherwise(met(whole))
        out = F.coalesce(*[F.when(kind == k, _ruled_out(k, x)) for k in range(len(KINDS))])
        label = F.when(vouched & ~(out & (kind == SECRET)), 1).when(out | met(same), 0)
        return F.struct(kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), bits.alias("bits"), label.alias("label"), (~met(over)).alias("free"))

    return rows.withColumn("wide", F.transform("_wide", described)).drop("_wide", "_blocks")


def _tree(cells: list[tuple[int, float, float]], seen: list[int]) -> tuple:
    """The tree of depth two of least squares over (bits, weight, residual sum), on the features seen: (bit, (bit, low, high), (bit, low, high))."""

    def split(part: list) -> tuple[float, int]:
        best = (-1.0, -seen[0])
        for b in seen:
            gain = 0.0
            for side in (0, 1):
                own = [c for c in part if (c[0] >> b & 1) == side]
                weight = sum(c[1] for c in own)
                gain += sum(c[2] for c in own) ** 2 / (weight + 1)
            best = max(best, (gain, -b))
        return best[0], -best[1]

    mean = lambda part: sum(c[2] for c in part) / (sum(c[1] for c in part) * 0.25 + 1)
    root = split(cells)[1]
    sides = []
    for side in (0, 1):
        part = [c for c in cells if (c[0] >> root & 1) == side]
        b = split(part)[1] if part else seen[0]
        sides.append((b, *(mean([c for c in part if (c[0] >> b & 1) == s]) for s in (0, 1))))
    return root, *sides


def _margin(trees: list[tuple], bits: int) -> float:
    total = 0.0
    for root, low, high in trees:
        b, *leaf = high if bits >> root & 1 else low
        total += RATE * leaf[bits >> b & 1]
    return total


def boost(cells: list[tuple[int, int, int, int, int]], hidden: tuple[str, ...] = ()) -> tuple[list[tuple], dict[int, float]]:
    """Trees and the thresholds of each kind from counts (kind, bits, fold, labelled rows, positive rows).

    Fold 0 is fitted, without the hidden features; on fold 1 a kind's threshold is the least margin
    above which the share of positives stays at PRECISION or more, over at least LEAST rows. A kind
    without one adds no span.
    """
    seen = [i for i, (name, _) in enumerate(FEATURES) if name not in hidden]
    fitted: dict[int, list[int]] = {}
    for _, bits, fold, n, good in cells:
        if not fold:
            fitted.setdefault(bits, [0, 0])
            fitted[bits][0] += n
            fitted[bits][1] += good
    trees: list[tuple] = []
    for _ in range(ROUNDS if fitted else 0):
        chance = {b: 1 / (1 + math.exp(-max(-30.0, min(30.0, _margin(trees, b))))) for b in fitted}
        trees.append(_tree([(b, n, good - n * chance[b]) for b, (n, good) in sorted(fitted.items())], seen))
    thresholds = {}
    for kind in range(len(KINDS)):
        held = sorted(((_margin(trees, bits), n, good) for k, bits, fold, n, good in cells if k == kind and fold), reverse=True)
        rows = hits = 0
        for at, (margin, n, good) in enumerate(held):
            rows, hits = rows + n, hits + good
            if (at + 1 == len(held) or held[at + 1][0] < margin) and trees and rows >= LEAST and hits >= PRECISION * rows:
                thresholds[kind] = margin
    return trees, thresholds


def fit(described: DataFrame) -> dict[int, tuple[list[tuple], float]]:
    """Trees and threshold of each kind that has one, from the labelled candidates of all rows, counted by kind, feature cell and fold."""
    fold = F.pmod(F.xxhash64("_text"), F.lit(2)).cast("int")
    each = described.select(fold.alias("fold"), F.explode_outer("wide").alias("x")).filter("x.label is not null")
    counted = each.groupBy("x.kind", "x.bits", "fold").agg(F.count("*").alias("n"), F.sum("x.label").alias("good"))
    cells, out = sorted(tuple(r) for r in counted.collect()), {}
    for kind in range(len(KINDS)):
        trees, thresholds = boost([c for c in cells if c[0] == kind], HIDDEN.get(kind, ()))
        if kind in thresholds:
            out[kind] = (trees, thresholds[kind])
    return out


def _excess(models: dict[int, tuple[list[tuple], float]], x: Column) -> Column:
    """How far a candidate lies above the threshold of its kind; null for a kind without one."""
    bits, out = x["bits"], F.lit(None).cast("double")
    has = lambda b: bits.bitwiseAND(F.lit(1 << b)) != 0
    leaf = lambda side: F.when(has(side[0]), F.lit(RATE * side[2])).otherwise(F.lit(RATE * side[1]))
    for kind, (trees, least) in models.items():
        margin = sum((F.when(has(root), leaf(high)).otherwise(leaf(low)) for root, low, high in trees), F.lit(0.0))
        out = F.when(x["kind"] == kind, F.round(margin - least, 9)).otherwise(out)
    return out


def _best(chosen: Column) -> Column:
    """Chosen spans (kind, start, end, loose, over) without the numbers that overlap a better one: no loose cut, further above its threshold, longer, earlier."""
    number = lambda x: x["kind"].isin(IP, CARD, PHONE)
    ranked = F.array_sort(F.transform(F.filter(chosen, number), lambda x: F.struct(x["loose"].alias("loose"), (-x["over"]).alias("o"), (x["start"] - x["end"]).alias("n"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    plain = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    free = lambda a, x: ~F.exists(a, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    kept = F.aggregate(ranked, none, lambda a, x: F.when(free(a, x), F.concat(a, F.array(plain(x)))).otherwise(a))
    return F.concat(kept, F.transform(F.filter(chosen, lambda x: ~number(x)), plain))


def _found(rows: DataFrame) -> DataFrame:
    """rows with `_text` with `base` and `spans`; the model is fitted on all rows first."""
    described = candidates(rows)
    models = fit(described.select("_text", "wide"))
    judged = F.transform(F.filter("wide", lambda x: x["free"]), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (x["bits"].bitwiseAND(F.lit(LOOSE_BIT)) != 0).alias("loose"), _excess(models, x).alias("over")))
    described = described.withColumn("_chosen", F.filter(judged, lambda x: x["over"] >= 0))
    return described.withColumn("spans", F.array_sort(F.concat("base", _best(F.col("_chosen"))))).drop("_chosen").withColumn("base", F.array_sort("base")).drop("wide")


def detected(docs: DataFrame, text: Column) -> DataFrame:
    """docs (all columns) with `base` and `spans`, arrays of (kind, start, end) sorted by kind and start.

    Positions are code points, ends exclusive. Base spans are always among `spans`. A null or empty
    text has none; repeated rows are treated alike; an empty table gives none. Columns of docs
    named base or spans come back as docs_base and docs_spans.
    """
    rows = _found(docs.select(text.alias("_text"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")))
    names = {"base": "docs_base", "spans": "docs_spans"}
    return rows.select(*[F.col(f"_row.`{c}`").alias(names.get(c, c)) for c in docs.columns], "base", "spans")


def count_of(kind: int, spans: Column) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")


def span_list(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of `text` replaced by its kind in square brackets and n_chars counted anew.

    Of overlapping spans what the first leaves over is covered by its mark. Null texts stay null.
    """
    columns = docs.columns
    rows = _found(packed(docs).withColumn("_text", text_or_empty("_row.text")))
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(a: Column, x: Column) -> Column:
        fresh = x["start"] >= a["at"]
        piece = F.concat(F.substring("_text", a["at"] + 1, x["start"] - a["at"]), F.get(names, x["kind"]))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(fresh, F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substring("_text", a["at"] + 1, F.length("_text"))))
    text = F.when(F.col("_row.text").isNotNull(), F.when(F.size("spans") > 0, clean).otherwise(F.col("_text")))
    rows = rows.withColumn("_clean", text)
    out = rows.withColumn("_row", F.col("_row").withField("text", F.col("_clean")))
    if "n_chars" in columns:
        out = out.withColumn("_row", F.when(F.size("spans") > 0, F.col("_row").withField("n_chars", F.length("_clean").cast("bigint"))).otherwise(F.col("_row")))
    return unpacked(out, columns)
