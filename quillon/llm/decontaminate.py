"""Benchmark decontamination by template canonicalisation, with DataFrame expressions only.

Numbers, names and units become typed placeholders; windows of WIDTH template words are hashed and
joined with the windows of the benchmark. Matches of one alignment form a run; over a run, the
values in the slots of item and document must correspond one way, so a question asked again with
other numbers or names is caught, and an accidental likeness of templates is not.

A word's placeholder depends on the word alone (a unit also on the number before it), whatever
punctuation stands at its ends. Every window is also hashed by its plain words, without case and
punctuation, and either hash may carry a run: so a copy is found word for word even where its
capitals are lost, and a changed question by its template. Windows of almost nothing but placeholders
would match any list of numbers; they are matched by their plain words alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed, packed, small, text_or_empty, unpacked

#: Words of a window (a shorter item is one window of all its words); windows that a run needs.
WIDTH, RUN = 8, 6
#: Words beside placeholders that a window needs to match by its template, if it has WIDTH words and if it has fewer.
TELLING, SHORT_TELLING = 2, 4
#: Words that count as units after a number.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "foot", "yard", "yards", "mile", "miles", "mg", "g", "kg", "lb", "lbs", "pound", "pounds", "ton", "tons",
    "ml", "l", "liter", "liters", "litre", "litres", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks",
    "month", "months", "year", "years", "percent", "dollar", "dollars", "usd", "euro", "euros", "eur", "cent", "cents", "mph", "kmh", "hz", "w", "kw", "v", "c", "f", "k",
)
#: Placeholders: private-use characters, which no letter or digit class holds; in texts they count as white space.
NUMBER, UNIT, NAME = "", "", ""
GAP = f"[\\x20\\x09-\\x0D{NUMBER}-{NAME}]"


def telling(n: int) -> int:
    """Words beside placeholders that a window of n words needs to match by its template."""
    return TELLING if n == WIDTH else min(n, SHORT_TELLING)


def _canonical(flat: Column) -> Column:
    """The template of a text with single spaces, word by word: placeholders, else lower case without punctuation.

    A name is a word whose first letter or digit is a capital; a number is a word whose first letter or digit is a
    digit; a unit is a listed word after a number. Words stay in place, words of punctuation alone
    become empty.
    """
    named = F.regexp_replace(flat, "(?<![^ ])[^\\p{L}\\p{N} ]*[\\p{Lu}\\p{Lt}][^ ]*", NAME)
    counted = F.regexp_replace(named, "(?<![^ ])[^\\p{L}\\p{N} ]*[0-9][^ ]*", NUMBER)
    mark = "[^\\p{L}\\p{N} ]*"
    united = F.regexp_replace(counted, f"(?i)(?<={NUMBER} ){mark}(?:{'|'.join(UNITS)}){mark}(?![^ ])", UNIT)
    filled = F.when(named.rlike("[0-9]"), united).otherwise(named)
    return F.lower(F.regexp_replace(filled, f"[^\\p{{L}}\\p{{N}} {NUMBER}-{NAME}]+", ""))


def with_tokens(df: DataFrame, text: str) -> DataFrame:
    """df with `w`, the template words of a text, and `p`, the plain words behind them."""
    held = lambda x: F.filter(F.split(x, " ", -1), lambda y: y != "")
    df = df.withColumn("_flat", F.regexp_replace(text_or_empty(text), f"{GAP}+", " "))
    plain = F.lower(F.regexp_replace("_flat", "[^\\p{L}\\p{N} ]+", ""))
    return df.withColumns({"w": held(_canonical(F.col("_flat"))), "p": held(plain)}).drop("_flat")


def windows(tokens: DataFrame, keep: list[str], at: str, lengths: list[int]) -> DataFrame:
    """(keep, at, hash) of every window of each of the given lengths, by template and by plain words; texts without a word have none.

    Places are exploded and words are read by position, so that hashes are computed in compiled code.
    """
    place = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - min(lengths)))
    each = tokens.select(*keep, "w", "p", F.explode_outer(place).alias(at)).filter(F.get("w", F.col(at) + (min(lengths) - 1)).isNotNull())
    hashes = [F.when(F.get("w", F.col(at) + (n - 1)).isNotNull(), h) for n in lengths for h in _hash(at, n)[:2]]
    return each.select(*keep, at, F.explode_outer(F.array(*hashes)).alias("hash")).filter("hash is not null")


def _hash(at: str, n: int) -> tuple[Column, Column, Column]:
    """The hashes of the window of n words from `at` by template (null if it tells too little) and by plain words, and whether it has the former."""
    near = [F.get("w", F.col(at) + k) for k in range(n)]
    light = sum((F.when(w.isin(NUMBER, UNIT, NAME), 0).otherwise(1) for w in near), F.lit(0)) >= telling(n)
    return F.when(light, F.xxhash64(F.lit(n), *near)), F.xxhash64(F.lit(-n), *[F.get("p", F.col(at) + k) for k in range(n)]), light


def item_windows(items: DataFrame, lengths: list[int]) -> DataFrame:
    """(item_id, item_pos, hash, n, need, rare) of the windows of items (item_id, w, p).

    A first word that would be a unit after a number gives its template in both forms. A run needs
    RUN windows or all that match by template, if any do, else all. Of n windows of which `need` must be met, any
    n - need + 1 hold one that is: the rarest in the benchmark are marked, and find the candidates.
    """
    first = items.filter(F.get("w", F.lit(0)).isin(*UNITS)).withColumn("w", F.concat(F.array(F.lit(UNIT)), F.slice("w", 2, F.size("w"))))
    parts = []
    for n in lengths:
        own = lambda df, n=n: df.filter(F.least(F.size("w"), F.lit(WIDTH)) == n)
        for df, places in ((own(items), F.sequence(F.lit(0), F.size("w") - n)), (own(first), F.array(F.lit(0)))):
            template, plain, light = _hash("item_pos", n)
            placed = df.select("item_id", "w", "p", F.explode_outer(places).alias("item_pos")).select("item_id", "item_pos", F.array(template, plain).alias("both"), light.alias("light"), F.lit(n).alias("n"))
            parts.append(placed.select("item_id", "item_pos", F.explode_outer("both").alias("hash"), "light", "n").filter("hash is not null"))
    each = parts[0]
    for part in parts[1:]:
        each = each.unionByName(part)
    each = checkpointed(each)
    needs = each.groupBy("item_id").agg(F.count_distinct("item_pos").alias("n_windows"), F.count_distinct(F.when(F.col("light"), F.col("item_pos"))).alias("n_light"))
    needs = needs.withColumn("need", F.least(F.when(F.col("n_light") > 0, F.col("n_light")).otherwise(F.col("n_windows")), F.lit(RUN)))
    often = each.groupBy("hash").agg(F.count("*").alias("often"))
    places = each.join(often, "hash").groupBy("item_id", "item_pos").agg(F.max("often").alias("often"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("often", "item_pos"))
    places = places.withColumn("rank", rank).join(needs, "item_id").select("item_id", "item_pos", "n_windows", "need", (F.col("rank") <= F.col("n_windows") - F.col("need") + 1).alias("rare"))
    return each.drop("light").join(places, ["item_id", "item_pos"])


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(text_hash, item_id, shift, n_matched, n_windows, n_slots, n_changed, leak) of every long enough run of a text.

    Candidates come from the rarest windows of an item, so a stem that many items share does not
    pair every text that holds it with each of them; then all windows of a candidate are counted.
    Whole runs are read again word by word, so equal hashes of different windows do no harm.
    """
    items = with_tokens(benchmark.select("item_id", "text"), "text").select("item_id", "w", "p")
    items = checkpointed(items.filter(F.size("w") > 0))
    lengths = sorted(r["n"] for r in items.select(F.least(F.size("w"), F.lit(WIDTH)).alias("n")).distinct().collect()) or [WIDTH]
    wanted = checkpointed(item_windows(items, lengths))
    texts = docs.select(text_or_empty("text").alias("text")).withColumn("text_hash", F.md5("text"))
    read = windows(with_tokens(texts, "text"), ["text_hash"], "pos", lengths)
    met = checkpointed(read.join(small(wanted.select("hash").distinct()), "hash", "left_semi").distinct())
    rare = wanted.filter("rare").select("hash", "item_id", "item_pos")
    tried = met.join(small(rare), "hash").select("text_hash", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    asked = tried.join(small(wanted.drop("rare")), "item_id").withColumn("pos", F.col("item_pos") + F.col("shift"))
    hits = asked.join(met, ["text_hash", "pos", "hash"])
    runs = hits.groupBy("text_hash", "item_id", "shift", "n", "n_windows", "need").agg(F.count_distinct("item_pos").alias("n_matched"), F.min("item_pos").alias("first"), F.max("item_pos").alias("last"))
    runs = checkpointed(runs.filter("n_matched >= need"))

    held = texts.join(small(runs.select("text_hash").distinct()), "text_hash", "left_semi").dropDuplicates(["text_hash"])
    held = with_tokens(held, "text").select("text_hash", F.col("w").alias("dw"), F.col("p").alias("dp"))
    both = runs.join(held, "text_hash").join(small(items), "item_id")
    size = F.col("last") - F.col("first") + F.col("n")
    of_item, of_doc = F.col("first") + 1, F.col("first") + F.col("shift") + 1
    item = F.arrays_zip(F.slice("w", of_item, size).alias("canon"), F.slice("p", of_item, size).alias("word"))
    doc = F.arrays_zip(F.slice("dw", of_doc, size).alias("canon"), F.slice("dp", of_doc, size).alias("word"))
    both = both.withColumn("pairs", F.zip_with(item, doc, lambda i, d: F.struct(i["canon"].alias("canon"), i["word"].alias("item"), d["word"].alias("doc"), (i["canon"] == d["canon"]).alias("same"))))
    both = both.withColumn("s", F.transform(F.filter("pairs", lambda x: x["same"] & x["canon"].isin(NUMBER, UNIT, NAME)), lambda x: F.struct(x["canon"].alias("canon"), x["item"].alias("item"), x["doc"].alias("doc"))))
    alike = F.size(F.filter("pairs", lambda x: x["same"] | (x["item"] == x["doc"]))) >= F.col("n_matched") + F.col("n") - 1
    return both.filter(alike).select(
        "text_hash", "item_id", "shift", "n_matched", "n_windows", F.size("s").cast("bigint").alias("n_slots"),
        F.size(F.filter("s", lambda x: x["item"] != x["doc"])).cast("bigint").alias("n_changed"),
        (F.size(F.array_distinct(F.transform("s", lambda x: F.xxhash64(x)))) == F.size(F.array_distinct(F.transform("s", lambda x: F.xxhash64(x["canon"], x["item"]))))).alias("leak"),
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, text_hash, n_matched, n_windows, n_slots, n_changed, leak), one row for each document and item with a long enough run.

    leak is true if the slots of a run correspond one way: equal values of the item always meet
    equal values of the document. Of several runs one that leaks counts, then the longest, then the first.
    n_changed counts slots whose value differs (0 for a verbatim copy). Null and empty texts match
    nothing; items without text are never matched; rows that repeat a document give one row. Rows
    with a null doc_id take part. Other columns are ignored; an empty table on either side gives no rows.
    """
    runs = judged(docs, benchmark)
    best = runs.groupBy("text_hash", "item_id", "n_windows").agg(F.max(F.struct("leak", "n_matched", (-F.col("shift")).alias("back"), "n_slots", "n_changed")).alias("r"))
    best = checkpointed(best.select("text_hash", "item_id", "n_windows", "r.*"))
    rows = docs.select("doc_id", F.md5(text_or_empty("text")).alias("text_hash"))
    out = rows.join(small(best), "text_hash").select("doc_id", "item_id", "text_hash", "n_matched", "n_windows", "n_slots", "n_changed", "leak")
    return out.distinct()


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (all columns, repeated rows too) without those that hold an item; null and empty texts stay."""
    found = checkpointed(judged(docs, benchmark).filter("leak").select("text_hash").distinct())
    rows = packed(docs).withColumn("_h", F.md5(text_or_empty("_row.text")))
    return unpacked(rows.join(small(found), rows["_h"] == found["text_hash"], "left_anti"), docs.columns)
