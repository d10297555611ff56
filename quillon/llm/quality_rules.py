"""Quality rules as a ledger of failure bits, with DataFrame expressions only.

Every rule is evaluated once for a row; its failure sets one bit. A policy is a named, versioned
mask: a row is kept if it fails none of the policy's rules. Ablations need the ledger only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import text_or_empty, words

#: name of a rule and the condition under which a row fails it, over the measurements; the order gives the bits.
RULES = (
    ("too_few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words and n_words > 0"),
)
BASE = ("too_few_words", "repeated_words")
#: version: rules that the policy applies.
POLICIES = {"base": BASE, "v1": tuple(name for name, _ in RULES)}
_MARKS = "#*$%&|<>"
_GAPS = " \t\n\x0b\x0c\r"
#: Above so many comparisons repeats are found by sorting positions.
_SEARCH = 500_000


def mask(policy: str) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in POLICIES[policy])


def _with_repeat_places(rows: DataFrame) -> DataFrame:
    """rows with `_at`: the places of 3-word windows found twice or more, in order.

    Reads `_h`, the windows' hashes, and `_d`, the repeated ones. Short searches go through `_d`; in
    long texts with many repeats the places are sorted by hash and neighbours are compared.
    """
    many = F.size("_d").cast("bigint") * F.size("_h") > _SEARCH
    sorted_ = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_p", F.when(many, sorted_))
    same = lambda k, j: F.coalesce(F.get("_p", k + j)["h"] == F.get("_p", k)["h"], F.lit(False))
    compared = F.array_sort(F.transform(F.filter("_p", lambda p, k: same(k, F.lit(-1)) | same(k, F.lit(1))), lambda p: p["i"]))
    searched = F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda i: F.array_contains("_d", F.get("_h", i)))
    found = F.when(F.size("_p") > 0, compared).when(F.size("_d") > 0, searched)
    return rows.withColumn("_at", F.coalesce(found, F.array().cast("array<int>"))).drop("_p")


def _covered() -> Column:
    """Words that the windows at `_at` cover: each adds three, less those that the one before it has covered."""
    added = F.transform("_at", lambda a, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), a - F.get("_at", k - 1))))
    return F.aggregate(added, F.lit(0), lambda total, x: total + x).cast("bigint")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words) for every row.

    A null text is an empty one, with zeros throughout; rows that repeat are measured each. Other columns are ignored.
    """
    text = text_or_empty("text")
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.translate(x, _GAPS, "")) > 0)
    rows = docs.select("doc_id", text.alias("_t")).withColumns({"_w": words(F.col("_t")), "_l": lines})
    windows = F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "doc_id",
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.translate("_t", _GAPS, "")).cast("bigint").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", _MARKS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.size("_l").cast("bigint").alias("n_lines"),
        windows.alias("_h"),
    )
    rows = rows.withColumn("_s", F.sort_array("_h"))
    rows = rows.withColumn("_d", F.array_distinct(F.filter("_s", lambda h, i: (i > 0) & (h == F.get("_s", i - 1)))))
    return _with_repeat_places(rows).withColumn("n_repeat_words", _covered()).drop("_h", "_s", "_d", "_at")


def ledger(measures: DataFrame) -> DataFrame:
    """The measurements with `bits`: bit i is set if the row fails rule i."""
    return measures.withColumn("bits", sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(0) for i, (_, rule) in enumerate(RULES)), F.lit(0)).cast("bigint"))


def verdicts(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """A ledger with base_failed and kept under a policy; who fails a base rule is never kept."""
    base = F.col("bits").bitwiseAND(F.lit(mask("base"))) != 0
    return rows.withColumns({"base_failed": base, "kept": ~base & (F.col("bits").bitwiseAND(F.lit(mask(policy))) == 0)})


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """(rule, failed, only): rows that fail each rule of the policy, and rows that would be kept without it."""
    under = rows.groupBy(F.col("bits").bitwiseAND(F.lit(mask(policy))).alias("b")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("bigint").alias("bit")) for i, (name, _) in enumerate(RULES) if name in POLICIES[policy]]))
    each = under.select("b", "n", rules.alias("r"))
    hit = F.col("b").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy("r.rule").agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("failed"), F.coalesce(F.sum(F.when(F.col("b") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("only"))


def all_ablations(rows: DataFrame) -> DataFrame:
    """ablations() of every version: (policy, rule, failed, only), in one pass over the rows.

    The rows are counted by their bits first, a table of at most one row for each set of failed rules.
    """
    counts = rows.groupBy("bits").agg(F.count("*").alias("n"))
    bit = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(bit[r]).cast("bigint").alias("bit"), F.lit(mask(p)).cast("bigint").alias("mask")) for p in sorted(POLICIES) for r in POLICIES[p]]))
    under = counts.select("n", each.alias("r"), "bits").withColumn("b", F.col("bits").bitwiseAND(F.col("r.mask")))
    some = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return under.groupBy("r.policy", "r.rule").agg(some(F.col("b").bitwiseAND(F.col("r.bit")) != 0).alias("failed"), some(F.col("b") == F.col("r.bit")).alias("only"))
