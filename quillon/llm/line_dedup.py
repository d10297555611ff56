"""Lines that many documents share, dropped with DataFrame expressions only.

Texts are exploded into lines; a line's key (stripped, A-Z lower-cased) is named by 128 bits. Distinct
documents of each name are counted with the pairs of name and document as the shuffle's key, so a
line of a third of all documents is spread over all tasks. Lines meet the frequent names: the names
that stand in most pairs are broadcast, and as there are at most HEAVY of those by arithmetic, the
rest shuffles with no key that is large. Only places of dropped lines are gathered for a text, which
is then put together from the stretches between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed, packed, text_or_empty, unpacked

#: Documents in which a key must stand, and code points that it must have, for its lines to be dropped.
DOCUMENTS, LEAST = 10, 1
#: Names that are broadcast at most: those in at least 1/HEAVY of all pairs of name and document.
HEAVY = 200_000
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ("n_lines", "n_dropped")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _named(rows: DataFrame, keep: list[str], least: int) -> DataFrame:
    """(keep, at, h1, h2) of each line of `_text` whose key has at least `least` code points."""
    lines = rows.select(*keep, F.split("_text", "\n", -1).alias("_lines"))
    each = lines.select(*keep, F.posexplode_outer("_lines").alias("at", "_line")).select(*keep, "at", line_key(F.col("_line")).alias("_key"))
    return each.filter(F.length("_key") >= least).select(*keep, "at", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(1), "_key").alias("h2"))


def frequent_lines(docs: DataFrame, documents: int = DOCUMENTS, least: int = LEAST) -> DataFrame:
    """(h1, h2, n_docs) of the keys found in at least `documents` different doc_ids; null doc_ids count as one."""
    rows = docs.select(F.struct("doc_id").alias("_doc"), text_or_empty("text").alias("_text"))
    pairs = _named(rows, ["_doc"], least).groupBy("h1", "h2")
    return pairs.agg(F.count_distinct("_doc").alias("n_docs")).filter(F.col("n_docs") >= documents)


def _places(rows: DataFrame, frequent: DataFrame, least: int) -> DataFrame:
    """(_row_key, places): where the lines of each text with frequent keys stand, in order."""
    total = frequent.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    bound = total // HEAVY + 1  # at most HEAVY names can stand in this many pairs
    lines = _named(rows, ["_row_key"], least)
    names = lambda test: frequent.filter(test).select("h1", "h2")
    heavy = lines.join(F.broadcast(names(F.col("n_docs") >= bound)), ["h1", "h2"], "left_semi")
    hits = heavy.select("_row_key", "at")
    if frequent.filter(F.col("n_docs") < bound).limit(1).count():
        light = lines.join(F.broadcast(names(F.col("n_docs") >= bound)), ["h1", "h2"], "left_anti")
        hits = hits.unionByName(light.join(names(F.col("n_docs") < bound).hint("shuffle_merge"), ["h1", "h2"], "left_semi").select("_row_key", "at"))
    return hits.groupBy("_row_key").agg(F.array_sort(F.collect_set("at")).alias("_places"))


def without_frequent_lines(docs: DataFrame, documents: int = DOCUMENTS, least: int = LEAST) -> DataFrame:
    """docs (all columns) whose texts have lost the lines with frequent keys, with `n_lines` (before) and `n_dropped`.

    Lines are what stands between \\n; the others stay as they are, in order, joined by \\n. A key counts
    once for a doc_id however often it stands there, so rows that repeat a document count once; rows
    with a null doc_id count as one document. Null and empty texts have one empty line, which is never
    frequent while `least` is 1 or more; null texts stay null. A text that loses all lines becomes
    empty. n_chars is counted anew if docs has it. Columns of docs named n_lines or n_dropped come back
    as docs_n_lines and docs_n_dropped. An empty table gives an empty one.
    """
    frequent = checkpointed(frequent_lines(docs, documents, least))
    own = F.concat(F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("")), F.lit("\n"), F.col("_text"))
    rows = packed(docs).withColumn("_text", text_or_empty("_row.text")).withColumn("_row_key", F.md5(own))
    places = checkpointed(_places(rows.select("_row_key", "_text"), frequent, least))
    both = rows.join(places, "_row_key", "left").withColumn("_lines", F.split("_text", "\n", -1))
    ends = F.concat("_places", F.array(F.size("_lines")))
    starts = F.concat(F.array(F.lit(0)), F.transform("_places", lambda p: p + 1))
    both = both.withColumn("_gaps", F.arrays_zip(starts.alias("from"), ends.alias("to")))
    kept = F.flatten(F.transform("_gaps", lambda g: F.slice("_lines", g["from"] + 1, g["to"] - g["from"])))
    both = both.withColumn("_clean", F.when(F.col("_places").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("_row.text")))
    row = F.col("_row").withField("text", F.col("_clean"))
    if "n_chars" in docs.columns:
        row = F.when(F.col("_places").isNotNull(), row.withField("n_chars", F.length("_clean").cast("bigint"))).otherwise(F.col("_row"))
    out = both.select(row.alias("_row"), F.size("_lines").cast("bigint").alias("n_lines"), F.coalesce(F.size("_places"), F.lit(0)).cast("bigint").alias("n_dropped"))
    return out.select(*[F.col(f"_row.`{c}`").alias(f"docs_{c}" if c in ADDED else c) for c in docs.columns], *ADDED)
