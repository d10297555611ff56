"""Temporal URL list join: dated list entries become validity intervals, joined as of the fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_ROWS, packed

#: Days of a time bucket: a capture meets the intervals of its key that touch its bucket only.
BUCKET_DAYS = 30
#: Pieces into which captures of one key and bucket are dealt where the list is too long to broadcast.
SALTS = 16


def host_of(url: Column) -> Column:
    """The lower-case host of a URL without user, port or final dot; null if there is none."""
    authority = F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), "[.]?(:[0-9]*)?$", "")
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, action, valid_from, valid_to) from dated entries (domain, action, day).

    An entry holds until the next entry of its domain; the last one has no end. Of several entries
    of one day the largest action in text order counts, and repeated entries count once. Entries
    with a null field are void.
    """
    entries = entries.select(F.lower("domain").alias("domain"), "action", "day").filter("domain is not null and action is not null and day is not null")
    last = entries.groupBy("domain", F.col("day").alias("valid_from")).agg(F.max("action").alias("action"))
    return last.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("domain").orderBy("valid_from")))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Captures (all columns in `capture`) with host, matched_domain, action, valid_from, valid_to and blocked.

    The entry of the longest listed domain that is active on the fetch day decides; blocked is true
    for the action `block`. Without host, day or active entry the match is null and blocked false. Each
    number of labels that entries have, from one to any, is one left join with at most one match, so
    rows are neither lost nor multiplied. The list is broadcast up to `bound` interval pieces; beyond, captures of a key are salted.
    """
    spans = intervals(entries)
    ends = captures.agg(F.min(fetched).alias("low"), F.max(fetched).alias("high")).first()
    bucket = lambda day: F.floor(F.unix_date(day) / BUCKET_DAYS)
    clipped = spans.withColumns({"low": F.lit(ends["low"]).cast("date"), "high": F.lit(ends["high"]).cast("date")}).filter("valid_from <= high and (valid_to is null or valid_to > low)")
    reach = F.sequence(bucket(F.greatest("valid_from", "low")), bucket(F.least(F.coalesce(F.date_sub("valid_to", 1), F.col("high")), F.col("high"))))
    pieces = clipped.select("domain", "action", "valid_from", "valid_to", F.explode(reach).alias("bucket"))
    depths = [r["n"] for r in clipped.select(F.size(F.split("domain", "[.]", -1)).alias("n")).distinct().orderBy(F.desc("n")).collect()] or [1]
    light = pieces.limit(bound + 1).count() <= bound
    salts = 1 if light else SALTS
    dealt = pieces.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = packed(captures).withColumn("_host", host_of(F.col(f"_row.`{url}`")))
    rows = rows.withColumns({"_day": F.col(f"_row.`{fetched}`"), "_labels": F.split("_host", "[.]", -1), "_salt": F.pmod(F.xxhash64(f"_row.`{url}`"), F.lit(salts)).cast("int")})
    rows = rows.withColumn("_bucket", bucket(F.col("_day")))
    for depth in depths:
        near = dealt.select(F.struct("domain", "action", "valid_from", "valid_to").alias(f"_m{depth}"), F.col("bucket").alias("b"), F.col("salt").alias("s"))
        key = F.when(F.size("_labels") >= depth, F.array_join(F.slice("_labels", -depth, depth), "."))
        m = F.col(f"_m{depth}")
        rows = rows.join(
            F.broadcast(near) if light else near,
            (key == m["domain"]) & (F.col("_bucket") == F.col("b")) & (F.col("_salt") == F.col("s")) & (F.col("_day") >= m["valid_from"]) & (m["valid_to"].isNull() | (F.col("_day") < m["valid_to"])),
            "left",
        ).drop("b", "s")
    match = F.coalesce(*[F.col(f"_m{depth}") for depth in depths])
    return rows.select(
        F.col("_row").alias("capture"), F.col("_host").alias("host"), match["domain"].alias("matched_domain"), match["action"].alias("action"),
        match["valid_from"].alias("valid_from"), match["valid_to"].alias("valid_to"), F.coalesce(match["action"] == "block", F.lit(False)).alias("blocked"),
    )
