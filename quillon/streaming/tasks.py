"""Streams of task events: file source, all that is there, then stop. Results equal the batch form."""

from __future__ import annotations

import uuid

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunking
from quillon.plans.base import registrar
from quillon.plans.operations import PHASES
from quillon.sources import sinks
from quillon.sources.corpus import one_of

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

LATE = "40 days"


def stream(spark, sf_dir: str, late: str = LATE) -> DataFrame:
    """Events as a file stream; event time is ts, rows later than `late` may be dropped by windows."""
    whole = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.readStream.schema(whole.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def drained(df: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over what is there and returns its result table.

    State, progress and rows lie in a folder that driver and executors share; a batch that runs again
    replaces its own rows. In complete mode the last batch replaces all.
    """
    spark = df.sparkSession
    folder = f"{sinks.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], df.schema).write.parquet(f"{folder}/rows/none")

    def write(rows: DataFrame, no: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/{'all' if mode == 'complete' else no}")

    run = df.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    try:
        run.awaitTermination()
    finally:
        run.stop()
    return spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{folder}/rows")


@query("SELECT event_type, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1")
def stream_task_state(spark, sf_dir):
    return drained(stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at")), "complete").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_at", "last_at")})


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_task_counts(spark, sf_dir):
    counts = stream(spark, sf_dir).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return drained(counts, "complete").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT event_type, count(*) FILTER (WHERE value >= 5) AS n, round(avg(value) FILTER (WHERE value >= 5), 6) AS mean FROM events GROUP BY 1")
def stream_throughput(spark, sf_dir):
    timed = F.when(F.col("value") >= 5, F.col("value"))
    return drained(stream(spark, sf_dir).groupBy("event_type").agg(F.count(timed).alias("n"), F.round(F.avg(timed), 6).alias("mean")), "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    return drained(stream(spark, sf_dir).dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type"), "append")


SPAN = "user_id bigint, span bigint, phase string, started_at timestamp, ended_at timestamp, n bigint"


def _close_spans(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Closes a span when the phase changes; the open one stays in the state."""
    span, phase, began, n = state.get if state.exists else (0, None, None, 0)
    closed = []
    rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
    for ts, kind in zip(rows["ts"], rows["event_type"], strict=True):
        if span == 0 or kind != phase:
            if span:
                closed.append((key[0], span, phase, began, ts, n))
            span, phase, began, n = span + 1, kind, ts, 0
        n += 1
    state.update((span, phase, began, n))
    yield pd.DataFrame(closed, columns=["user_id", "span", "phase", "started_at", "ended_at", "n"])


def phase_spans(events: DataFrame) -> DataFrame:
    """Closed spans of equal phases of each user from a stream of events (user_id, ts, event_id, event_type).

    A user's state is the open span only. Within a batch events are put in order; a later batch is
    taken to hold later events, as spans once closed are never opened again.
    """
    state = "span bigint, phase string, began timestamp, n bigint"
    return events.select("user_id", "ts", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(_close_spans, SPAN, state, "append", "NoTimeout")


@query("WITH " + PHASES.lstrip(", ") + " SELECT user_id, span::BIGINT AS span, phase, started_at, lead(started_at) OVER (PARTITION BY user_id ORDER BY span) AS ended_at, n FROM g QUALIFY ended_at IS NOT NULL")
def stream_phase_history(spark, sf_dir):
    """Spans that are closed; the batch form is phase_history."""
    return drained(phase_spans(stream(spark, sf_dir)), "append").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")})


def stream_inventory(scans: DataFrame, path: str, checkpoint: str):
    """Runs scans of files (root, path, size, mtime, sha256) into a table of roots; a root's new scan replaces its old one.

    Everything there is is taken, batch by batch; a batch that runs again gives the same table.
    """

    def take(rows: DataFrame, _: int) -> None:
        sinks.replace_papers(rows.sparkSession, rows.withColumn("paper_id", F.col("root")), path)

    return scans.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_index(docs: DataFrame, path: str, checkpoint: str):
    """Runs a stream of texts (doc_id, text) into an index of the chunks of their sections; a paper that comes again replaces its chunks."""

    def take(rows: DataFrame, _: int) -> None:
        last = rows.groupBy("doc_id").agg(F.max("text").alias("text"))
        made = chunking.indexed_sections(last.select(F.col("doc_id").cast("string").alias("paper_id"), T.clean_markdown(F.coalesce("text", F.lit(""))).alias("markdown")))
        sinks.replace_papers(rows.sparkSession, made, path, last.select(F.col("doc_id").cast("string").alias("paper_id")))

    return docs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATUSES = ("queued", "running", "completed", "failed", "cancelled")


def task_changes(events: DataFrame) -> DataFrame:
    """(task_id, at, no, status, value): each event is a change of the task of its user and type."""
    return events.select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("task_id"), F.col("ts").alias("at"), F.col("event_id").alias("no"), one_of(F.col("event_id"), *STATUSES).alias("status"), "value"
    )


#: A change of a task; the newest by time, then by number, is its state.
CHANGE = ("at", "no", "status", "value")


def upsert_states(changes: DataFrame, batch: int, path: str) -> None:
    """Merges a batch of changes (task_id, at, no, status, value) into the table of task states at path.

    A task's row holds its newest change, `n` changes seen, `n_late` of them that were older than the
    state that earlier batches had left, the last batch that it was in and the last that changed its
    state. Changes without a task or a time are left out. Only the buckets of the batch's tasks are
    read and written. A batch that runs again, whole or after a part of its buckets was written,
    changes nothing, as a task's row tells that it has had that batch.
    """
    spark = changes.sparkSession
    each = changes.filter("task_id is not null and at is not null").withColumn("paper_id", F.col("task_id")).select("paper_id", F.struct(*CHANGE).alias("change"))
    if not sinks.exists(spark, path):
        known = each.limit(0).select("paper_id", F.col("change").alias("state"), *[F.lit(0).cast("bigint").alias(c) for c in ("n", "n_late", "last_batch", "changed_batch")])
    else:
        touched = [r["b"] for r in each.select(sinks.bucket().alias("b")).distinct().collect()]  # at most sinks.BUCKETS rows
        known = spark.read.parquet(path).filter(F.col("bucket").isin(touched) & F.col("paper_id").isNotNull()).select("paper_id", F.struct(*CHANGE).alias("state"), "n", "n_late", "last_batch", "changed_batch")
    # All of a batch's changes of a task meet in two partial steps: those newer than the state, and the others, each as one row.
    by_age = each.join(known, "paper_id", "left").filter(F.col("last_batch").isNull() | (F.col("last_batch") < batch))
    late = F.coalesce(F.col("change") <= F.col("state"), F.lit(False))
    met = by_age.groupBy("paper_id").agg(F.max("change").alias("top"), F.max("state").alias("state"), F.count("*").alias("new"), F.count_if(late).alias("late"), *[F.max(c).alias(c) for c in ("n", "n_late", "changed_batch")])
    state = F.greatest("top", F.coalesce("state", "top"))
    merged = met.select(
        "paper_id", state.alias("state"), (F.coalesce("n", F.lit(0)) + F.col("new")).alias("n"), (F.coalesce("n_late", F.lit(0)) + F.col("late")).alias("n_late"), F.lit(batch).cast("bigint").alias("last_batch"),
        F.when(F.col("state").isNull() | (F.col("top") > F.col("state")), F.lit(batch).cast("bigint")).otherwise(F.col("changed_batch")).alias("changed_batch"),
    )
    sinks.replace_papers(spark, sinks.kept(merged.select("paper_id", "state.*", "n", "n_late", "last_batch", "changed_batch")), path)


def stream_states(changes: DataFrame, path: str, checkpoint: str):
    """Runs a stream of changes into the table of task states at path."""
    return changes.writeStream.foreachBatch(lambda rows, no: upsert_states(rows, no, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states(spark, path: str, after: int | None = None) -> DataFrame:
    """The snapshot of all task states, or only those that changed after a batch that a reader has seen."""
    rows = sinks.table(spark, path).withColumnRenamed("paper_id", "task_id")
    return rows if after is None else rows.filter(F.col("changed_batch") > after)


@query(
    f"""SELECT task_id, status, value, changed_at, n FROM (SELECT concat_ws(':', user_id, event_type) AS task_id, ts AS changed_at, event_id, ({list(STATUSES)})[event_id % 5 + 1] AS status, value,
  count(*) OVER (PARTITION BY concat_ws(':', user_id, event_type)) AS n FROM events WHERE ts IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY changed_at DESC, event_id DESC) = 1"""
)
def stream_task_latest(spark, sf_dir):
    """The newest state of each task, kept by keyed upserts of a stream of changes."""
    folder = f"{sinks.shared_folder(spark)}/states-{uuid.uuid4().hex}"
    run = stream_states(task_changes(stream(spark, sf_dir)), f"{folder}/table", f"{folder}/state")
    try:
        run.awaitTermination()
    finally:
        run.stop()
    return states(spark, f"{folder}/table").select("task_id", "status", "value", F.col("at").cast("timestamp_ntz").alias("changed_at"), "n")


#: Windows close when event time is so far past their end; then their state goes.
CLOSES = "1 hour"
#: Where the watermark stands after all events, in whole milliseconds.
CLOSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)"


def sliding_counts(events: DataFrame) -> DataFrame:
    """Counts of each type in windows of a day that start every six hours, of a stream with a watermark."""
    return events.groupBy(F.window("ts", "1 day", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))


def activity_sessions(events: DataFrame) -> DataFrame:
    """Bursts of a user's events with no gap of over six hours, of a stream with a watermark."""
    return events.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query(
    f"""SELECT start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k::INT * INTERVAL 6 HOUR AS start, event_type FROM events, range(4) t(k) WHERE ts IS NOT NULL)
WHERE start + INTERVAL 1 DAY <= {CLOSED} GROUP BY ALL"""
)
def stream_sliding_counts(spark, sf_dir):
    """Closed sliding windows in append mode: the watermark bounds the state, open windows are not given."""
    return drained(sliding_counts(stream(spark, sf_dir, CLOSES)), "append").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    f"""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS ends, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM (
  SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR, true) AS fresh FROM events WHERE ts IS NOT NULL))
GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= {CLOSED}"""
)
def stream_activity_sessions(spark, sf_dir):
    """Closed sessions of each user in append mode; a session's state goes when the watermark has passed its end."""
    found = drained(activity_sessions(stream(spark, sf_dir, CLOSES)), "append")
    return found.select("user_id", *[F.col(f"w.{a}").cast("timestamp_ntz").alias(b) for a, b in (("start", "start"), ("end", "ends"))], "n", "errors")
