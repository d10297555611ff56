"""Phases of tasks: their states, how long they took, their rates and what is left of the current one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spans(events: DataFrame, task: list[str], at: list[str], phase: str, done: str) -> DataFrame:
    """(task, no, phase, started_at, ended_at, done): stretches of equal phases of a task in time; the last one is open.

    What is done in a stretch is what its last event says.
    """
    order = Window.partitionBy(*task).orderBy(*at)
    rows = events.withColumn("_turn", (~F.lag(phase).over(order).eqNullSafe(F.col(phase)) | (F.row_number().over(order) == 1)).cast("int")).withColumn("no", F.sum("_turn").over(order))
    found = rows.groupBy(*task, "no").agg(F.first(phase).alias("phase"), F.min(at[0]).alias("started_at"), F.max_by(done, F.struct(*at)).alias("done"))
    return found.withColumn("ended_at", F.lead("started_at").over(Window.partitionBy(*task).orderBy("no")))


def millis(at: Column) -> Column:
    """Milliseconds of a time with or without a zone."""
    return F.unix_millis(at.cast("timestamp"))


def rates(tasks: DataFrame, closed: DataFrame, task: list[str]) -> DataFrame:
    """(task, place, phase, status, elapsed_ms, done, total, rate, eta) for each phase that a task goes through.

    tasks: the phases in order, the current one (phase, started_at, done, total) and as_of. closed: finished
    spans (no, phase, started_at, ended_at, seconds, done, total), the last of a phase counts. A phase with a
    closed span is done, the current one runs, earlier ones without a span are skipped. A span lasts its
    seconds if they are known, else from start to end, else nothing; the current one from its start (if unknown,
    now) until as_of. The rate (a second) needs a second or more and something done; what is left (eta, seconds)
    is told for the current phase only, while less than its total is done.
    """
    last = closed.groupBy(*task, "phase").agg(F.max_by(F.struct("started_at", "ended_at", "seconds", "done", "total"), "no").alias("h"))
    current = F.struct("phase", "started_at", "done", "total").alias("c")
    each = tasks.select(*task, current, "as_of", (F.array_position("phases", F.col("phase")) - 1).alias("at"), F.posexplode("phases").alias("place", "phase")).join(last, [*task, "phase"], "left")
    status = F.when(F.col("h").isNotNull(), "done").when(F.col("phase") == F.col("c.phase"), "running").when(F.col("place") < F.col("at"), "skipped").otherwise("pending")
    each = each.withColumn("status", status)
    ms = lambda a, b: F.greatest(F.lit(0), millis(b) - millis(a))
    known = F.when(F.col("h.seconds") > 0, F.round(F.col("h.seconds") * 1000).cast("bigint")).otherwise(F.coalesce(ms(F.col("h.started_at"), F.col("h.ended_at")), F.lit(0)))
    of = lambda hist, now: F.when(F.col("status") == "done", hist).when(F.col("status") == "running", now)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    elapsed = of(known, millis(F.col("as_of")) - millis(F.coalesce("c.started_at", "as_of")))
    each = each.withColumns({"elapsed_ms": elapsed, "done": of(zero("h.done"), zero("c.done")), "total": of(zero("h.total"), zero("c.total"))})
    each = each.withColumn("rate", F.when((F.col("elapsed_ms") >= 1000) & (F.col("done") > 0), F.col("done") / (F.col("elapsed_ms") / 1000)))
    left = F.col("total") - F.col("done")
    eta = F.when((F.col("status") == "running") & (F.col("total") > 0) & (left > 0), left / F.col("rate"))
    return each.select(*task, "place", "phase", "status", "elapsed_ms", "done", "total", F.round("rate", 9).alias("rate"), F.round(eta, 6).alias("eta"))


def duration(ms: Column) -> Column:
    """A duration as it is shown: under a second, seconds, minutes with seconds, hours with minutes."""
    sec = F.floor(ms / 1000)
    minutes, hours = F.floor(sec / 60), F.floor(sec / 3600)
    part = lambda n, unit: F.when(n > 0, F.concat(F.lit(" "), n, F.lit(unit))).otherwise("")
    long = F.concat(hours, F.lit(" 时"), part(minutes % 60, " 分"))
    return F.when(ms < 1000, "<1 秒").when(sec < 60, F.concat(sec, F.lit(" 秒"))).when(minutes < 60, F.concat(minutes, F.lit(" 分"), part(sec % 60, " 秒"))).otherwise(long)
