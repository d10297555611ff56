"""Task plans: counts, throughput, phases, decisions and clean-up over the log of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.plans.base import registrar
from quillon.sources.corpus import PAPERS, TASKS, papers, read, tasks

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
T = f"WITH {TASKS} "
ACTIVE = ("queued", "running")
FLAG = "coalesce(CASE WHEN json_valid(payload) THEN payload ->> '$.{}' END, '') NOT IN ('', 'false', '0', '0.0', '[]', '{{}}')"
#: Tasks with their kind and how long they took: since their own start if it is known, at least 0.
KINDS = f"""WITH {TASKS}, kinds AS (SELECT *, CASE WHEN t <> 'index' THEN t WHEN {FLAG.format('download_only')} THEN 'download' WHEN {FLAG.format('parse_only')} THEN 'parse' WHEN {FLAG.format('reindex_only')} THEN 'reindex' ELSE 'index' END AS kind,
  greatest(0, epoch(updated_at) - epoch(coalesce(started_at, created_at)))::DOUBLE AS took FROM (SELECT *, trim(coalesce(nullif(work_type, ''), 'index')) AS t FROM tasks)) """
#: Completions of the window of what is queued or runs, over all kinds and by kind; no rows if nothing does.
DONE = """, w AS (SELECT min(created_at) AS low, max(created_at) AS high FROM tasks WHERE status IN ('queued', 'running')),
done AS (SELECT kind, grouping(kind)::INT AS g_kind, count(*) AS done, min(updated_at) AS first_done, round(avg(took), 2) AS mean_seconds FROM (SELECT kinds.* FROM kinds, w WHERE status = 'completed' AND (created_at BETWEEN low AND high OR updated_at >= low)) GROUP BY GROUPING SETS ((), (kind)))"""
ETA = """CASE WHEN remaining <= 0 OR coalesce(done, 0) < 1 THEN NULL WHEN mean_seconds > 0 THEN round(remaining * mean_seconds / 2, 3) WHEN elapsed >= 5 THEN round(remaining * elapsed / done, 3) END"""


def kinds(spark, sf_dir) -> DataFrame:
    """Tasks with their kind and how long they took: since their own start if it is known, at least 0."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    took = F.greatest(F.lit(0.0), (micros(F.col("updated_at")) - micros(F.coalesce("started_at", "created_at"))) / 1e6)
    return tasks(spark, sf_dir).withColumns({"kind": X.task_kind(F.col("work_type"), F.col("payload")), "took": took})


def throughput(rows: DataFrame) -> DataFrame:
    """(kind, g_kind, low, high, done, first_done, mean_seconds) over all kinds (g_kind 1) and by kind.

    Counts what was completed among tasks created between the first and the last active one, or
    updated since the first. Without an active task there is no window and there are no rows.
    """
    window = rows.filter(F.col("status").isin(*ACTIVE)).agg(F.min("created_at").alias("low"), F.max("created_at").alias("high"))
    of = F.col("created_at").between(F.col("low"), F.col("high")) | (F.col("updated_at") >= F.col("low"))
    done = rows.filter("status = 'completed'").join(F.broadcast(window), of)  # one row
    sets = done.groupingSets([[], [F.col("kind")]], F.col("kind"))
    sets = sets.agg(F.grouping("kind").cast("int").alias("g_kind"), F.count("*").alias("done"), F.min("updated_at").alias("first_done"), F.round(F.avg("took"), 2).alias("mean_seconds"))
    return sets.join(F.broadcast(window), F.col("low").isNotNull())


def estimates(remaining: DataFrame, done: DataFrame, on: list[str], as_of: DataFrame, workers: int = 2) -> DataFrame:
    """remaining with `eta`, seconds until it is done.

    It is the mean duration of completed tasks, dealt over the workers; where that is not above 0, the
    pace since the first completion, if at least 5 seconds have passed by `as_of` (one row, `now`).
    Nothing left to do, or nothing completed, gives null.
    """
    met = (remaining.join(done, on, "left") if on else remaining.join(F.broadcast(done), F.lit(True), "left")).join(F.broadcast(as_of))
    elapsed = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("first_done").cast("timestamp"))) / 1e6
    left, n, mean = F.col("remaining"), F.col("done"), F.col("mean_seconds")
    eta = F.when((left <= 0) | (F.coalesce(n, F.lit(0)) < 1), None).when(mean > 0, F.round(left * mean / workers, 3)).when(elapsed >= 5, F.round(left * elapsed / n, 3))
    return met.withColumn("eta", eta)


def left_to_do() -> F.Column:
    """Queued tasks, and of each running one the part that its progress leaves."""
    s = F.col("status")
    part = 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("seconds") / 600))
    return F.round(F.count_if(s == "queued") + F.sum(F.when(s == "running", part).otherwise(0.0)), 6).alias("remaining")


LEFT = "round(count(*) FILTER (WHERE status = 'queued') + sum(CASE WHEN status = 'running' THEN 1 - least(1, greatest(0, seconds / 600)) ELSE 0 END), 6)"
ELAPSED = "(SELECT epoch(max(updated_at)) FROM tasks) - epoch(first_done) AS elapsed"


@query(KINDS + "SELECT work_type AS task_type, kind, status, count(*) AS n, grouping(work_type)::INT AS g_type, grouping(kind)::INT AS g_kind, grouping(status)::INT AS g_status FROM kinds GROUP BY GROUPING SETS ((status), (work_type), (work_type, status), (kind), (kind, status))")
def task_counts(spark, sf_dir):
    """Counts by status, by type, by kind, and by type or kind and status, in one pass."""
    rows = kinds(spark, sf_dir).drop("task_type").withColumnRenamed("work_type", "task_type")
    t, k, s = F.col("task_type"), F.col("kind"), F.col("status")
    sets = rows.groupingSets([[s], [t], [t, s], [k], [k, s]], t, k, s)
    return sets.agg(F.count("*").alias("n"), *[F.grouping(c).cast("int").alias(g) for c, g in (("task_type", "g_type"), ("kind", "g_kind"), ("status", "g_status"))])


@query(KINDS + DONE + " SELECT done.*, low, high FROM done, w WHERE low IS NOT NULL")
def queue_throughput(spark, sf_dir):
    """Completed work within the window of what is active, over all kinds and by kind."""
    return throughput(kinds(spark, sf_dir))


@query(T + "SELECT min(created_at) AS low, max(created_at) AS high FROM tasks WHERE status IN ('queued', 'running')")
def pending_range(spark, sf_dir):
    return tasks(spark, sf_dir).filter(F.col("status").isin(*ACTIVE)).agg(F.min("created_at").alias("low"), F.max("created_at").alias("high"))


@query(f"WITH {PAPERS}, {TASKS} SELECT t.id, t.status, title, t.created_at FROM tasks t LEFT JOIN papers p ON p.id = t.paper_id AND NOT deleted WHERE status IN ('queued', 'running')")
def active_tasks(spark, sf_dir, of: DataFrame | None = None):
    """Active tasks, running ones first, then by age; of the papers (id) of a list, if one is given."""
    live = papers(spark, sf_dir).filter(~F.col("deleted")).select(F.col("id").alias("paper_id"), "title")
    rows = tasks(spark, sf_dir).filter(F.col("status").isin(*ACTIVE))
    rows = rows if of is None else rows.join(of.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    return rows.join(live, "paper_id", "left").select("id", "status", "title", "created_at").orderBy(F.desc(F.col("status") == "running"), "created_at", "id")


@query(f"WITH {PAPERS}, {TASKS} SELECT id, CASE status WHEN 'queued' THEN 'cancelled' ELSE 'failed' END AS new_status FROM tasks WHERE status IN ('queued', 'running') AND paper_id NOT IN (SELECT id FROM papers WHERE NOT deleted)")
def cancel_orphans(spark, sf_dir):
    """Active tasks whose paper is gone: queued ones are cancelled, running ones fail."""
    live = papers(spark, sf_dir).filter(~F.col("deleted")).select(F.col("id").alias("paper_id"))
    lost = tasks(spark, sf_dir).filter(F.col("status").isin(*ACTIVE)).join(live, "paper_id", "left_anti")
    return lost.select("id", F.when(F.col("status") == "queued", "cancelled").otherwise("failed").alias("new_status"))


@query(T + "SELECT status, task_type, count(*) AS n FROM tasks WHERE status IN ('failed', 'cancelled') GROUP BY ALL")
def purge_terminal(spark, sf_dir):
    return tasks(spark, sf_dir).filter(F.col("status").isin("failed", "cancelled")).groupBy("status", "task_type").agg(F.count("*").alias("n"))


@query(T + "SELECT paper_id, task_type, id FROM tasks WHERE status IN ('queued', 'running') QUALIFY row_number() OVER (PARTITION BY paper_id, task_type ORDER BY created_at DESC, id DESC) = 1")
def active_task_of_paper(spark, sf_dir):
    newest = F.max(F.struct("created_at", "id"))["id"].alias("id")
    return tasks(spark, sf_dir).filter(F.col("status").isin(*ACTIVE)).groupBy("paper_id", "task_type").agg(newest)


@query(T + "SELECT paper_id, task_type, arg_max(id, (created_at, id)) AS id, max(value) AS best FROM tasks GROUP BY ALL")
def latest_report(spark, sf_dir):
    return tasks(spark, sf_dir).groupBy("paper_id", "task_type").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.max("value").alias("best"))


INTENT = "concat_ws(','" + "".join(f", CASE WHEN {FLAG.format(n)} THEN '{n}' END" for n in ("force", "reindex_only", "parse_only", "download_only")) + ")"


@query(KINDS + f""", {PAPERS}, x AS (SELECT *, {INTENT} AS intent FROM kinds), a AS (SELECT paper_id, arg_max(status, (created_at, id)) AS s, arg_max(intent, (created_at, id)) AS now FROM x WHERE t = 'index' AND status IN ('queued', 'running') GROUP BY 1)
SELECT r.paper_id, r.intent, CASE WHEN p.id IS NULL THEN 'error' WHEN a.s IS NULL THEN 'insert' WHEN a.now = r.intent THEN 'dedupe' WHEN a.s = 'running' THEN 'reject' ELSE 'replace' END AS action
FROM (SELECT DISTINCT paper_id, intent FROM x) r LEFT JOIN papers p ON p.id = r.paper_id AND NOT deleted LEFT JOIN a ON a.paper_id = r.paper_id""")
def enqueue_decision(spark, sf_dir):
    """What to do with a request to index a paper, given its newest active task of indexing.

    The same intent is asked for once; a running task of another intent refuses the request, a queued
    one is replaced by it.
    """
    rows = kinds(spark, sf_dir).withColumn("intent", X.task_intent(F.col("payload")))
    asked = rows.select("paper_id", "intent").distinct()
    live = papers(spark, sf_dir).filter(~F.col("deleted")).select(F.col("id").alias("paper_id"), F.lit(True).alias("there"))
    newest = F.max_by(F.struct("status", "intent"), F.struct("created_at", "id")).alias("a")
    index = F.trim(F.coalesce(F.nullif(F.col("work_type"), F.lit("")), F.lit("index"))) == "index"
    now = rows.filter(F.col("status").isin(*ACTIVE) & index).groupBy("paper_id").agg(newest)
    action = (
        F.when(F.col("there").isNull(), "error").when(F.col("a").isNull(), "insert").when(F.col("a.intent") == F.col("intent"), "dedupe")
        .when(F.col("a.status") == "running", "reject").otherwise("replace")
    )
    return asked.join(live, "paper_id", "left").join(now, "paper_id", "left").select("paper_id", "intent", action.alias("action"))


PHASES = """, m AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER w IS DISTINCT FROM event_type AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(turn::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS span FROM m),
g AS (SELECT user_id, span, any_value(event_type) AS phase, min(ts) AS started_at, count(*) AS n FROM s GROUP BY ALL)"""


@query(T + PHASES + " SELECT user_id, span::BIGINT AS span, phase, started_at, lead(started_at) OVER (PARTITION BY user_id ORDER BY span) AS ended_at, n FROM g")
def phase_history(spark, sf_dir):
    """Spans of equal events of a user in time; a span ends where the next one starts."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").withColumn("turn", (~F.lag("event_type").over(order).eqNullSafe(F.col("event_type"))).cast("int"))
    spans = rows.withColumn("span", F.sum("turn").over(order)).groupBy("user_id", "span").agg(F.first("event_type").alias("phase"), F.min("ts").alias("started_at"), F.count("*").alias("n"))
    return spans.withColumn("ended_at", F.lead("started_at").over(Window.partitionBy("user_id").orderBy("span")))


@query(KINDS + "SELECT id, kind, count(*) OVER w AS n, round(avg(CASE WHEN took >= 5 THEN took END) OVER w, 6) AS mean FROM kinds WHERE status = 'completed' WINDOW w AS (PARTITION BY kind ORDER BY created_at, id)")
def running_average(spark, sf_dir):
    """Completions of a kind so far and the mean of those that took 5 seconds or more.

    There are few kinds, so a window over a kind would be one task: totals of days are summed first,
    and the windows over rows reach over a day of a kind only.
    """
    done = kinds(spark, sf_dir).filter("status = 'completed'").select("id", "kind", "created_at", F.when(F.col("took") >= 5, F.col("took")).alias("long"), F.date_trunc("day", "created_at").alias("day"))
    days = done.groupBy("kind", "day").agg(F.count("*").alias("n0"), F.count("long").alias("m0"), F.coalesce(F.sum("long"), F.lit(0.0)).alias("s0"))
    before = Window.partitionBy("kind").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("kind", "day", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n0", "m0", "s0")])
    own = Window.partitionBy("kind", "day").orderBy("created_at", "id")
    rows = done.withColumns({"n": F.count("*").over(own), "m": F.count("long").over(own), "s": F.coalesce(F.sum("long").over(own), F.lit(0.0))}).join(days, ["kind", "day"])
    n, m, s = (F.col(c) + F.col(f"{c}0") for c in "nms")
    return rows.select("id", "kind", n.alias("n"), F.when(m > 0, F.round(s / m, 6)).alias("mean"))


@query(KINDS + "SELECT id, kind, paper_id, substr(repeat('error of ' || id || ' ', 60), 1, 500) AS error, updated_at FROM kinds WHERE status = 'failed' ORDER BY updated_at DESC, id LIMIT 20")
def failed_samples(spark, sf_dir, n=20):
    """The newest failed tasks with their kind and the first 500 characters of their error."""
    newest = kinds(spark, sf_dir).filter("status = 'failed'").orderBy(F.desc("updated_at"), "id").limit(n)
    error = F.repeat(F.concat(F.lit("error of "), "id", F.lit(" ")), 60)
    return newest.select("id", "kind", "paper_id", F.substring(error, 1, 500).alias("error"), "updated_at")


@query(KINDS + DONE + f" SELECT kind, remaining, done, {ETA} AS eta FROM (SELECT r.kind, remaining, coalesce(done, 0) AS done, mean_seconds, {ELAPSED} FROM (SELECT kind, {LEFT} AS remaining FROM kinds GROUP BY 1) r LEFT JOIN done d ON r.kind = d.kind AND g_kind = 0)")
def queue_eta_by_kind(spark, sf_dir):
    """The estimate of each kind by its own completions."""
    rows = kinds(spark, sf_dir)
    found = estimates(rows.groupBy("kind").agg(left_to_do()), throughput(rows).filter("g_kind = 0"), ["kind"], rows.agg(F.max("updated_at").alias("now")))
    return found.select("kind", "remaining", F.coalesce("done", F.lit(0)).alias("done"), "eta")


@query(KINDS + DONE + f" SELECT remaining, done, {ETA} AS eta FROM (SELECT remaining, coalesce(done, 0) AS done, mean_seconds, {ELAPSED} FROM (SELECT {LEFT} AS remaining FROM kinds) LEFT JOIN done ON g_kind = 1)")
def queue_eta(spark, sf_dir):
    """Seconds until the queue is empty; a running task counts by what it has left."""
    rows = kinds(spark, sf_dir)
    found = estimates(rows.agg(left_to_do()), throughput(rows).filter("g_kind = 1"), [], rows.agg(F.max("updated_at").alias("now")))
    return found.select("remaining", F.coalesce("done", F.lit(0)).alias("done"), "eta")


@query(T + "SELECT coalesce(paper_id, 'total') AS job, count(*) AS started, count(*) FILTER (WHERE status = 'completed') AS done, min(created_at) AS first_at, max(updated_at) AS last_at FROM tasks GROUP BY ROLLUP (paper_id)")
def log_progress(spark, sf_dir):
    """Progress of each job and of all jobs."""
    rows = tasks(spark, sf_dir).rollup("paper_id").agg(F.count("*").alias("started"), F.count_if(F.col("status") == "completed").alias("done"), F.min("created_at").alias("first_at"), F.max("updated_at").alias("last_at"))
    return rows.select(F.coalesce("paper_id", F.lit("total")).alias("job"), "started", "done", "first_at", "last_at")


@query("SELECT l_orderkey AS paper, count(*) AS prefix FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem WHERE l_linenumber <> 4) WHERE l_linenumber = k GROUP BY 1")
def completed_prefix(spark, sf_dir):
    """How many slices from the first are complete without a gap."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), "l_linenumber").filter("l_linenumber <> 4")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("paper").orderBy("l_linenumber"))).filter("l_linenumber = k").groupBy("paper").agg(F.count("*").alias("prefix"))


@query(KINDS + "SELECT id, work_type, payload, kind FROM kinds")
def task_kind(spark, sf_dir):
    """The kind of a task from its type and the flags of its payload."""
    return kinds(spark, sf_dir).select("id", "work_type", "payload", "kind")


@query(T + """SELECT id, CASE WHEN id % 7 = 0 OR id % 11 = 0 THEN 0 ELSE greatest(0, epoch(b) - epoch(a)) END::DOUBLE AS elapsed FROM (SELECT id, CASE WHEN id % 2 = 0 THEN created_at ELSE updated_at END AS a, CASE WHEN id % 2 = 0 THEN updated_at ELSE created_at END AS b FROM tasks)""")
def iso_seconds(spark, sf_dir):
    """Seconds between two times kept as text; 0 where the second is earlier or one is missing or no time."""
    k = F.col("id")
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    a, b = F.when(k % 2 == 0, text("created_at")).otherwise(text("updated_at")), F.when(k % 2 == 0, text("updated_at")).otherwise(text("created_at"))
    a, b = F.when(k % 7 == 0, "yesterday").otherwise(a), F.when(k % 11 != 0, b)
    return tasks(spark, sf_dir).select("id", X.seconds_between(a, b).alias("elapsed"))


@query(f"WITH {PAPERS}, {TASKS} SELECT t.id, t.status, title, t.created_at FROM tasks t JOIN papers p ON p.id = t.paper_id AND lang = 'en' LEFT JOIN (SELECT id AS i FROM papers WHERE NOT deleted) ON i = p.id WHERE status IN ('queued', 'running')".replace("t.status, title", "t.status, CASE WHEN i IS NOT NULL THEN title END AS title"))
def active_tasks_of(spark, sf_dir):
    """Active tasks of the English papers."""
    return active_tasks(spark, sf_dir, papers(spark, sf_dir).filter("lang = 'en'"))
