"""Jobs of the catalogue: fallback searches, phase percentages, paths, vectors, the index as a whole."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import models
from quillon.functions import text as T
from quillon.operators import chunking, phases, search
from quillon.plans.base import registrar
from quillon.plans.corpus import TYPED, chunks
from quillon.plans.corpus import ORACLES as TEXT_SQL
from quillon.plans.retrieval import ASKED, TERMS, asked
from quillon.sources import files, sinks
from quillon.sources.corpus import CHUNKS, PAPERS, papers, read

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)


@query(
    f"""WITH {ASKED}, {CHUNKS}, {TERMS}, {PAPERS}, longest AS (SELECT query_id, term FROM terms QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, term) <= 8),
hits AS (SELECT DISTINCT query_id, chunk_id, paper_id FROM longest JOIN chunks ON contains(lower(body), term) WHERE paper_id IN (SELECT id FROM papers WHERE NOT deleted))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM hits QUALIFY rank <= 40"""
)
def like_search(spark, sf_dir):
    """Chunks of live papers that contain any of the eight longest tokens of a query; 40 for each query."""
    by_length = F.array_sort(F.transform(T.search_tokens(F.col("query")), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    ask = asked(spark, sf_dir).select("query_id", F.transform(F.slice(by_length, 1, 8), lambda x: x["t"]).alias("tokens"))
    rows = chunking.chunks(papers(spark, sf_dir, scored=False).filter(~F.col("deleted")))
    hits = search.containing(ask, rows, F.lower("body"), ["chunk_id", "paper_id"], first=40, order=(F.col("chunk_id"),))
    return search.ranked(hits.withColumn("score", F.lit(0.0)), F.col("score"), 40).drop("score")


@query(
    rf"""WITH {ASKED}, {PAPERS}, tokens AS (SELECT query_id, unnest(CASE WHEN len(t) > 0 THEN t[1:6] ELSE [substr(trim(query), 1, 24)] END) AS t FROM (
  SELECT query_id, query, list_filter(regexp_split_to_array(lower(replace(query, '，', ' ')), '\s+'), lambda x: length(x) >= 2) AS t FROM queries WHERE length(trim(query)) >= 2)),
hits AS (SELECT DISTINCT query_id, id AS paper_id, year, created_at FROM tokens JOIN papers ON contains(lower(coalesce(text, '') || chr(10) || title), t) WHERE NOT deleted)
SELECT query_id, paper_id, year, row_number() OVER (PARTITION BY query_id ORDER BY year DESC NULLS LAST, created_at DESC, paper_id) AS rank FROM hits QUALIFY rank <= 6"""
)
def summary_search(spark, sf_dir):
    """Summaries (here: the texts) that contain any of the first six words of a query in content or title, newest first."""
    words = F.filter(F.split(F.lower(F.replace("query", F.lit("，"), F.lit(" "))), "\\s+"), lambda x: F.length(x) >= 2)
    ask = asked(spark, sf_dir).filter(F.length(F.trim("query")) >= 2).withColumn("w", words)
    ask = ask.select("query_id", F.when(F.size("w") > 0, F.slice("w", 1, 6)).otherwise(F.array(F.substring(F.trim("query"), 1, 24))).alias("tokens"))
    live = papers(spark, sf_dir, scored=False).filter(~F.col("deleted")).select(F.col("id").alias("paper_id"), "year", "created_at", "title", "text")
    told = F.lower(F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), "title"))
    order = (F.desc_nulls_last("year"), F.desc("created_at"), F.col("paper_id"))
    hits = search.containing(ask, live, told, ["paper_id", "year", "created_at"], first=6, order=order)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("bigint")).filter("rank <= 6").select("query_id", "paper_id", "year", "rank")


#: Phases of each kind of task, in order.
TEMPLATES = (("signup", "view", "click", "purchase", "error"), ("view", "click", "purchase"), ("purchase", "click", "view", "signup"))


@query(
    f"""WITH e AS (SELECT user_id, ts::DATE AS day, (ts, event_id) AS o, event_type, (props::JSON ->> '$.k')::INT AS k FROM events),
c AS (SELECT user_id, day, arg_max(event_type, o) AS cur, arg_max(k, o) AS done FROM e GROUP BY ALL),
b AS (SELECT user_id, day, max(o) AS before FROM e JOIN c USING (user_id, day) WHERE event_type <> cur GROUP BY ALL),
hist AS (SELECT DISTINCT user_id, day, event_type FROM e JOIN c USING (user_id, day) LEFT JOIN b USING (user_id, day) WHERE event_type <> cur OR o < before),
t AS (SELECT user_id, day, cur, done, (done % 7) * 20 AS total, unnest(p) AS phase, unnest(range(len(p))) AS i, len(p) AS n, list_position(p, cur) - 1 AS cur_i FROM (
  SELECT *, ([{", ".join(str(list(t)) for t in TEMPLATES)}])[user_id % 3 + 1] AS p FROM c)),
s AS (SELECT t.*, CASE WHEN h.event_type IS NOT NULL THEN 'done' WHEN phase = cur THEN 'running' WHEN i < cur_i THEN 'skipped' ELSE 'pending' END AS status FROM t LEFT JOIN hist h ON h.user_id = t.user_id AND h.day = t.day AND h.event_type = t.phase)
SELECT user_id, day, floor(100 * sum(CASE WHEN status IN ('done', 'skipped') THEN 1.0::DOUBLE WHEN status = 'pending' THEN 0 WHEN total <= 0 THEN 0.05 WHEN done <= 0 THEN 0.5 ELSE least(1.0, done::DOUBLE / total) END) / n + 0.5)::BIGINT AS percent,
  count(*) FILTER (WHERE status IN ('done', 'skipped')) AS finished, string_agg(phase || ':' || status, ',' ORDER BY i) AS phases FROM s GROUP BY user_id, day, n"""
)
def phase_progress(spark, sf_dir):
    """States of the phases of each task (a user's day) and its percentage, all phases weighing the same.

    A phase with a closed span is done, the current one runs, earlier ones without a span are skipped.
    """
    at = F.struct("ts", "event_id")
    events = read(spark, sf_dir, "events").withColumns({"day": F.to_date("ts"), "k": F.get_json_object("props", "$.k").cast("int")})
    kinds = events.groupBy("user_id", "day", "event_type").agg(F.min(at).alias("low"), F.max(at).alias("high"), F.max_by("k", at).alias("k"))
    tasks = kinds.groupBy("user_id", "day").agg(F.max(F.struct("high", "event_type", "k")).alias("last"), F.collect_list(F.struct("event_type", "low", "high")).alias("seen"))  # one entry for each type
    tasks = tasks.withColumns({"cur": F.col("last.event_type"), "done": F.col("last.k")}).withColumn("total", F.col("done") % 7 * 20)
    tasks = tasks.withColumn("before", F.array_max(F.transform(F.filter("seen", lambda x: x["event_type"] != F.col("cur")), lambda x: x["high"])))
    closed = F.filter("seen", lambda x: (x["event_type"] != F.col("cur")) | (x["low"] < F.col("before")))
    tasks = tasks.withColumn("hist", F.transform(closed, lambda x: x["event_type"]))
    template = F.element_at(F.array(*[F.array(*map(F.lit, t)) for t in TEMPLATES]), (F.col("user_id") % 3).cast("int") + 1)
    tasks = tasks.withColumn("p", template).withColumn("cur_i", F.array_position("p", F.col("cur")) - 1)
    status = lambda p, i: F.when(F.array_contains("hist", p), "done").when(p == F.col("cur"), "running").when(i < F.col("cur_i"), "skipped").otherwise("pending")
    tasks = tasks.withColumn("s", F.transform("p", status))
    running = F.when(F.col("total") <= 0, 0.05).when(F.col("done") <= 0, 0.5).otherwise(F.least(F.lit(1.0), F.col("done") / F.col("total")))
    part = F.transform("s", lambda s: F.when(s.isin("done", "skipped"), 1.0).when(s == "running", running).otherwise(0.0))
    whole = F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    named = F.zip_with("p", "s", lambda p, s: F.concat(p, F.lit(":"), s))
    return tasks.select("user_id", "day", F.floor(100 * whole / F.size("p") + 0.5).cast("bigint").alias("percent"), F.size(F.filter("s", lambda s: s.isin("done", "skipped"))).cast("bigint").alias("finished"), F.array_join(named, ",").alias("phases"))


@query(
    f"""WITH e AS (SELECT user_id, ts::DATE AS day, ts, event_id, event_type, (props::JSON ->> '$.k')::INT AS k FROM events),
m AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) IS DISTINCT FROM event_type AS turn FROM e),
s AS (SELECT *, sum(turn::INT) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS no FROM m),
g AS (SELECT user_id, day, no, any_value(event_type) AS phase, min(ts) AS a, arg_max(k, (ts, event_id)) AS done FROM s GROUP BY ALL),
h AS (SELECT *, done % 7 * 20 AS total, lead(a) OVER (PARTITION BY user_id, day ORDER BY no) AS b FROM g),
hist AS (SELECT *, CASE no % 3 WHEN 0 THEN 0 WHEN 2 THEN (epoch_us(b) // 1000 - epoch_us(a) // 1000)::DOUBLE / 1000 + 0.5::DOUBLE END AS seconds FROM h WHERE b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, day, phase ORDER BY no DESC) = 1),
cur AS (SELECT user_id, day, phase, CASE WHEN user_id % 5 <> 0 THEN a END AS a, done, total, a + ((user_id % 4) * 40 + 10)::INT * INTERVAL 1 SECOND AS as_of, ([{", ".join(str(list(t)) for t in TEMPLATES)}])[user_id % 3 + 1] AS p FROM h WHERE b IS NULL),
t AS (SELECT c.*, unnest(p) AS each, unnest(range(len(p))) AS place FROM cur c),
x AS (SELECT t.user_id, t.day, place, each AS phase, CASE WHEN h.phase IS NOT NULL THEN 'done' WHEN each = t.phase THEN 'running' WHEN place < list_position(p, t.phase) - 1 THEN 'skipped' ELSE 'pending' END AS status,
  CASE WHEN h.seconds > 0 THEN round(h.seconds * 1000)::BIGINT ELSE greatest(0, epoch_us(h.b) // 1000 - epoch_us(h.a) // 1000) END AS spent, epoch_us(as_of) // 1000 - epoch_us(coalesce(t.a, as_of)) // 1000 AS now, h.done AS hd, h.total AS ht, t.done AS cd, t.total AS ct
  FROM t LEFT JOIN hist h ON h.user_id = t.user_id AND h.day = t.day AND h.phase = each),
y AS (SELECT user_id, day, place, phase, status, CASE status WHEN 'done' THEN spent WHEN 'running' THEN now END AS elapsed_ms, CASE status WHEN 'done' THEN coalesce(hd, 0) WHEN 'running' THEN coalesce(cd, 0) END AS done, CASE status WHEN 'done' THEN coalesce(ht, 0) WHEN 'running' THEN coalesce(ct, 0) END AS total FROM x),
z AS (SELECT *, CASE WHEN elapsed_ms >= 1000 AND done > 0 THEN done::DOUBLE / (elapsed_ms / 1000) END AS r, elapsed_ms // 1000 AS sec FROM y)
SELECT user_id, day, place, phase, status, elapsed_ms, done, total, round(r, 9) AS rate, round(CASE WHEN status = 'running' AND total > 0 AND done < total THEN (total - done) / r END, 6) AS eta,
  CASE WHEN elapsed_ms < 1000 THEN '<1 秒' WHEN sec < 60 THEN sec || ' 秒' WHEN sec < 3600 THEN (sec // 60) || ' 分' || CASE WHEN sec % 60 > 0 THEN ' ' || (sec % 60) || ' 秒' ELSE '' END WHEN sec IS NOT NULL THEN (sec // 3600) || ' 时' || CASE WHEN sec // 60 % 60 > 0 THEN ' ' || (sec // 60 % 60) || ' 分' ELSE '' END END AS shown FROM z"""
)
def phase_rates(spark, sf_dir):
    """Rates and remaining times of the phases of each task (a user's day).

    Some closed spans know their seconds, some only start and end; some current phases have no known start.
    """
    task = ["user_id", "day"]
    events = read(spark, sf_dir, "events").withColumns({"day": F.to_date("ts"), "k": F.get_json_object("props", "$.k").cast("int")})
    found = phases.spans(events, task, ["ts", "event_id"], "event_type", "k").withColumn("total", F.col("done") % 7 * 20)
    seconds = F.when(F.col("no") % 3 == 0, 0.0).when(F.col("no") % 3 == 2, (phases.millis(F.col("ended_at")) - phases.millis(F.col("started_at"))) / 1000 + 0.5)
    template = F.element_at(F.array(*[F.array(*map(F.lit, t)) for t in TEMPLATES]), (F.col("user_id") % 3).cast("int") + 1)
    as_of = F.col("started_at") + F.make_dt_interval(secs=((F.col("user_id") % 4) * 40 + 10).cast("decimal(18,6)"))
    now = found.filter("ended_at is null").withColumns({"as_of": as_of, "phases": template}).withColumn("started_at", F.when(F.col("user_id") % 5 != 0, F.col("started_at")))
    rows = phases.rates(now, found.filter("ended_at is not null").withColumn("seconds", seconds), task)
    return rows.withColumn("shown", phases.duration(F.col("elapsed_ms")))


PREFIXES, ROOT = ("/library", "/mnt/archive"), "/data/store"


@query(
    f"""WITH {PAPERS}, there AS (SELECT CASE doc_id % 4 WHEN 0 THEN pdf_path WHEN 1 THEN replace(pdf_path, '{PREFIXES[0]}', '{PREFIXES[1]}') WHEN 2 THEN replace(pdf_path, '{PREFIXES[0]}/storage', '{ROOT}') END AS path FROM papers)
SELECT id, CASE WHEN pdf_path IN (SELECT path FROM there WHERE path IS NOT NULL) THEN pdf_path WHEN replace(pdf_path, '{PREFIXES[0]}', '{PREFIXES[1]}') IN (SELECT path FROM there WHERE path IS NOT NULL) THEN replace(pdf_path, '{PREFIXES[0]}', '{PREFIXES[1]}')
  WHEN replace(pdf_path, '{PREFIXES[0]}/storage', '{ROOT}') IN (SELECT path FROM there WHERE path IS NOT NULL) THEN replace(pdf_path, '{PREFIXES[0]}/storage', '{ROOT}') END AS path FROM papers"""
)
def resolve_paths(spark, sf_dir):
    """The readable path of each paper: the kept one, the one under a new prefix, or the one under the root."""
    rows = papers(spark, sf_dir)
    d, p = F.col("doc_id") % 4, F.col("pdf_path")
    moved = F.when(d == 0, p).when(d == 1, F.replace(p, F.lit(PREFIXES[0]), F.lit(PREFIXES[1]))).when(d == 2, F.replace(p, F.lit(f"{PREFIXES[0]}/storage"), F.lit(ROOT)))
    there = rows.select(moved.alias("path")).filter("path is not null")
    return files.resolve_paths(rows.select("id", F.col("pdf_path").alias("path")), there, *PREFIXES, ROOT)


VECTORS = "v AS (SELECT label::VARCHAR AS paper_id, CASE WHEN vec_id % 5 <> 0 AND label % 3 <> 0 THEN embedding END AS vector FROM embeddings)"


@query(f"WITH {VECTORS} SELECT paper_id, count(vector) > 0 AS ok, count(vector) AS n_rows FROM v GROUP BY 1")
def backfill_vectors(spark, sf_dir):
    """What writing the kept vectors of each listed paper comes to: an error where it has none."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("paper_id"), F.when((F.col("vec_id") % 5 != 0) & (F.col("label") % 3 != 0), F.col("embedding")).alias("vector"))
    return sinks.vector_outcome(rows.select("paper_id"), rows)


ENCODED = f"""w AS (SELECT chunk_id, md5(unnest(regexp_extract_all({T.folded_sql("lower(body)")}, '[\\p{{L}}\\p{{N}}]+'))) AS m FROM chunks),
d AS (SELECT chunk_id, ('0x' || substr(m, 1, 2))::INT % {models.DIMENSIONS} AS dim, sum(CASE WHEN ('0x' || substr(m, 3, 1))::INT % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS s FROM w GROUP BY ALL HAVING s <> 0),
vectors AS (SELECT chunk_id, dim, round(s / sqrt(sum(s * s) OVER (PARTITION BY chunk_id)), 6) AS weight FROM d)"""


@query(f"WITH {CHUNKS}, {ENCODED} SELECT chunk_id, dim, weight FROM vectors")
def encode_passages(spark, sf_dir):
    """Unit vectors of all chunks by feature hashing, in rows."""
    return models.hashed_vectors(chunks(spark, sf_dir), "chunk_id", F.col("body"))


@query(f"WITH {CHUNKS}, {ENCODED} SELECT chunk_id, count(*) AS n_dims, ascii(chunk_id) % 2 = 0 AS fresh FROM vectors GROUP BY 1")
def refresh_vectors(spark, sf_dir):
    """Only chunks without a stored vector are encoded: here, of those whose id has an even first character."""
    rows = chunks(spark, sf_dir).select("chunk_id", "body")
    encode = lambda part: models.hashed_vectors(part, "chunk_id", F.col("body"))
    stored = encode(rows.filter(F.ascii("chunk_id") % 2 == 1))
    return models.refreshed(rows, stored, "chunk_id", encode).groupBy("chunk_id", "fresh").agg(F.count("*").alias("n_dims"))


CLEANED = f"""cleaned AS ({TEXT_SQL["clean_markdown"]}), {CHUNKS.replace("FROM documents", "FROM cleaned")}, {TYPED}"""


@query(
    f"""WITH {PAPERS}, {CLEANED}, once AS (SELECT * FROM typed QUALIFY row_number() OVER (PARTITION BY paper_id, content_hash ORDER BY chunk_index) = 1),
n AS (SELECT paper_id, count(*) AS n_chunks, sum(greatest(1, length(body) // 4))::BIGINT AS n_tokens, count(DISTINCT chunk_type) AS n_types, min(chunk_id) AS first_id FROM once GROUP BY 1)
SELECT id AS paper_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_types, 0) AS n_types, first_id, CASE WHEN n_chunks > 0 THEN 'indexed' ELSE 'failed' END AS status FROM papers LEFT JOIN n ON paper_id = id WHERE NOT deleted"""
)
def index_corpus(spark, sf_dir):
    """The whole job for live papers: clean, chunk, drop repeats, classify and count; papers without a chunk fail."""
    live = papers(spark, sf_dir, scored=False).filter(~F.col("deleted")).select(F.col("id").alias("paper_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = chunking.indexed(live.select("doc_id", T.clean_markdown(F.col("text")).alias("text")))
    counts = made.groupBy("paper_id").agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"), F.count_distinct("chunk_type").alias("n_types"), F.min("chunk_id").alias("first_id"))
    rows = live.select("paper_id").join(counts, "paper_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return rows.select("paper_id", zero("n_chunks"), zero("n_tokens"), zero("n_types"), "first_id", F.when(F.col("n_chunks") > 0, "indexed").otherwise("failed").alias("status"))
