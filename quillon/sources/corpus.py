"""The tables of the catalogue, bound to the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Payloads of tasks; the empty one stands for none.
PAYLOADS = ('{"parse_only": true, "reindex_only": true}', '{"parse_only": false, "reindex_only": 1}', "no object", '{"download_only": true, "parse_only": true}', "", '{"parse_only": null}')


def one_of(number: F.Column, *values: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values)).cast("int") + 1)


def papers(spark: SparkSession, sf_dir: str, scored: bool = True) -> DataFrame:
    """One row for each document: id, title, path, tags, statuses, score; without `scored` no score, so labels are not joined."""
    d = F.col("doc_id")
    docs = read(spark, sf_dir, "documents")
    docs = docs.join(read(spark, sf_dir, "labels"), "doc_id", "left") if scored else docs
    file = F.concat(F.lit("doc"), d, F.lit(".pdf"))
    return docs.select(
        d.cast("string").alias("id"), "doc_id", F.concat(F.lit("Paper "), d).alias("title"), file.alias("file_name"),
        F.concat(F.lit("/library/storage/"), F.upper(F.substring(F.md5("source"), 1, 8)), F.lit("/"), file).alias("pdf_path"),
        "lang", "source", (1990 + d % 35).cast("int").alias("year"), (d % 17 == 0).alias("deleted"),
        one_of(d, "pending", "failed", "parsed", "parsed", "parsed").alias("parse_status"),
        one_of(d, "pending", "failed", "indexed", "indexed").alias("index_status"),
        *[(F.col("quality") * F.lit(0.5) + (d % 5) * F.lit(0.1)).alias("score")] * scored,
        (F.to_timestamp(F.lit(EPOCH)) + F.make_dt_interval(mins=d.cast("int"))).alias("created_at"), "text",
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event: a task of a paper with a status, a payload and its times.

    Types and payloads are derived so that each branch of the rule of kinds occurs: flags that are
    false, two flags at once, no object, no payload, an empty type.
    """
    e = F.col("event_id")
    start = F.when(e % 6 == 3, F.col("ts") + F.make_dt_interval(mins=F.lit(20))).when(e % 3 == 1, F.col("ts") + F.make_dt_interval(secs=F.lit(30).cast("decimal(18,6)")))
    return read(spark, sf_dir, "events").select(
        e.alias("id"), F.col("event_type").alias("task_type"), F.col("user_id").cast("string").alias("paper_id"),
        one_of(e, "queued", "running", "completed", "failed", "cancelled").alias("status"), F.col("ts").alias("created_at"),
        (F.col("ts") + F.make_dt_interval(secs=(e % 600).cast("decimal(18,6)"))).alias("updated_at"), (e % 600).cast("double").alias("seconds"), "value", "props",
        F.when(F.col("event_type") == "view", "summarize").when(F.col("event_type") == "error", "").when(F.col("event_type") == "click", " index ").otherwise("index").alias("work_type"),
        one_of(e, *PAYLOADS).alias("payload"), start.alias("started_at"),
    )


#: The same tables in DuckDB SQL.
PAPERS = f"""papers AS (SELECT doc_id::VARCHAR AS id, doc_id, 'Paper ' || doc_id AS title, 'doc' || doc_id || '.pdf' AS file_name,
  '/library/storage/' || upper(substr(md5(source), 1, 8)) || '/doc' || doc_id || '.pdf' AS pdf_path, lang, source, (1990 + doc_id % 35)::INT AS year, doc_id % 17 = 0 AS deleted,
  (['pending', 'failed', 'parsed', 'parsed', 'parsed'])[doc_id % 5 + 1] AS parse_status, (['pending', 'failed', 'indexed', 'indexed'])[doc_id % 4 + 1] AS index_status,
  quality::DOUBLE * 0.5::DOUBLE + (doc_id % 5)::DOUBLE * 0.1::DOUBLE AS score, TIMESTAMP '{EPOCH}' + doc_id::INT * INTERVAL 1 MINUTE AS created_at, text
  FROM documents LEFT JOIN labels USING (doc_id))"""
TASKS = f"""tasks AS (SELECT event_id AS id, event_type AS task_type, user_id::VARCHAR AS paper_id, (['queued', 'running', 'completed', 'failed', 'cancelled'])[event_id % 5 + 1] AS status,
  ts AS created_at, ts + (event_id % 600)::INT * INTERVAL 1 SECOND AS updated_at, (event_id % 600)::DOUBLE AS seconds, value, props,
  CASE event_type WHEN 'view' THEN 'summarize' WHEN 'error' THEN '' WHEN 'click' THEN ' index ' ELSE 'index' END AS work_type, ({list(PAYLOADS)})[event_id % 6 + 1] AS payload,
  CASE WHEN event_id % 6 = 3 THEN ts + INTERVAL 20 MINUTE WHEN event_id % 3 = 1 THEN ts + INTERVAL 30 SECOND END AS started_at FROM events)"""
CHUNKS = r"""chunks AS (SELECT *, substr(sha256(paper_id || '|全文|' || chunk_index), 1, 32) AS chunk_id,
    substr(sha256(regexp_replace(regexp_replace(lower(body), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), 1, 32) AS content_hash FROM (
  SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY k) - 1 AS chunk_index, body FROM (
    SELECT paper_id, k, regexp_replace(substr(t, (k * 3100 + 1)::BIGINT, 3500), '^\s+|\s+$', '', 'g') AS body FROM (
      SELECT paper_id, t, unnest(range(CASE WHEN length(t) <= 3500 THEN 1 ELSE 1 + ceil((length(t) - 3500) / 3100.0)::BIGINT END)) AS k FROM (
        SELECT doc_id::VARCHAR AS paper_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents))) WHERE body <> ''))"""
