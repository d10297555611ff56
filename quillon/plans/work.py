"""Work sets of the catalogue: what to parse, index and embed, what is stale, and the states that follow."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunking
from quillon.operators.search import broadcast_if_small
from quillon.plans.base import registrar
from quillon.plans.corpus import NONBLANK, TYPED, chunks, typed
from quillon.sources.corpus import CHUNKS, PAPERS, TASKS, papers, read, tasks

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
P, C, PC = f"WITH {PAPERS} ", f"WITH {CHUNKS} ", f"WITH {PAPERS}, {CHUNKS} "

REPORT = rf"""report AS (SELECT doc_id, least(1, greatest(0, least(1, 0.35 * least(1, length(t) / 12000) + 0.35 * least(1, sections / 8) + 0.2 * least(1, rich / 20) + 0.1 - least(0.5, garbled * 8 + ocr * 0.8)))
    + CASE WHEN refs THEN 0.03 ELSE 0 END) AS score, length(t) AS text_length, sections, rich, garbled, ocr FROM (SELECT doc_id, t, sections, refs, len(regexp_extract_all(t, '(?s)\$\$.*?\$\$|\\\[.*?\\\]')) + len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^\|.+\|$'))) + len(regexp_extract_all(t, '!\[[^\]]*\]\([^)]+\)')) AS rich,
  CASE WHEN t = '' THEN 0 ELSE length(regexp_replace(t, '[^\x{{0}}-\x{{8}}\x{{E000}}-\x{{F8FF}}]', '', 'g')) / length(t) END AS garbled, CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: length(x) <= 2 AND NOT regexp_matches(x, '^[0-9]+$'))) / len(l) ELSE 0 END AS ocr
  FROM (SELECT doc_id, coalesce(text, '') AS t, {NONBLANK} AS l, coalesce(n, 0) AS sections, coalesce(refs, false) AS refs FROM documents LEFT JOIN (
    SELECT doc_id, count(*) AS n, bool_or(refs) AS refs FROM (SELECT doc_id, part, bool_or(head AND regexp_matches(lower(line), '(references|bibliography|参考文献|引用文献)')) AS refs, string_agg(CASE WHEN head THEN '' ELSE line END, '') AS body FROM (
      SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM (SELECT doc_id, line, i, regexp_matches(line, '^#{{1,6}}\s+\S') AS head FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))) GROUP BY ALL) WHERE regexp_replace(body, '\s', '', 'g') <> '' GROUP BY 1) USING (doc_id))))"""


def report(spark, sf_dir):
    """(doc_id, score, text_length, sections, rich, garbled, ocr) of every text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = chunking.section_split(docs.select(F.col("doc_id").alias("paper_id"), F.col("text").alias("markdown")))
    told = F.lower("path").rlike("(references|bibliography|参考文献|引用文献)")
    counted = parts.groupBy(F.col("paper_id").alias("doc_id")).agg(F.count("*").alias("n"), F.bool_or(told).alias("refs"))
    found = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    rich = found("(?s)\\$\\$.*?\\$\\$|\\\\\\[.*?\\\\\\]") + found("(?m)^\\|.+\\|$") + found("!\\[[^\\]]*\\]\\([^)]+\\)")
    rows = docs.join(counted, "doc_id", "left").withColumns({"sections": F.coalesce("n", F.lit(0)), "refs": F.coalesce("refs", F.lit(False)), "rich": rich.cast("bigint"), "garbled": T.garbled_ratio(F.col("text")), "ocr": T.ocr_fragment_ratio(F.col("text")), "text_length": F.length("text").cast("bigint")})
    score = T.quality_score(F.col("text_length"), F.col("sections"), F.col("rich"), F.col("garbled"), F.col("ocr"), F.col("refs"))
    return rows.select("doc_id", score.alias("score"), "text_length", "sections", "rich", "garbled", "ocr")


@query(f"WITH {REPORT} SELECT doc_id, round(score, 9) AS score, text_length, sections, rich, concat_ws(',', CASE WHEN text_length < 800 THEN 'markdown_too_short' END, CASE WHEN garbled > 0.02 THEN 'high_garbled_ratio' END, CASE WHEN ocr > 0.25 THEN 'high_ocr_fragment_ratio' END, CASE WHEN sections < 2 AND text_length > 5000 THEN 'few_sections' END) AS warnings FROM report")
def parse_report(spark, sf_dir):
    warn = lambda when, name: F.when(when, name)
    n, s = F.col("text_length"), F.col("sections")
    warnings = F.concat_ws(",", warn(n < 800, "markdown_too_short"), warn(F.col("garbled") > 0.02, "high_garbled_ratio"), warn(F.col("ocr") > 0.25, "high_ocr_fragment_ratio"), warn((s < 2) & (n > 5000), "few_sections"))
    return report(spark, sf_dir).select("doc_id", F.round("score", 9).alias("score"), "text_length", "sections", "rich", warnings.alias("warnings"))


MODES = ("layout", "plain_text", "layout_fallback", "invalid")
MODE = f"(['{MODES[0]}', '{MODES[1]}', '{MODES[2]}', '{MODES[3]}'])[doc_id % 4 + 1]"


def mode():
    return F.element_at(F.array(*map(F.lit, MODES)), (F.col("doc_id") % 4).cast("int") + 1)


@query(f"WITH {REPORT}, m AS (SELECT *, {MODE} AS mode FROM report) SELECT doc_id, CASE WHEN mode = 'plain_text' OR ocr > 0.25 THEN 'layout' ELSE 'second' END AS retry_with FROM m WHERE score < 0.65 AND doc_id % 6 <> 0 AND text_length >= 80 AND mode <> 'invalid' AND (mode = 'plain_text' OR ocr > 0.25 OR score < 0.65 * 0.85)")
def reparse_candidates(spark, sf_dir):
    """Texts of low score, not retried yet, that another parser may read better."""
    bad = (F.col("mode") == "plain_text") | (F.col("ocr") > 0.25)
    rows = report(spark, sf_dir).withColumn("mode", mode()).filter((F.col("score") < 0.65) & (F.col("doc_id") % 6 != 0) & (F.col("text_length") >= 80) & (F.col("mode") != "invalid") & (bad | (F.col("score") < 0.65 * 0.85)))
    return rows.select("doc_id", F.when(bad, "layout").otherwise("second").alias("retry_with"))


@query(rf"""WITH e AS (SELECT doc_id, {MODE} AS mode, CASE WHEN doc_id % 23 = 0 THEN 'x提取失败' ELSE '' END || coalesce(text, '') AS t, CASE WHEN doc_id % 5 = 0 THEN repeat('bad table ', 60) ELSE '' END AS err, CASE WHEN doc_id % 8 = 3 THEN 'no header' END AS file_error FROM documents),
s AS (SELECT *, regexp_replace(t, '^\s+|\s+$', '', 'g') AS b, coalesce(nullif(substr(trim(err), 1, 500), ''), mode) AS detail FROM e), f AS (SELECT *, length(b) < 80 OR contains(substr(b, 1, 500), '提取失败') AS failed FROM s)
SELECT doc_id, CASE WHEN failed THEN 'failed' ELSE 'parsed' END AS status, CASE WHEN failed THEN substr(CASE WHEN mode = 'invalid' THEN coalesce(file_error, detail) ELSE 'no usable text: ' || detail END, 1, 2000)
  ELSE 'notes: ' || nullif(substr(concat_ws('; ', CASE mode WHEN 'plain_text' THEN 'plain text only' WHEN 'layout_fallback' THEN 'incomplete: layout_fallback' END, CASE WHEN err <> '' AND mode NOT IN ('plain_text', 'layout_fallback') THEN 'warning: ' || substr(trim(err), 1, 400) END,
    CASE WHEN doc_id % 3 <> 0 THEN 'exit code ' || doc_id % 3 END, CASE WHEN doc_id % 11 = 0 THEN 'timeout' END), 1, 2000), '') END AS message FROM f""")
def parse_outcome(spark, sf_dir):
    """Status and message of a parse from its text, mode, errors, exit code and timeout."""
    d = F.col("doc_id")
    marked = F.concat(F.when(d % 23 == 0, "x" + T.EXTRACTION_FAILED).otherwise(""), F.coalesce("text", F.lit("")))
    error, file_error = F.when(d % 5 == 0, "bad table " * 60).otherwise(""), F.when(d % 8 == 3, "no header")
    status, message = T.parse_outcome(marked, mode(), error, d % 3, d % 11 == 0, file_error)
    return read(spark, sf_dir, "documents").select("doc_id", status.alias("status"), message.alias("message"))


STORED = "CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN sha256(coalesce(text, '') || 'x') ELSE sha256(coalesce(text, '')) END"


def stored():
    """The digest kept from an earlier run: none, an old one, or that of the text."""
    t = F.coalesce("text", F.lit(""))
    return F.when(F.col("doc_id") % 10 == 0, None).when(F.col("doc_id") % 4 == 0, F.sha2(F.concat(t, F.lit("x")), 256)).otherwise(F.sha2(t, 256))


@query(P + f"SELECT id, doc_id % 19 = 0 OR length(trim(coalesce(text, ''))) = 0 OR coalesce({STORED} <> sha256(coalesce(text, '')), false) AS needed FROM papers WHERE NOT deleted")
def needs_parse(spark, sf_dir):
    """What must be parsed: asked for by force, without a text, or of another digest than the stored one."""
    t, force = F.coalesce("text", F.lit("")), F.col("doc_id") % 19 == 0
    return papers(spark, sf_dir).filter(~F.col("deleted")).select("id", (force | (F.length(F.trim(t)) == 0) | F.coalesce(stored() != F.sha2(t, 256), F.lit(False))).alias("needed"))


@query(PC + f"SELECT id, doc_id % 19 = 0 OR doc_id % 23 = 0 OR NOT (index_status = 'indexed' AND coalesce({STORED} = sha256(coalesce(text, '')), false) AND coalesce(n, 0) > 0) AS needed FROM papers LEFT JOIN (SELECT paper_id, count(*) AS n FROM chunks GROUP BY 1) ON paper_id = id WHERE NOT deleted")
def needs_index(spark, sf_dir):
    """What must be indexed again: asked for by force or as a rebuild, not indexed yet, changed, or without chunks."""
    counts = chunks(spark, sf_dir).groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("n"))
    same = F.coalesce(stored() == F.sha2(F.coalesce("text", F.lit("")), 256), F.lit(False))
    force, rebuild = F.col("doc_id") % 19 == 0, F.col("doc_id") % 23 == 0
    rows = papers(spark, sf_dir).filter(~F.col("deleted")).join(counts, "id", "left")
    return rows.select("id", (force | rebuild | ~((F.col("index_status") == "indexed") & same & (F.coalesce("n", F.lit(0)) > 0))).alias("needed"))


@query(P + "SELECT id FROM papers WHERE 'fr' IN (source, lang)")
def json_list_contains(spark, sf_dir):
    """An exact member of a list that is kept as JSON text."""
    tags = F.to_json(F.array_compact(F.array("source", "lang")))
    return papers(spark, sf_dir).filter(F.array_contains(F.from_json(tags, "array<string>"), "fr")).select("id")


@query(f"WITH {CHUNKS}, {TYPED} SELECT chunk_id, chunk_type FROM typed WHERE chunk_type IS NULL OR chunk_type NOT IN ('references', 'abstract')")
def exclude_chunk_types(spark, sf_dir):
    return typed(spark, sf_dir).filter(F.col("chunk_type").isNull() | ~F.col("chunk_type").isin("references", "abstract")).select("chunk_id", "chunk_type")


@query(C + "SELECT paper_id, chunk_index, substr(body, 1, 400) AS preview, count(*) OVER (PARTITION BY paper_id) AS total FROM chunks QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY chunk_index) <= 20")
def chunk_preview(spark, sf_dir):
    """The first page of twenty chunks of each paper, with the count of all."""
    own = Window.partitionBy("paper_id")
    rows = chunks(spark, sf_dir).select("paper_id", "chunk_index", F.substring("body", 1, 400).alias("preview"))
    return rows.withColumns({"total": F.count("*").over(own), "n": F.row_number().over(own.orderBy("chunk_index"))}).filter("n <= 20").drop("n")


@query(PC + "SELECT chunk_id, paper_id, title, pdf_path FROM chunks JOIN papers ON id = paper_id")
def chunk_detail(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", "paper_id").join(papers(spark, sf_dir).select(F.col("id").alias("paper_id"), "title", "pdf_path"), "paper_id")


@query(PC + "SELECT id FROM papers WHERE NOT deleted AND id IN (SELECT paper_id FROM chunks) AND doc_id NOT IN (SELECT vec_id FROM embeddings)")
def resync_set(spark, sf_dir):
    """Live papers with chunks but without a vector."""
    live = papers(spark, sf_dir).filter(~F.col("deleted")).select("id", "doc_id")
    return live.join(chunks(spark, sf_dir).select(F.col("paper_id").alias("id")), "id", "left_semi").join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("id")


@query(P + "SELECT DISTINCT vec_id::VARCHAR AS paper_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label % 3 <> 0)")
def vectors_pending(spark, sf_dir):
    """Papers that have vectors but none in the table of vectors (here: those of two labels in three), in order."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("paper_id"), "label")
    return v.select("paper_id").distinct().join(v.filter("label % 3 <> 0").select("paper_id"), "paper_id", "left_anti").orderBy("paper_id")


@query(P + "SELECT count(*) AS papers, count(vec_id) AS with_vector, count(DISTINCT label) AS labels FROM (SELECT id, vec_id, label FROM papers LEFT JOIN embeddings ON vec_id = doc_id WHERE NOT deleted)")
def vector_coverage(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "vec_id", "label")
    rows = papers(spark, sf_dir).filter(~F.col("deleted")).join(vectors, "doc_id", "left")
    return rows.agg(F.count("*").alias("papers"), F.count("vec_id").alias("with_vector"), F.count_distinct("label").alias("labels"))


@query(f"WITH {PAPERS}, {TASKS} SELECT id FROM tasks WHERE status IN ('queued', 'running') AND paper_id NOT IN (SELECT id FROM papers WHERE NOT deleted)")
def orphan_tasks(spark, sf_dir):
    live = papers(spark, sf_dir).filter(~F.col("deleted")).select(F.col("id").alias("paper_id"))
    return tasks(spark, sf_dir).filter(F.col("status").isin("queued", "running")).join(live, "paper_id", "left_anti").select("id")


@query(PC + "SELECT chunk_id, paper_id FROM chunks WHERE paper_id NOT IN (SELECT id FROM papers WHERE NOT deleted)")
def orphan_index_rows(spark, sf_dir):
    live = papers(spark, sf_dir).filter(~F.col("deleted")).select(F.col("id").alias("paper_id"))
    return chunks(spark, sf_dir).select("chunk_id", "paper_id").join(live, "paper_id", "left_anti")


@query(C + "SELECT paper_id, chunk_id FROM chunks QUALIFY row_number() OVER (PARTITION BY paper_id, content_hash ORDER BY chunk_index) > 1")
def stale_chunks(spark, sf_dir):
    """Chunks that a new set of chunks, here without repeats, no longer holds."""
    now = chunks(spark, sf_dir)
    return now.select("paper_id", "chunk_id").join(chunking.dedupe_chunks(now).select("paper_id", "chunk_id"), ["paper_id", "chunk_id"], "left_anti")


@query(PC + "SELECT id, title FROM papers WHERE id IN (SELECT paper_id FROM chunks)")
def papers_with_chunks(spark, sf_dir):
    return papers(spark, sf_dir).select("id", "title").join(chunks(spark, sf_dir).select(F.col("paper_id").alias("id")), "id", "left_semi")


@query(f"WITH {CHUNKS}, {TASKS} SELECT coalesce(c.paper_id, t.paper_id) AS paper_id, coalesce(c.n, 0) AS n_chunks, coalesce(t.n, 0) AS n_tasks FROM (SELECT paper_id, count(*) AS n FROM chunks GROUP BY 1) c FULL JOIN (SELECT paper_id, count(*) AS n FROM tasks GROUP BY 1) t ON c.paper_id = t.paper_id")
def rows_per_paper(spark, sf_dir):
    count = lambda df, name: df.groupBy("paper_id").agg(F.count("*").alias(name))
    return count(chunks(spark, sf_dir), "n_chunks").join(count(tasks(spark, sf_dir), "n_tasks"), "paper_id", "full_outer").select("paper_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_tasks", F.lit(0)).alias("n_tasks"))


@query(P + "SELECT id, doc_id IN (SELECT doc_id FROM labels) AS has_summary FROM papers")
def summary_flags(spark, sf_dir):
    told = read(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("there", F.lit(True))
    return papers(spark, sf_dir).select("id", "doc_id").join(told, "doc_id", "left").select("id", F.coalesce("there", F.lit(False)).alias("has_summary"))


@query(r"SELECT paper_id, chunk_id, list_min(p) AS page_start, list_max(p) AS page_end FROM (SELECT l_orderkey::VARCHAR AS paper_id, l_linenumber AS chunk_id, list_transform(regexp_extract_all(lower('Page ' || l_partkey || ' and page ' || l_suppkey), 'page ([0-9]{1,5})', 1), lambda x: x::INT) AS p FROM lineitem)")
def page_hints(spark, sf_dir):
    """The range of the pages a chunk names; here, two are written into each line item."""
    first, last = T.page_hints(F.concat(F.lit("Page "), "l_partkey", F.lit(" and page "), "l_suppkey"))
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("paper_id"), F.col("l_linenumber").alias("chunk_id"), first.alias("page_start"), last.alias("page_end"))


@query("""WITH m AS (SELECT o_orderkey AS k, o_orderpriority, o_orderdate, c_custkey AS c, c_name, c_mktsegment, coalesce(c_custkey % 4 <> 0, false) AS own FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_custkey % 5 <> 0)
SELECT k AS item, nullif(trim(CASE WHEN own THEN CASE WHEN c % 7 = 0 THEN ' ' ELSE c_name END ELSE 'Order ' || k END), '') AS title, CASE WHEN c % 6 <> 0 THEN 'A ' || c ELSE 'B ' || k END AS authors,
  CASE WHEN own THEN CASE WHEN c % 2 = 0 THEN 1999 END ELSE year(o_orderdate) END::INT AS year, CASE WHEN own THEN CASE WHEN c % 2 = 0 THEN c_mktsegment WHEN c % 5 = 1 THEN 'Book ' || c END ELSE o_orderpriority END AS venue,
  CASE WHEN own THEN CASE WHEN c % 3 <> 0 THEN '10.1/' || c END ELSE '10.2/' || k END AS doi, array_to_string(list_sort(list_distinct(list_filter(['t' || c % 3, 't' || k % 3], lambda x: x IS NOT NULL))), '; ') AS tags, 'col' || coalesce(c, k) % 4 AS collections FROM m""")
def biblio_meta(spark, sf_dir):
    """The whole record of each attachment: that of its parent, or its own if it has none or the parent has no fields.

    Creators fall back on their own, tags are those of both, collections those of the item that counts.
    """
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    parents = read(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0").select("c_custkey", "c_name", "c_mktsegment")
    rows = read(spark, sf_dir, "orders").join(broadcast_if_small(parents), F.col("o_custkey") == c, "left")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    own = F.coalesce(c % 4 != 0, F.lit(False))
    field = lambda parent, attachment: F.nullif(F.trim(F.when(own, parent).otherwise(attachment)), F.lit(""))
    publication, book = F.when(c % 2 == 0, F.col("c_mktsegment")).otherwise(""), F.when(c % 5 == 1, text("Book ", c))
    authors = F.coalesce(F.when(c % 6 != 0, text("A ", c)), text("B ", k))
    tags = F.array_sort(F.array_distinct(F.array_compact(F.array(text("t", c % 3), text("t", k % 3)))))
    return rows.select(
        k.alias("item"), field(F.when(c % 7 == 0, " ").otherwise(F.col("c_name")), text("Order ", k)).alias("title"), authors.alias("authors"),
        T.year_in(F.when(own, F.when(c % 2 == 0, "May 1999")).otherwise(F.col("o_orderdate").cast("string"))).alias("year"),
        field(F.coalesce(F.nullif(publication, F.lit("")), book), F.col("o_orderpriority")).alias("venue"),
        field(F.when(c % 3 != 0, text("10.1/", c)), text("10.2/", k)).alias("doi"), F.array_join(tags, "; ").alias("tags"), text("col", F.coalesce(c, k) % 4).alias("collections"),
    )


@query(P + "SELECT id, coalesce(c_name, title) AS title, c_mktsegment AS venue, CASE WHEN c_custkey IS NULL THEN 'unmatched' ELSE 'updated' END AS outcome FROM papers LEFT JOIN customer ON c_custkey = doc_id AND c_custkey % 4 <> 0")
def sync_metadata(spark, sf_dir):
    """Fields of the catalogue from bibliographic records: a title stays where none is given, others are overwritten."""
    c = read(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("doc_id"), "c_name", "c_mktsegment", F.lit(True).alias("there"))
    rows = papers(spark, sf_dir).select("id", "doc_id", "title").join(c, "doc_id", "left")
    return rows.select("id", F.coalesce("c_name", "title").alias("title"), F.col("c_mktsegment").alias("venue"), F.when(F.col("there"), "updated").otherwise("unmatched").alias("outcome"))


@query("SELECT o_custkey AS item, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS collections FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
def collection_list(spark, sf_dir):
    o, l = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    rows = l.join(broadcast_if_small(read(spark, sf_dir, "part").select("p_partkey", "p_type")), F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("o_custkey").alias("item")).agg(F.array_join(F.sort_array(F.collect_set("p_type")), "; ").alias("collections"))


@query(f"WITH {TASKS} SELECT event_type AS task_type, day, count(*) AS n, round(sum(m * n0) / sum(n0), 6) AS mean FROM (SELECT task_type AS event_type, date_trunc('day', created_at) AS day, paper_id, avg(seconds) AS m, count(*) AS n0 FROM tasks GROUP BY ALL) GROUP BY ALL")
def merge_averages(spark, sf_dir):
    """Averages of papers merged to averages of days by their counts."""
    day = F.date_trunc("day", "created_at").cast("timestamp_ntz")
    part = tasks(spark, sf_dir).groupBy("task_type", day.alias("day"), "paper_id").agg(F.avg("seconds").alias("m"), F.count("*").alias("n0"))
    return part.groupBy("task_type", "day").agg(F.count("*").alias("n"), F.round(F.sum(F.col("m") * F.col("n0")) / F.sum("n0"), 6).alias("mean"))


@query(f"WITH {TASKS} SELECT paper_id, status, max_by(id, (updated_at, id)) AS id FROM tasks GROUP BY ALL")
def latest_summary(spark, sf_dir):
    return tasks(spark, sf_dir).groupBy("paper_id", "status").agg(F.max_by("id", F.struct("updated_at", "id")).alias("id"))


WAITING = "trim(coalesce(nullif(work_type, ''), 'index')) = 'index'"


@query(f"""WITH {PAPERS}, {TASKS}, hit AS (SELECT paper_id FROM tasks WHERE {WAITING} GROUP BY 1 HAVING bool_or(status = 'queued') AND NOT bool_or(status = 'running')), p AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'indexing' ELSE index_status END AS i FROM papers WHERE NOT deleted)
SELECT id, i AS old_status, CASE WHEN i = 'indexing' AND id IN (SELECT paper_id FROM hit) THEN CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN 'indexed' ELSE 'pending' END ELSE i END AS index_status FROM p""")
def cancel_queued(spark, sf_dir):
    """Papers that were being indexed and whose queued indexing is cancelled fall back to what they hold, unless indexing runs."""
    s = F.col("status")
    hit = tasks(spark, sf_dir).filter(WAITING).groupBy(F.col("paper_id").alias("id")).agg((F.bool_or(s == "queued") & ~F.bool_or(s == "running")).alias("hit"))
    i = F.when(F.col("doc_id") % 2 == 0, "indexing").otherwise(F.col("index_status"))
    rows = papers(spark, sf_dir).filter(~F.col("deleted")).withColumn("old_status", i).join(hit, "id", "left")
    back = F.when(F.coalesce("text", F.lit("")).rlike("\\S"), "indexed").otherwise("pending")
    return rows.select("id", "old_status", F.when(F.col("hit") & (F.col("old_status") == "indexing"), back).otherwise(F.col("old_status")).alias("index_status"))


@query(f"WITH {PAPERS}, {TASKS}, u AS (SELECT paper_id, max_by(status, (updated_at, id)) AS s FROM tasks GROUP BY 1) SELECT id, CASE s WHEN 'completed' THEN 'parsed' WHEN 'failed' THEN 'failed' ELSE parse_status END AS parse_status, CASE WHEN s = 'failed' THEN 'last task failed' WHEN s IS NULL THEN 'kept' END AS message FROM papers LEFT JOIN u ON paper_id = id")
def set_status(spark, sf_dir):
    """A partial update: the last task sets a status and sets or clears the message."""
    last = tasks(spark, sf_dir).groupBy(F.col("paper_id").alias("id")).agg(F.max_by("status", F.struct("updated_at", "id")).alias("s"))
    rows, s = papers(spark, sf_dir).join(last, "id", "left"), F.col("s")
    return rows.select("id", F.when(s == "completed", "parsed").when(s == "failed", "failed").otherwise(F.col("parse_status")).alias("parse_status"), F.when(s == "failed", "last task failed").when(s.isNull(), "kept").alias("message"))


@query(f"WITH {TASKS} SELECT key, arg_max(id, (moment, id)) AS id FROM (SELECT paper_id || '|' || task_type AS key, id, created_at AS moment FROM tasks WHERE id % 2 = 0 UNION ALL SELECT paper_id || '|' || task_type, id, updated_at FROM tasks WHERE id % 2 = 1) GROUP BY 1")
def upsert_cache(spark, sf_dir):
    """Two generations of cached rows; the latest of a key stays."""
    rows = tasks(spark, sf_dir).select(F.concat_ws("|", "paper_id", "task_type").alias("key"), "id", F.when(F.col("id") % 2 == 0, F.col("created_at")).otherwise(F.col("updated_at")).alias("at"))
    return rows.groupBy("key").agg(F.max_by("id", F.struct("at", "id")).alias("id"))


@query(f"WITH {TASKS} SELECT id, key = sha256(task_type || '|' || paper_id) AND (id % 4 = 0 OR epoch(TIMESTAMP '2024-02-01' - created_at) <= 864000) AS valid FROM (SELECT *, CASE WHEN id % 7 = 0 THEN 'old' ELSE sha256(task_type || '|' || paper_id) END AS key FROM tasks)")
def cache_valid(spark, sf_dir):
    """A cached row holds if its key is still what its parts give and it is no older than its limit (ten days; here, every fourth row has 0: no limit)."""
    key, ttl = F.sha2(F.concat_ws("|", "task_type", "paper_id"), 256), F.when(F.col("id") % 4 == 0, 0).otherwise(864_000).cast("bigint")
    age = F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    return tasks(spark, sf_dir).select("id", ((F.when(F.col("id") % 7 == 0, "old").otherwise(key) == key) & ((ttl == 0) | (age <= ttl * 1_000_000))).alias("valid"))


@query("""SELECT event_id, event_id % 9 NOT IN (0, 1) AS valid, CASE WHEN event_id % 9 > 1 THEN event_type END AS mode, CASE WHEN event_id % 9 > 1 AND event_id % 2 = 0 THEN 'late' END AS error, CASE WHEN event_id % 9 > 1 THEN md5(event_id::VARCHAR) END AS pdf_hash FROM events""")
def parse_meta(spark, sf_dir):
    """Mode, error and digest kept as JSON for each paper; broken JSON and what is no object are invalid and give nulls."""
    fields = F.struct(F.col("event_type").alias("mode"), F.when(F.col("event_id") % 2 == 0, "late").alias("error"), F.md5(F.col("event_id").cast("string")).alias("pdf_hash"))
    raw = F.when(F.col("event_id") % 9 == 0, "[broken").when(F.col("event_id") % 9 == 1, "[1, 2]").otherwise(F.to_json(fields))
    meta = F.when(F.trim(raw).startswith("{"), F.from_json(raw, "map<string,string>"))
    rows = read(spark, sf_dir, "events").select("event_id", meta.alias("m"))
    return rows.select("event_id", F.col("m").isNotNull().alias("valid"), *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("mode", "error", "pdf_hash")])


@query(f"""WITH {PAPERS}, {REPORT} SELECT p.id, regexp_matches(coalesce(p.text, ''), '\\S') AS ok, CASE WHEN regexp_matches(coalesce(p.text, ''), '\\S') THEN round(r.score, 9) END AS score
FROM papers p JOIN report r USING (doc_id) WHERE NOT p.deleted AND p.score IS NULL""")
def rescore(spark, sf_dir):
    """Live papers without a score, scored from their text; those without text are told and stay unscored."""
    held = F.coalesce("text", F.lit("")).rlike("\\S")
    rows = papers(spark, sf_dir).filter(~F.col("deleted") & F.col("score").isNull()).select("doc_id", "id", held.alias("ok"))
    scores = report(spark, sf_dir).select("doc_id", F.round("score", 9).alias("found"))
    return rows.join(scores, "doc_id").select("id", "ok", F.when(F.col("ok"), F.col("found")).alias("score"))


@query(P + ", f AS (SELECT id, title, CASE year % 3 WHEN 0 THEN source WHEN 1 THEN '' END AS focus FROM papers) SELECT id, CASE WHEN coalesce(focus, '') = '' THEN title ELSE title || '。重点：' || focus END AS query FROM f")
def review_query(spark, sf_dir):
    """The topic of a review with its focus, where one is given."""
    k = F.col("year") % 3
    focus = F.when(k == 0, F.col("source")).when(k == 1, F.lit(""))
    return papers(spark, sf_dir).select("id", T.review_query(F.col("title"), focus).alias("query"))


@query(P + "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM papers WHERE NOT deleted)")
def orphan_vectors(spark, sf_dir):
    """Vectors whose paper is gone or was never there."""
    live = papers(spark, sf_dir).filter(~F.col("deleted")).select(F.col("doc_id").alias("vec_id"))
    return read(spark, sf_dir, "embeddings").select("vec_id", "label").join(live, "vec_id", "left_anti")


@query(f"WITH m AS ({ORACLES['sync_metadata']}) SELECT outcome, count(*) AS n FROM m GROUP BY 1")
def sync_counts(spark, sf_dir):
    return sync_metadata(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH {TASKS} SELECT id, CASE status WHEN 'queued' THEN 'cancelled' ELSE status END AS status, CASE status WHEN 'queued' THEN 'cancelled by the user' END AS error FROM tasks")
def cancelled_tasks(spark, sf_dir):
    """The tasks after all queued ones are cancelled."""
    queued = F.col("status") == "queued"
    return tasks(spark, sf_dir).select("id", F.when(queued, "cancelled").otherwise(F.col("status")).alias("status"), F.when(queued, "cancelled by the user").alias("error"))


@query(f"WITH {TASKS} SELECT id, CASE WHEN id % 3 = 1 THEN '{{\"answer\":\"a ' || task_type || '\",\"n\":\"' || id || '\"}}' END AS payload FROM tasks")
def clear_translation(spark, sf_dir):
    """Cached answers without their translation; null where there was none."""
    other = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "une réponse")
    fields = F.struct(F.concat(F.lit("a "), "task_type").alias("answer"), other.alias("answer_other"), F.lit("fr").alias("answer_other_lang"), F.col("id").cast("string").alias("n"), F.lit("true").alias("cached"))
    return tasks(spark, sf_dir).select("id", T.clear_translation(F.to_json(fields)).alias("payload"))
