"""Text shaping: labels, links, lenient JSON, merged slices, prompts, pooled vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.plans.base import registrar
from quillon.plans.corpus import STRIPPED, docs
from quillon.sources.corpus import PAPERS, TASKS, papers, read, tasks

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
P = f"WITH {PAPERS} "
PREAMBLE = "Translation:|以下是翻译|将以下文本翻译为"


@query("WITH m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL) SELECT label, i::INT AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m")
def mean_pool_l2(spark, sf_dir):
    """The mean vector of each group, of length 1."""
    from pyspark.sql import Window

    each = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = each.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.select("label", "i", F.round(F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("label"))), 6).alias("x"))


RAW = """CASE doc_id % 3 WHEN 0 THEN '["' || source || '", " ' || lang || '"]' WHEN 1 THEN source || ' / ' || lang ELSE source END"""


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN source || ' › ' || lang ELSE source END AS shown FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def section_path_parts(spark, sf_dir):
    """Paths kept as JSON, joined by slashes, or alone."""
    kept = read(spark, sf_dir, "documents").filter("source is not null and lang is not null")
    return kept.select("doc_id", F.array_join(T.path_parts(F.expr(RAW)), " › ").alias("shown"))


@query("SELECT l_orderkey, l_linenumber, concat_ws(' · ', l_returnflag, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_suppkey <> l_suppkey % 10 THEN '第 ' || l_suppkey % 10 || '–' || l_suppkey || ' 页' ELSE '第 ' || l_suppkey || ' 页' END) AS source FROM lineitem")
def source_label(spark, sf_dir):
    none = F.col("l_linenumber") % 3 == 0
    pages = T.page_range(F.when(~none, F.col("l_suppkey") % 10), F.when(~none, F.col("l_suppkey")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(" · ", "l_returnflag", F.nullif(pages, F.lit(""))).alias("source"))


@query(r"SELECT doc_id, length(s) > 0 AND length(regexp_replace(s, '[^\x{4e00}-\x{9fff}]', '', 'g')) >= 0.25 * length(s) AS cjk FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\s', '', 'g') AS s FROM documents)")
def is_mostly_cjk(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.is_mostly_cjk(F.col("text")).alias("cjk"))


ASKS = "q AS (SELECT item_id, trim(regexp_replace(text, '[^A-Za-z ]', '', 'g')) AS q FROM benchmark)"


@query(f"WITH {ASKS} SELECT item_id, CASE WHEN item_id % 6 < 5 THEN nullif(q, '') END AS en, CASE WHEN item_id % 6 IN (0, 3, 4) THEN '甲' END AS zh FROM q")
def parse_query_json(spark, sf_dir):
    """Queries read from fenced, embedded and loose JSON."""
    q = F.trim(F.regexp_replace("text", "[^A-Za-z ]", ""))
    k = F.col("item_id") % 6
    raw = F.when(k == 0, F.concat(F.lit('```json\n{"zh": "甲", "en": "'), q, F.lit('"}\n```'))).when(k == 1, F.concat(F.lit('Sure: {"english": "'), q, F.lit('"} ok'))).when(k == 2, F.concat(F.lit("en = '"), q, F.lit("'")))
    raw = raw.when(k == 3, F.concat(F.lit('{"zh_query": "甲", "en_query": "'), q, F.lit('"}'))).when(k == 4, F.concat(F.lit('{"中文": "甲", "英文": "'), q, F.lit('"}'))).otherwise("none")
    rows = read(spark, sf_dir, "benchmark").select("item_id", raw.alias("raw"))
    return rows.select("item_id", T.query_json(F.col("raw"), *T.ENGLISH_KEYS).alias("en"), T.query_json(F.col("raw"), *T.CHINESE_KEYS).alias("zh"))


@query(rf"""WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {STRIPPED}), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF i = 1 OR l[i] <> l[i - 1]], chr(10)) AS text FROM t""")
def sanitize_translation(spark, sf_dir):
    """Announcing first lines and paragraphs equal to the one before are dropped; here, each text gets such a line."""
    announced = F.concat(F.lit("Translation: as asked\n"), "text")
    bare = F.regexp_replace(announced, f"^(?:(?:{PREAMBLE})[^\\n]*(?:\\n|$))+", "")
    rows = docs(spark, sf_dir).select("doc_id", F.filter(F.transform(F.split(bare, "\n"), T.strip), lambda x: x != "").alias("l"))
    return rows.select("doc_id", F.array_join(F.filter("l", lambda x, i: (i == 0) | (x != F.get("l", i - 1))), "\n").alias("text"))


@query("""WITH t AS (SELECT doc_id, t, substr(t, greatest(1, length(t) - 1199)) AS tail FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
SELECT doc_id, length(t) >= 500 AND len(list_filter(range(80, least(400, length(tail) // 3)), lambda p: (length(tail) - length(replace(tail, right(tail, p), ''))) / p >= 3)) > 0 AS repeats FROM t""")
def repetition_flag(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.repetition(F.col("text")).alias("repeats"))


@query(r"""SELECT o_orderkey AS item, coalesce(CASE WHEN o_orderkey % 4 = 3 THEN 1987 END, CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) END, CASE WHEN o_orderkey % 5 = 0 THEN 2001 END, CASE WHEN o_orderkey % 2 = 0 THEN 2020 END)::INT AS year FROM orders""")
def year_of(spark, sf_dir):
    """The first of four fields that holds a year: year, date, date of issue, date of access."""
    k = F.col("o_orderkey")
    year = F.when(k % 4 == 0, "").when(k % 4 == 1, "c2019x").when(k % 4 == 2, "n.d. 12019").otherwise("spring 1987")
    fields = year, F.when(k % 3 == 0, F.col("o_orderdate").cast("string")), F.when(k % 5 == 0, "12/2001"), F.when(k % 2 == 0, "2020-01-01")
    return read(spark, sf_dir, "orders").select(k.alias("item"), T.year_in(*fields).alias("year"))


@query("""SELECT page_id, '![a](assets/' || page_id || '/i.png) <img src="assets/' || page_id || '/b.png"> ![c](' || url || ') ![d](#x)' AS text FROM pages WHERE url LIKE 'http%'""")
def rebase_asset_urls(spark, sf_dir):
    text = F.concat(F.lit('![a](i.png) <img src="b.png"> ![c]('), "url", F.lit(") ![d](#x)"))
    return read(spark, sf_dir, "pages").filter("url like 'http%'").select("page_id", T.rebase_assets(text, F.concat(F.lit("assets/"), "page_id", F.lit("/"))).alias("text"))


@query(r"SELECT conv_id, string_agg('## 分段 ' || (turn + 1) || chr(10) || chr(10) || regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def merge_slices(spark, sf_dir):
    """Slices in order become one document with a heading each."""
    part = F.concat(F.lit("## 分段 "), F.col("turn") + 1, F.lit("\n\n"), T.strip(F.coalesce("text", F.lit(""))))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", part.alias("p"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "p"))), lambda x: x["p"]), "\n\n---\n\n").alias("text"))


@query(f"WITH {TASKS} SELECT id, CASE WHEN id % 3 = 0 THEN created_at + INTERVAL 1 SECOND WHEN id % 3 = 1 THEN created_at + INTERVAL 2 SECOND ELSE created_at END AS started_at FROM tasks")
def task_start(spark, sf_dir):
    """The start of a task: what was noted, else its earliest phase, else its creation."""
    k, later = F.col("id") % 3, lambda s: F.col("created_at") + F.make_dt_interval(secs=F.lit(s))
    noted, history = F.when(k == 0, later(1)), F.when(k == 1, F.array(later(5), later(2)))
    return tasks(spark, sf_dir).select("id", F.coalesce(noted, F.array_min(history), "created_at").alias("started_at"))


@query(r"""SELECT item_id, CASE item_id % 3 WHEN 0 THEN '$' || t || '$ and ' || n || n || '$$' || n || 'x' || n || '$$' || n || n WHEN 1 THEN '```' || n || '\(a\) ＊' || n || '``` * $' || t || '$' ELSE '``` $' || t || '$ * \(' END AS text
  FROM (SELECT item_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, chr(10) AS n FROM benchmark)""")
def normalize_math(spark, sf_dir):
    """Items as formulas in line, after a closed fence, and after one that is never closed."""
    k = F.col("item_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("\\( "), "text", F.lit("\n\\) and \\[ x\n\\]"))).when(k == 1, F.concat(F.lit("```\n\\(a\\) ＊\n``` ＊ \\("), "text", F.lit("\\)")))
    rows = read(spark, sf_dir, "benchmark").select("item_id", raw.otherwise(F.concat(F.lit("``` \\("), "text", F.lit("\\) ＊ \\("))).alias("raw"))
    return rows.select("item_id", T.normalize_math(F.col("raw")).alias("text"))


@query(P + "SELECT id, title || chr(10) || chr(10) || substr(text, 1, 8000) AS prompt FROM papers WHERE NOT deleted AND index_status = 'indexed' AND length(text) > 0")
def summary_prompt(spark, sf_dir):
    rows = papers(spark, sf_dir).filter(~F.col("deleted") & (F.col("index_status") == "indexed") & (F.length("text") > 0))
    return rows.select("id", F.concat("title", F.lit("\n\n"), F.substring("text", 1, 8000)).alias("prompt"))


TEMPLATES = ("survey", "method", "gap", "compare")


@query(P + "SELECT id, template, CASE WHEN lang = 'en' THEN 'Write a ' || template || ' review: ' ELSE '综述（' || template || '）：' END || title || CASE WHEN year % 2 = 0 THEN '; focus: ' || source ELSE '' END AS prompt FROM papers, (SELECT unnest(['survey', 'method', 'gap', 'compare']) AS template) WHERE NOT deleted AND lang IS NOT NULL AND source IS NOT NULL")
def review_prompt(spark, sf_dir):
    """A prompt for each paper and each of four templates, with the focus where there is one."""
    rows = papers(spark, sf_dir).filter(~F.col("deleted") & F.col("lang").isNotNull() & F.col("source").isNotNull()).withColumn("template", F.explode(F.array(*map(F.lit, TEMPLATES))))
    head = F.when(F.col("lang") == "en", F.concat(F.lit("Write a "), "template", F.lit(" review: "))).otherwise(F.concat(F.lit("综述（"), "template", F.lit("）：")))
    return rows.select("id", "template", F.concat(head, "title", F.when(F.col("year") % 2 == 0, F.concat(F.lit("; focus: "), "source")).otherwise("")).alias("prompt"))
