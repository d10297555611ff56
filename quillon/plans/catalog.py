"""Catalogue plans: filters, diffs, metadata joins and state changes over papers and normalised tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.search import broadcast_if_small
from quillon.plans.base import registrar
from quillon.sources.corpus import CHUNKS, PAPERS, papers, read

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
P = f"WITH {PAPERS} "
#: Papers with their backlogs.
WORK = f"""WITH {PAPERS}, work AS (SELECT papers.*, CASE WHEN index_status = 'pending' AND doc_id % 3 = 0 THEN 'indexing' ELSE index_status END AS i, toxic IS NOT NULL AS summarized, CASE WHEN doc_id % 6 > 0 THEN score END AS s,
  doc_id IN (SELECT vec_id FROM embeddings) AS embedded, doc_id IN (SELECT vec_id FROM embeddings WHERE label % 3 <> 0) AS stored FROM papers LEFT JOIN labels USING (doc_id) WHERE NOT deleted) """
#: Requests by bounds of the score, and by scope.
SHOWN = {"low": {"most": 0.65}, "high": {"least": 0.85}, "middle": {"least": 0.3, "most": 0.65}, "missing": {"least": 0.3, "missing": True}}
SCOPES = {"empty": {}, "ids": {"ids": ("1", "2", "3", "17")}, "tags": {"tags": ("src1", "src2"), "year_from": 1995}, "both": {"tags": ("src1", "src3"), "collections": ("en", "fr"), "year_to": 2015}}


@query(P + "SELECT id, title FROM papers WHERE NOT deleted AND (contains(lower(title), '9') OR contains(lower(file_name), 'doc1') OR contains(lower(source), 'src3'))")
def catalog_search(spark, sf_dir):
    """Case-insensitive substrings over several columns."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    hit = F.contains(low("title"), F.lit("9")) | F.contains(low("file_name"), F.lit("doc1")) | F.contains(low("source"), F.lit("src3"))
    return papers(spark, sf_dir).filter(~F.col("deleted") & hit).select("id", "title")


@query(P + """SELECT id, score, unnest(list_filter([CASE WHEN score <= 0.65 THEN 'low' END, CASE WHEN score >= 0.85 THEN 'high' END, CASE WHEN score >= 0.3 AND score <= 0.65 THEN 'middle' END, CASE WHEN score IS NULL THEN 'missing' END], lambda x: x IS NOT NULL)) AS shown FROM papers""")
def quality_filter(spark, sf_dir):
    """Which of several requests show a paper: bounds hold for given scores only, `missing` overrides them."""
    wanted = [F.when(T.quality_within(F.col("score"), **bounds), name) for name, bounds in SHOWN.items()]
    return papers(spark, sf_dir).select("id", "score", F.explode(F.array_compact(F.array(*wanted))).alias("shown"))


@query(P + """SELECT id, unnest(list_filter(['empty', CASE WHEN id IN ('1', '2', '3', '17') THEN 'ids' END, CASE WHEN source IN ('src1', 'src2') AND year >= 1995 THEN 'tags' END,
  CASE WHEN source IN ('src1', 'src3') AND lang IN ('en', 'fr') AND year <= 2015 THEN 'both' END], lambda x: x IS NOT NULL)) AS scope FROM papers WHERE NOT deleted""")
def scope_filter(spark, sf_dir):
    """Live papers with each scope that holds them, all scopes in one pass; an empty scope holds all."""
    rows = papers(spark, sf_dir).filter(~F.col("deleted")).withColumns({"tags": F.array("source"), "collections": F.array("lang")})
    return rows.select("id", F.explode(F.array_compact(F.array(*[F.when(T.within_scope(**s), name) for name, s in SCOPES.items()]))).alias("scope"))


@query(WORK + """SELECT id, unnest(list_filter([CASE WHEN i IN ('pending', 'failed') THEN 'index_missing' END, CASE WHEN parse_status IN ('pending', 'failed') THEN 'parse_missing' END, CASE WHEN i = 'indexed' AND NOT summarized THEN 'summarize_missing' END,
  CASE WHEN s IS NULL AND length(trim(coalesce(text, ''))) > 0 THEN 'unscored_rescore' END, CASE WHEN embedded AND NOT stored THEN 'vectors_pending' END], lambda x: x IS NOT NULL)) AS queue FROM work""")
def work_queue_filter(spark, sf_dir):
    """Each live paper with each of the five queues it waits in."""
    of = backlogs()
    names = {"index_missing": "index_missing", "parse_missing": "parse_missing", "summarize_missing": "summarize_missing", "unscored_with_text": "unscored_rescore", "vectors_pending": "vectors_pending"}
    return backlog_rows(spark, sf_dir).select("id", F.explode(F.array_compact(F.array(*[F.when(of[c], name) for c, name in names.items()]))).alias("queue"))


@query(P + "SELECT id, substr(coalesce(text, ''), 1, 400) AS preview, length(coalesce(text, '')) AS total, length(coalesce(text, '')) > 400 AS truncated FROM papers")
def document_preview(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return papers(spark, sf_dir).select("id", F.substring(t, 1, 400).alias("preview"), F.length(t).cast("bigint").alias("total"), (F.length(t) > 400).alias("truncated"))


@query(f"WITH {PAPERS}, {CHUNKS} SELECT chunk_id, paper_id, title, year FROM chunks JOIN papers ON id = paper_id WHERE NOT deleted")
def live_chunks(spark, sf_dir):
    from quillon.plans.corpus import chunks

    live = papers(spark, sf_dir).filter(~F.col("deleted")).select(F.col("id").alias("paper_id"), "title", "year")
    return chunks(spark, sf_dir).select("chunk_id", "paper_id").join(live, "paper_id").select("chunk_id", "paper_id", "title", "year")


@query(f"WITH {PAPERS}, {CHUNKS} SELECT count(*) FILTER (WHERE NOT deleted) AS papers, count(*) FILTER (WHERE NOT deleted AND index_status = 'indexed') AS indexed, (SELECT count(*) FROM chunks) AS chunks FROM papers")
def library_stats(spark, sf_dir):
    from quillon.plans.corpus import chunks

    n = chunks(spark, sf_dir).agg(F.count("*").alias("chunks"))
    rows = papers(spark, sf_dir).agg(F.count_if(~F.col("deleted")).alias("papers"), F.count_if(~F.col("deleted") & (F.col("index_status") == "indexed")).alias("indexed"))
    return rows.join(F.broadcast(n))  # one row each


@query(P + "SELECT count(*) AS total, count(*) FILTER (WHERE score IS NULL) AS unscored, count(*) FILTER (WHERE score < 0.65) AS low, count(*) FILTER (WHERE score >= 0.85) AS high FROM papers WHERE NOT deleted")
def quality_summary(spark, sf_dir):
    s = F.col("score")
    return papers(spark, sf_dir).filter(~F.col("deleted")).agg(F.count("*").alias("total"), F.count_if(s.isNull()).alias("unscored"), F.count_if(s < 0.65).alias("low"), F.count_if(s >= 0.85).alias("high"))


@query(WORK + """SELECT count(*) FILTER (WHERE i IN ('pending', 'failed')) AS index_missing, count(*) FILTER (WHERE i IN ('pending', 'failed', 'indexing')) AS index_missing_including_indexing, count(*) FILTER (WHERE parse_status IN ('pending', 'failed')) AS parse_missing,
  count(*) FILTER (WHERE i = 'indexed' AND NOT summarized) AS summarize_missing, count(*) FILTER (WHERE s IS NULL AND length(trim(coalesce(text, ''))) > 0) AS unscored_with_text, count(*) FILTER (WHERE embedded AND NOT stored) AS vectors_pending,
  count(*) FILTER (WHERE embedded) AS with_vectors, (SELECT count(DISTINCT vec_id) FROM embeddings WHERE label % 3 <> 0) AS stored_vectors, true AS vectors_enabled FROM work""")
def work_summary(spark, sf_dir, vectors_enabled=True):
    """All backlogs in one pass over papers joined with their summaries and vectors, and whether vectors are in use."""
    counts = backlog_rows(spark, sf_dir).agg(*[F.count_if(c).alias(name) for name, c in backlogs().items()])
    n = read(spark, sf_dir, "embeddings").filter("label % 3 <> 0").agg((F.count_distinct("vec_id") if vectors_enabled else F.lit(0).cast("bigint")).alias("stored_vectors"))
    return counts.join(F.broadcast(n)).withColumn("vectors_enabled", F.lit(vectors_enabled))


@query(P + "SELECT id FROM papers WHERE index_status = 'indexed' AND NOT deleted AND doc_id NOT IN (SELECT doc_id FROM labels)")
def summaries_missing(spark, sf_dir):
    return papers(spark, sf_dir).filter("index_status = 'indexed' and not deleted").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("id")


@query(f"WITH {PAPERS}, {CHUNKS} SELECT count(*) FILTER (WHERE index_status = 'indexed') || ':' || (SELECT count(*) FROM chunks WHERE paper_id IN (SELECT id FROM papers WHERE NOT deleted)) || ':' || coalesce(strftime(max(created_at), '%Y-%m-%d %H:%M:%S'), '') AS fingerprint FROM papers WHERE NOT deleted")
def corpus_fingerprint(spark, sf_dir):
    """Indexed papers, chunks of papers and the time of the last change, all of papers that are not deleted."""
    rows = papers(spark, sf_dir).filter(~F.col("deleted"))
    n = live_chunks(spark, sf_dir).agg(F.count("*").alias("n"))
    found = rows.agg(F.count_if(F.col("index_status") == "indexed").cast("string").alias("i"), F.coalesce(F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("at"))
    return found.join(F.broadcast(n)).select(F.concat_ws(":", "i", F.col("n").cast("string"), "at").alias("fingerprint"))


@query(P + """, n AS (SELECT count(*) AS total FROM papers WHERE NOT deleted), s AS (SELECT id, score, unnest(['updated', 'quality_asc', 'quality_desc']) AS sort, created_at FROM papers WHERE NOT deleted)
SELECT sort, id, score, total, row_number() OVER (PARTITION BY sort ORDER BY CASE WHEN sort <> 'updated' THEN score IS NULL END, CASE sort WHEN 'quality_asc' THEN score WHEN 'quality_desc' THEN -score END, created_at DESC, id) AS place FROM s, n QUALIFY place BETWEEN 11 AND 30""")
def catalog_page(spark, sf_dir, offset=10, limit=20):
    """The second page of a list in each of its three orders, with the count of all rows; rows without a score come last."""
    live = papers(spark, sf_dir).filter(~F.col("deleted")).select("id", "score", "created_at")
    orders = {"updated": [], "quality_asc": [F.asc_nulls_last("score")], "quality_desc": [F.desc_nulls_last("score")]}
    total, out = live.agg(F.count("*").alias("total")), None
    for name, first in orders.items():
        order = [*first, F.desc("created_at"), "id"]
        rows = live.orderBy(*order).limit(offset + limit).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint")).filter(F.col("place") > offset)
        rows = rows.select(F.lit(name).alias("sort"), "id", "score", "place")
        out = rows if out is None else out.unionByName(rows)
    return out.join(F.broadcast(total))


@query(P + """SELECT doc_id AS id, path, CASE WHEN starts_with(path, '/library/storage/') AND len(parts) >= 2 AND parts[1] <> '' AND NOT starts_with(parts[1], '.') THEN parts[1] END AS key, regexp_extract(path, '/storage/([A-Za-z0-9]{8})/', 1) AS folder, substr(sha256(path), 1, 32) AS path_key
FROM (SELECT *, list_filter(string_split(substr(path, 18), '/'), lambda x: x <> '') AS parts FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '/library/storage/' || file_name WHEN doc_id % 7 = 0 THEN '/library/storage/.trash/' || file_name WHEN doc_id % 11 = 0 THEN '/elsewhere/storage/ABCD1234/' || file_name ELSE pdf_path END AS path FROM papers))""")
def storage_key(spark, sf_dir):
    """The folder of a path under the root of the storage, and the eight letters after `/storage/` wherever that is."""
    d, own = F.col("doc_id"), lambda folder: F.concat(F.lit(folder), "file_name")
    path = F.when(d % 5 == 0, own("/library/storage/")).when(d % 7 == 0, own("/library/storage/.trash/")).when(d % 11 == 0, own("/elsewhere/storage/ABCD1234/")).otherwise(F.col("pdf_path"))
    rows = papers(spark, sf_dir).select(d.alias("id"), path.alias("path"))
    return rows.select("id", "path", T.storage_key(F.col("path"), "/library/storage").alias("key"), F.regexp_extract("path", "/storage/([A-Za-z0-9]{8})/", 1).alias("folder"), F.substring(F.sha2("path", 256), 1, 32).alias("path_key"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 8 AS shard FROM (SELECT DISTINCT doc_id FROM documents)")
def shard_assign(spark, sf_dir):
    """Round robin over the ids in order: counts of ranges first, so that no task numbers all ids."""
    ids = read(spark, sf_dir, "documents").select("doc_id").distinct().withColumn("block", F.floor(F.col("doc_id") / 10_000))
    before = ids.groupBy("block").agg(F.count("*").alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("block").orderBy("doc_id")) - 1
    return ids.withColumn("own", own).join(before.select("block", "skip"), "block").select("doc_id", ((F.col("skip") + F.col("own")) % 8).alias("shard"))


@query("""WITH c AS (SELECT o_orderkey AS k, o_totalprice AS p, o_orderkey % 100 AS size, o_orderkey % 13 = 0 AS deleted FROM orders WHERE o_orderkey % 7 <> 0),
i AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p, o_orderkey % 100 + CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS size FROM orders WHERE o_orderkey % 5 <> 0),
m AS (SELECT coalesce(i.k, c.k) AS k, CASE WHEN c.k IS NULL THEN 'insert' WHEN i.k IS NULL THEN CASE WHEN c.deleted THEN 'gone' ELSE 'delete' END WHEN i.size <> c.size THEN CASE WHEN i.p <> c.p THEN 'changed' ELSE 'touched' END WHEN c.deleted THEN 'undelete' ELSE 'same' END AS action FROM i FULL JOIN c ON i.k = c.k)
SELECT k, action, action IN ('delete', 'gone') AS deleted, CASE WHEN action IN ('insert', 'changed') THEN 'pending' ELSE 'parsed' END AS parse_status, CASE WHEN action IN ('insert', 'changed') THEN 'pending' ELSE 'indexed' END AS index_status FROM m""")
def scan_diff(spark, sf_dir):
    """An inventory against the catalogue (two snapshots of orders): what to do with each file, and its new state.

    A file of another size is read again: another content resets the statuses, the same one is only
    touched. A file that is back is no longer deleted. A content that changes without the size is not seen.
    """
    k = F.col("k")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"), (F.col("o_orderkey") % 100).alias("size"))
    catalogue = o.filter("k % 7 <> 0").select("k", F.col("p").alias("old"), F.col("size").alias("old_size"), (k % 13 == 0).alias("deleted"))
    other = k % 11 == 0
    found = o.filter("k % 5 <> 0").select("k", F.when(other, F.col("p") + 1).otherwise(F.col("p")).alias("new"), (F.col("size") + F.when(other | (k % 3 == 0), 1).otherwise(0)).alias("size"))
    read_again = F.when(F.col("old") != F.col("new"), "changed").otherwise("touched")
    action = (
        F.when(F.col("old_size").isNull(), "insert").when(F.col("size").isNull() & F.col("deleted"), "gone").when(F.col("size").isNull(), "delete")
        .when(F.col("size") != F.col("old_size"), read_again).when(F.col("deleted"), "undelete").otherwise("same")
    )
    rows, reset = found.join(catalogue, "k", "full_outer").select("k", action.alias("action")), F.col("action").isin("insert", "changed")
    return rows.select("k", "action", F.col("action").isin("delete", "gone").alias("deleted"), F.when(reset, "pending").otherwise("parsed").alias("parse_status"), F.when(reset, "pending").otherwise("indexed").alias("index_status"))


@query("SELECT c_custkey AS item, max(CASE WHEN f = 'name' THEN v END) AS name, max(CASE WHEN f = 'nation' THEN v END) AS nation, max(CASE WHEN f = 'segment' THEN v END) AS segment FROM (SELECT c_custkey, 'name' AS f, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'nation', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1")
def biblio_fields(spark, sf_dir):
    """Item, field and value rows pivoted to one row for each item."""
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    rows = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"], "left")
    values = rows.select("c_custkey", F.expr("stack(3, 'name', c_name, 'segment', c_mktsegment, 'nation', n_name) as (field, value)"))
    return values.groupBy(F.col("c_custkey").alias("item")).pivot("field", ["name", "nation", "segment"]).agg(F.first("value", True))


@query("SELECT o_custkey AS item, string_agg(DISTINCT lower(o_orderpriority), '; ' ORDER BY lower(o_orderpriority)) AS tags, count(*) AS n FROM orders GROUP BY 1")
def tag_list(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("item")).agg(F.array_join(F.sort_array(F.collect_set(F.lower("o_orderpriority"))), "; ").alias("tags"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag IN ('A', 'R') AS preferred, CASE WHEN l_linenumber % 4 = 0 THEN ' ' ELSE s_name END AS l, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'F' || l_suppkey END AS f, l_linenumber % 3 = 1 AS one FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
m AS (SELECT *, trim(l) AS a, trim(f) AS b, bool_or(preferred) OVER (PARTITION BY l_orderkey) AS any_preferred FROM r),
n AS (SELECT *, CASE WHEN a <> '' AND b <> '' AND NOT one THEN a || ', ' || b WHEN a <> '' THEN a ELSE b END AS name FROM m WHERE preferred OR NOT any_preferred)
SELECT l_orderkey AS item, string_agg(name, '; ' ORDER BY l_linenumber, name) FILTER (WHERE name <> '') AS authors FROM n GROUP BY 1""")
def author_string(spark, sf_dir):
    """The creators of an item in their order: authors and contributors if it has any, else all; blank names are left out."""
    l, s = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    k, preferred = F.col("l_linenumber"), F.col("l_returnflag").isin("A", "R")
    rows = l.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag").join(broadcast_if_small(s), F.col("l_suppkey") == F.col("s_suppkey"))
    last, first = F.when(k % 4 == 0, " ").otherwise(F.col("s_name")), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("F"), "l_suppkey"))
    named = rows.select(F.col("l_orderkey").alias("item"), F.struct("l_linenumber", T.creator_name(first, last, k % 3 == 1).alias("name"), preferred.alias("preferred")).alias("c"))
    all_ = named.groupBy("item").agg(F.array_sort(F.collect_list("c")).alias("c"))
    some = F.filter("c", lambda x: x["preferred"])
    names = F.filter(F.transform(F.when(F.size(some) > 0, some).otherwise(F.col("c")), lambda x: x["name"]), lambda x: x != "")
    return all_.select("item", F.when(F.size(names) > 0, F.array_join(names, "; ")).alias("authors"))


@query("""WITH a AS (SELECT o_orderkey AS aid, CASE WHEN o_orderkey % 2 = 0 THEN 'Key' ELSE 'KEY' END || o_orderkey // 5 AS key, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS pid FROM orders)
SELECT lower(key) AS key, min(aid) AS attachment, min_by(coalesce(pid, -1), aid) AS parent FROM a WHERE aid % 13 <> 0 AND coalesce(pid % 9 <> 0, true) GROUP BY 1""")
def attachment_parent(spark, sf_dir):
    """The first live attachment of each folder key, whatever its case, and its parent (-1: none); deleted items and items of deleted parents are skipped."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.lower(F.concat(F.when(k % 2 == 0, "Key").otherwise("KEY"), F.floor(k / 5))).alias("key"), k.alias("aid"), F.when(k % 4 != 0, F.col("o_custkey")).alias("pid"))
    gone = read(spark, sf_dir, "customer").filter("c_custkey % 9 = 0").select(F.col("c_custkey").alias("pid"))
    live = rows.filter("aid % 13 <> 0").join(broadcast_if_small(gone), "pid", "left_anti")
    first = live.groupBy("key").agg(F.min(F.struct("aid", "pid")).alias("f"))
    return first.select("key", F.col("f.aid").alias("attachment"), F.coalesce("f.pid", F.lit(-1)).alias("parent"))


@query(P + """, o AS (SELECT *, CASE WHEN score IS NULL THEN 'failed' WHEN index_status = 'indexed' THEN 'skipped' ELSE 'succeeded' END AS outcome FROM papers)
SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'succeeded') AS succeeded, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'failed') AS failed,
  (SELECT string_agg(id || ': no score', '; ' ORDER BY doc_id) FROM (SELECT id, doc_id FROM o WHERE outcome = 'failed' ORDER BY doc_id LIMIT 5)) AS errors FROM o""")
def batch_outcome(spark, sf_dir, sample=5):
    """Counts of the outcomes of a batch and a few of its errors."""
    outcome = F.when(F.col("score").isNull(), "failed").when(F.col("index_status") == "indexed", "skipped").otherwise("succeeded")
    rows = papers(spark, sf_dir).select("id", "doc_id", outcome.alias("outcome"))
    told = rows.filter("outcome = 'failed'").orderBy("doc_id").limit(sample).agg(F.array_sort(F.collect_list(F.struct("doc_id", F.concat("id", F.lit(": no score")).alias("e")))).alias("l"))
    counts = rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == name).alias(name) for name in ("succeeded", "skipped", "failed")])
    return counts.join(F.broadcast(told)).select("total", "succeeded", "skipped", "failed", F.when(F.size("l") > 0, F.array_join(F.transform("l", lambda x: x["e"]), "; ")).alias("errors"))


@query(f"WITH {PAPERS}, {CHUNKS} SELECT id, parse_status, status AS index_status, CASE WHEN length(coalesce(text, '')) >= 100 THEN 'parsed' ELSE parse_status END AS new_parse, CASE WHEN n > 0 THEN 'indexed' WHEN status IN ('indexed', 'indexing') THEN 'pending' ELSE status END AS new_index FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'indexing' ELSE index_status END AS status FROM papers) LEFT JOIN (SELECT paper_id, count(*) AS n FROM chunks WHERE paper_id::BIGINT % 3 <> 0 GROUP BY 1) ON paper_id = id")
def reconcile(spark, sf_dir):
    """Statuses set right from what is there: a text of 100 characters is parsed, any chunk makes a paper indexed, one without is pending again if it was indexed or being indexed.

    Every third paper has lost its chunks, and every seventh is being indexed.
    """
    from quillon.plans.corpus import chunks

    counts = chunks(spark, sf_dir).filter(F.col("paper_id").cast("bigint") % 3 != 0).groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("n"))
    status = F.when(F.col("doc_id") % 7 == 0, "indexing").otherwise(F.col("index_status"))
    rows = papers(spark, sf_dir).withColumn("index_status", status).join(counts, "id", "left")
    parse = F.when(F.length(F.coalesce("text", F.lit(""))) >= 100, "parsed").otherwise(F.col("parse_status"))
    index = F.when(F.col("n") > 0, "indexed").when(F.col("index_status").isin("indexed", "indexing"), "pending").otherwise(F.col("index_status"))
    return rows.select("id", "parse_status", "index_status", parse.alias("new_parse"), index.alias("new_index"))


@query("WITH old AS (SELECT o_custkey AS k, o_orderstatus AS t, max(o_orderkey) AS v FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL), new AS (SELECT o_custkey AS k, o_orderstatus AS t, max(o_orderkey) AS v FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL) SELECT * FROM new UNION ALL SELECT * FROM old WHERE (k, t) NOT IN (SELECT (k, t) FROM new)")
def upsert_summary(spark, sf_dir):
    """New values replace old ones of the same key and kind."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("t"), F.col("o_orderkey").alias("v"))
    last = lambda df: df.groupBy("k", "t").agg(F.max("v").alias("v"))
    old, new = last(rows.filter("v % 3 <> 0")), last(rows.filter("v % 3 = 0"))
    return new.unionByName(old.join(new, ["k", "t"], "left_anti"))


@query(P + "SELECT substr(sha256(lower(title) || '|' || lang || '|' || year), 1, 32) AS cache_key, id FROM papers")
def cache_key(spark, sf_dir):
    return papers(spark, sf_dir).select(F.substring(F.sha2(F.concat_ws("|", F.lower("title"), "lang", "year"), 256), 1, 32).alias("cache_key"), "id")


@query(P + "SELECT source, lang, doc_id // 1000 AS part, string_agg('- ' || title, chr(10) ORDER BY doc_id) AS markdown FROM papers WHERE NOT deleted GROUP BY ALL")
def export_review_md(spark, sf_dir, papers_of_part=1000):
    """Lists of papers in Markdown, in parts of ranges of ids, so that a large source is no large row."""
    lines = F.array_sort(F.collect_list(F.struct("doc_id", F.concat(F.lit("- "), "title").alias("line"))))
    rows = papers(spark, sf_dir).filter(~F.col("deleted")).groupBy("source", "lang", F.floor(F.col("doc_id") / papers_of_part).alias("part"))
    return rows.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("markdown"))


def backlog_rows(spark, sf_dir):
    """Live papers joined with their summaries (`toxic`) and whether their vectors are stored (null without vectors)."""
    stored = read(spark, sf_dir, "embeddings").groupBy(F.col("vec_id").alias("doc_id")).agg(F.bool_or(F.col("label") % 3 != 0).alias("stored"))
    return papers(spark, sf_dir).filter(~F.col("deleted")).join(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left").join(stored, "doc_id", "left")


def indexing():
    """The index status; some pending papers are being indexed."""
    return F.when((F.col("index_status") == "pending") & (F.col("doc_id") % 3 == 0), "indexing").otherwise(F.col("index_status"))


def backlogs():
    """Condition of each backlog over `backlog_rows`."""
    i, score, held = indexing(), F.when(F.col("doc_id") % 6 > 0, F.col("score")), F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    return {
        "index_missing": i.isin("pending", "failed"), "index_missing_including_indexing": i.isin("pending", "failed", "indexing"), "parse_missing": F.col("parse_status").isin("pending", "failed"),
        "summarize_missing": (i == "indexed") & F.col("toxic").isNull(), "unscored_with_text": score.isNull() & held, "vectors_pending": ~F.col("stored"), "with_vectors": F.col("stored").isNotNull(),
    }


@query(f"WITH d AS ({ORACLES['scan_diff']}) SELECT action, count(*) AS n FROM d GROUP BY 1")
def scan_counts(spark, sf_dir):
    return scan_diff(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))
