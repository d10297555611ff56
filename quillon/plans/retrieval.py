"""Retrieval plans: benchmark texts ask, chunks of documents answer."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import cells, chunking, index, search
from quillon.plans.base import registrar
from quillon.sources import sinks
from quillon.sources.corpus import CHUNKS, read

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

STOP = ", ".join(f"'{w}'" for w in T.SEARCH_STOP)
ASKED = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
TERMS = rf"""terms AS (SELECT query_id, unnest(t) AS term FROM (SELECT query_id, list_distinct(ws) AS d, (
    SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(ws) AS x, unnest(range(len(ws))) AS i) GROUP BY x ORDER BY i LIMIT 24)) AS t FROM (
  SELECT query_id, list_concat(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda w: length(w) >= 2 AND w NOT IN ({STOP})),
    list_transform(list_filter(regexp_extract_all(lower(query), '[^\x00-\x7F\s。，、；：？！（）]+'), lambda w: length(w) >= 2), lambda w: substr(w, 1, 24))) AS ws FROM queries)))"""
INDEX = rf"""words AS (SELECT chunk_id, paper_id, regexp_extract_all({T.folded_sql('lower(body)')}, '[\p{{L}}\p{{N}}]+') AS w FROM chunks),
postings AS (SELECT term, chunk_id, paper_id, any_value(dl) AS dl, count(*) AS tf FROM (SELECT chunk_id, paper_id, len(w) AS dl, unnest(w) AS term FROM words) GROUP BY term, chunk_id, paper_id),
stats AS (SELECT count(*) AS n_chunks, avg(len(w)) AS mean_length FROM words)"""
SCORED = f"""scored AS (SELECT query_id, chunk_id, paper_id, round(sum(greatest(1e-6, ln((n_chunks - n + 0.5) / (n + 0.5))) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean_length))), 6) AS score
  FROM (SELECT DISTINCT query_id, {T.folded_sql('term')} AS term FROM terms) JOIN postings USING (term) JOIN (SELECT term, count(*) AS n FROM postings GROUP BY term) USING (term), stats GROUP BY ALL)"""
LEXICAL = f"WITH {ASKED}, {CHUNKS}, {TERMS}, {INDEX}, {SCORED}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 40)"
DENSE = """, dense AS (SELECT a.vec_id AS query_id, b.vec_id::VARCHAR AS chunk_id, b.label::VARCHAR AS paper_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)"""


def quota_sql(rows: str) -> str:
    """The final selection in SQL, from a table with query_id, paper_id and rank."""
    return f"""SELECT * EXCLUDE (n_, first_, p_), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM (
      SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first_) AS p_ FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY rank) AS n_, min(rank) OVER (PARTITION BY query_id, paper_id) AS first_ FROM {rows}) WHERE n_ <= 3) WHERE p_ <= 8 QUALIFY place <= 8"""


def asked(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def chunks(spark, sf_dir):
    return chunking.chunks(read(spark, sf_dir, "documents"))


def place(spark, sf_dir, table: str, kind: str) -> str:
    """A shared folder of this application for what is built from a table, told by paths, times and sizes of its files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{sf_dir}/{table}.parquet").select("path", "modificationTime", "length")
    mark = files.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(path, modificationTime, length))").alias("x")).first()
    return f"{sinks.shared_folder(spark)}/{kind}-{hashlib.sha256(f'{spark.sparkContext.applicationId}|{sf_dir}|{mark}'.encode()).hexdigest()[:32]}"


def stored(spark, sf_dir) -> str:
    """The folder of the index of documents: written once in an application and then read by every search."""
    path = place(spark, sf_dir, "documents", "index")
    if not index.manifest(spark, path)[0]:
        index.build(spark, chunks(spark, sf_dir), path)
    return path


def stored_cells(spark, sf_dir) -> str:
    """The folder of the cells of embeddings, written once in an application."""
    path = place(spark, sf_dir, "embeddings", "cells")
    if not sinks.exists(spark, f"{path}/cells"):
        cells.build(spark, labelled(spark, sf_dir), path)
    return path


def lexical(spark, sf_dir, k=40, ask=None, rows=None):
    """The k best chunks (of the stored index of documents, or of `rows`) of each query by BM25; statistics cover the whole index."""
    ask = asked(spark, sf_dir) if ask is None else ask
    if rows is None:
        return index.bm25_topk(spark, stored(spark, sf_dir), ask, k)
    lengths = rows.select(F.size(T.index_tokens(F.col("body"))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("m")).first()
    return search.ranked(search.bm25(search.postings(rows), search.query_terms(ask), lengths["n"], lengths["m"] or 1.0), F.col("score"), k)


def with_bodies(spark, sf_dir, found):
    """found (chunk_id, paper_id and more) with the bodies of its chunks, from the stored index."""
    found = sinks.kept(found)
    return found.join(index.chunks(spark, stored(spark, sf_dir), found).select("chunk_id", "body"), "chunk_id")


def labelled(spark, sf_dir):
    """Vectors as rows of an index; their label stands for the paper."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("paper_id"), F.col("embedding").alias("vector"))


def asking(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def dense(spark, sf_dir, k):
    """Every hundredth vector asks, all vectors answer: the k best of each."""
    return search.ranked(search.nearest(asking(spark, sf_dir), labelled(spark, sf_dir), k), F.col("score"), k)


@query(f"WITH {ASKED}, {TERMS} SELECT query_id, term FROM terms")
def search_tokens(spark, sf_dir):
    return search.query_terms(asked(spark, sf_dir))


@query(f"WITH {CHUNKS}, {INDEX} SELECT term, chunk_id, paper_id, dl, tf FROM postings")
def build_text_index(spark, sf_dir):
    """The postings of the stored index, read back."""
    return index.postings(spark, stored(spark, sf_dir)).select("term", "chunk_id", "paper_id", "dl", "tf")


CHANGED = "changed AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN coalesce(text, '') || ' ' || lang || ' ' || source ELSE text END AS text FROM documents WHERE doc_id % 10 <> 7)"


@query(LEXICAL.replace(CHUNKS, f"{CHANGED}, {CHUNKS.replace('FROM documents', 'FROM changed')}") + " SELECT query_id, chunk_id, paper_id, score, rank FROM top")
def updated_index_topk(spark, sf_dir):
    """Searches after an update of the index in which a tenth of the papers has a new text and a tenth is gone."""
    base = stored(spark, sf_dir)
    docs = read(spark, sf_dir, "documents").filter("doc_id % 10 in (3, 7)")
    longer = F.concat_ws(" ", F.coalesce("text", F.lit("")), "lang", "source")
    path = f"{sinks.shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index.replace(spark, chunking.chunks(docs.filter("doc_id % 10 = 3").withColumn("text", longer)), docs.select(F.col("doc_id").cast("string").alias("paper_id")), path, index.manifest(spark, base)[1])
    return index.bm25_topk(spark, path, asked(spark, sf_dir))


@query(f"{LEXICAL} SELECT query_id, chunk_id, paper_id, score, rank FROM top")
def bm25_topk(spark, sf_dir):
    return lexical(spark, sf_dir)


@query(f"{LEXICAL} SELECT query_id, chunk_id, paper_id, rank, body FROM top JOIN chunks USING (chunk_id, paper_id)")
def hydrate(spark, sf_dir):
    return with_bodies(spark, sf_dir, lexical(spark, sf_dir)).select("query_id", "chunk_id", "paper_id", "rank", "body")


DEDUPED = f"""{LEXICAL}, deduped AS (SELECT * FROM top JOIN chunks USING (chunk_id, paper_id)
  QUALIFY row_number() OVER (PARTITION BY query_id, CASE WHEN length(body) < 48 THEN body ELSE substr(sha256(body), 1, 20) END ORDER BY rank) = 1 OR trim(body) = '')"""


@query(f"{DEDUPED} SELECT query_id, chunk_id, paper_id, rank FROM deduped")
def dedupe_results(spark, sf_dir):
    return search.dedupe_results(hydrate(spark, sf_dir)).select("query_id", "chunk_id", "paper_id", "rank")


@query(f"{LEXICAL} SELECT query_id, chunk_id, paper_id, rank, place FROM ({quota_sql('top')})")
def paper_quota(spark, sf_dir):
    return search.paper_quota(lexical(spark, sf_dir)).select("query_id", "chunk_id", "paper_id", "rank", "place")


@query(f"{DEDUPED} SELECT query_id, chunk_id, paper_id, score, place FROM ({quota_sql('deduped')})")
def text_retrieve(spark, sf_dir):
    """Lexical candidates, one row for each text, at most three chunks of a paper, eight papers, eight rows."""
    top = with_bodies(spark, sf_dir, lexical(spark, sf_dir))
    return search.paper_quota(search.dedupe_results(top)).select("query_id", "chunk_id", "paper_id", "score", "place")


NEAREST = f"WITH x AS (SELECT 1){DENSE} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense QUALIFY rank <= 10"


@query(NEAREST)
def dense_topk(spark, sf_dir):
    return dense(spark, sf_dir, 10)


@query()
def dense_cells_topk(spark, sf_dir):
    """The ten nearest vectors of those in the cells nearest to each query; SQL has no such cells, tests measure the recall."""
    return cells.topk(spark, stored_cells(spark, sf_dir), asking(spark, sf_dir), 10)


@query(NEAREST)
def dense_exact_topk(spark, sf_dir):
    """The ten nearest vectors of all, by cells: those are left out that can't hold any of them."""
    return cells.topk(spark, stored_cells(spark, sf_dir), asking(spark, sf_dir), 10, exact=True)


@query(
    f"""WITH x AS (SELECT 1){DENSE}, lists AS (
  SELECT query_id, 0 AS list_no, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense QUALIFY rank <= 40
  UNION ALL SELECT query_id, 1, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY paper_id, chunk_id) AS rank FROM dense QUALIFY rank <= 40),
f AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 9) AS fused, min((list_no, rank)) AS seen FROM lists GROUP BY ALL)
SELECT query_id, chunk_id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, seen, chunk_id) AS rank FROM f"""
)
def rrf_fuse(spark, sf_dir):
    """Fusion of the order by cosine with the order by label."""
    found = dense(spark, sf_dir, 40).select("query_id", F.lit(0).alias("list_no"), "chunk_id", F.col("rank").cast("int").alias("rank"))
    first = labelled(spark, sf_dir).select("paper_id", "chunk_id").orderBy("paper_id", "chunk_id").limit(40)
    first = first.withColumn("rank", F.row_number().over(Window.orderBy("paper_id", "chunk_id")))  # the same for every query
    return search.fuse(found.unionByName(asking(spark, sf_dir).select("query_id", F.lit(1).alias("list_no")).crossJoin(F.broadcast(first.drop("paper_id")))))


@query(
    f"""{LEXICAL}, expected AS (SELECT item_id AS query_id, doc_id::VARCHAR AS paper_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
SELECT query_id, count(DISTINCT e.paper_id) AS n_expected, coalesce(bool_or(e.paper_id IN (SELECT t.paper_id FROM top t WHERE t.query_id = e.query_id)), false) AS id_hit
FROM expected e GROUP BY query_id"""
)
def retrieval_eval(spark, sf_dir):
    """Whether a paper that holds the item's text is among its candidates."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), "text")
    held = search.holding(items, docs)
    found = lexical(spark, sf_dir).select("query_id", "paper_id").distinct().withColumn("hit", F.lit(True))
    return held.join(found, ["query_id", "paper_id"], "left").groupBy("query_id").agg(F.count_distinct("paper_id").alias("n_expected"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias("id_hit"))


@query(
    f"""{LEXICAL} SELECT query_id, string_agg('[' || rank || '] ' || substr(body, 1, 280) || CASE WHEN length(body) > 280 THEN '…' ELSE '' END, chr(10) ORDER BY rank) AS prompt
FROM top JOIN chunks USING (chunk_id, paper_id) WHERE rank <= 5 GROUP BY query_id"""
)
def evidence_prompt(spark, sf_dir):
    """Numbered evidence of each query, best first."""
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.substring("body", 1, 280), F.when(F.length("body") > 280, "…").otherwise(""))
    rows = hydrate(spark, sf_dir).filter("rank <= 5").withColumn("line", line)
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("prompt"))
