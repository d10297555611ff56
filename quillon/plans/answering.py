"""Retrieval as a request meets it: variants, a fallback for queries without hits, three lists, a scored pool, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import index, search
from quillon.plans.base import registrar
from quillon.plans.corpus import CLAIM_STOP
from quillon.plans.hybrid import POOL
from quillon.plans.retrieval import INDEX, SCORED, TERMS, chunks, quota_sql, stored, with_bodies
from quillon.sources import sinks
from quillon.sources.corpus import CHUNKS, read

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

#: Candidates of a question, the least of one of its variants, and the tokens by which texts are searched where no term hits.
CANDIDATES, LEAST, TOKENS = 40, 10, 8


def variants(asked: DataFrame) -> DataFrame:
    """(query_id, no, query, least) of questions with what was made of them (query_id, query, others): blanks and repeats by case go, the first stays.

    The candidates of a question are shared out to its variants, each gets LEAST or more.
    """
    text = F.concat(F.array("query"), F.coalesce("others", F.array().cast("array<string>")))
    each = asked.select("query_id", F.posexplode(F.transform(text, T.strip)).alias("no", "query")).filter("no = 0 or query <> ''")
    first = each.groupBy("query_id", F.lower("query").alias("same")).agg(F.min(F.struct("no", "query")).alias("x")).select("query_id", "x.no", "x.query")
    n = F.count("*").over(Window.partitionBy("query_id"))
    return first.withColumn("least", F.greatest(F.lit(LEAST), F.floor(F.lit(CANDIDATES) / n)).cast("int"))


def lexical_candidates(asked: DataFrame, path: str, texts: DataFrame) -> DataFrame:
    """(query_id, chunk_id, paper_id, score, rank): the best score of each chunk over the variants of a question.

    A variant whose terms hit nothing in the index at path is searched in texts (chunk_id, paper_id, body) by its
    longest tokens; what is found so has the score 0.
    """
    spark = asked.sparkSession
    each = sinks.kept(variants(asked).withColumn("vid", F.concat_ws(":", "query_id", "no")))
    own = each.select(F.col("vid").alias("query_id"), "query")
    hits = sinks.kept(index.bm25_topk(spark, path, own, CANDIDATES).select("query_id", "chunk_id", "paper_id", "score", "rank"))
    tokens = F.array_sort(F.transform(T.search_tokens(F.col("query")), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    missed = own.join(hits.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.transform(F.slice(tokens, 1, TOKENS), lambda x: x["t"]).alias("tokens")).filter("size(tokens) > 0")
    missed = sinks.kept(missed)
    if not missed.isEmpty():
        found = search.containing(missed, texts, F.lower("body"), ["chunk_id", "paper_id"], first=CANDIDATES, order=(F.col("chunk_id"),)).withColumn("score", F.lit(0.0))
        hits = hits.unionByName(search.ranked(found, F.col("score"), CANDIDATES))
    best = hits.join(search.broadcast_if_small(each.select(F.col("vid").alias("query_id"), F.col("query_id").alias("of"), "least")), "query_id").filter("rank <= least")
    return search.ranked(best.groupBy(F.col("of").alias("query_id"), "chunk_id", "paper_id").agg(F.max("score").alias("score")), F.col("score"), CANDIDATES)


def fused_candidates(lexical: DataFrame, vectors: DataFrame, asking: DataFrame, placed: DataFrame) -> DataFrame:
    """(query_id, chunk_id, fused, rank): lexical order, dense order of all chunks, dense order of the lexical candidates, fused.

    A chunk (placed: chunk_id, paper_id) has the vector of its paper (vectors: paper_id, vector). A question without
    a vector (asking: query_id, vector) keeps its lexical order; one without lexical hits gets the dense one.
    """
    listed = lambda df, no: df.select("query_id", F.lit(no).alias("list_no"), "chunk_id", "rank")
    every = search.near_chunks(asking, vectors, placed, CANDIDATES)
    mine = lexical.select("query_id", "chunk_id", "paper_id").join(asking.withColumnRenamed("vector", "q"), "query_id").join(vectors, "paper_id")
    among = search.ranked(mine.select("query_id", "chunk_id", F.round(T.cosine(F.col("q"), F.col("vector")), 6).alias("score")), F.col("score"), CANDIDATES)
    return search.fuse(listed(lexical, 0).unionByName(listed(every, 1)).unionByName(listed(among, 2)))


def reranked(rows: DataFrame, score: Column, pool: int = POOL) -> DataFrame:
    """Ranked rows with their first `pool` in the order of a score (an expression, or a model's column as `models.score_column`); the rest follows."""
    old = F.col("rank")
    order = Window.partitionBy("query_id").orderBy(F.desc(old <= pool), F.desc_nulls_last("score"), old)
    return rows.withColumn("score", F.when(old <= pool, score)).withColumn("rank", F.row_number().over(order).cast("bigint"))


HALF = "substr(w, 2, length(w) - 2)"
ASKING = f"""told AS (SELECT item_id, CASE WHEN item_id % 5 = 0 AND length(w) > 4 THEN {HALF} ELSE text END AS q FROM (SELECT item_id, text, list_sort(list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda x: {{'n': -length(x), 'w': x}}))[1].w AS w FROM benchmark)),
each AS (SELECT item_id, trim(v) AS v, no FROM (SELECT item_id, unnest([q, lower(q), regexp_replace(q, '^\\S+\\s+', ''), '']) AS v, unnest([0, 1, 2, 3]) AS no FROM told) WHERE no = 0 OR trim(v) <> '' QUALIFY row_number() OVER (PARTITION BY item_id, lower(trim(v)) ORDER BY no) = 1),
queries AS (SELECT item_id || ':' || no AS query_id, v AS query, item_id, no, greatest(10, 40 // count(*) OVER (PARTITION BY item_id)) AS least FROM each)"""


@query(
    rf"""WITH {ASKING}, {CHUNKS}, {TERMS}, {INDEX}, {SCORED}, hits AS (SELECT query_id, chunk_id, paper_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored),
longest AS (SELECT query_id, term FROM terms WHERE query_id NOT IN (SELECT query_id FROM scored) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, term) <= {TOKENS}),
liked AS (SELECT query_id, chunk_id, paper_id, 0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM (SELECT DISTINCT query_id, chunk_id, paper_id FROM longest JOIN chunks ON contains(lower(body), term))),
merged AS (SELECT item_id, chunk_id, paper_id, max(score) AS score FROM (FROM hits UNION ALL FROM liked) JOIN queries USING (query_id) WHERE rank <= least GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM merged QUALIFY rank <= {CANDIDATES}),
qv AS (SELECT item_id, embedding AS q FROM told JOIN embeddings ON vec_id = item_id WHERE item_id % 7 <> 3), v AS (SELECT item_id, vec_id::VARCHAR AS paper_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS s FROM qv, embeddings),
lists AS (SELECT item_id, 0 AS list_no, chunk_id, rank FROM lex UNION ALL SELECT item_id, 1, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, chunk_id) AS rank FROM v JOIN chunks USING (paper_id) QUALIFY rank <= {CANDIDATES}
  UNION ALL SELECT item_id, 2, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, chunk_id) AS rank FROM lex JOIN v USING (item_id, paper_id)),
f AS (SELECT item_id, chunk_id, round(sum(1 / (60 + rank)), 9) AS fused, min((list_no, rank)) AS seen FROM lists GROUP BY ALL),
g AS (SELECT item_id, chunk_id, c.paper_id, body, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, seen, chunk_id) AS old FROM f JOIN chunks c USING (chunk_id)),
w AS (SELECT g.*, list_distinct(list_filter(regexp_extract_all(lower(q), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2 AND w NOT IN ({CLAIM_STOP}))) AS w FROM g JOIN told USING (item_id)),
s AS (SELECT *, CASE WHEN old <= {POOL} THEN round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(lower(substr(body, 1, 1800)), x))) / len(w) ELSE 0 END, 6) END AS score FROM w),
r AS (SELECT item_id AS query_id, chunk_id, paper_id, body, score, row_number() OVER (PARTITION BY item_id ORDER BY (old <= {POOL}) DESC, score DESC, old) AS rank FROM s),
d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, CASE WHEN length(body) < 48 THEN body ELSE substr(sha256(body), 1, 20) END ORDER BY rank) = 1 OR trim(body) = '')
SELECT query_id, chunk_id, paper_id, score, place FROM ({quota_sql('d')})"""
)
def request_retrieve(spark, sf_dir):
    """Questions with three variants each; a fifth asks for the inside of a word, which no term equals; a seventh has no vector."""
    words = F.array_sort(F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w"))))
    told = read(spark, sf_dir, "benchmark").withColumn("w", F.get(words, 0)["w"])
    inside = (F.col("item_id") % 5 == 0) & (F.length("w") > 4)
    told = told.select(F.col("item_id").alias("query_id"), F.when(inside, F.expr(HALF)).otherwise(F.col("text")).alias("query"))
    told = told.withColumn("others", F.array(F.lower("query"), F.regexp_replace("query", "^\\S+\\s+", ""), F.lit("")))
    path = stored(spark, sf_dir)
    lexical = sinks.kept(lexical_candidates(told, path, index.chunks(spark, path).select("chunk_id", "paper_id", "body")))
    v = read(spark, sf_dir, "embeddings")
    asking = told.select("query_id").filter("query_id % 7 <> 3").join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    placed = chunks(spark, sf_dir).select("chunk_id", "paper_id")
    fused = fused_candidates(lexical, v.select(F.col("vec_id").cast("string").alias("paper_id"), F.col("embedding").alias("vector")), asking, placed).join(placed, "chunk_id")
    rows = with_bodies(spark, sf_dir, fused).join(search.broadcast_if_small(told.select("query_id", "query")), "query_id")
    scored = reranked(rows, F.round(T.keyword_overlap(F.col("query"), F.substring("body", 1, 1800)), 6))
    return search.paper_quota(search.dedupe_results(scored)).select("query_id", "chunk_id", "paper_id", "score", "place")
