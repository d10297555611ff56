"""Compositions of retrieval: variants, merged lists, reranking, fusion of lexical and dense order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunking, index, search
from quillon.plans.base import registrar
from quillon.plans.corpus import CLAIM_STOP, SECTION_CHUNKS, TYPED, markdown, typed
from quillon.plans.retrieval import ASKED, DENSE, INDEX, LEXICAL, ORACLES as BEFORE, TERMS, asked, chunks, dense, hydrate, lexical, quota_sql, stored, text_retrieve, with_bodies
from quillon.sources import sinks
from quillon.sources.corpus import CHUNKS, read, tasks, TASKS

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

#: Candidates that are scored anew.
POOL = 80
VARIANTS = "queries AS (SELECT item_id * 2 AS query_id, substr(text, 1, length(text) // 2) AS query FROM benchmark UNION ALL SELECT item_id * 2 + 1, substr(text, length(text) // 2 + 1) FROM benchmark)"
QUERY_VECTORS = "qv AS (SELECT query_id, embedding AS q FROM queries JOIN embeddings ON vec_id = query_id)"


@query(f"WITH {ASKED}, {CHUNKS}, {TERMS}, {INDEX} SELECT query_id, count(DISTINCT chunk_id) AS n_chunks FROM terms JOIN postings USING (term) GROUP BY 1")
def text_match(spark, sf_dir):
    """How many chunks hold a term of each query."""
    return index.matches(spark, stored(spark, sf_dir), search.query_terms(asked(spark, sf_dir)))


@query(LEXICAL.replace(ASKED, VARIANTS) + ", best AS (SELECT query_id // 2 AS query_id, chunk_id, max(score) AS score FROM top WHERE rank <= 20 GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM best QUALIFY rank <= 40")
def merge_query_hits(spark, sf_dir):
    """The best score of each chunk over the variants of a query."""
    b = read(spark, sf_dir, "benchmark")
    half = F.floor(F.length("text") / 2).cast("int")
    part = lambda v, piece: b.select((F.col("item_id") * 2 + v).alias("query_id"), piece.alias("query"))
    hits = lexical(spark, sf_dir, 20, part(0, F.substring("text", F.lit(1), half)).unionByName(part(1, F.substring("text", half + 1, F.length("text")))))
    best = hits.groupBy(F.floor(F.col("query_id") / 2).alias("query_id"), "chunk_id").agg(F.max("score").alias("score"))
    return search.ranked(best, F.col("score"), 40)


@query(f"WITH r AS ({BEFORE['text_retrieve']}), {CHUNKS} SELECT query_id, place AS ref, chunk_id, substr(body, 1, 280) || CASE WHEN length(body) > 280 THEN '…' ELSE '' END AS preview FROM r JOIN chunks USING (chunk_id)")
def number_citations(spark, sf_dir):
    rows = with_bodies(spark, sf_dir, text_retrieve(spark, sf_dir).select("query_id", "chunk_id", "paper_id", F.col("place").alias("ref")))
    return rows.select("query_id", "ref", "chunk_id", F.concat(F.substring("body", 1, 280), F.when(F.length("body") > 280, "…").otherwise("")).alias("preview"))


@query(f"WITH x AS (SELECT 1){DENSE}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense QUALIFY rank <= 40), s AS (SELECT c.query_id, c.chunk_id, c.rank AS old, CASE WHEN b.vec_id % 5 = 0 THEN 0 ELSE round(list_cosine_similarity(a.embedding[1:32]::DOUBLE[], b.embedding[1:32]::DOUBLE[]), 6) END AS second FROM c JOIN embeddings a ON a.vec_id = c.query_id JOIN embeddings b ON b.vec_id = c.chunk_id::BIGINT) SELECT query_id, chunk_id, second, row_number() OVER (PARTITION BY query_id ORDER BY second DESC, old) AS rank FROM s")
def vector_rerank(spark, sf_dir):
    """Candidates reordered by a second vector (here: the first half of each); a missing one counts as 0."""
    half = read(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("h"))
    found = dense(spark, sf_dir, 40).select("query_id", "chunk_id", F.col("rank").alias("old"))
    rows = found.join(half.select(F.col("vec_id").alias("query_id"), F.col("h").alias("a")), "query_id").join(half.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("h").alias("b")), "chunk_id")
    second = F.when(F.col("chunk_id").cast("bigint") % 5 == 0, 0.0).otherwise(F.round(T.cosine(F.col("a"), F.col("b")), 6))
    return rows.select("query_id", "chunk_id", "old", second.alias("second")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("second"), "old")).cast("bigint")).drop("old")


@query(f"{LEXICAL}, {QUERY_VECTORS}, s AS (SELECT query_id, paper_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM (SELECT DISTINCT query_id, paper_id FROM top) JOIN qv USING (query_id) JOIN embeddings ON vec_id = paper_id::BIGINT) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS rank FROM s QUALIFY rank <= 10")
def dense_rank_candidates(spark, sf_dir):
    """Papers of the lexical candidates ordered by the cosine of their vector with that of the query."""
    v = read(spark, sf_dir, "embeddings")
    found = lexical(spark, sf_dir).select("query_id", "paper_id").distinct()
    rows = found.join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id").join(v.select(F.col("vec_id").cast("string").alias("paper_id"), "embedding"), "paper_id")
    return search.ranked(rows.select("query_id", "paper_id", F.round(T.cosine(F.col("q"), F.col("embedding")), 6).alias("score")), F.col("score"), 10, "paper_id")


@query(rf"""{LEXICAL}, c AS (SELECT query_id, chunk_id, rank AS old, lower(body) AS e, list_distinct(list_filter(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2 AND w NOT IN ({CLAIM_STOP}))) AS w FROM top JOIN chunks USING (chunk_id, paper_id) JOIN queries USING (query_id)),
s AS (SELECT query_id, chunk_id, old, CASE WHEN old <= {POOL} THEN round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(e, x))) / len(w) ELSE 0 END, 6) END AS score FROM c) SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY (old <= {POOL}) DESC, score DESC, old) AS rank FROM s""")
def rerank_pool(spark, sf_dir, pool=POOL):
    """The first candidates reordered by the words that their whole texts share with the query; the rest follow in their order."""
    rows = hydrate(spark, sf_dir).join(search.broadcast_if_small(asked(spark, sf_dir)), "query_id").withColumnRenamed("rank", "old")
    score = F.when(F.col("old") <= pool, F.round(T.keyword_overlap(F.col("query"), F.col("body")), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.col("old") <= pool), F.desc("score"), "old")
    return rows.withColumn("score", score).select("query_id", "chunk_id", "score", F.row_number().over(order).cast("bigint").alias("rank"))


LISTS = f"""{LEXICAL}, {QUERY_VECTORS}, v AS (SELECT query_id, vec_id::VARCHAR AS paper_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM qv, embeddings),
near AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY v.score DESC, chunk_id) AS rank FROM v JOIN chunks USING (paper_id) QUALIFY rank <= 40),
lists AS (SELECT query_id, 0 AS list_no, chunk_id, rank FROM top UNION ALL SELECT query_id, 1, chunk_id, rank FROM near)"""
#: The dense order of the lexical candidates; one without a vector is in no such list, ties stay in lexical order.
AMONG = "SELECT query_id, 2 AS list_no, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY v.score DESC, top.rank) AS rank FROM top JOIN v USING (query_id, paper_id) WHERE v.score IS NOT NULL"


def listed(rows, no):
    return rows.select("query_id", F.lit(no).alias("list_no"), "chunk_id", "rank")


def asking(spark, sf_dir):
    """Queries that have a vector."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return asked(spark, sf_dir).select("query_id").join(v, "query_id")


def paper_vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("paper_id"), F.col("embedding").alias("vector"))


def whole_lists(spark, sf_dir, found):
    """The lexical (found) and the dense order of all chunks; a chunk, read from the stored index, has the vector of its paper."""
    placed = index.chunks(spark, stored(spark, sf_dir)).select("paper_id", "chunk_id")
    rows = search.near_chunks(asking(spark, sf_dir), paper_vectors(spark, sf_dir), placed, 40)
    return listed(found, 0).unionByName(listed(rows, 1))


@query(f"{LISTS} SELECT * FROM lists UNION ALL {AMONG}")
def rank_lists(spark, sf_dir):
    """Three orders of chunks as lists of one table: the lexical one, the dense one of all chunks, the dense one of the lexical candidates."""
    found = sinks.kept(lexical(spark, sf_dir))
    among = search.near_candidates(found, asking(spark, sf_dir), paper_vectors(spark, sf_dir))
    return whole_lists(spark, sf_dir, found).unionByName(listed(among, 2))


@query(f"""{LISTS}, f AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 9) AS fused, min((list_no, rank)) AS seen FROM lists GROUP BY ALL),
g AS (SELECT f.query_id, f.chunk_id, c.paper_id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, seen, chunk_id) AS rank FROM f JOIN chunks c USING (chunk_id)) SELECT query_id, chunk_id, paper_id, fused, place FROM ({quota_sql('g')})""")
def hybrid_retrieve(spark, sf_dir):
    """Lexical and dense lists fused, then the quotas of papers and rows."""
    fused = search.fuse(whole_lists(spark, sf_dir, lexical(spark, sf_dir))).join(chunks(spark, sf_dir).select("chunk_id", "paper_id"), "chunk_id")
    return search.paper_quota(fused).select("query_id", "chunk_id", "paper_id", "fused", "place")


@query(f"WITH h AS ({ORACLES['hybrid_retrieve']}), s AS (SELECT query_id, paper_id, min(place) AS place FROM h GROUP BY query_id, paper_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY min(place)) <= 3) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY block, place) AS ref, block, id FROM (SELECT query_id, 0 AS block, place, paper_id AS id FROM s UNION ALL SELECT query_id, 1, place, chunk_id FROM h)")
def retrieve_contexts(spark, sf_dir):
    """At most three papers first, as summaries, then the chunks; references run on."""
    h = hybrid_retrieve(spark, sf_dir)
    own = Window.partitionBy("query_id")
    papers = h.groupBy("query_id", "paper_id").agg(F.min("place").alias("place")).withColumn("n", F.row_number().over(own.orderBy("place"))).filter("n <= 3")
    rows = papers.select("query_id", F.lit(0).alias("block"), "place", F.col("paper_id").alias("id")).unionByName(h.select("query_id", F.lit(1).alias("block"), "place", F.col("chunk_id").alias("id")))
    return rows.select("query_id", F.row_number().over(own.orderBy("block", "place")).cast("bigint").alias("ref"), "block", "id")


@query(r"SELECT * FROM (SELECT item_id AS query_id, unnest([text, lower(text), regexp_replace(text, '^\S+\s+', '')]) AS variant, unnest([0, 1, 2]) AS list_no FROM benchmark) QUALIFY row_number() OVER (PARTITION BY query_id, lower(variant) ORDER BY list_no) = 1")
def query_variants(spark, sf_dir):
    """A question and what was made of it, without repeats by case; the first one stays."""
    made = F.array(F.col("text"), F.lower("text"), F.regexp_replace("text", "^\\S+\\s+", ""))
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(made).alias("list_no", "variant"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", F.lower("variant")).orderBy("list_no"))).filter("n = 1").drop("n")


@query("SELECT p_partkey AS query_id, 'shade of ' || p_name AS variant FROM part WHERE regexp_matches(p_name, '^[a-z]+ [a-z]+$')")
def synonym_expand(spark, sf_dir):
    """Part names with their first word widened by a rule for each such word."""
    asks = read(spark, sf_dir, "part").filter(F.col("p_name").rlike("^[a-z]+ [a-z]+$")).select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    term = F.substring_index("query", " ", 1)
    rules = asks.select(term.alias("term"), F.concat(F.lit("shade of "), term).alias("alt")).distinct()
    return search.synonyms(asks, rules)


@query("SELECT user_id, row_number() OVER (ORDER BY k) AS place FROM (SELECT user_id, min((ts, event_id)) AS k FROM events GROUP BY 1) QUALIFY place <= 100")
def ordered_distinct_ids(spark, sf_dir):
    """The first hundred different ids in the order of their first appearance."""
    first = read(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("k")).orderBy("k").limit(100)
    return first.select("user_id", F.row_number().over(Window.orderBy("k")).cast("bigint").alias("place"))


@query(f"WITH {TASKS} SELECT task_type, id, row_number() OVER (PARTITION BY task_type ORDER BY created_at DESC, id DESC) AS place FROM tasks WHERE status = 'completed' QUALIFY place <= 10")
def recent_questions(spark, sf_dir):
    newest = Window.partitionBy("task_type").orderBy(F.desc("created_at"), F.desc("id"))
    return tasks(spark, sf_dir).filter("status = 'completed'").select("task_type", "id", F.row_number().over(newest).cast("bigint").alias("place")).filter("place <= 10")


@query(f"""{LEXICAL}, {TYPED} SELECT query_id, t.chunk_id, chunk_type, rank FROM top t JOIN typed y ON y.chunk_id = t.chunk_id WHERE chunk_type IS NULL
  OR CASE query_id % 4 WHEN 0 THEN chunk_type <> 'references' WHEN 2 THEN chunk_type <> 'unknown' ELSE true END""")
def scope_defaults(spark, sf_dir):
    """What four kinds of request see: no scope; a scope with references asked for; a scope of its own; no scope with references."""
    k = F.col("query_id") % 4
    rows = lexical(spark, sf_dir).join(typed(spark, sf_dir).select("chunk_id", "chunk_type"), "chunk_id")
    return search.in_scope(rows, k.isin(1, 2), F.array(F.lit("unknown")), k.isin(1, 3)).select("query_id", "chunk_id", "chunk_type", "rank")


@query(LEXICAL.replace(CHUNKS, SECTION_CHUNKS) + " SELECT query_id, t.chunk_id, t.paper_id, path, score, rank FROM top t JOIN chunks c ON c.chunk_id = t.chunk_id WHERE rank <= 10")
def section_topk(spark, sf_dir):
    """The best chunks of sections with the path of headings that a citation shows."""
    rows = chunking.chunk_sections(chunking.section_split(markdown(spark, sf_dir)))
    return lexical(spark, sf_dir, 10, rows=rows).join(rows.select("chunk_id", "path"), "chunk_id").select("query_id", "chunk_id", "paper_id", "path", "score", "rank")
