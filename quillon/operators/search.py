"""Lexical and dense retrieval for many queries at once, rank fusion and final selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillon.functions import text as T
from quillon.operators import contained

K1, B, LEAST_IDF, FUSION = 1.2, 0.75, 1e-6, 60
#: Components of query vectors that tasks hold at once (more meet the vectors in blocks of rows); pairs that a task scores at once.
HELD, PAIRS = 4 << 20, 1 << 20
#: Tokens that tasks hold at once to look for them in texts, and their bytes; queries times rows that a task looks at together.
WANTED, WANTED_BYTES, CELLS = 100_000, 8 << 20, 2_000_000
#: Cosines are rounded to six digits, so what is cut off must be further away than that.
SLACK = 2e-6


def broadcast_if_small(df: DataFrame, rows: int = 200_000, most: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint up to so many rows and about so many bytes, measured; beyond either joins shuffle."""
    found = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct(*[df[f"`{c}`"] for c in df.columns]))).cast("bigint").alias("b"))
    n, size = found.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= most else df


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, paper_id, tf, dl) of every chunk."""
    return counted(chunks.select("chunk_id", "paper_id", T.index_tokens(F.col("body")).alias("w")))


def counted(words: DataFrame) -> DataFrame:
    """The postings of chunks with their tokens `w`."""
    each = words.select("chunk_id", "paper_id", F.size("w").alias("dl"), F.explode_outer("w").alias("term")).filter("term is not null")
    return each.groupBy("term", "chunk_id", "paper_id", "dl").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) of queries (query_id, query)."""
    return queries.select("query_id", F.explode_outer(T.search_tokens(F.col("query"))).alias("term")).filter("term is not null").distinct()


def bm25(index: DataFrame, terms: DataFrame, n_chunks: int, mean_length: float) -> DataFrame:
    """(query_id, chunk_id, paper_id, score): BM25 summed over the terms of a query."""
    terms = terms.select("query_id", T.folded(F.col("term")).alias("term")).distinct()
    asked = broadcast_if_small(terms.select("term").distinct())
    hit = index.join(asked, "term", "left_semi")
    df = hit.groupBy("term").agg(F.count("*").alias("n"))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.lit(float(n_chunks)) - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean_length)))
    scored = hit.join(df, "term").select("term", "chunk_id", "paper_id", part.alias("part"))
    return scored.join(broadcast_if_small(terms), "term").groupBy("query_id", "chunk_id", "paper_id").agg(F.round(F.sum("part"), 6).alias("score"))


def ranked(rows: DataFrame, score: Column, k: int | None = None, tie: str = "chunk_id") -> DataFrame:
    """rows with rank from 1 by falling score, ties by id; at most k for each query."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(score.desc(), tie)).cast("bigint"))
    return out.filter(F.col("rank") <= k) if k else out


def dense(queries: DataFrame, vectors: DataFrame, block: int = 256) -> DataFrame:
    """(query_id, chunk_id, paper_id, score): cosine of each query vector with each vector.

    The stated query set meets all vectors in blocks of about `block` queries. A rank filter on the
    result keeps the best of each query in every task before anything is shuffled.
    """
    n = max(1, -(-queries.count() // block))
    blocks = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("no")).agg(F.collect_list(F.struct("query_id", F.col("vector").alias("q"))).alias("block"))
    dealt = vectors.select("chunk_id", "paper_id", "vector").withColumn("no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    each = dealt.join(broadcast_if_small(blocks), "no").select("chunk_id", "paper_id", "vector", F.explode("block").alias("b"))
    return each.select("b.query_id", "chunk_id", "paper_id", F.round(T.cosine(F.col("b.q"), F.col("vector")), 6).alias("score"))


def directed(vector: Column, size: int) -> Column:
    """Whether a vector has `size` finite components that are not all zero."""
    ends = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e30)
    return F.coalesce((F.size(vector) == size) & ~F.exists(vector, ends) & F.exists(vector, lambda x: F.abs(x) > 1e-30), F.lit(False))


def held(queries: DataFrame, width: int) -> tuple[list, np.ndarray] | None:
    """Ids and vectors of queries (query_id, vector) of `width` components, if there are any and tasks can hold them."""
    most = HELD // max(1, width)
    rows = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).limit(most + 1).collect() if width else []  # at most HELD components
    return ([r["query_id"] for r in rows], np.array([r["vector"] for r in rows])) if 0 < len(rows) <= most else None


def near(asked: tuple[list, np.ndarray], kind, vectors: DataFrame, k: int, cells: np.ndarray | None = None) -> DataFrame:
    """(query_id, chunk_id, paper_id, score) of held queries: of each task what may be among the k best of each query.

    Vectors must have a direction. With `cells` (for each cell bits of the queries, packed) a vector of a `cell` meets
    its queries only. Products of matrices tell which pairs are near the best; only these get their score, summed in the order of `dense`.
    """
    ids, rows = asked
    names = [(c, vectors.schema[c].dataType.simpleString()) for c in ("chunk_id", "paper_id")]

    def norms(m: np.ndarray) -> np.ndarray:
        return np.sqrt(np.cumsum(m * m, axis=1)[:, -1])

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Pieces of a batch and the queries that they meet."""
        if cells is None:
            yield batch, np.arange(len(rows))
            return
        cell = batch["cell"].to_numpy(zero_copy_only=False)
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.diff(cell[order], prepend=-2))
        for at, to in zip(first, np.append(first[1:], len(order)), strict=True):
            yield batch.take(pa.array(order[at:to])), np.flatnonzero(np.unpackbits(cells[cell[order[at]]], count=len(rows)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, own, least = pa.array(ids, to_arrow_type(kind)), norms(rows), np.full(len(rows), -2.0)
        unit = rows / own[:, None]
        for whole, some in (x for batch in batches for x in parts(batch)):
            step = max(k, PAIRS // max(1, len(some)))
            for at in range(0, whole.num_rows if len(some) else 0, step):
                batch = whole.slice(at, step)
                m = batch["vector"].flatten().to_numpy(zero_copy_only=False).reshape(-1, rows.shape[1])
                length = norms(m)
                about = unit[some] @ (m / length[:, None]).T
                if len(m) >= k:
                    least[some] = np.maximum(least[some], np.partition(about, len(m) - k, axis=1)[:, len(m) - k])
                query, row = np.nonzero(about >= least[some][:, None] - SLACK)
                query = some[query]
                for i in range(0, len(query), PAIRS // 8):
                    q, r = query[i : i + PAIRS // 8], row[i : i + PAIRS // 8]
                    score = np.cumsum(rows[q] * m[r], axis=1)[:, -1] / (own[q] * length[r])
                    found = [batch[c].take(pa.array(r)) for c, _ in names]
                    yield pa.RecordBatch.from_arrays([named.take(pa.array(q)), *found, pa.array(score)], names=["query_id", "chunk_id", "paper_id", "score"])

    plain = vectors.select("chunk_id", "paper_id", F.col("vector").cast("array<double>").alias("vector"), *["cell"] * (cells is not None))
    return plain.mapInArrow(best, f"query_id {kind.simpleString()}, {', '.join(f'{c} {t}' for c, t in names)}, score double").withColumn("score", F.round("score", 6))


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Rows of `dense` among which are the k best of each query, and all that tie with the last of them by score.

    Tasks hold the query vectors, score batches of vectors as products of matrices, and pass on what may be among the
    best (`near`). Vectors and queries without direction, and query sets of more than HELD components, go by `dense`.
    """
    sizes = vectors.groupBy(F.size("vector").alias("size")).count().filter("size > 0").orderBy(F.desc("count"), "size").first()
    width = sizes["size"] if sizes else 0
    good = directed(F.col("vector"), width)
    asked = held(queries.filter(good), width)
    if asked is None:
        return dense(queries, vectors)
    out = near(asked, queries.schema["query_id"].dataType, vectors.filter(good), k)
    for some, rest in ((queries.filter(~good), vectors), (queries.filter(good), vectors.filter(~good))):
        if not some.isEmpty() and not rest.isEmpty():
            out = out.unionByName(dense(some, rest))
    return out


def near_chunks(queries: DataFrame, vectors: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, paper_id, score, rank): the k best chunks (placed: chunk_id, paper_id) of each query, which have the vector of their paper (vectors: paper_id, vector).

    They belong to the k best papers that have chunks, or to papers which tie with the last of these.
    """
    own = vectors.join(placed.select("paper_id").distinct(), "paper_id", "left_semi").select(F.lit("").alias("chunk_id"), "paper_id", "vector")
    papers = nearest(queries, own, k).drop("chunk_id").withColumn("place", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("place") <= k)
    return ranked(papers.drop("place").join(placed, "paper_id"), F.col("score"), k)


def near_candidates(found: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, rank): ranked candidates (found: query_id, chunk_id, paper_id, rank) ordered by the cosine of their paper's vector (vectors: paper_id, vector) with that of their query (query_id, vector).

    What has no vector is left out; ties stay in the order of the candidates.
    """
    mine = broadcast_if_small(found.select("query_id", "chunk_id", "paper_id", F.col("rank").alias("old")))
    met = vectors.filter("vector is not null").join(mine, "paper_id")
    rows = met.join(broadcast_if_small(queries.filter("vector is not null").select("query_id", F.col("vector").alias("q"))), "query_id")
    return ranked(rows.select("query_id", "chunk_id", "old", F.round(T.cosine(F.col("q"), F.col("vector")), 6).alias("score")), F.col("score"), tie="old").drop("old")


#: Words of an item by which texts that may hold it are found, where the items are too many for tasks to hold.
ANCHOR = 4


def holding(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, paper_id) for each text of docs (paper_id, text) that contains the text of an item (query_id, item).

    Tasks hold the items and read each text once (`containing`). Items beyond what tasks hold go by runs of words:
    the first and last word of an item may be parts of words of a text, those between are whole words
    there. So texts are found by a join on the longest run of ANCHOR such words (of all, if there are
    fewer) and then read. Only items of fewer than three words are read against every text, in blocks.
    Nulls hold nothing and are held by nothing.
    """
    whole = items.filter("item is not null").select("query_id", F.array("item").alias("tokens"))
    if _wanted(whole) is not None:
        return containing(whole, docs, F.col("text"), ["paper_id"]).distinct()
    return _by_runs(items, docs)


def _by_runs(items: DataFrame, docs: DataFrame) -> DataFrame:
    split = items.filter("item is not null").select("query_id", "item", F.split("item", "\\s+").alias("w")).withColumn("inner", F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))))
    split = split.withColumn("width", F.least(F.size("inner"), F.lit(ANCHOR)))
    run = lambda i: F.slice("inner", i, F.col("width"))
    runs = F.transform(F.sequence(F.lit(1), F.size("inner") - F.col("width") + 1), lambda i: F.struct(F.length(F.array_join(run(i), "")).alias("n"), F.xxhash64(run(i)).alias("gram")))
    anchors = split.filter("width > 0").select("query_id", "width", F.array_max(runs)["gram"].alias("gram"))
    widths = [r["width"] for r in anchors.select("width").distinct().orderBy("width").collect()]  # at most ANCHOR values
    words = docs.filter("text is not null").select("paper_id", F.split("text", "\\s+").alias("w"))
    grams = lambda k: F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.struct(F.lit(k).alias("width"), F.xxhash64(F.slice("w", i, k)).alias("gram"))))
    asked = broadcast_if_small(anchors)
    found = docs.sparkSession.createDataFrame([], anchors.select("query_id").schema).crossJoin(docs.select("paper_id").limit(0))
    for k in widths:
        each = words.select("paper_id", F.explode_outer(F.array_distinct(grams(k))).alias("g")).select("paper_id", "g.*")
        found = found.unionByName(each.join(asked, ["width", "gram"]).select("query_id", "paper_id"))
    pairs = found.distinct().join(docs, "paper_id").join(broadcast_if_small(items), "query_id").filter(F.contains("text", "item"))
    short = split.filter("width <= 0").select("query_id", F.array("item").alias("tokens"))
    return pairs.select("query_id", "paper_id").unionByName(containing(short, docs.filter("text is not null"), F.col("text"), ["paper_id"])).distinct()


def _wanted(queries: DataFrame) -> tuple[list, list[str], np.ndarray, np.ndarray] | None:
    """Queries (query_id, tokens) as arrays, if tasks can hold them: ids, different tokens, and which queries (places in ids) ask for each token."""
    each = queries.select("query_id", F.explode_outer("tokens").alias("t")).filter("t is not null")
    n, size = each.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    if n > WANTED or size > WANTED_BYTES:
        return None
    rows = each.distinct().orderBy("query_id", "t").collect()  # at most WANTED, of WANTED_BYTES
    ids, words = list(dict.fromkeys(r["query_id"] for r in rows)), sorted({r["t"] for r in rows})
    place, number = {q: i for i, q in enumerate(ids)}, {w: i for i, w in enumerate(words)}
    token, query = np.array([(number[r["t"]], place[r["query_id"]]) for r in rows], dtype=np.int64).reshape(-1, 2).T
    order = np.argsort(token, kind="stable")
    return ids, words, np.searchsorted(token[order], np.arange(len(words) + 1)), query[order]


def containing(queries: DataFrame, rows: DataFrame, text: Column, keep: list[str], block: int = 512, first: int | None = None, order: tuple[Column, ...] = ()) -> DataFrame:
    """(query_id, keep): rows whose text contains any of a query's tokens (query_id, tokens).

    Tasks hold the tokens and look for all of them in one pass over a text. With `first` a task sorts its rows by
    `order` (no two equal) and passes on the first so many of each query only, so it no longer looks for what has enough.
    More tokens than tasks hold (WANTED, WANTED_BYTES) meet all rows in blocks, and all hits are given.
    """
    wanted = _wanted(queries)
    if wanted is None:
        return _in_blocks(queries, rows, text, keep, block)
    ids, words, starts, asks = wanted
    kind = queries.schema["query_id"].dataType
    read = rows.select(*keep, text.alias("_text"))
    read = read.sortWithinPartitions(*order) if first else read

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, got, tokens, live = pa.array(ids, to_arrow_type(kind)), np.zeros(len(ids), dtype=np.int64), None, len(ids)
        for whole in batches:
            for at in range(0, whole.num_rows if live else 0, max(1, CELLS // max(1, len(ids)))):
                batch = whole.slice(at, max(1, CELLS // max(1, len(ids))))
                open_ = got < first if first else np.ones(len(ids), dtype=bool)
                if tokens is None or open_.sum() < live:
                    live = int(open_.sum())
                    own = np.unique(np.repeat(np.arange(len(words)), np.diff(starts))[open_[asks]])
                    tokens = contained.Tokens([words[t] for t in own], contained.flat(batch["_text"])[0][: contained.PIECE])
                token, row = tokens.found(batch["_text"])
                times = np.diff(starts)[own[token]]
                hit = np.repeat(np.arange(len(token)), times)
                query = asks[starts[own[token]][hit] + np.arange(len(hit)) - (np.cumsum(times) - times)[hit]]
                both = np.unique(query * batch.num_rows + row[hit])
                query, row = both // max(1, batch.num_rows), both % max(1, batch.num_rows)
                if first:
                    n = np.arange(len(query)) - np.searchsorted(query, query)
                    query, row = query[n < first - got[query]], row[n < first - got[query]]
                    got += np.bincount(query, minlength=len(ids))
                yield pa.RecordBatch.from_arrays([named.take(pa.array(query)), *[batch[c].take(pa.array(row)) for c in keep]], names=["query_id", *keep])

    names = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return read.mapInArrow(met, f"query_id {kind.simpleString()}, {names}")


def _in_blocks(queries: DataFrame, rows: DataFrame, text: Column, keep: list[str], block: int) -> DataFrame:
    """`containing` by a join: a row meets each block of about `block` queries and reads its tokens there, so only hits leave the task."""
    n = max(1, -(-queries.count() // block))
    blocks = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("no")).agg(F.collect_list(F.struct("query_id", "tokens")).alias("block"))
    dealt = rows.select(*keep, text.alias("_text")).withColumn("no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    met = dealt.join(broadcast_if_small(blocks, 64), "no")
    hit = F.filter("block", lambda q: F.exists(q["tokens"], lambda t: F.contains(F.col("_text"), t)))
    return met.select(*keep, F.explode(hit).alias("q")).select("q.query_id", *keep)


def fuse(lists: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list_no, rank, chunk_id); ties go to who appears first."""
    summed = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (F.lit(FUSION) + F.col("rank"))), 9).alias("fused"), F.min(F.struct("list_no", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "seen", "chunk_id")
    return summed.withColumn("rank", F.row_number().over(order).cast("bigint")).drop("seen")


def dedupe_results(rows: DataFrame) -> DataFrame:
    """The best row of each text for each query; blank texts stay."""
    key = F.when(F.length("body") < 48, F.col("body")).otherwise(F.substring(F.sha2("body", 256), 1, 20))
    marked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank")))
    return marked.filter("_n = 1 or trim(body) = ''").drop("_n")


def paper_quota(rows: DataFrame, per_paper: int = 3, n_papers: int = 8, limit: int = 8) -> DataFrame:
    """Ranked rows with at most per_paper of a paper, of the first n_papers papers, limit in all; 0 sets no bound."""
    own = Window.partitionBy("query_id", "paper_id")
    rows = rows.filter("paper_id is not null").withColumns({"_n": F.row_number().over(own.orderBy("rank")), "_first": F.min("rank").over(own)})
    rows = rows.filter(F.col("_n") <= per_paper) if per_paper else rows
    if n_papers:
        rows = rows.withColumn("_p", F.dense_rank().over(Window.partitionBy("query_id").orderBy("_first"))).filter(F.col("_p") <= n_papers)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("bigint")).drop("_n", "_first", "_p")
    return rows.filter(F.col("place") <= limit) if limit else rows


def synonyms(queries: DataFrame, rules: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, variant): queries with the first hit of a rule's term replaced by each alternative.

    Rules (term, alt) meet queries by the term's first word, so only likely pairs are tried; the whole
    term must then stand between word boundaries. At most `most` variants of a query are kept, which
    is the limit of the feature.
    """
    word = "[\\p{L}\\p{N}_]+"
    asked = queries.select("query_id", "query", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(word), F.lit(0)))).alias("w"))
    told = rules.filter("lower(alt) <> lower(term)").withColumn("w", F.regexp_extract(F.lower("term"), word, 0))
    hit = F.concat(F.lit("(?is)^(.*?)(?<![\\p{L}\\p{N}_])\\Q"), F.col("term"), F.lit("\\E(?![\\p{L}\\p{N}_])"))
    met = asked.join(broadcast_if_small(told), "w").filter(F.regexp_like("query", hit))
    safe = F.replace(F.replace(F.col("alt"), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    made = met.select("query_id", "term", "alt", F.regexp_replace("query", hit, F.concat(F.lit("$1"), safe)).alias("variant"))
    first = made.groupBy("query_id", "variant").agg(F.min(F.struct("term", "alt")).alias("o"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("o"))).filter(F.col("n") <= most).select("query_id", "variant")


def in_scope(rows: DataFrame, scoped: Column, excluded: Column, with_references: Column) -> DataFrame:
    """Rows (chunk_type) that a request may see: with references all; else without those types that its scope excludes; without a scope all but references.

    `excluded` is the array of types that a scope names, read where `scoped` is true.
    """
    out = F.when(with_references, F.array().cast("array<string>")).when(scoped, excluded).otherwise(F.array(F.lit("references")))
    return rows.filter(F.col("chunk_type").isNull() | ~F.array_contains(out, F.col("chunk_type")))
