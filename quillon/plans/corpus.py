"""Text plans over documents, chunks, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunking
from quillon.plans.base import registrar
from quillon.sources.corpus import CHUNKS, read

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

STRIPPED = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
NONBLANK = rf"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {STRIPPED}), lambda x: x <> '')"
EDGE = r"[^\p{L}\p{N}_]"
TYPES = " ".join(f"WHEN regexp_matches(h, '(^|{EDGE})({told})($|{EDGE})') THEN '{kind}'" for kind, told in T.CHUNK_TYPES)
TYPED = f"""typed AS (SELECT * EXCLUDE (h, m), CASE {TYPES} WHEN m IN ('proof', 'definition') THEN m WHEN m <> '' THEN 'theorem' ELSE 'unknown' END AS chunk_type
  FROM (SELECT *, regexp_extract(h, '(?:^|{EDGE})({T.MATH_WORDS})(?:$|{EDGE})', 1) AS m FROM (SELECT *, lower('全文 ' || substr(body, 1, 400)) AS h FROM chunks)))"""


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def chunks(spark, sf_dir):
    return chunking.chunks(read(spark, sf_dir, "documents"))


@query(f"WITH {CHUNKS} SELECT paper_id, chunk_index, chunk_id, content_hash, length(body) AS n_chars, greatest(1, length(body) // 4) AS n_tokens FROM chunks")
def chunk_markdown(spark, sf_dir):
    return chunks(spark, sf_dir).select("paper_id", "chunk_index", "chunk_id", "content_hash", F.length("body").cast("bigint").alias("n_chars"), T.estimate_tokens(F.col("body")).alias("n_tokens"))


@query(f"WITH {CHUNKS} SELECT paper_id, chunk_index, chunk_id FROM chunks QUALIFY row_number() OVER (PARTITION BY paper_id, content_hash ORDER BY chunk_index) = 1")
def dedupe_chunks(spark, sf_dir):
    return chunking.dedupe_chunks(chunks(spark, sf_dir)).select("paper_id", "chunk_index", "chunk_id")


def typed(spark, sf_dir):
    return chunks(spark, sf_dir).withColumn("chunk_type", T.chunk_type(F.col("path"), F.col("body")))


@query(f"WITH {CHUNKS}, {TYPED} SELECT chunk_id, chunk_type FROM typed")
def chunk_type(spark, sf_dir):
    return typed(spark, sf_dir).select("chunk_id", "chunk_type")


@query(
    rf"""WITH {CHUNKS}, {TYPED} SELECT chunk_id, round(CASE WHEN length(body) < 40 THEN 0.2 ELSE greatest(0, least(1, 0.55 + CASE WHEN regexp_matches(body, '[。．.!?？]') THEN 0.15 ELSE 0 END
  - CASE WHEN chunk_type = 'references' AND length(body) > 200 THEN 0.25 ELSE 0 END + CASE WHEN chunk_type IN ('theorem', 'definition', 'proof') AND regexp_matches(body, '[$\\]') THEN 0.1 ELSE 0 END)) END::DOUBLE, 4) AS score FROM typed"""
)
def chunk_score(spark, sf_dir):
    return typed(spark, sf_dir).select("chunk_id", T.chunk_score(F.col("body"), F.col("chunk_type")).alias("score"))


@query(
    r"""SELECT paper_id, line, count(*) AS n FROM (SELECT doc_id::VARCHAR AS paper_id, regexp_replace(regexp_replace(unnest(l), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS line FROM (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) WHERE len(l) >= 12) WHERE length(line) BETWEEN 8 AND 80 GROUP BY ALL HAVING count(*) >= 4"""
)
def repeated_lines(spark, sf_dir):
    return chunking.repeated_lines(read(spark, sf_dir, "documents"))


@query(rf"SELECT doc_id, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(x, '^\s*[0-9]{{1,4}}\s*$')), chr(10)) AS text FROM documents")
def drop_page_numbers(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.drop_page_numbers(F.col("text")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(coalesce(text, ''), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g') AS text FROM documents")
def fix_hyphens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.fix_hyphens(F.col("text")).alias("text"))


@query(
    rf"""WITH h AS (SELECT doc_id, coalesce(text, '') AS t, string_split(regexp_replace(array_to_string(list_filter(string_split(regexp_replace(coalesce(text, ''), '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g'), chr(10)),
    lambda x: NOT regexp_matches(x, '^\s*[0-9]{{1,4}}\s*$')), chr(10)), '\n$', ''), chr(10)) AS l FROM documents),
e AS (SELECT *, count(*) OVER (PARTITION BY doc_id, norm) AS c FROM (SELECT doc_id, i, x, regexp_replace({STRIPPED}, '\s+', ' ', 'g') AS norm FROM (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM h WHERE len(l) >= 12))),
k AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS body FROM e WHERE NOT (length(norm) BETWEEN 8 AND 80 AND c >= 4) GROUP BY 1),
s AS (SELECT doc_id, t, regexp_replace(CASE WHEN len(l) < 12 THEN array_to_string(l, chr(10)) ELSE coalesce(body, '') END, '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS x FROM h LEFT JOIN k USING (doc_id)),
o AS (SELECT doc_id, t, {STRIPPED} AS o FROM s)
SELECT doc_id, CASE WHEN {STRIPPED.replace("(x,", "(t,")} = '' THEN t WHEN o = '' THEN o ELSE o || chr(10) END AS text FROM o"""
)
def clean_markdown(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.clean_markdown(F.col("text")).alias("text"))


#: What may follow a text: headings of references and lines that only look like one.
ENDINGS = ("\n# References\nEntry\n", "\n 参考文献 \nEntry", "\nReferences cited\nEntry", "", "\n##Works  Cited", "\nBIBLIOGRAPHY\nEntry\nReferences\n", "\nReferences\tof cats\n")
ENDINGS_SQL = ", ".join("'" + e.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for e in ENDINGS)


@query(
    rf"""WITH e AS (SELECT doc_id, coalesce(text, '') || ([{ENDINGS_SQL}])[doc_id % 7 + 1] AS t FROM documents),
f AS (SELECT doc_id, t, list_position(list_transform(string_split(t, chr(10)), lambda x: regexp_full_match({STRIPPED}, '(?i)(#+\s*)?({T.REFERENCE_HEADINGS})')), true) AS cut FROM e)
SELECT doc_id, CASE WHEN cut > 0 THEN regexp_replace(array_to_string(string_split(t, chr(10))[1:cut - 1], chr(10)), '\s+$', '') || chr(10) ELSE t END AS text FROM f"""
)
def trim_references(spark, sf_dir):
    """Texts with an ending, cut at their first heading of references."""
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % len(ENDINGS)).cast("int") + 1)
    return docs(spark, sf_dir).select("doc_id", T.trim_references(F.concat("text", ending), "\n").alias("text"))


@query(rf"""SELECT doc_id, round(CASE WHEN t = '' THEN 0 ELSE length(regexp_replace(t, '[^\x{{0}}-\x{{8}}\x{{E000}}-\x{{F8FF}}]', '', 'g')) / length(t) END, 9) AS garbled,
  round(CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: length(x) <= 2 AND NOT regexp_matches(x, '^[0-9]+$'))) / len(l) ELSE 0 END, 9) AS fragments FROM (SELECT doc_id, coalesce(text, '') AS t, {NONBLANK} AS l FROM documents)""")
def parse_quality(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(T.garbled_ratio(F.col("text")), 9).alias("garbled"), F.round(T.ocr_fragment_ratio(F.col("text")), 9).alias("fragments"))


@query(rf"""SELECT paper_id, count(*) AS n_before, count(*) FILTER (WHERE q IS DISTINCT FROM p) AS n_after FROM (
  SELECT paper_id, p, lag(p) OVER (PARTITION BY paper_id ORDER BY i) AS q FROM (SELECT doc_id::VARCHAR AS paper_id, unnest(l) AS p, unnest(range(len(l))) AS i FROM (SELECT doc_id, {NONBLANK} AS l FROM documents))) GROUP BY 1""")
def collapse_paragraphs(spark, sf_dir):
    return chunking.collapse_paragraphs(read(spark, sf_dir, "documents"))


@query(
    r"""WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)
SELECT conv_id::VARCHAR AS paper_id, 'Conversation ' || conv_id || ' › Turn ' || turn || ' ' || role AS path, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM m WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''"""
)
def section_split(spark, sf_dir):
    return chunking.section_split(markdown(spark, sf_dir)).select("paper_id", "path", "body")


def markdown(spark, sf_dir):
    """Conversations as Markdown: a heading for each conversation, one below for each turn."""
    turn = F.concat(F.lit("## Turn "), "turn", F.lit(" "), "role", F.lit("\n"), F.coalesce("text", F.lit("")))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", turn.alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "\n")
    return turns.groupBy("conv_id").agg(joined.alias("m")).select(F.col("conv_id").cast("string").alias("paper_id"), F.concat(F.lit("# Conversation "), "conv_id", F.lit("\n"), "m").alias("markdown"))


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
#: Chunks of the sections of conversations as Markdown.
SECTION_CHUNKS = rf"""chunks AS (SELECT *, substr(sha256(paper_id || '|' || path || '|' || chunk_index), 1, 32) AS chunk_id, substr(sha256(regexp_replace({STRIP.format('lower(body)')}, '\s+', ' ', 'g')), 1, 32) AS content_hash FROM (
  SELECT paper_id, path, row_number() OVER (PARTITION BY paper_id ORDER BY turn, k) - 1 AS chunk_index, body FROM (SELECT paper_id, turn, path, k, {STRIP.format('substr(t, (k * 3100 + 1)::BIGINT, 3500)')} AS body FROM (
    SELECT *, unnest(range(CASE WHEN length(t) <= 3500 THEN 1 ELSE 1 + ceil((length(t) - 3500) / 3100.0)::BIGINT END)) AS k FROM (
      SELECT conv_id::VARCHAR AS paper_id, turn, 'Conversation ' || conv_id || ' › Turn ' || turn || ' ' || role AS path, {STRIP.format("coalesce(text, '')")} AS t FROM conversations))) WHERE body <> ''))"""


@query(f"""WITH {SECTION_CHUNKS}, {TYPED.replace("'全文 ' ||", "path || ' ' ||")} SELECT paper_id, path, chunk_index, chunk_id, chunk_type, greatest(1, length(body) // 4) AS n_tokens FROM typed QUALIFY row_number() OVER (PARTITION BY paper_id, content_hash ORDER BY chunk_index) = 1""")
def index_sections(spark, sf_dir):
    """The index of Markdown by sections: each content of a paper once, under the headings above it."""
    return chunking.indexed_sections(markdown(spark, sf_dir)).select("paper_id", "path", "chunk_index", "chunk_id", "chunk_type", "n_tokens")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, substr(sha256('/lib/' || source || '/' || doc_id), 1, 32) AS paper_key FROM documents")
def content_digest(spark, sf_dir):
    path = F.concat(F.lit("/lib/"), "source", F.lit("/"), "doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), T.key32(path).alias("paper_key"))


@query("SELECT page_id, CASE WHEN starts_with(h, '%pdf') THEN 'ok' WHEN starts_with(h, '<!doctype') OR starts_with(h, '<html') OR starts_with(h, '<?xml') THEN 'markup' ELSE 'missing' END AS kind FROM (SELECT page_id, lower(ltrim(substr(coalesce(html, ''), 1, 32))) AS h FROM pages)")
def sniff_file_kind(spark, sf_dir):
    head = F.lower(F.ltrim(F.substring(F.coalesce("html", F.lit("")), 1, 32)))
    kind = F.when(head.startswith("%pdf"), "ok").when(head.startswith("<!doctype") | head.startswith("<html") | head.startswith("<?xml"), "markup").otherwise("missing")
    return read(spark, sf_dir, "pages").select("page_id", kind.alias("kind"))


@query(r"""SELECT doc_id, coalesce(nullif(CASE WHEN starts_with(line, '# ') THEN trim(substr(line, 3)) ELSE 'doc' || doc_id END, ''), 'Paper ' || doc_id) AS title
FROM (SELECT doc_id, regexp_extract(CASE doc_id % 4 WHEN 0 THEN '# Text ' || doc_id || chr(10) WHEN 1 THEN '#  ' || chr(10) WHEN 2 THEN chr(10) || '# later' ELSE '' END || coalesce(text, ''), '^([^\r\n]*)', 1) AS line FROM documents)""")
def title_guess(spark, sf_dir):
    """The heading of the first line, else the name of the file; the old title where the heading is blank."""
    d = F.col("doc_id")
    head = F.when(d % 4 == 0, F.concat(F.lit("# Text "), d, F.lit("\n"))).when(d % 4 == 1, "#  \n").when(d % 4 == 2, "\n# later").otherwise("")
    guess = T.title_guess(F.concat(head, F.coalesce("text", F.lit(""))), F.concat(F.lit("doc"), d), F.concat(F.lit("Paper "), d))
    return read(spark, sf_dir, "documents").select("doc_id", guess.alias("title"))


@query("SELECT a.vec_id AS query_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("b"))
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("a")).join(after, "query_id").select("query_id", F.round(T.cosine(F.col("a"), F.col("b")), 6).alias("score"))


ANSWERS = "a AS (SELECT conv_id, turn, text || ' [' || (turn % 3 + 1) || '] and [' || (conv_id % 7) || ']' AS answer FROM conversations WHERE role = 'assistant')"


def answers(spark, sf_dir):
    """Assistant texts with two references each."""
    cited = F.concat("text", F.lit(" ["), F.col("turn") % 3 + 1, F.lit("] and ["), F.col("conv_id") % 7, F.lit("]"))
    return read(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", cited.alias("answer"))


@query(rf"WITH {ANSWERS} SELECT conv_id, turn, unnest(list_transform(regexp_extract_all(answer, '\[([0-9]{{1,18}})\]', 1), lambda x: x::BIGINT)) AS ref FROM a")
def citation_refs(spark, sf_dir):
    return answers(spark, sf_dir).select("conv_id", "turn", F.explode_outer(T.citation_refs(F.col("answer"))).alias("ref")).filter("ref is not null")


@query(rf"""WITH {ANSWERS}, r AS (SELECT conv_id, turn, unnest(list_transform(regexp_extract_all(answer, '\[([0-9]{{1,18}})\]', 1), lambda x: x::BIGINT)) AS ref FROM a),
e AS (SELECT conv_id, turn + 1 AS ref FROM conversations WHERE role = 'user') SELECT conv_id, turn, ref, max((e.conv_id IS NOT NULL)::INT) = 1 AS valid FROM r LEFT JOIN e USING (conv_id, ref) GROUP BY ALL""")
def claim_evidence(spark, sf_dir):
    """References of an answer against the user turns of its conversation; others are out of range."""
    turns = read(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", (F.col("turn") + 1).cast("bigint").alias("ref"), F.lit(True).alias("v"))
    return citation_refs(spark, sf_dir).join(turns, ["conv_id", "ref"], "left").groupBy("conv_id", "turn", "ref").agg(F.coalesce(F.bool_or("v"), F.lit(False)).alias("valid"))


CLAIM_STOP = ", ".join(f"'{w}'" for w in T.CLAIM_STOP)


@query(rf"""WITH p AS (SELECT a.conv_id, a.turn, list_distinct(list_filter(regexp_extract_all(lower(a.text), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2 AND w NOT IN ({CLAIM_STOP}))) AS w, lower(q.text) AS e
  FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant')
SELECT conv_id, turn, round(s, 6) AS score, s >= 0.12 AS verified FROM (SELECT conv_id, turn, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(e, x))) / len(w) ELSE 0 END AS s FROM p)""")
def verify_claims(spark, sf_dir):
    """Each answer against the turn before it, by the share of its words found there."""
    rows = read(spark, sf_dir, "conversations")
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    s = T.keyword_overlap(F.col("text"), F.col("evidence"))
    return rows.filter("role = 'assistant'").join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(s, 6).alias("score"), (s >= 0.12).alias("verified"))


@query(rf"WITH v AS ({ORACLES['verify_claims']}) SELECT conv_id, count(*) AS n_claims, count(*) FILTER (WHERE verified) AS n_verified, max(score) AS best FROM v GROUP BY 1")
def claim_rollup(spark, sf_dir):
    return verify_claims(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n_claims"), F.count_if("verified").alias("n_verified"), F.max("score").alias("best"))


@query("SELECT d.doc_id AS query_id, p.doc_id AS pos, n.doc_id AS neg FROM labels a JOIN documents d ON d.doc_id = a.doc_id AND a.quality = 1 JOIN documents p ON p.doc_id = a.doc_id + 1 JOIN (SELECT doc_id FROM labels WHERE quality = 0) n ON n.doc_id BETWEEN a.doc_id AND a.doc_id + 20 QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY n.doc_id) <= 2")
def training_pairs(spark, sf_dir):
    """For each good document the next one as positive and the next two bad ones within twenty ids as negatives."""
    ids, marks = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels")
    good = marks.filter("quality = 1").select("doc_id").join(ids, "doc_id").select(F.col("doc_id").alias("query_id"))
    pos = ids.select((F.col("doc_id") - 1).alias("query_id"), F.col("doc_id").alias("pos"))
    near = marks.filter("quality = 0").select(F.col("doc_id").alias("neg"), F.explode(F.sequence(F.col("doc_id") - 20, "doc_id")).alias("query_id"))
    order = Window.partitionBy("query_id").orderBy("neg")
    return good.join(pos, "query_id").join(near, "query_id").withColumn("n", F.row_number().over(order)).filter("n <= 2").select("query_id", "pos", "neg")
