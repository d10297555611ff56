"""DuckDB SQL of the queries that SQL can express (5, 8 and 9, and the boosted part of 4, are tested otherwise)."""

from __future__ import annotations

from quillon.llm.centroids import CENTROIDS, COMPONENTS, ROUNDS, SEED
from quillon.llm.collocations import FIRST, INSIDE, LONGEST, OFTEN
from quillon.llm.decontaminate import RUN, SHORT_TELLING, TELLING, UNITS, WIDTH
from quillon.llm.license_scan import SHARE, SHINGLE, TEMPLATES, WINDOW
from quillon.llm.line_dedup import DOCUMENTS, LEAST
from quillon.llm.quality_rules import POLICIES, RULES, mask

_SPACE = r"[\x20\x09-\x0D]"
_CONTROL = "<|im_end|><|im_start|>assistant ok"

OP1 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{_CONTROL}'
), o AS (
  SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY turn, r, x) AS p FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  sum(length(regexp_replace(x, '<(\\*)\|', '<\\\1|', 'g')) + CASE WHEN r = p THEN 10 ELSE 12 + length(r) + 1 + 11 END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""

_UNITS = ", ".join(f"'{u}'" for u in UNITS)


def _tokens(table: str, key: str) -> str:
    """(key, place, word, canon) of a table's texts, place counted from 0 over the words kept."""
    return rf"""
  SELECT {key}, word, canon, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS place FROM (
    SELECT {key}, i, word, CASE WHEN substr(word, 1, 1) BETWEEN '0' AND '9' THEN '#q'
      WHEN substr(bare, 1, 1) <> lower(substr(bare, 1, 1)) THEN '#n'
      WHEN coalesce(substr(before_word, 1, 1) BETWEEN '0' AND '9', false) AND word IN ({_UNITS}) THEN '#u'
      ELSE word END AS canon
    FROM (
      SELECT {key}, i, bare, word, lag(word) OVER (PARTITION BY {key} ORDER BY i) AS before_word
      FROM (SELECT {key}, unnest(bares) AS bare, unnest(plains) AS word, unnest(range(len(bares))) AS i FROM (
        SELECT {key}, string_split(regexp_replace(flat, '[^\p{{L}}\p{{N}} ]+', '', 'g'), ' ') AS bares, string_split(lower(regexp_replace(flat, '[^\p{{L}}\p{{N}} ]+', '', 'g')), ' ') AS plains
        FROM (SELECT {key}, regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g') AS flat FROM {table}))))
  ) WHERE word <> ''"""


def _keyed(table: str, key: str) -> str:
    """(key, n, place, light, window_) of the windows of n words of (key, n, starts, cs, ws), from the places `starts`."""
    return rf"""
  SELECT {key}, n, place, light, unnest(CASE WHEN light THEN [n || ' ' || array_to_string(c, ' '), -n || ' ' || array_to_string(w, ' ')] ELSE [-n || ' ' || array_to_string(w, ' ')] END) AS window_ FROM (
    SELECT *, len(list_filter(c, lambda x: x NOT IN ('#q', '#u', '#n'))) >= CASE WHEN n = {WIDTH} THEN {TELLING} ELSE least(n, {SHORT_TELLING}) END AS light FROM (
      SELECT {key}, n, place, cs[place + 1:place + n] AS c, ws[place + 1:place + n] AS w FROM (SELECT {key}, n, cs, ws, unnest(starts) AS place FROM {table})))"""


OP2 = rf"""
WITH i AS ({_tokens("benchmark", "item_id")}), d AS ({_tokens("(SELECT DISTINCT doc_id, text FROM documents)", "doc_id")}),
il AS (SELECT item_id, least(count(*), {WIDTH}) AS n, list(canon ORDER BY place) AS cs, list(word ORDER BY place) AS ws FROM i GROUP BY 1),
ia AS (SELECT *, range(len(cs) - n + 1) AS starts FROM il
  UNION ALL SELECT item_id, n, list_concat(['#u'], cs[2:]), ws, [0] FROM il WHERE cs[1] IN ({_UNITS})),
iw AS ({_keyed("ia", "item_id")}),
n AS (SELECT item_id, count(DISTINCT place) AS n_windows, count(DISTINCT place) FILTER (WHERE light) AS n_light FROM iw GROUP BY 1),
dl AS (SELECT doc_id, list(canon ORDER BY place) AS cs, list(word ORDER BY place) AS ws FROM d GROUP BY 1),
dw AS ({_keyed("(SELECT doc_id, n, cs, ws, range(len(cs) - n + 1) AS starts FROM dl, (SELECT DISTINCT n FROM il) WHERE len(cs) >= n)", "doc_id")}),
r AS (SELECT doc_id, item_id, iw.n, dw.place - iw.place AS shift, count(DISTINCT iw.place) AS n_matched, min(iw.place) AS first_, max(iw.place) AS last_
  FROM dw JOIN iw USING (window_) GROUP BY ALL),
b AS (SELECT * FROM r JOIN n USING (item_id) WHERE n_matched >= least(CASE WHEN n_light > 0 THEN n_light ELSE n_windows END, {RUN})),
s AS (SELECT b.doc_id, b.item_id, shift, i.canon, i.word AS item, d.word AS doc FROM b
  JOIN i ON i.item_id = b.item_id AND i.place BETWEEN first_ AND last_ + b.n - 1
  JOIN d ON d.doc_id = b.doc_id AND d.place = i.place + shift AND d.canon = i.canon WHERE i.canon IN ('#q', '#u', '#n')),
j AS (SELECT doc_id, item_id, shift, n_matched, n_windows, coalesce(n_slots, 0) AS n_slots, coalesce(n_changed, 0) AS n_changed, coalesce(pairs = items, true) AS leak
  FROM b LEFT JOIN (
    SELECT doc_id, item_id, shift, count(*) AS n_slots, count(*) FILTER (WHERE item <> doc) AS n_changed,
      count(DISTINCT (canon, item, doc)) AS pairs, count(DISTINCT (canon, item)) AS items FROM s GROUP BY ALL) USING (doc_id, item_id, shift))
SELECT * EXCLUDE (shift) FROM j QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY leak DESC, n_matched DESC, shift) = 1
"""

OP3 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}+'), lambda x: x <> '') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 3 THEN ws ELSE ws[k:k + 2] END, ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS k FROM w WHERE len(ws) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_ >= 90 * (p.n + q.n - both_)
), c AS (
  SELECT doc_id AS a, doc_id AS low FROM n UNION SELECT l.b, c.low FROM c JOIN l ON l.a = c.a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.low, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(low) AS low FROM c GROUP BY 1) m USING (doc_id)
"""

_TEMPLATES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
_PLAIN = rf"list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{N}}\x20\x09-\x0D]+', '', 'g')), '{_SPACE}+'), lambda x: x <> '')"

OP6 = rf"""
WITH t AS (SELECT license_id, ws, list_distinct(list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda k: array_to_string(ws[k:k + {SHINGLE - 1}], ' '))) AS g
  FROM (SELECT license_id, {_PLAIN} AS ws FROM (VALUES {_TEMPLATES}) v(license_id, text))),
d AS (SELECT DISTINCT doc_id, {_PLAIN} AS ws FROM documents),
g AS (SELECT doc_id, k, array_to_string(ws[k:k + {SHINGLE - 1}], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {SHINGLE - 2})) AS k FROM d)),
h AS (SELECT doc_id, license_id, k, shingle, len(t.ws) AS size, len(t.g) AS many FROM g JOIN (SELECT license_id, ws, g, unnest(g) AS shingle FROM t) t USING (shingle)),
r AS (SELECT doc_id, license_id, j, count(DISTINCT shingle) / any_value(many) AS share FROM (
    SELECT *, unnest(range(greatest(0, (k - size - {WINDOW}) // {WINDOW // 2} - 2)::BIGINT, ((k + size) // {WINDOW // 2} + 2)::BIGINT)) AS j FROM h)
  WHERE k >= greatest(1, j * {WINDOW // 2} + 1 - size) AND k + {SHINGLE - 1} <= j * {WINDOW // 2} + size + {WINDOW} + {SHINGLE}
  GROUP BY ALL)
SELECT doc_id, license_id, max(share) AS containment FROM r GROUP BY ALL HAVING max(share) >= {SHARE}
"""

OP7 = r"""
WITH p AS (SELECT page_id, DATE '2024-01-01' + (page_id % 365)::INT AS fetched,
    nullif(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '[.]?(:[0-9]*)?$', ''), '') AS host FROM pages),
h AS (SELECT DISTINCT host AS domain, md5(host) AS m, DATE '2024-02-01' + ascii(substr(md5(host), 2, 1)) AS first_ FROM p WHERE host IS NOT NULL),
t AS (SELECT DISTINCT array_to_string(list_slice(string_split(domain, '.'), -2, -1), '.') AS domain FROM h),
e AS (SELECT domain, 'block' AS action, first_ AS day FROM h WHERE substr(m, 1, 1) < '8'
  UNION ALL SELECT domain, 'allow', first_ + 60 FROM h WHERE substr(m, 3, 1) < '8'
  UNION ALL SELECT domain, 'block', DATE '2024-06-01' FROM t WHERE substr(md5(domain), 1, 1) < 'c'
  UNION ALL SELECT domain, 'allow', DATE '2024-09-15' FROM t),
i AS (SELECT domain, action, day AS valid_from, lead(day) OVER (PARTITION BY domain ORDER BY day) AS valid_to FROM (SELECT domain, day, max(action) AS action FROM e GROUP BY ALL)),
m AS (SELECT page_id, i.*, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC) AS k FROM p JOIN i
  ON (p.host = i.domain OR ends_with(p.host, '.' || i.domain)) AND p.fetched >= i.valid_from AND (i.valid_to IS NULL OR p.fetched < i.valid_to))
SELECT p.page_id, p.fetched, p.host, m.domain AS matched_domain, m.action, m.valid_from, m.valid_to, coalesce(m.action = 'block', false) AS blocked
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT r, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS ws FROM d)),
g AS (SELECT r, i, (w, lead(w, 1) OVER o, lead(w, 2) OVER o) AS g, lead(i, 2) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
x AS (SELECT r, i FROM g WHERE whole QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM x, range(3) z(k) GROUP BY 1),
n AS (SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM w GROUP BY 1),
l AS (SELECT r, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d)),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN n USING (r) LEFT JOIN l USING (r) LEFT JOIN c USING (r)),
b AS (SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
  + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 25 * n_words AND n_words > 0)::INT AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS bits FROM b
"""

_VERSIONS = ", ".join(f"('{p}', '{r}', {1 << i}, {mask(p)})" for p in POLICIES for i, (r, _) in enumerate(RULES) if r in POLICIES[p])
ABLATIONS = f"""SELECT policy, rule, count(*) FILTER (WHERE bits & bit <> 0) AS failed, count(*) FILTER (WHERE bits & mask = bit) AS only
FROM ({OP10}) x, (VALUES {_VERSIONS}) v(policy, rule, bit, mask) GROUP BY policy, rule"""



def _round(no: int, vectors: str, centroids: str) -> str:
    """Every vector's nearest centroid by squared distance, and the next centroids from them."""
    nearest = f"""SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min((d, no)) AS best FROM (
      SELECT v.r, v.vec_id, v.x, c.no, list_sum(list_transform(range(1, {COMPONENTS + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d FROM {vectors} v, {centroids} c) GROUP BY r"""
    moved = f"""SELECT no, coalesce(n.x, c.x) AS x FROM {centroids} c LEFT JOIN (
      SELECT no, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS x FROM (
        SELECT best[2] AS no, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM near{no}, range(1, {COMPONENTS + 1}) t(i) GROUP BY ALL) GROUP BY no) n USING (no)"""
    return f"near{no} AS MATERIALIZED ({nearest}), c{no + 1} AS MATERIALIZED ({moved})"


OP11 = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS no, x FROM (SELECT sha256('{SEED}:' || vec_id) AS h, x FROM kept ORDER BY h, x LIMIT {CENTROIDS})),
{", ".join(_round(k, "kept", f"c{k}") for k in range(ROUNDS + 1))}
SELECT vec_id, best[2]::INT AS cluster, best[1] AS distance, sum(best[1]) OVER (PARTITION BY best[2])::BIGINT AS cluster_inertia, sum(best[1]) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM near{ROUNDS} JOIN c{ROUNDS} c ON c.no = best[2]
"""

_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(ws[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM w)" for k in range(1, LONGEST + 1))

OP12 = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS ws FROM p),
g AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL HAVING k = 1 OR count(*) >= {OFTEN}),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE k > 1),
x AS (SELECT lang, phrase, f AS a, cut, array_to_string(ws[1:cut], ' ') AS first_, array_to_string(ws[cut + 1:k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT x.lang, x.phrase, a, cut, y.f AS l, z.f AS r, n, ((1000::HUGEINT * a * n) // (y.f::HUGEINT * z.f))::BIGINT AS score
  FROM x JOIN n USING (lang) JOIN g y ON y.lang = x.lang AND y.phrase = x.first_ JOIN g z ON z.lang = x.lang AND z.phrase = x.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, phrase, max(f) AS most FROM (
  SELECT lang, f, unnest(list_transform(range(1, k * k + 1), lambda j: CASE WHEN (j - 1) // k + (j - 1) % k + 1 <= k AND (j - 1) % k + 1 < k THEN array_to_string(ws[(j - 1) // k + 1:(j - 1) // k + (j - 1) % k + 1], ' ') END)) AS phrase FROM c) WHERE phrase IS NOT NULL GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, n, score
FROM b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE coalesce(100 * most < {INSIDE} * a, true) QUALIFY rank <= {FIRST}
"""

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT key FROM l WHERE length(key) >= {LEAST} GROUP BY key HAVING count(DISTINCT (doc_id,)) >= {DOCUMENTS})
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f USING (key) GROUP BY r
"""

ORACLES = {
    "op1_chat_format": OP1,
    "op2_decontaminate": OP2,
    "op3_jaccard_join": OP3,
    "op6_license_scan": OP6,
    "op7_url_filter": OP7,
    "op10_quality_rules": OP10,
    "quality_ablations": ABLATIONS,
    "op11_centroid_clustering": OP11,
    "op12_phrase_collocations": OP12,
    "op13_line_dedup": OP13,
}
