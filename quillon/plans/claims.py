"""Answers and their citations: locks, claims, checks against the evidence, statuses."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.plans.base import registrar
from quillon.plans.corpus import ANSWERS, CLAIM_STOP, STRIPPED, answers
from quillon.sources import sinks
from quillon.sources.corpus import read

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

KEY = ["conv_id", "turn"]
LEAST_OVERLAP = 0.12
#: The answer where there is no evidence, by language.
NO_EVIDENCE = {
    "zh": "当前知识库中未检索到足够证据支持该结论。请尝试换一个问题，或先完成文献扫描与「建立索引」。",
    "en": "The knowledge base does not contain sufficient evidence to support an answer. Try rephrasing your question, or scan and index your library first.",
}

CONTEXTS = "contexts AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ref, md5(conv_id || ':' || turn) AS chunk_id, coalesce(text, '') AS evidence FROM conversations WHERE role = 'user')"
CLAIMS = rf"""parts AS (SELECT conv_id, turn, unnest(p) AS s, unnest(range(len(p))) AS i FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace({STRIPPED.replace('x,', 'answer,')}, '([。！？.!?])\s*', '\1' || chr(1), 'g'), chr(1)), lambda x: {STRIPPED}), lambda x: x <> '') AS p FROM a)),
marked AS (SELECT *, regexp_matches(s, '^(\[[0-9]+\])+$') AS bare, length(s) >= 8 AND (length(s) >= 12 OR regexp_matches(s, '\[[0-9]+\]')) AND NOT starts_with(s, '（注：') AND NOT starts_with(s, '(Note:') AS good FROM parts),
told AS (SELECT conv_id, turn, claim_no, string_agg(s, ' ' ORDER BY i) AS claim FROM (SELECT *, sum((good AND NOT bare)::INT) OVER (PARTITION BY conv_id, turn ORDER BY i) AS claim_no FROM marked WHERE good OR bare) WHERE claim_no > 0 GROUP BY ALL),
claims AS (SELECT conv_id, turn, claim_no::BIGINT AS claim_no, claim FROM told UNION ALL SELECT conv_id, turn, 1, {STRIPPED.replace('x,', 'answer,')} FROM a WHERE length({STRIPPED.replace('x,', 'answer,')}) >= 12 AND (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM told))"""


def contexts(spark, sf_dir) -> DataFrame:
    """(conv_id, ref, chunk_id, evidence): the user turns of a conversation, numbered from 1."""
    rows = read(spark, sf_dir, "conversations").filter("role = 'user'")
    ref = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    key = F.md5(F.concat_ws(":", "conv_id", "turn"))
    return rows.select("conv_id", ref.cast("bigint").alias("ref"), key.alias("chunk_id"), F.coalesce("text", F.lit("")).alias("evidence"))


def normalized_locks(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """(conv_id, turn, answer, invalid): locks on chunks become reference numbers; unknown locks go and are listed.

    Locks are told in any case; ids are compared as they stand, so one in other letters is unknown. The locks of an answer are looked up by a join, so the work follows the locks, not the evidence.
    """
    lock = "(?i)\\[CHUNK:([a-f0-9]{32})\\]"
    cut = rows.withColumns({"between": F.split("answer", lock), "ids": F.regexp_extract_all("answer", F.lit(lock), F.lit(1))})
    each = cut.select(*KEY, "between", F.posexplode_outer("ids").alias("i", "chunk_id"))
    met = each.join(evidence.select("conv_id", "chunk_id", "ref"), ["conv_id", "chunk_id"], "left")
    whole = met.groupBy(*KEY).agg(F.first("between").alias("between"), F.array_sort(F.collect_list(F.struct("i", "ref", "chunk_id"))).alias("found"))
    mark = lambda x: F.when(x["ref"].isNull(), "").otherwise(F.concat(F.lit("["), x["ref"], F.lit("]")))
    text = F.array_join(F.transform("between", lambda b, i: F.when(i == 0, b).otherwise(F.concat(mark(F.get("found", i - 1)), b))), "")
    invalid = F.transform(F.filter("found", lambda x: x["ref"].isNull() & x["chunk_id"].isNotNull()), lambda x: x["chunk_id"])
    return whole.select(*KEY, text.alias("answer"), F.array_join(invalid, ",").alias("invalid"))


def claims(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, claim_no, claim) of answers."""
    each = rows.select(*KEY, F.posexplode_outer(T.split_claims(F.col("answer"))).alias("i", "claim")).filter("claim is not null")
    return each.select(*KEY, (F.col("i") + 1).cast("bigint").alias("claim_no"), "claim")


def checked(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """(conv_id, turn, claim_no, ref, score, status): one row for the best reference of a claim, and one for each reference out of range.

    A claim of more than 60 characters without a reference is listed; one whose references share no word with it is not.
    """
    refs = found.withColumn("refs", T.citation_refs(F.col("claim")))
    bare = refs.filter((F.size("refs") == 0) & (F.length("claim") > 60)).select(*KEY, "claim_no", F.lit(None).cast("bigint").alias("ref"), F.lit(0.0).alias("score"), F.lit("unreferenced").alias("status"))
    each = refs.select(*KEY, "claim_no", "claim", F.posexplode_outer("refs").alias("i", "r")).filter("r is not null").withColumn("ref", F.col("r").cast("bigint"))
    met = each.join(evidence.select("conv_id", "ref", "evidence"), ["conv_id", "ref"], "left")
    wrong = met.filter("evidence is null").select(*KEY, "claim_no", "ref", F.lit(0.0).alias("score"), F.lit("invalid_ref").alias("status"))
    scored = met.filter("evidence is not null").withColumn("s", T.keyword_overlap(F.col("claim"), F.col("evidence"))).filter("s > 0")
    best = scored.groupBy(*KEY, "claim_no").agg(F.max_by(F.struct("ref", "s"), F.struct("s", -F.col("i"))).alias("b"))
    status = F.when(F.col("b.s") >= LEAST_OVERLAP, "verified").otherwise("insufficient")
    return best.select(*KEY, "claim_no", F.col("b.ref").alias("ref"), F.round("b.s", 4).alias("score"), status.alias("status")).unionByName(wrong).unionByName(bare)


#: What is told of an answer that was changed, by language; the first two with what was taken out.
NOTES = {
    "zh": ("\n\n（注：已移除无效证据锁定 {}。）", "\n\n（注：已移除无效引用编号 {}，有效证据编号为 1–{}。）", "\n\n（提示：上文部分论断未标注 [n] 引用，请结合下方证据片段核对。）"),
    "en": ("\n\n(Note: removed invalid CHUNK lock(s) {}.)", "\n\n(Note: removed invalid citation(s) {}; valid refs are 1–{}.)", "\n\n(Note: some statements above lack [n] citations; verify against the evidence list.)"),
}


def noted(lang, which: int, *values):
    """A note in the language of a row with values put in."""
    def filled(text: str):
        parts = text.split("{}")
        return F.concat(F.lit(parts[0]), *[c for v, t in zip(values, parts[1:]) for c in (v, F.lit(t))])

    return F.when(lang == "zh", filled(NOTES["zh"][which])).otherwise(filled(NOTES["en"][which]))


def cleaned(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Answers (conv_id, turn, answer, lang) with locks as references, without invalid references, and with notes of what went.

    (conv_id, turn, lang, n, answer, locks, valid, invalid); n is the number of pieces of evidence. Without any, the answer is the fixed one.
    """
    trimmed = lambda c: F.regexp_replace(c, "\\s+$", "")
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    count = evidence.groupBy("conv_id").agg(F.count("*").alias("n"))
    out = normalized_locks(rows.withColumn("answer", F.coalesce("answer", F.lit(""))), evidence).join(rows.select(*KEY, "lang"), KEY).join(count, "conv_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.withColumn("locks", F.filter(F.split("invalid", ","), lambda x: x != ""))
    quoted = listed(F.transform(F.slice("locks", 1, 5), lambda x: F.concat(F.lit("'"), x, F.lit("'"))))
    out = out.withColumn("answer", F.when(F.size("locks") > 0, F.concat(trimmed(F.col("answer")), noted(F.col("lang"), 0, quoted))).otherwise(F.col("answer")))
    out = out.withColumn("refs", F.array_sort(F.array_distinct(T.citation_refs(F.col("answer")))))
    inside = lambda x: (x >= 1) & (x <= F.col("n"))
    out = out.withColumns({"valid": F.filter("refs", inside), "invalid": F.filter("refs", lambda x: ~inside(x))})
    bare = T.strip_refs(F.col("answer"), F.col("invalid"))
    told = noted(F.col("lang"), 1, listed(F.col("invalid").cast("array<string>")), F.col("n").cast("string"))
    out = out.withColumn("answer", F.when(F.size("invalid") > 0, T.strip(F.concat(trimmed(bare), told))).otherwise(F.col("answer")))
    none = F.when(F.col("lang") == "en", NO_EVIDENCE["en"]).otherwise(NO_EVIDENCE["zh"])
    empty = F.col("n") == 0
    clear = lambda c, kind: F.when(~empty, F.col(c)).otherwise(F.array().cast(f"array<{kind}>")).alias(c)
    return out.select(*KEY, "lang", "n", F.when(empty, none).otherwise(F.col("answer")).alias("answer"), clear("locks", "string"), clear("valid", "bigint"), clear("invalid", "bigint"))


def verified(rows: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The job of checking answers (conv_id, turn, answer, lang): the answers with their totals, and one record for each checked claim.

    A long answer without a valid reference ends with a hint. An answer is ok if no lock, no reference and no
    claim was found wanting; one without evidence is not.
    """
    texts = sinks.kept(cleaned(rows, evidence))
    found = claims(texts.filter("n > 0").select(*KEY, "answer"))
    records = checked(found, evidence).join(found, [*KEY, "claim_no"]).join(evidence.select("conv_id", "ref", "chunk_id"), ["conv_id", "ref"], "left")
    records = sinks.kept(records.select(*KEY, "claim_no", "claim", "ref", "chunk_id", "score", "status"))
    of = lambda *names: F.count_if(F.col("status").isin(*names))
    totals = records.groupBy(*KEY).agg(of("verified").alias("n_verified"), of("insufficient", "unreferenced").alias("n_insufficient"), of("invalid_ref").alias("n_invalid"))
    totals = found.groupBy(*KEY).agg(F.count("*").alias("n_claims")).join(totals, KEY, "left")
    out = texts.join(totals, KEY, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_claims", "n_verified", "n_insufficient", "n_invalid")})
    hint = (F.col("n") > 0) & (F.size("valid") == 0) & (F.length(T.strip(F.col("answer"))) > 80)
    text = F.when(hint, F.concat(F.regexp_replace("answer", "\\s+$", ""), noted(F.col("lang"), 2))).otherwise(F.col("answer"))
    ok = (F.col("n") > 0) & (F.size("invalid") == 0) & (F.size("locks") == 0) & (F.col("n_insufficient") == 0)
    return out.withColumns({"answer": text, "ok": ok}), records


def record_citations(records: DataFrame, path: str) -> None:
    """Adds records to the citations at path under the id of their answer; those that are there already are not added again."""
    same = Window.partitionBy(*KEY, "claim_no", "ref", "status").orderBy("score")
    rows = records.withColumn("no", F.row_number().over(same)).withColumn("answer_id", F.md5(F.concat_ws(":", *KEY)))
    key = F.sha2(F.concat_ws(":", "answer_id", "claim_no", F.coalesce(F.col("ref").cast("string"), F.lit("")), "status", "no"), 256)
    sinks.append_new(rows.select(key.alias("id"), "answer_id", "claim_no", "claim", "ref", "chunk_id", "score", "status"), path, "id", "answer_id")


@query(rf"WITH {ANSWERS}, {CLAIMS} SELECT conv_id, turn, claim_no, claim FROM claims")
def split_claims(spark, sf_dir):
    return claims(answers(spark, sf_dir).filter("answer is not null"))


CHECKED = rf"""{CLAIMS}, {CONTEXTS}, refs AS (SELECT *, regexp_extract_all(claim, '\[([0-9]{{1,18}})\]', 1) AS r FROM claims),
each AS (SELECT conv_id, turn, claim_no, claim, unnest(r)::BIGINT AS ref, unnest(range(len(r))) AS i FROM refs),
met AS (SELECT e.*, c.evidence, list_distinct(list_filter(regexp_extract_all(lower(claim), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2 AND w NOT IN ({CLAIM_STOP}))) AS w FROM each e LEFT JOIN contexts c USING (conv_id, ref)),
scored AS (SELECT *, len(list_filter(w, lambda x: contains(lower(evidence), x))) / len(w) AS s FROM met WHERE evidence IS NOT NULL AND len(w) > 0),
checked AS (SELECT conv_id, turn, claim_no, ref, round(s, 4) AS score, CASE WHEN s >= 0.12 THEN 'verified' ELSE 'insufficient' END AS status FROM scored WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, turn, claim_no ORDER BY s DESC, i) = 1
  UNION ALL SELECT conv_id, turn, claim_no, ref, 0, 'invalid_ref' FROM met WHERE evidence IS NULL UNION ALL SELECT conv_id, turn, claim_no, NULL, 0, 'unreferenced' FROM refs WHERE len(r) = 0 AND length(claim) > 60)"""


@query(f"WITH {ANSWERS}, {CHECKED} SELECT * FROM checked")
def verify_answers(spark, sf_dir):
    """Locks, claims and references of all answers against the evidence of their conversations."""
    return checked(split_claims(spark, sf_dir), contexts(spark, sf_dir))


@query(f"""WITH {ANSWERS}, {CHECKED} SELECT c.conv_id, a.turn, c.ref, CASE WHEN bool_or(status = 'verified') THEN 'verified' WHEN count(status) > 0 THEN 'insufficient' ELSE 'unused' END AS verification
FROM a JOIN contexts c USING (conv_id) LEFT JOIN checked k ON k.conv_id = c.conv_id AND k.turn = a.turn AND k.ref = c.ref WHERE a.answer IS NOT NULL GROUP BY ALL""")
def citation_status_merge(spark, sf_dir):
    """The status of each piece of evidence for each answer; what no claim uses is unused."""
    offered = answers(spark, sf_dir).filter("answer is not null").select(*KEY).join(contexts(spark, sf_dir).select("conv_id", "ref"), "conv_id")
    used = verify_answers(spark, sf_dir).select(*KEY, "ref", "status")
    verified = F.max(F.when(F.col("status") == "verified", 2).when(F.col("status").isNotNull(), 1).otherwise(0))
    return offered.join(used, [*KEY, "ref"], "left").groupBy(*KEY, "ref").agg(verified.alias("v")).select(*KEY, "ref", F.when(F.col("v") == 2, "verified").when(F.col("v") == 1, "insufficient").otherwise("unused").alias("verification"))


@query(f"""WITH {CONTEXTS}, t AS (SELECT conv_id, turn, text, md5(conv_id || ':' || (turn - 1)) AS one, md5('x' || conv_id) AS two FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)
SELECT t.conv_id, turn, CASE WHEN turn % 4 = 1 THEN text || '  AND ' ELSE text || ' ' || coalesce('[' || ref || ']', '') || ' and ' END AS answer,
  CASE WHEN turn % 4 = 1 THEN upper(one || ',' || two) ELSE concat_ws(',', CASE WHEN ref IS NULL THEN one END, two) END AS invalid FROM t LEFT JOIN contexts c ON c.conv_id = t.conv_id AND c.chunk_id = one""")
def normalize_locks(spark, sf_dir):
    """Answers with a lock on a turn, if there is one, and one on nothing; some have their locks in capitals."""
    lock = lambda *key: F.concat(F.lit("[CHUNK:"), F.md5(F.concat(*key)), F.lit("]"))
    rows = read(spark, sf_dir, "conversations").filter("role = 'assistant' and text is not null")
    locked = F.concat("text", F.lit(" "), lock(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - 1).cast("string")), F.lit(" and "), lock(F.lit("x"), F.col("conv_id").cast("string")))
    raised = F.when(F.col("turn") % 4 == 1, F.regexp_replace(F.upper(F.substring_index(locked, "[CHUNK:", -2)), "^", "[CHUNK:"))
    mixed = F.concat("text", F.lit(" "), raised)
    return normalized_locks(rows.select(*KEY, F.coalesce(mixed, locked).alias("answer")), contexts(spark, sf_dir))


@query(rf"""WITH {ANSWERS}, {CONTEXTS}, n AS (SELECT conv_id, count(*) AS n FROM contexts GROUP BY 1), r AS (SELECT conv_id, turn, answer, coalesce(n, 0) AS n, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\[([0-9]{{1,18}})\]', 1), lambda x: x::BIGINT))) AS refs FROM a LEFT JOIN n USING (conv_id) WHERE answer IS NOT NULL),
b AS (SELECT *, list_filter(refs, lambda x: x < 1 OR x > n) AS bad FROM r) SELECT conv_id, turn, array_to_string(list_filter(refs, lambda x: x >= 1 AND x <= n), ',') AS valid, array_to_string(bad, ',') AS invalid,
list_reduce(list_prepend(answer, list_transform(bad, lambda x: '[' || x || ']')), lambda t, m: replace(t, m, '')) AS answer FROM b""")
def strip_invalid_refs(spark, sf_dir):
    """References outside the evidence are taken out of an answer and listed."""
    count = contexts(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n"))
    rows = answers(spark, sf_dir).filter("answer is not null").join(count, "conv_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "refs": F.array_sort(F.array_distinct(T.citation_refs(F.col("answer"))))})
    rows = rows.withColumn("bad", F.filter("refs", lambda x: (x < 1) | (x > F.col("n"))))
    good = F.array_except("refs", "bad")
    return rows.select(*KEY, F.array_join(good.cast("array<string>"), ",").alias("valid"), F.array_join(F.col("bad").cast("array<string>"), ",").alias("invalid"), T.strip_refs(F.col("answer"), F.col("bad")).alias("answer"))


@query(f"SELECT conv_id, CASE WHEN count(*) FILTER (WHERE role = 'user' AND length(text) >= 200) > 0 THEN NULL WHEN conv_id % 2 = 0 THEN '{NO_EVIDENCE['en']}' ELSE '{NO_EVIDENCE['zh']}' END AS answer FROM conversations GROUP BY 1")
def no_evidence_answer(spark, sf_dir):
    """A fixed answer for questions without evidence (here: a user turn of 200 characters or more)."""
    has = F.count_if((F.col("role") == "user") & (F.length("text") >= 200))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(has.alias("n"))
    return rows.select("conv_id", F.when(F.col("n") > 0, None).when(F.col("conv_id") % 2 == 0, NO_EVIDENCE["en"]).otherwise(NO_EVIDENCE["zh"]).alias("answer"))


def locked_answers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Answers with two references and, by conversation, a lock on a turn, one on nothing or none; a tenth of the conversations has no evidence."""
    k = F.col("conv_id")
    lock = lambda *key: F.concat(F.lit(" [CHUNK:"), F.md5(F.concat(*key)), F.lit("]"))
    mark = F.when(k % 3 == 0, lock(k.cast("string"), F.lit(":"), (F.col("turn") - 1).cast("string"))).when(k % 3 == 1, lock(F.lit("x"), k.cast("string"))).otherwise("")
    rows = answers(spark, sf_dir).filter("answer is not null").withColumns({"answer": F.concat("answer", mark), "lang": F.when(k % 2 == 0, "en").otherwise("zh")})
    return rows, contexts(spark, sf_dir).filter("conv_id % 10 <> 9")


def _note_sql(which: int, *values: str) -> str:
    fill = lambda text: "'" + text.replace("{}", "' || {} || '").format(*values) + "'"
    return f"CASE WHEN lang = 'zh' THEN {fill(NOTES['zh'][which])} ELSE {fill(NOTES['en'][which])} END"


_LOCK, _WRONG = "'[''' || bad || ''']'", "'[' || array_to_string(wrong, ', ') || ']'"
WHOLE = rf"""WITH {CONTEXTS.replace("role = 'user'", "role = 'user' AND conv_id % 10 <> 9")}, n AS (SELECT conv_id, count(*) AS n FROM contexts GROUP BY 1),
raw AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'en' ELSE 'zh' END AS lang, text || ' [' || (turn % 3 + 1) || '] and [' || (conv_id % 7) || ']' AS t,
  CASE conv_id % 3 WHEN 0 THEN md5(conv_id || ':' || (turn - 1)) WHEN 1 THEN md5('x' || conv_id) END AS lock FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
l1 AS (SELECT r.conv_id, turn, lang, coalesce(n, 0) AS n, t || CASE WHEN lock IS NULL THEN '' WHEN ref IS NULL THEN ' ' ELSE ' [' || ref || ']' END AS t, CASE WHEN lock IS NOT NULL AND ref IS NULL THEN lock END AS bad
  FROM raw r LEFT JOIN n ON n.conv_id = r.conv_id LEFT JOIN contexts c ON c.conv_id = r.conv_id AND c.chunk_id = r.lock),
l2 AS (SELECT *, CASE WHEN bad IS NULL THEN t ELSE regexp_replace(t, '\s+$', '') || {_note_sql(0, _LOCK)} END AS u FROM l1),
l3 AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(u, '\[([0-9]{{1,18}})\]', 1), lambda x: x::BIGINT))) AS refs FROM l2),
l4 AS (SELECT *, list_filter(refs, lambda x: x >= 1 AND x <= n) AS valid, list_filter(refs, lambda x: x < 1 OR x > n) AS wrong FROM l3),
l5 AS (SELECT *, CASE WHEN n = 0 THEN CASE WHEN lang = 'en' THEN '{NO_EVIDENCE['en']}' ELSE '{NO_EVIDENCE['zh']}' END WHEN len(wrong) = 0 THEN u ELSE regexp_replace(regexp_replace(list_reduce(list_prepend(u, list_transform(wrong, lambda x: '[' || x || ']')), lambda t, m: replace(t, m, '')), '\s+$', '')
  || {_note_sql(1, _WRONG, "n")}, '^\s+|\s+$', '', 'g') END AS answer FROM l4), a AS (SELECT conv_id, turn, answer FROM l5 WHERE n > 0),
{CHECKED.replace(f"{CONTEXTS}, ", "")}"""


@query(WHOLE + rf""", k AS (SELECT conv_id, turn, count(*) FILTER (WHERE status = 'verified') AS v, count(*) FILTER (WHERE status IN ('insufficient', 'unreferenced')) AS i, count(*) FILTER (WHERE status = 'invalid_ref') AS x FROM checked GROUP BY ALL), c AS (SELECT conv_id, turn, count(*) AS m FROM claims GROUP BY ALL)
SELECT l.conv_id, l.turn, CASE WHEN n > 0 AND len(valid) = 0 AND length(regexp_replace(answer, '^\s+|\s+$', '', 'g')) > 80 THEN regexp_replace(answer, '\s+$', '') || {_note_sql(2)} ELSE answer END AS answer, n > 0 AND len(wrong) = 0 AND bad IS NULL AND coalesce(i, 0) = 0 AS ok,
  CASE WHEN n = 0 THEN '' ELSE array_to_string(valid, ',') END AS valid, CASE WHEN n = 0 THEN '' ELSE array_to_string(wrong, ',') END AS invalid, CASE WHEN n = 0 THEN '' ELSE coalesce(bad, '') END AS locks, coalesce(m, 0) AS n_claims, coalesce(v, 0) AS n_verified, coalesce(i, 0) AS n_insufficient, coalesce(x, 0) AS n_invalid
FROM l5 l LEFT JOIN k ON k.conv_id = l.conv_id AND k.turn = l.turn LEFT JOIN c ON c.conv_id = l.conv_id AND c.turn = l.turn""")
def answer_checks(spark, sf_dir):
    """Answers as they are shown after the whole check, with their totals."""
    rows = verified(*locked_answers(spark, sf_dir))[0]
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return rows.select(*KEY, "answer", "ok", joined("valid"), joined("invalid"), joined("locks"), "n_claims", "n_verified", "n_insufficient", "n_invalid")


@query(WHOLE + " SELECT md5(k.conv_id || ':' || k.turn) AS answer_id, k.claim_no, k.claim, k.ref, chunk_id, score, status FROM (SELECT x.*, claim FROM checked x JOIN claims USING (conv_id, turn, claim_no)) k LEFT JOIN contexts c ON c.conv_id = k.conv_id AND c.ref = k.ref WHERE k.turn % 4 <> 3")
def answer_citations(spark, sf_dir):
    """The recorded citations of some answers, read back after all were added twice."""
    rows, evidence = locked_answers(spark, sf_dir)
    records = verified(rows, evidence)[1]
    path = f"{sinks.shared_folder(spark)}/citations-{uuid.uuid4().hex}"
    record_citations(records, path)
    record_citations(records, path)
    asked = rows.filter("turn % 4 <> 3").select(F.md5(F.concat_ws(":", *KEY)).alias("answer_id"))
    return sinks.owned(path, asked).drop("id")
