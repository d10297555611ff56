"""Text expressions: cleaning, quality measures, tokens, keys. All are Columns without Python in tasks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a search ignores, and words that say nothing about a claim.
SEARCH_STOP = ("and", "or", "not", "near", "a", "an", "the", "to", "of", "in", "for", "on", "is", "are", "as", "at", "be", "by", "was", "were")
CLAIM_STOP = ("the", "and", "that", "with", "this", "from", "have", "were", "which")
MAX_TOKENS = 24


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def key32(text: Column) -> Column:
    """The first 32 hexadecimal digits of a SHA-256 digest."""
    return F.substring(F.sha2(text, 256), 1, 32)


def chunk_key(paper: Column, path: Column, index: Column) -> Column:
    return key32(F.concat_ws("|", paper, path, index.cast("string")))


def content_hash(text: Column) -> Column:
    return key32(F.regexp_replace(strip(F.lower(text)), "\\s+", " "))


def fix_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, "([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])", "$1$2")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), lambda x: f(x))[0]  # not f itself, as a second argument of it would get the place


def drop_page_numbers(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike("^\\s*[0-9]{1,4}\\s*$")), "\n")


#: Headings that open a list of references.
REFERENCE_HEADINGS = "references|bibliography|works\\s+cited|参考文献|引用文献|文献目录"


def trim_references(text: Column, ending: str = "") -> Column:
    """What stands before the first line that is only a heading of references, and an ending; a text without one stays."""
    heading = f"(?is)(?:^|\\n)[^\\S\\n]*(?:#+[^\\S\\n]*)?(?:{REFERENCE_HEADINGS})[^\\S\\n]*(?:\\n.*)?$"
    return F.when(F.regexp_like(text, F.lit(heading)), F.concat(F.regexp_replace(F.regexp_replace(text, heading, ""), "\\s+$", ""), F.lit(ending))).otherwise(text)


def drop_repeated_lines(text: Column, repeats: int = 4) -> Column:
    """A text of at least 3 * repeats lines (a final line end begins none) without its lines of 8 to 80 characters that occur `repeats` times or more.

    Lines are sorted, so that equal ones are neighbours and the work is that of a sort.
    """

    def numbered(lines: Column) -> Column:
        return F.array_sort(F.transform(lines, lambda x, i: F.struct(F.regexp_replace(strip(x), "\\s+", " ").alias("norm"), i.alias("i"), x.alias("line"))))

    def kept(s: Column) -> Column:
        def alike(e: Column, i: Column) -> Column:
            first = [F.get(s, i - k)["norm"].eqNullSafe(e["norm"]) & F.get(s, i - k + repeats - 1)["norm"].eqNullSafe(e["norm"]) for k in range(repeats)]
            out = first[0]
            for other in first[1:]:
                out = out | other
            return out

        rest = F.filter(s, lambda e, i: ~(F.length(e["norm"]).between(8, 80) & alike(e, i)))
        return F.array_join(F.transform(F.array_sort(F.transform(rest, lambda e: F.struct(e["i"], e["line"]))), lambda e: e["line"]), "\n")

    return bound(F.split(F.regexp_replace(text, "\n\\z", ""), "\n"), lambda lines: F.when(F.size(lines) < 3 * repeats, text).otherwise(bound(numbered(lines), kept)))


def squeeze_blank(text: Column) -> Column:
    return F.regexp_replace(text, "\\n{4,}", "\n\n\n")


def clean_markdown(text: Column, keep_references: bool = True) -> Column:
    """Hyphens joined, page numbers and repeated lines dropped, references cut if not kept, blank lines squeezed, one final newline.

    A blank text stays as it is; without anything left the result is empty.
    """
    body = bound(drop_page_numbers(fix_hyphens(text)), drop_repeated_lines)
    out = strip(squeeze_blank(body if keep_references else bound(body, trim_references)))
    return F.when(strip(text) == "", text).otherwise(bound(out, lambda x: F.when(x == "", x).otherwise(F.concat(x, F.lit("\n")))))


def garbled_ratio(text: Column) -> Column:
    odd = F.length(F.regexp_replace(text, "[^\\x00-\\x08\\uE000-\\uF8FF]", ""))
    return F.when(F.length(text) > 0, odd / F.length(text)).otherwise(F.lit(0.0))


def ocr_fragment_ratio(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    short = F.filter(lines, lambda x: (F.length(x) <= 2) & ~x.rlike("^[0-9]+$"))
    return F.when(F.size(lines) > 0, F.size(short) / F.size(lines)).otherwise(F.lit(0.0))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def chunk_score(text: Column, kind: Column) -> Column:
    n = F.length(text)
    score = (
        F.lit(0.55)
        + F.when(text.rlike("[。．.!?？]"), 0.15).otherwise(0.0)
        - F.when((kind == "references") & (n > 200), 0.25).otherwise(0.0)
        + F.when(kind.isin("theorem", "definition", "proof") & text.rlike("[$\\\\]"), 0.1).otherwise(0.0)
        - F.when(n > 8000, 0.1).otherwise(0.0)
    )
    return F.round(F.when(n < 40, 0.2).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))), 4)


#: Class of a chunk and the words that tell it, in order of precedence.
CHUNK_TYPES = (
    ("references", "references|bibliography|参考文献|引用文献|works cited"),
    ("abstract", "abstract|摘要"),
    ("introduction", "introduction|引言|前言"),
    ("conclusion", "conclusion|conclusions|结论"),
    ("method", "method|methods|methodology|方法"),
    ("experiment", "experiment|experiments|实验|数值"),
    ("discussion", "discussion|讨论"),
)
#: Words of mathematical blocks; the first one found tells the class.
MATH_WORDS = "definition|lemma|proposition|theorem|corollary|remark|proof|example"
EDGE = "[^\\p{L}\\p{N}_]"


def chunk_type(path: Column, text: Column) -> Column:
    head = F.lower(F.concat_ws(" ", path, F.substring(text, 1, 400)))
    word = F.regexp_extract(head, f"(?:^|{EDGE})({MATH_WORDS})(?:$|{EDGE})", 1)
    out = F.when(word == "", "unknown").when(word.isin("proof", "definition"), word).otherwise("theorem")
    for kind, told in reversed(CHUNK_TYPES):
        out = F.when(head.rlike(f"(^|{EDGE})({told})($|{EDGE})"), kind).otherwise(out)
    return out


def search_tokens(text: Column) -> Column:
    """At most 24 distinct tokens: ASCII words of two characters or more that are no stop words, then other runs."""
    ascii_ = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 2) & ~w.isin(*SEARCH_STOP))
    other = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[^\\x00-\\x7F\\s。，、；：？！（）]+"), F.lit(0)), lambda w: F.length(w) >= 2)
    return F.slice(F.array_distinct(F.concat(ascii_, F.transform(other, lambda w: F.substring(w, 1, 24)))), 1, MAX_TOKENS)


def _marked_letters() -> tuple[str, str]:
    """Lower-case letters of the Latin blocks that are an ASCII letter with marks, and those letters."""
    letters = [c for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if c == c.lower()]
    pairs = [(c, d[0]) for c in letters if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii() and d[0].isalpha() and all(map(unicodedata.combining, d[1:]))]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


MARKED, BARE = _marked_letters()


def folded(text: Column) -> Column:
    """A lower-case text whose Latin letters carry no diacritics."""
    return F.translate(text, MARKED, BARE)


def folded_sql(text: str) -> str:
    return f"translate({text}, '{MARKED}', '{BARE}')"


def index_tokens(text: Column) -> Column:
    """All words of a text in order, lower case without diacritics; a run of letters and digits is one word."""
    return F.regexp_extract_all(folded(F.lower(text)), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def citation_refs(text: Column) -> Column:
    """All reference numbers of a text, of up to 18 digits."""
    return F.transform(F.regexp_extract_all(text, F.lit("\\[([0-9]{1,18})\\]"), F.lit(1)), lambda x: x.cast("bigint"))


def claim_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)), lambda w: (F.length(w) >= 2) & ~w.isin(*CLAIM_STOP)))


def keyword_overlap(claim: Column, evidence: Column) -> Column:
    """Share of the distinct claim words that occur in the evidence."""
    found = F.filter(claim_words(claim), lambda w: F.contains(F.lower(evidence), w))
    return F.when(F.size(claim_words(claim)) > 0, F.size(found) / F.size(claim_words(claim))).otherwise(F.lit(0.0))


def is_mostly_cjk(text: Column) -> Column:
    solid = F.length(F.regexp_replace(text, "\\s", ""))
    return (F.length(F.regexp_replace(text, "[^\\u4e00-\\u9fff]", "")) >= 0.25 * solid) & (solid > 0)


#: A closed fence of code in Markdown.
FENCE = "(?s)```.*?```"


def outside_fences(text: Column, rule) -> Column:
    """A text with a rule applied to each stretch between closed fences of code; the fences stay as they are."""
    fences = F.regexp_extract_all(text, F.lit(FENCE), F.lit(0))
    return F.array_join(F.transform(F.split(text, FENCE, -1), lambda part, i: F.concat(rule(part), F.coalesce(F.get(fences, i), F.lit("")))), "")


def normalize_math(text: Column) -> Column:
    r"""Outside of fences \[..\] becomes a display in dollar marks of its own, \(..\) stands in single ones, a full-width star is a plain one."""

    def rule(part: Column) -> Column:
        shown = F.regexp_replace(part, r"(?sU)\\\[\s*(.*?)\s*\\\]", "\n\n\\$\\$\n$1\n\\$\\$\n\n")
        return F.replace(F.regexp_replace(shown, r"(?sU)\\\(\s*(.*?)\s*\\\)", "\\$$1\\$"), F.lit("\uff0a"), F.lit("*"))

    return outside_fences(text, rule)


def page_hints(text: Column) -> tuple[Column, Column]:
    pages = F.transform(F.regexp_extract_all(F.lower(text), F.lit("page ([0-9]{1,5})"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_min(pages), F.array_max(pages)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for null, different lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def quality_score(length: Column, sections: Column, rich: Column, garbled: Column, fragments: Column, references: Column) -> Column:
    """Score of a parsed text from 0 to 1: length, structure, formulas and tables, less what looks broken."""
    base = 0.35 * F.least(F.lit(1.0), length / 12000) + 0.35 * F.least(F.lit(1.0), sections / 8) + 0.2 * F.least(F.lit(1.0), rich / 20) + 0.1
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - F.least(F.lit(0.5), garbled * 8 + fragments * 0.8)))
    return F.when(references, F.least(F.lit(1.0), score + 0.03)).otherwise(score)


def split_claims(text: Column) -> Column:
    """Sentences of an answer that say enough; a fragment of references alone joins the claim before it."""
    whole = strip(F.coalesce(text, F.lit("")))
    parts = F.filter(F.transform(F.split(whole, "(?<=[。！？.!?])\\s*"), strip), lambda s: s != "")
    has_ref = lambda s: s.rlike("\\[[0-9]+\\]")

    def step(claims: Column, s: Column) -> Column:
        joined = F.concat(F.slice(claims, 1, F.greatest(F.lit(0), F.size(claims) - 1)), F.array(F.concat_ws(" ", F.element_at(claims, -1), s)))
        drop = (F.length(s) < 8) | ((F.length(s) < 12) & ~has_ref(s)) | s.startswith("（注：") | s.startswith("(Note:")
        return F.when(s.rlike("^(\\[[0-9]+\\])+$") & (F.size(claims) > 0), joined).when(drop, claims).otherwise(F.concat(claims, F.array(s)))

    claims = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when((F.size(claims) == 0) & (F.length(whole) >= 12), F.array(whole)).otherwise(claims)


def strip_refs(text: Column, refs: Column) -> Column:
    """text without the reference marks of the given numbers."""
    return F.aggregate(refs, text, lambda t, r: F.replace(t, F.concat(F.lit("["), r.cast("string"), F.lit("]")), F.lit("")))


def repetition(text: Column) -> Column:
    """Whether a block of 80 characters or more at the end of a text stands three times in its last 1200.

    Each such block ends with the last 80 characters, so texts that don't repeat these need no search.
    """
    tail = F.substring(text, -1200, 1200)
    last = F.least(F.lit(400), F.floor(F.length(tail) / 3).cast("int")) - 1
    thrice = lambda p: (F.length(tail) - F.length(F.replace(tail, F.right(tail, p), F.lit("")))) / p >= 3
    return F.when((F.length(text) < 500) | (last < 80), False).when(~thrice(F.lit(80)), False).otherwise(F.exists(F.sequence(F.lit(80), F.greatest(last, F.lit(80))), thrice))


#: Field names of the two languages of a query.
CHINESE_KEYS = ("zh", "chinese", "query_zh", "zh_query", "中文")
ENGLISH_KEYS = ("en", "english", "query_en", "en_query", "英文")


def query_json(raw: Column, *names: str) -> Column:
    """The first field of these names in a lenient JSON text: fenced, embedded in prose, or only near JSON."""
    body = F.regexp_extract(raw, "(?s)(\\{.*\\})", 1)
    fields = [F.nullif(F.trim(F.get_json_object(body, f"$['{n}']")), F.lit("")) for n in names]
    loose = F.regexp_extract(raw, f"(?i)[\"']?(?:{'|'.join(names)})[\"']?\\s*[:=]\\s*[\"']([^\"']+)[\"']", 1)
    return F.coalesce(*fields, F.nullif(F.trim(loose), F.lit("")))


def page_range(start: Column, end: Column) -> Column:
    """Label of a page range; empty without pages."""
    one = F.coalesce(start, end)
    return F.when(one.isNull(), "").when(start != end, F.concat(F.lit("第 "), start, F.lit("–"), end, F.lit(" 页"))).otherwise(F.concat(F.lit("第 "), one, F.lit(" 页")))


def path_parts(raw: Column) -> Column:
    """Parts of a section path given as a JSON list, joined by slashes, or alone."""
    parts = F.when(F.trim(raw).startswith("["), F.from_json(raw, "array<string>")).otherwise(F.split(raw, " / "))
    return F.filter(F.transform(F.coalesce(parts, F.array(raw)), lambda x: F.trim(x)), lambda x: x != "")


def rebase_assets(text: Column, prefix: Column) -> Column:
    """Relative image links of Markdown and HTML get a prefix; absolute ones, anchors and rebased ones stay."""
    relative = "(?!https?:|data:|/|#|assets/)"
    text = F.regexp_replace(text, F.lit(f"(!\\[[^\\]]*\\]\\(){relative}"), F.concat(F.lit("$1"), prefix))
    return F.regexp_replace(text, F.lit(f"(?i)(<img[^>]*\\ssrc=[\"']){relative}"), F.concat(F.lit("$1"), prefix))


def review_query(topic: Column, focus: Column) -> Column:
    """The question that a review asks: its topic, and its focus if one is given."""
    return F.when(F.coalesce(focus, F.lit("")) == "", topic).otherwise(F.concat(topic, F.lit("。重点："), focus))


def task_kind(kind: Column, payload: Column) -> Column:
    """The kind of a task: its type, and for indexing what the first set flag of a JSON payload says.

    A missing or empty type is indexing. A flag is set unless it is missing, null, false, zero or empty.
    """
    kind = F.trim(F.coalesce(F.when(kind != "", kind), F.lit("index")))
    flag = lambda name: ~F.coalesce(F.get_json_object(payload, f"$.{name}"), F.lit("")).isin("", "false", "0", "0.0", "[]", "{}")
    return F.when(kind != "index", kind).when(flag("download_only"), "download").when(flag("parse_only"), "parse").when(flag("reindex_only"), "reindex").otherwise("index")


def storage_key(path: Column, root: str) -> Column:
    """The first folder of a path under a root; null outside it, for a file in the root itself, and for a hidden folder."""
    parts = F.filter(F.split(F.substr(path, F.lit(len(root) + 2)), "/"), lambda x: x != "")
    return F.when(path.startswith(root + "/") & (F.size(parts) >= 2) & ~F.get(parts, F.lit(0)).startswith("."), F.get(parts, F.lit(0)))


def quality_within(score: Column, least: float | None = None, most: float | None = None, missing: bool = False) -> Column:
    """Whether a score is within bounds, which hold for given scores only; `missing` asks for absent ones instead."""
    if missing:
        return score.isNull()
    return (F.lit(True) if least is None else F.coalesce(score >= least, F.lit(False))) & (F.lit(True) if most is None else F.coalesce(score <= most, F.lit(False)))


def within_scope(ids=(), tags=(), collections=(), year_from: int | None = None, year_to: int | None = None) -> Column:
    """Whether a paper (id, year, arrays `tags` and `collections`) is within a scope; what a scope leaves out restricts nothing."""
    any_of = lambda c, values: F.arrays_overlap(F.col(c), F.array(*map(F.lit, values)))
    parts = [F.col("id").isin(*ids)] if ids else []
    parts += [any_of(c, values) for c, values in (("tags", tags), ("collections", collections)) if values]
    parts += [F.col("year") >= year_from] if year_from is not None else []
    parts += [F.col("year") <= year_to] if year_to is not None else []
    out = F.lit(True)
    for part in parts:
        out = out & F.coalesce(part, F.lit(False))
    return out


def creator_name(first: Column, last: Column, single: Column) -> Column:
    """A creator as "last, first"; as one name if only one is given or the name is a single field."""
    first, last = F.trim(F.coalesce(first, F.lit(""))), F.trim(F.coalesce(last, F.lit("")))
    return F.when((last != "") & (first != "") & ~single, F.concat_ws(", ", last, first)).when(last != "", last).otherwise(first)


def title_guess(markdown: Column, stem: Column, title: Column) -> Column:
    """The heading on the first line of a text, else the name of its file; the old title where that is blank."""
    line = F.regexp_extract(F.coalesce(markdown, F.lit("")), "^([^\\r\\n]*)", 1)
    guess = F.when(line.startswith("# "), F.trim(F.substr(line, F.lit(3)))).otherwise(stem)
    return F.coalesce(F.nullif(guess, F.lit("")), title)


def year_in(*fields: Column) -> Column:
    """The first year from 1900 to 2099 that stands alone in the first field that has one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), "\\b((?:19|20)[0-9]{2})\\b", 1), F.lit("")) for c in fields]).cast("int")


def task_intent(payload: Column) -> Column:
    """What a task of indexing was asked for: its four flags, joined."""
    flag = lambda name: ~F.coalesce(F.get_json_object(payload, f"$.{name}"), F.lit("")).isin("", "false", "0", "0.0", "[]", "{}")
    return F.concat_ws(",", *[F.when(flag(n), n) for n in ("force", "reindex_only", "parse_only", "download_only")])


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from one time to a later one, both as ISO text; 0 if one is missing or no time, or if the end is earlier."""
    micros = lambda c: F.unix_micros(F.try_to_timestamp(c))
    return F.coalesce(F.greatest(F.lit(0.0), (micros(end) - micros(start)) / 1e6), F.lit(0.0))


def clear_translation(payload: Column) -> Column:
    """A JSON answer without its translation; null where there is none, as then nothing changes."""
    fields = F.from_json(payload, "map<string,string>")
    kept = F.map_filter(fields, lambda k, _: ~k.isin("cached", "answer_other", "answer_other_lang"))
    return F.when(F.coalesce(F.try_element_at(fields, F.lit("answer_other")), F.lit("")) != "", F.to_json(kept))


#: Fixed value: what a text says in whose first 500 characters nothing could be extracted.
EXTRACTION_FAILED = "提取失败"


def parse_outcome(text: Column, mode: Column, error: Column, code: Column, timeout: Column, file_error: Column) -> tuple[Column, Column]:
    """(status, message) of a parse: failed without 80 characters of text or with the mark of failure, else parsed with distinct warnings in order."""
    body, error = strip(F.coalesce(text, F.lit(""))), F.trim(F.coalesce(error, F.lit("")))
    failed = (F.length(body) < 80) | F.contains(F.substring(body, 1, 500), F.lit(EXTRACTION_FAILED))
    detail = F.coalesce(F.nullif(F.substring(error, 1, 500), F.lit("")), F.nullif(mode, F.lit("")))
    lost = F.when(mode == "invalid", F.coalesce(F.nullif(file_error, F.lit("")), detail, F.lit("invalid file"))).otherwise(F.concat(F.lit("no usable text"), F.coalesce(F.concat(F.lit(": "), detail), F.lit(""))))
    plain, back = F.coalesce(mode.startswith("plain"), F.lit(False)), F.coalesce(F.contains(mode, F.lit("fallback")), F.lit(False))
    warnings = F.array_distinct(F.array_compact(F.array(
        F.when(plain, "plain text only").when(back, F.concat(F.lit("incomplete: "), mode)), F.when((error != "") & ~back & ~plain, F.concat(F.lit("warning: "), F.substring(error, 1, 400))),
        F.when(code != 0, F.concat(F.lit("exit code "), code)), F.when(timeout, "timeout"),
    )))
    message = F.when(failed, F.substring(lost, 1, 2000)).when(F.size(warnings) > 0, F.concat(F.lit("notes: "), F.substring(F.array_join(warnings, "; "), 1, 2000)))
    return F.when(failed, "failed").otherwise("parsed"), message
