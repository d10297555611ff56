"""Phrases that stand together more often than their parts suggest, mined by stripes.

A stripe belongs to a prefix and holds a counter of its next words. Tasks make the stripes of their
share of the texts and send them packed, those of a group of prefixes in one row; stripes of one prefix
are merged elementwise, a group at a time. Everything is read off the merged
stripes: entries are extensions, the entry of a prefix's last word in the stripe of the words before
it is the prefix's total, and the largest entry by prefix and by the phrase without its first word
tells what a longer phrase subsumes. The stripe of the empty prefix has an entry (null) for all words that
are not frequent, so its sum is the number of words of a language.

Which phrases may be frequent is found before, one word longer each time: a phrase can be frequent only
if its first and its last words are, so only such phrases are counted, by 32 bits of a hash. The
frequent ones are told to the tasks as two bits each of a table of fixed size (BITS); bits set by chance
cost a row, never an answer. So words are shuffled for frequent phrases only. A prefix of many
occurrences has its stripe cut by the next word, so that a part stands for at most about a HOT-th of all
occurrences; there are at most HOT such prefixes of one length by arithmetic. The empty prefix is
cut into PARTS.

Words are told apart by their bytes; hashes serve the bits and the cut only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed, small, text_or_empty
from quillon.llm.shingles import mix

#: Occurrences of a candidate; words of a phrase; share (per hundred) of a longer phrase that subsumes; rows of a language.
OFTEN, LONGEST, INSIDE, FIRST = 100, 5, 100, 2000
#: Bits told to the tasks for each length, prefixes whose stripes are cut at most, and rows into which the empty prefix is cut.
BITS, HOT, PARTS = 1 << 24, 2000, 512
#: An odd factor below 2^31 that gives the second bit of a 32-bit hash.
SECOND = 1640531527
#: Bytes of text that a task counts together, entries and hashes that it holds before it sends them, and groups of hashes.
PIECE, HELD, HASHES, RANGES = 2 << 20, 1_000_000, 1_000_000, 1024
#: Groups of stripes of a language, and groups that a task sends in a batch.
GROUPS, SENT = 512, 64
UNKNOWN = "und"

U = np.uint64
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [*range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_strings, _numbers = pa.list_(pa.string()), pa.list_(pa.int32())
#: Stripes of a group in one row: prefix, part and size of each stripe, then the entries of one stripe after the other.
PACKED = pa.schema([("lang", pa.string()), ("group", pa.int32()), ("prefix", _strings), ("part", _numbers), ("size", _numbers), ("next", _strings), ("n", pa.list_(pa.int64()))])
MERGED = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("part", pa.int32()), ("total", pa.int64()), ("next", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))])


def _words(raw: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-cased bytes, and the number of the piece in which each stands."""
    kind = _KIND[raw]
    gap = np.concatenate(([True], kind > 0, [True]))
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = turn[::2], turn[1::2]
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(raw[kind == 0].tobytes()))
    return words, np.cumsum(kind == 2)[start] if len(start) else np.zeros(0, np.int64)


def _hashed(words: list[str], seed: int) -> np.ndarray:
    """A 64-bit hash of each word, by its bytes from the left, eight at a time over all words."""
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    size = np.array([len(x) for x in data], np.int64)
    h = mix(size.astype(U) + U(seed))
    order = np.argsort(size, kind="stable")
    ordered, at = [data[i] for i in order], 0
    longest = int(size.max()) if len(size) else 0
    sizes = size[order]
    while at < longest:
        first = int(np.searchsorted(sizes, at, side="right"))
        block = np.frombuffer(b"".join(x[at : at + 8].ljust(8, b"\0") for x in ordered[first:]), "<u8").astype(U)
        h[order[first:]] = mix(h[order[first:]] + block)
        at += 8
    return h


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """(language, bytes) of texts joined by a piece mark, about PIECE bytes of one language together."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            while data:
                cut = data
                if len(data) > PIECE:  # a long text is cut where a piece ends
                    to = next((k for k in range(PIECE, len(data)) if _KIND[data[k]] == 2), len(data))
                    cut = data[:to]
                data = data[len(cut) :]
                held.setdefault(lang, []).append(cut)
                size[lang] = size.get(lang, 0) + len(cut) + 1
                if size[lang] >= PIECE:
                    yield lang, _LOWER[np.frombuffer(b"\n".join(held.pop(lang)), np.uint8)]
                    size[lang] = 0
    for lang, parts in held.items():
        yield lang, _LOWER[np.frombuffer(b"\n".join(parts), np.uint8)]


def _dense(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of first occurrence of each distinct code, and the dense number of each code."""
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    return first, inverse.astype(np.int64)


class _Phrases:
    """The phrases of some text: `code` (numbers of words in `names`), and for each length hashes and where they stand.

    standing(k) tells, place by place, whether k words of one piece begin there; known(k) whether
    these may be a frequent phrase, its first and last words included.
    """

    def __init__(self, lang: str, raw: np.ndarray, bits: list[np.ndarray]):
        words, self.piece = _words(raw)
        coded = words.dictionary_encode()
        self.names, self.bits = coded.dictionary, bits
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.of_name = _hashed(self.names.to_pylist(), int(_hashed([lang], 7)[0] >> U(1)))
        self.hashes = [self.of_name[self.code]]
        self.marks: list[np.ndarray] = []

    def hashed(self, k: int) -> np.ndarray:
        while len(self.hashes) < k:
            before = self.hashes[-1]
            self.hashes.append(mix(before[:-1] + self.hashes[0][len(self.hashes) :]))
        return self.hashes[k - 1]

    def standing(self, k: int) -> np.ndarray:
        here = self.piece[: max(0, len(self.code) - k + 1)] == self.piece[k - 1 :]
        return here & self.known(k - 1)[:-1] & self.known(k - 1)[1:] if k > 1 else here

    def known(self, k: int) -> np.ndarray:
        while len(self.marks) < k:
            n = len(self.marks) + 1
            bucket, mark = _bucket(self.hashed(n)), self.standing(n)
            for at in (bucket & U(BITS - 1), ((bucket * U(SECOND)) >> U(17)) & U(BITS - 1)):
                mark &= (self.bits[n - 1][at >> U(6)] >> (at & U(63))) & U(1) == 1
            self.marks.append(mark)
        return self.marks[k - 1]


def _bucket(h: np.ndarray) -> np.ndarray:
    return h >> U(32)


def _summed(value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the sum of n of each."""
    order = np.argsort(value, kind="stable")
    value, n = value[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, np.int64)
    return value[first], np.add.reduceat(n, first) if len(first) else n


def _hash_counts(k: int, bits: list[bytes]):
    """The task's function: texts (lang, text) to (range, bucket, n) of the phrases of k words that may be frequent."""

    def sent(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        value, n = _summed(np.concatenate([v for v, _ in held]), np.concatenate([c for _, c in held]))
        wide = np.int64((1 << 32) // RANGES)
        group = (value // wide).astype(np.int32)
        first = np.flatnonzero(np.diff(group, prepend=-1))
        cuts = pa.array(np.append(first, len(value)).astype(np.int32))
        lists = [pa.array(group[first]), pa.ListArray.from_arrays(cuts, pa.array((value % wide).astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(n.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays(lists, names=["range", "place", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, size = [np.frombuffer(b, U) for b in bits], [], 0
        for lang, raw in _chunks(batches):
            text = _Phrases(lang, raw, tables)
            if len(text.code) < k:
                continue
            value, n = np.unique(_bucket(text.hashed(k)[text.standing(k)]).astype(np.int64), return_counts=True)
            held.append((value, n.astype(np.int64)))
            size += len(value)
            if size > HASHES:
                held = [_summed(np.concatenate([v for v, _ in held]), np.concatenate([c for _, c in held]))]
                size = len(held[0][0])
                if size > HASHES // 2:
                    yield from sent(held)
                    held, size = [], 0
        if size:
            yield from sent(held)

    return run


def _told(texts: DataFrame, k: int, often: int, bits: list[bytes]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bits of the phrases of k words that may be frequent, and (bucket, parts) of those whose stripes are to be cut.

    The driver gets at most BITS / 64 numbers and at most HOT buckets, since so many can hold a HOT-th of all occurrences.
    """
    made = texts.mapInArrow(_hash_counts(k, bits), "range int, place array<int>, n array<int>").repartition("range")
    each = made.select("range", F.explode(F.arrays_zip("place", "n")).alias("e")).select("range", "e.place", "e.n")
    bucket = F.col("range").cast("bigint") * ((1 << 32) // RANGES) + F.col("place")
    found = checkpointed(each.groupBy("range", "place").agg(F.sum("n").alias("n")).filter(F.col("n") >= often).select(bucket.alias("bucket"), "n"))
    both = found.select(F.expr(f"explode(array(bucket & {BITS - 1}, shiftright(bucket * {SECOND}L, 17) & {BITS - 1}))").alias("at"))
    rows = both.groupBy(F.expr("shiftright(at, 6)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("b")).toArrow()
    out = np.zeros(max(1, BITS // 64), np.int64)
    out[rows.column("at").to_numpy()] = rows.column("b").to_numpy()
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [(r["bucket"], -(-r["n"] * HOT // total)) for r in found.filter(F.col("n") > total // HOT).collect()]
    return out.tobytes(), sorted(hot)


def _distinct(columns: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of word numbers (from -1 to size - 1), and the sum of n of each."""
    code = np.zeros(len(columns), np.int64)
    for column in columns.T:
        code = _dense(code * (size + 1) + column + 1)[1]
    first, inverse = _dense(code)
    return columns[first], np.bincount(inverse, n).astype(np.int64)


class _Counters:
    """What a task has counted of one language: phrases of frequent words as numbers of its own vocabulary."""

    def __init__(self, longest: int):
        self.words: dict[str, int] = {}
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(longest)]

    def add(self, text: _Phrases) -> int:
        """Counts some text; the number of entries added."""
        known = text.known(1)
        used = np.unique(text.code[known])
        own = np.full(len(text.names) + 1, -1, np.int32)
        own[used] = [self.words.setdefault(w, len(self.words)) for w in text.names.take(pa.array(used)).to_pylist()]
        added = 0
        for k, held in enumerate(self.held, 1):
            if len(text.code) < k:
                break
            at = np.arange(len(text.code)) if k == 1 else np.flatnonzero(text.known(k))
            columns = own[text.code[at[:, None] + np.arange(k)]]
            held.append(_distinct(columns, np.ones(len(at)), len(self.words)))
            added += len(held[-1][1])
        return added

    def merge(self) -> int:
        for k, held in enumerate(self.held):
            if held:
                self.held[k] = [_distinct(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]), len(self.words))]
        return sum(len(n) for held in self.held for _, n in held)

    def striped(self, lang: str, hot: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The stripes of all that is held, packed by group."""
        self.merge()
        names = pa.array([*self.words], pa.string())
        made: list[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        of_name = _hashed([*self.words], int(_hashed([lang], 7)[0] >> U(1)))
        for k, held in enumerate(self.held, 1):
            for columns, n in held:
                if not len(n):
                    continue
                prefix, h = np.zeros(len(n), np.int64), None
                for column in columns.T[:-1]:
                    prefix = _dense(prefix * len(names) + column)[1]
                    h = of_name[column] if h is None else mix(h + of_name[column])
                last = columns[:, -1]
                cut = np.full(len(n), PARTS, np.int64)
                if h is not None:
                    bucket, (cuts, parts) = _bucket(h).astype(np.int64), hot[k - 2].T
                    at = np.minimum(np.searchsorted(cuts, bucket), max(0, len(cuts) - 1))
                    cut = np.where(cuts[at] == bucket, parts[at], 1) if len(cuts) else np.ones(len(n), np.int64)
                of_last = of_name[last] if len(names) else np.zeros(len(n), U)
                part = np.where(cut == 1, -1, np.where(last >= 0, (of_last % cut.astype(U)).astype(np.int64), 0))
                order = np.lexsort((part, prefix))
                first = np.flatnonzero((np.diff(prefix[order], prepend=-1) != 0) | (np.diff(part[order], prepend=-2) != 0))
                shown = pa.array([""] * len(first)) if k == 1 else names.take(pa.array(columns[order[first], 0]))
                for j in range(1, k - 1):
                    shown = pc.binary_join_element_wise(shown, names.take(pa.array(columns[order[first], j])), " ")
                own, at = part[order[first]], np.zeros(len(first), U) if h is None else h[order[first]]
                group = (mix(at + (own + 2).astype(U)) % U(GROUPS)).astype(np.int64)
                made.append((shown, names.take(pa.array(last[order], mask=last[order] < 0)), own, np.diff(np.append(first, len(n))), group, n[order]))
        if made:
            prefixes, following = (pa.concat_arrays([m[i] for m in made]) for i in (0, 1))
            own, size, group, n = (np.concatenate([m[i] for m in made]) for i in (2, 3, 4, 5))
            order, start = np.argsort(group, kind="stable"), np.cumsum(size) - size
            sizes, group = size[order], group[order]
            ends = np.append(0, np.cumsum(sizes))
            entry = np.repeat(start[order] - ends[:-1], sizes) + np.arange(len(n))
            first = np.flatnonzero(np.diff(group, prepend=-1))
            stripe = np.append(first, len(group))
            listed = lambda cuts, values: pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values)
            lists = [listed(stripe, prefixes.take(pa.array(order)))] + [listed(stripe, pa.array(x.astype(np.int32))) for x in (own[order], sizes)]
            lists += [listed(ends[stripe], following.take(pa.array(entry))), listed(ends[stripe], pa.array(n[entry]))]
            yield from pa.Table.from_arrays([pa.array([lang] * len(first), pa.string()), pa.array(group[first].astype(np.int32)), *lists], schema=PACKED).to_batches(max_chunksize=SENT)


def _entries(batch: pa.RecordBatch) -> pa.Table:
    """The entries of packed stripes as rows."""
    stripes = pc.list_value_length(batch["prefix"]).to_numpy(zero_copy_only=False)
    size = batch["size"].flatten().to_numpy(zero_copy_only=False)
    stripe = pa.array(np.repeat(np.arange(len(size)), size))
    row = pa.array(np.repeat(np.repeat(np.arange(batch.num_rows), stripes), size))
    named = {c: batch[c].take(row) for c in ("lang", "group")} | {c: batch[c].flatten().take(stripe) for c in ("prefix", "part")}
    return pa.table(named | {c: batch[c].flatten() for c in ("next", "n")})


def _added(entries: pa.Table) -> pa.Table:
    """Entries of equal stripes and words as one."""
    keys = ["lang", "group", "prefix", "part", "next"]
    return entries.group_by(keys).aggregate([("n", "sum")]).select([*keys, "n_sum"]).rename_columns([*keys, "n"])


def _merged(often: int):
    """The task's function: packed stripes, sorted by language and group, to merged stripes; a group and a batch are held at once."""

    def whole(entries: pa.Table) -> Iterator[pa.RecordBatch]:
        entries = _added(entries).sort_by([(c, "ascending") for c in ("lang", "prefix", "part")]).combine_chunks()
        if not entries.num_rows:
            return
        new = np.zeros(entries.num_rows - 1, bool)
        for c in ("lang", "prefix", "part"):
            new |= pc.not_equal(entries[c][1:], entries[c][:-1]).to_numpy(zero_copy_only=False) if len(new) else new
        first = np.append(0, np.flatnonzero(new) + 1)
        n = entries["n"].to_numpy()
        frequent = (n >= often) & entries["next"].is_valid().to_numpy()
        ends = np.append(0, np.cumsum(np.add.reduceat(frequent.astype(np.int64), first)))
        kept = entries.filter(pa.array(frequent)).combine_chunks()
        pairs = pa.StructArray.from_arrays([kept[c].combine_chunks() if kept.num_rows else pa.array([], kept[c].type) for c in ("next", "n")], names=["word", "n"])
        stripes = [entries[c].take(pa.array(first)) for c in ("lang", "prefix", "part")]
        out = pa.Table.from_arrays([*stripes, pa.array(np.add.reduceat(n, first)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs)], schema=MERGED)
        yield from out.filter(pc.or_(pc.equal(out["prefix"], ""), pc.greater(pc.list_value_length(out["next"]), 0))).to_batches(max_chunksize=20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            entries = _entries(batch)
            held = entries if held is None else pa.concat_tables([held, entries])
            open_ = pc.and_(pc.equal(held["lang"], batch["lang"][-1]), pc.equal(held["group"], batch["group"][-1]))
            yield from whole(held.filter(pc.invert(open_)))
            held = _added(held.filter(open_))
        if held is not None:
            yield from whole(held)

    return run


def _stripes(longest: int, bits: list[bytes], hot: list[list[tuple[int, int]]]):
    """The task's function: texts (lang, text) to packed stripes of prefixes of less than `longest` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, marked = [np.frombuffer(b, U) for b in bits], [np.array(x, np.int64).reshape(-1, 2) for x in hot]
        counters: dict[str, _Counters] = {}
        rows = least = 0
        for lang, raw in _chunks(batches):
            rows += counters.setdefault(lang, _Counters(longest)).add(_Phrases(lang, raw, tables))
            if rows - least > HELD:
                least = rows = sum(c.merge() for c in counters.values())
            if rows > 2 * HELD:
                for own, c in counters.items():
                    yield from c.striped(own, marked)
                counters, rows, least = {}, 0, 0
        for own, c in counters.items():
            yield from c.striped(own, marked)

    return run


def stripes(texts: DataFrame, longest: int, often: int) -> DataFrame:
    """(lang, prefix, part, total, next): merged stripes of the prefixes of less than `longest` words of texts (lang, text).

    `next` holds (word, n) of the words that follow at least `often` times; total is the sum of all
    entries, which for the empty prefix is the number of words; part is -1 where a stripe is not cut. A task sends at most a
    row for each group of each language, so rows grow with the tasks, and has no more entries than phrases whose hashes it counted.
    """
    bits: list[bytes] = []
    hot: list[list[tuple[int, int]]] = []
    for k in range(1, longest + 1):
        table, cut = _told(texts, k, often, bits)
        bits.append(table)
        hot.append(cut)
    made = texts.mapInArrow(_stripes(longest, bits, hot), "lang string, group int, prefix array<string>, part array<int>, size array<int>, next array<string>, n array<bigint>")
    sent = made.repartition("lang", "group").sortWithinPartitions("lang", "group")
    return sent.mapInArrow(_merged(often), "lang string, prefix string, part int, total bigint, next array<struct<word:string,n:bigint>>")


def mined(docs: DataFrame, often: int = OFTEN, longest: int = LONGEST, inside: int = INSIDE, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language of docs (lang, text).

    Texts are lower-cased (A-Z) and split at [.,;:!?\\x0A-\\x0D] into pieces and at blanks and tabs into words.
    A phrase of 2 to `longest` words that occurs a >= `often` times is a candidate; cut after k words
    into parts of l and r occurrences it scores floor(1000 * a * n / (l * r)), n being all words of
    the language, and its lowest cut counts, of equals the shortest first part. It is dropped if a
    longer candidate holds it and has `inside` hundredths of its occurrences. By rank: score, a (both falling), phrase.
    Null languages count as `und`, null and empty texts have no words, repeated rows count each time,
    other columns are ignored, an empty table gives no rows.
    """
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), text_or_empty("text").alias("text"))
    merged = checkpointed(stripes(texts, longest, often))
    totals = checkpointed(merged.filter("prefix = ''").groupBy("lang").agg(F.sum("total").alias("n")))
    longer = merged.filter("prefix <> ''")
    candidates = checkpointed(longer.select("lang", "prefix", F.explode("next").alias("e")).select("lang", F.concat("prefix", F.lit(" "), "e.word").alias("phrase"), F.col("e.n").alias("a")))
    alone = merged.filter("prefix = ''").select("lang", F.explode("next").alias("e")).select("lang", F.col("e.word").alias("phrase"), F.col("e.n").alias("f"))
    counts = alone.unionByName(candidates.withColumnRenamed("a", "f"))

    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = candidates.withColumn("w", F.split("phrase", " ", -1)).withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.size("w") - F.col("cut")).alias("rest"))
    of = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(small(totals), "lang")
    wide = "decimal(38,0)"
    score = F.expr(f"(cast(1000 as {wide}) * cast(a as {wide}) * cast(n as {wide})) div (cast(l as {wide}) * cast(r as {wide}))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))

    ends = F.explode(F.array(F.regexp_extract("phrase", "(?s)^(.*) [^ ]*$", 1), F.regexp_extract("phrase", "(?s)^[^ ]* (.*)$", 1)))
    held = candidates.filter(F.size(F.split("phrase", " ", -1)) > 2).select("lang", "a", ends.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = scored.join(held, ["lang", "phrase"], "left").filter(F.coalesce(F.col("most").cast(wide) * 100 < F.col("a").cast(wide) * inside, F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score")
