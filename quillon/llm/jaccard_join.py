"""N-gram Jaccard join by PartEnum signatures.

Two texts link when their sets of word shingles have a Jaccard similarity of at least
`per_hundred` / 100. Sets are grouped in size bands, so that linked sets lie in one band or in
neighbouring ones. For sets of one instance (a band and the next) a link bounds the symmetric
difference by k. The feature domain is split into groups of three cells; with more than k / 2 + 1
groups, at least two groups hold one difference or none, and there two of the three cells agree.
So enumerating all pairs of cells of each group gives linked sets a common signature: no
link is lost, and what shares a signature is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed, packed, small, unpacked
from quillon.llm.components import components
from quillon.llm.shingles import U, mix, set_id, shingle_sets

CELLS = 3
#: Sets of a block: members of a hub met in one task, and half of what is compared at once as a dense matrix.
BLOCK = 256
#: Members of a hub that are joined with one copy of its parity bits.
SHARE = 4096
#: Columns of that matrix at once.
COLUMNS = 4096


def _bands(per_hundred: int, n: int) -> tuple[list[int], list[int]]:
    """Upper ends of the size bands up to size n, and k of the instance of each band and the next."""
    ends = [1]
    while ends[-1] < n:
        ends.append((ends[-1] + 1) * 100 // per_hundred)
    most = [(u + u * 100 // per_hundred) * (100 - per_hundred) // (100 + per_hundred) for u in ends]
    return ends, most


def signatures(sets: list[np.ndarray], per_hundred: int) -> list[np.ndarray]:
    """The PartEnum signatures of each set; equal sets need none."""
    out: list[list[np.ndarray]] = [[] for _ in sets]
    if not sets:
        return []
    ends, most = _bands(per_hundred, 1 << max(len(s) for s in sets).bit_length())
    for lower in (0, 1):
        todo = [(i, b, most[b]) for i, s in enumerate(sets) if len(s) and (b := int(np.searchsorted(ends, len(s))) - lower) >= 0 and most[b] > 0]
        if not todo:
            continue
        spare = np.array([int(k >= 2) for _, _, k in todo])
        groups = np.array([k // 2 + 1 for _, _, k in todo]) + spare
        first = np.concatenate(([0], np.cumsum(groups)))
        own = np.repeat(np.arange(len(todo)), [len(sets[i]) for i, _, _ in todo])
        h = np.concatenate([sets[i] for i, _, _ in todo])
        group = first[own] + ((h >> U(32)) % groups[own].astype(U)).astype(np.int64)
        cell = group * CELLS + ((h & U(0xFFFFFFFF)) % U(CELLS)).astype(np.int64)
        sums = np.zeros(first[-1] * CELLS, U)
        np.add.at(sums, cell, mix(h + U(0x9E3779B97F4A7C15)))
        held = np.bincount(cell, minlength=len(sums)).reshape(-1, CELLS)
        kept = held.sum(1)[:, None] - held  # elements under the signature that leaves a cell out
        sums = sums.reshape(-1, CELLS)
        of = np.repeat(np.arange(len(todo)), groups)
        salt = np.array([b for _, b, _ in todo], dtype=U)[of] * U(1_000_003) + (np.arange(first[-1]) - first[of]).astype(U)
        value = mix(mix(salt[:, None] * U(CELLS) + np.arange(CELLS, dtype=U)) ^ (sums.sum(1, dtype=U)[:, None] - sums))
        # Signatures of nothing: two linked sets agree in more than `spare` groups, so they are only
        # needed by a set in which more groups than that have an empty signature.
        empty = kept == 0
        rare = np.bincount(of, weights=empty.any(1), minlength=len(todo)) <= spare
        wanted = ~(empty & rare[of][:, None])
        for j, (i, _, _) in enumerate(todo):
            out[i].append(value[first[j] : first[j + 1]][wanted[first[j] : first[j + 1]]])
    return [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)], dtype=np.int32), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64))


def _by_pieces(values: pa.Array, rows: int = 500) -> Iterator[list]:
    for at in range(0, len(values), rows):
        yield values.slice(at, rows).to_pylist()


def parity_bits(s: np.ndarray) -> bytes:
    """One bit for each of at least 2 * len(s) cells, a power of two: whether the cell holds an odd number of elements.

    Cells in which two sets' bits differ are no more than the elements in which the sets differ, so
    the bits can tell that sets are not alike, never that they are. Half the cells are the halves' XOR.
    """
    cells = 1 << max(6, (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((mix(s) & U(cells - 1)).astype(np.int64), minlength=cells) & 1).tobytes() if len(s) else b""


def _folded(bits: bytes, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), 0)


def _most_different(one: int | np.ndarray, two: int | np.ndarray, per_hundred: int) -> int | np.ndarray:
    """In how many elements linked sets of these sizes differ at most."""
    return (one + two) * (100 - per_hundred) // (100 + per_hundred)


def with_set(width: int, bits: bool = False):
    """An Arrow UDF: text to (id and size of its shingle set, parity bits if asked for)."""

    @F.arrow_udf("struct<sid:bigint,n:bigint,bits:binary>")
    def names(text: pa.Array) -> pa.Array:
        sid, n, own = [], [], []
        for texts in _by_pieces(text):
            for s in shingle_sets(texts, width):
                sid.append(set_id(s))
                n.append(len(s))
                own.append(parity_bits(s) if bits else None)
        return pa.StructArray.from_arrays([pa.array(sid, pa.int64()), pa.array(n, pa.int64()), pa.array(own, pa.binary())], ["sid", "n", "bits"])

    return names


def _each_set(docs: DataFrame, width: int, schema: str, made) -> DataFrame:
    """made(list of sets) for the distinct sets of each task: (sid, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for texts in _by_pieces(batch.column(0)):
                new: dict[int, np.ndarray] = {}
                for s in shingle_sets(texts, width):
                    if len(s) and (sid := set_id(s)) not in seen:
                        seen.add(sid)
                        new[sid] = s
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array([*new], pa.int64()), _lists(made([*new.values()]))], ["sid", "v"])

    return docs.select("text").mapInArrow(run, schema)


class _Forest:
    """Union-find over the rows of one group; `join` tells whether the link joins two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of at most 2 * BLOCK sets."""
    if len(sets) == 2:
        both = np.concatenate(sets)
        both.sort()
        return np.full((2, 2), int((both[1:] == both[:-1]).sum()))
    element = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(element, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    row, column = row[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        dense = np.zeros((len(sets), COLUMNS), np.float32)
        dense[row[a:b], column[a:b] - at] = 1
        out += np.rint(dense @ dense.T).astype(np.int64)
    return out


def _links(ids: list[int], roots: list[int], sets: list[np.ndarray], per_hundred: int) -> Iterator[tuple[int, int]]:
    """A forest of exactly verified links between sets of different roots that connects whatever such links connect."""
    sizes, root = np.array([len(s) for s in sets]), np.array(roots)
    common = _common(sets)
    linked = np.triu(100 * common >= per_hundred * (sizes[:, None] + sizes[None, :] - common), 1) & (root[:, None] != root[None, :])
    forest = _Forest(len(ids))
    for i, j in zip(*map(np.ndarray.tolist, np.nonzero(linked)), strict=True):
        if forest.join(i, j):
            yield ids[i], ids[j]


def _rows_of(batch: pa.RecordBatch, fixed: int) -> Iterator[tuple]:
    """The rows of a batch: `fixed` plain values, then the set as an array."""
    plain = [batch.column(k).to_pylist() for k in range(fixed)]
    lists = batch.column(fixed)
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(U)
    for r, values in enumerate(zip(*plain, strict=True)):
        yield *values, flat[offsets[r] : offsets[r + 1]]


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _met_hub(per_hundred: int):
    """Reads (hub, part, member, sid, set) sorted so that a hub comes before its members; holds the hub's set alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, np.zeros(0, U)
        for batch in batches:
            found = []
            for hub, part, member, sid, s in _rows_of(batch, 4):
                if not member:
                    key, own = (hub, part), s.copy()
                elif key == (hub, part):
                    common = int(np.isin(s, own, assume_unique=True).sum())
                    if 100 * common >= per_hundred * (len(s) + len(own) - common):
                        found.append((hub, sid))
            yield _pairs(found)

    return run


def _may_link(per_hundred: int):
    """An Arrow UDF: whether two sets, known by size and parity bits, may be alike."""

    @F.arrow_udf("boolean")
    def may(n_one: pa.Array, one: pa.Array, n_two: pa.Array, two: pa.Array) -> pa.Array:
        out = []
        for na, a, nb, b in zip(*map(pa.Array.to_pylist, (n_one, one, n_two, two)), strict=True):
            size = min(len(a), len(b))
            out.append(int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum()) <= _most_different(na, nb, per_hundred))
        return pa.array(out, pa.bool_())

    return may


def _may_meet(per_hundred: int):
    """Reads (hub, one, two, root, sid, n, bits) sorted by the first three; gives the first five of sets that may link with one of another root."""
    names = ["hub", "one", "two", "root", "sid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, {}

        def flush() -> list[tuple]:
            if len(group) < 2:
                return []
            size = min(len(x[2]) for x in group.values())
            cells = np.unpackbits(np.stack([_folded(x[2], size) for x in group.values()]), axis=1).astype(np.float32)
            held, n, root = cells.sum(1), *(np.array([x[k] for x in group.values()]) for k in (1, 0))
            differ = held[:, None] + held[None, :] - 2 * (cells @ cells.T)
            may = (differ <= _most_different(n[:, None], n[None, :], per_hundred)) & (root[:, None] != root[None, :])
            return [(*key, x[0], sid) for (sid, x), use in zip(group.items(), may.any(1).tolist(), strict=True) if use]

        for batch in batches:
            found: list[tuple] = []
            for hub, one, two, root, sid, n, bits in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if (hub, one, two) != key:
                    found += flush()
                    key, group = (hub, one, two), {}
                group[sid] = (root, n, bits)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(5)], names)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in flush()], pa.int64()) for k in range(5)], names)

    return run


def _met_block(per_hundred: int):
    """Reads (hub, one, two, root, sid, set) sorted by the first three; holds one such group, about two blocks, at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, {}

        def flush() -> list[tuple[int, int]]:
            return [*_links([*group], [x[0] for x in group.values()], [x[1] for x in group.values()], per_hundred)] if len(group) > 1 else []

        for batch in batches:
            found: list[tuple[int, int]] = []
            for hub, one, two, root, sid, s in _rows_of(batch, 5):
                if (hub, one, two) != key:
                    found += flush()
                    key, group = (hub, one, two), {}
                group[sid] = (root, s.copy())
            yield _pairs(found)
        yield _pairs(flush())

    return run


def _with_sets(docs: DataFrame, width: int, dealt: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """dealt (sid, ...) with the sets `v`, brought together by keys and sorted within them."""
    sets = _each_set(docs, width, "sid bigint, v array<bigint>", lambda found: [s.astype(np.int64) for s in found])
    whole = sets.join(small(checkpointed(dealt)), "sid").select(*keys, *within, "sid", "v")
    return whole.repartition(*keys).sortWithinPartitions(*keys, *within)


def set_links(docs: DataFrame, sketches: DataFrame, width: int = 3, per_hundred: int = 90) -> DataFrame:
    """Links (a, b) between ids of distinct shingle sets that connect exactly what similarity connects.

    `sketches` holds (sid, n, bits) of every set. Of the sets that share a signature the one of
    smallest id is the hub. Parity bits first rule out pairs of a hub and a member that can't be
    alike; each member is then compared with the one hub left with which it shares most signatures,
    which joins most of what belongs together. What is connected needs no further comparison: only
    in groups of a hub that hold several components do the sets outside the largest one meet all
    others, by parity bits, and what these leave over is compared. Members of a hub are split by hash, and
    these comparisons are dealt as pairs of blocks, so no task holds more than about two blocks of sets.
    """
    signed = _each_set(docs, width, "sid bigint, v array<bigint>", lambda sets: signatures(sets, per_hundred))
    rows = signed.select("sid", F.explode("v").alias("sig"))
    hub = F.min("sid").over(Window.partitionBy("sig").orderBy("sid"))
    met = checkpointed(rows.withColumn("hub", hub).filter("sid <> hub").groupBy("hub", "sid").agg(F.count("*").alias("shared")))
    own = sketches.join(small(met.select("sid").union(met.select("hub")).distinct()), "sid", "left_semi")
    own = checkpointed(own.groupBy("sid").agg(F.min("n").alias("n"), F.min("bits").alias("bits")))
    known = small(own)
    of_hub = own.select(F.col("sid").alias("hub"), F.col("n").alias("hub_n"), F.col("bits").alias("hub_bits"))
    shares = small(checkpointed(met.groupBy("hub").agg((F.floor(F.count("*") / SHARE) + 1).alias("shares")).filter("shares > 1")))
    share = F.coalesce(F.pmod(F.xxhash64("sid"), F.col("shares")), F.lit(0).cast("bigint"))
    spread = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("shares"), F.lit(1)) - 1))
    of_hub = of_hub.join(shares, "hub", "left").select("hub", "hub_n", "hub_bits", spread.alias("share"))
    pairs = met.join(known, "sid").join(shares, "hub", "left").withColumn("share", share).join(of_hub, ["hub", "share"])
    met = checkpointed(pairs.select("hub", "sid", "shared", _may_link(per_hundred)("n", "bits", "hub_n", "hub_bits").alias("may")))

    best = checkpointed(met.filter("may").groupBy("sid").agg(F.max(F.struct("shared", "hub"))["hub"].alias("hub")))
    parts = best.groupBy("hub").agg((F.floor(F.count("*") / BLOCK) + 1).cast("int").alias("parts"))
    split = best.join(small(checkpointed(parts.filter("parts > 1"))), "hub", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"), F.lit(0)))
    hubs = split.select("hub", "part").distinct().select("hub", "part", F.lit(False).alias("member"), F.col("hub").alias("sid"))
    dealt = hubs.unionByName(split.select("hub", "part", F.lit(True).alias("member"), "sid"))
    near = checkpointed(_with_sets(docs, width, dealt, ["hub", "part"], ["member"]).mapInArrow(_met_hub(per_hundred), "a bigint, b bigint"))

    roots = checkpointed(components(near))
    tested = met.join(small(best.select("sid", F.col("hub").alias("best"))), "sid", "left").select("hub", "sid", (~F.col("may") | (F.col("hub") == F.col("best"))).alias("tested"))
    group = tested.unionByName(met.select(F.col("hub"), F.col("hub").alias("sid"), F.lit(True).alias("tested")).distinct())
    group = checkpointed(group.join(small(roots.withColumnRenamed("node", "sid")), "sid", "left").withColumn("root", F.coalesce("root", "sid")))
    counted = group.groupBy("hub", "root").agg(F.count("*").alias("n"), F.bool_and("tested").alias("tested"))
    groups = counted.groupBy("hub").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"), F.count("*").alias("n_roots"), F.bool_and("tested").alias("tested"))
    blocks = lambda n: (F.floor(n / BLOCK) + 1).cast("bigint")
    still = groups.filter("n_roots > 1 and not (all = 2 and tested)")
    still = checkpointed(still.select("hub", F.col("most.root").alias("major"), blocks(F.col("all") - F.col("most.n")).alias("n_one"), blocks(F.col("all")).alias("n_two")))
    asked = group.join(small(still), "hub")
    place = lambda n: F.pmod(F.xxhash64("sid"), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    others = asked.filter("root <> major").select("hub", place("n_one").alias("one"), all_of("n_two").alias("two"), "root", "sid")
    every = asked.select("hub", all_of("n_one").alias("one"), place("n_two").alias("two"), "root", "sid")
    keys = ["hub", "one", "two"]
    sketched = others.unionByName(every).join(known, "sid").select(*keys, "root", "sid", "n", "bits")
    left = sketched.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_may_meet(per_hundred), "hub bigint, one bigint, two bigint, root bigint, sid bigint")
    rest = _with_sets(docs, width, left, keys, ["root"]).mapInArrow(_met_block(per_hundred), "a bigint, b bigint")
    return near.unionByName(rest)


def jaccard_components(docs: DataFrame, width: int = 3, per_hundred: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id), one row for each row of docs.

    component_id is the smallest doc_id that links reach. A null text is an empty one; a text
    without a word has n_shingles 0, links with nothing and is its own component. Equal texts always
    share a component. Rows with a null doc_id are kept: they take part, and their component_id is
    the smallest id of the component, null if it has none. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    named = docs.select("doc_id", with_set(width, True)("text").alias("s")).select("doc_id", "s.*")
    named = checkpointed(named)
    roots = checkpointed(components(set_links(docs, named.filter("n > 0").select("sid", "n", "bits"), width, per_hundred)))
    least = named.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows"))
    least = least.join(small(roots.withColumnRenamed("node", "sid")), "sid", "left").filter("rows > 1 or root is not null")
    least = checkpointed(least.select("sid", "low", F.coalesce("root", "sid").alias("root")))
    lowest = checkpointed(least.groupBy("root").agg(F.min("low").alias("component_id")))
    of_set = checkpointed(least.join(small(lowest), "root").select("sid", "component_id"))
    rows = named.drop("bits").join(small(of_set), "sid", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.when(F.col("n") > 0, F.col("sid")).alias("set_id"))


def keep_one(docs: DataFrame, width: int = 3, per_hundred: int = 90) -> DataFrame:
    """docs without all but one document of each component: the one with the smallest doc_id.

    Texts without a word are all kept. Of rows that repeat the smallest doc_id itself one stays. A
    component without any doc_id keeps one row.
    """
    columns = docs.columns
    classes = checkpointed(jaccard_components(docs, width, per_hundred))
    many = classes.filter("set_id is not null").groupBy("component_id").agg(F.count("*").alias("rows"), F.count_if(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("firsts"))
    many = many.filter("rows > 1 or component_id is null").withColumnRenamed("component_id", "low")
    rest = classes.join(many, F.col("component_id").eqNullSafe(F.col("low"))).select("set_id", "low", "firsts").distinct()
    rows = packed(docs).select("_row", with_set(width)("_row.text")["sid"].alias("_sid"))
    marked = rows.join(small(rest), F.col("_sid") == F.col("set_id"), "left")
    first = F.col("_row.doc_id").eqNullSafe(F.col("low"))
    single = marked.filter(F.col("set_id").isNull() | (first & (F.col("firsts") == 1))).select("_row")
    again = marked.filter(F.col("set_id").isNotNull() & first & (F.col("firsts") > 1)).groupBy("low").agg(F.min_by("_row", F.xxhash64("_row.text")).alias("_row"))
    return unpacked(single.unionByName(again.select("_row")), columns)
