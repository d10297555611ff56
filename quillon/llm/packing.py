"""Variable-capacity best-fit packing of documents into training sequences.

A sequence of length s costs `overhead` + s + s * s / `attention`: long sequences pay for attention,
short ones for their overhead and for what does not fit. So no size is best by itself; pieces are packed with each
permitted size as the usual one, and the cheapest packing of a shard is kept.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, checkpointed, text_or_empty

#: Permitted sequence lengths; what a sequence costs beside its length; the length at which attention costs as much as all else.
CAPACITIES, OVERHEAD, ATTENTION = (256, 512, 1024, 2048), 16, 16384
#: Pieces packed together; each shard wastes a sequence or two at most.
SHARD = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE[1:]}+")).cast("bigint")


def cost_of(size: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return overhead + size + size * size / attention


def _packed(lengths: list[int], order: list[int], sizes: list[int], usual: int, cost: dict[int, float]) -> tuple[list[int], list[int]]:
    """best_fit() where no size beyond `usual` opens unless a piece needs it."""
    rising = np.array([lengths[i] for i in reversed(order)], np.int64)
    volume = np.concatenate(([0], np.cumsum(rising)))
    open_: list[tuple[int, int]] = []  # (space left, bin), sorted
    of, used = [0] * len(lengths), []
    for placed, i in enumerate(order):
        n = lengths[i]
        at = bisect_left(open_, (n, -1))
        if at < len(open_):
            left, b = open_.pop(at)
        else:
            to_come = len(order) - placed - 1

            def unit_cost(size: int, n: int = n, to_come: int = to_come) -> float:
                fits = min(to_come, int(np.searchsorted(rising, size - n, "right")))
                return cost[size] / (n + min(size - n, int(volume[fits])))

            least = sizes[bisect_left(sizes, n)]
            left = min((s for s in sizes if least <= s <= max(least, usual)), key=lambda s: (unit_cost(s), s))
            b = len(used)
            used.append(0)
        of[i] = b
        used[b] += n
        if left > n:
            insort(open_, (left - n, b))
    return of, [sizes[bisect_left(sizes, u)] for u in used]


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[list[int], list[int]]:
    """(bin of each piece, capacity of each bin) by best fit over pieces in falling order.

    A piece goes to the open bin that it fills best. Where none fits, the size opens whose cost per
    unit is least, counting what the pieces still to come could fill; in the end every bin shrinks
    to the least permitted size that holds its contents. This is done with each size as the largest
    that opens without need; the packing of least total cost counts, of equal ones that of the smaller size.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    sizes = sorted(capacities)
    cost = {s: cost_of(s, overhead, attention) for s in sizes}
    tried = [_packed(lengths, order, sizes, usual, cost) for usual in sizes]
    return min(tried, key=lambda x: sum(cost[s] for s in x[1]))


def pack(docs: DataFrame, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard: int = SHARD, pieces: Column | None = None) -> DataFrame:
    """(doc_id, part, start, length, shard, bin, bin_start, capacity): where each piece of each row goes.

    `length` measures a row (words of `text` by default). A row longer than the largest capacity is
    cut into pieces of that size and a rest; nothing is dropped. With `pieces`, an array of (tokens, words),
    a row is cut as that says: pieces are packed by their tokens, given in a further column, start and bin_start count tokens and
    length the words that begin in a piece. Null and empty texts give one piece
    of length 0 without a bin. Pieces are dealt to shards by a hash of id, part and length; each
    shard is packed by itself, in one task, and holds about `shard` pieces whatever the input. Rows that repeat
    are packed each; an empty table gives no rows; other columns are ignored.
    """
    most = max(capacities)
    if pieces is None:
        length = word_count(text_or_empty("text")) if length is None else length
        sized = checkpointed(docs.select("doc_id", length.alias("n")))
        full = F.floor((F.greatest(F.col("n"), F.lit(1)) - 1) / most)
        cut = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), full)).alias("part"))
        size = F.least(F.lit(most), F.col("n") - F.col("part") * most).cast("bigint")
        cut = cut.select("doc_id", "part", (F.col("part") * most).alias("start"), size.alias("tokens"), size.alias("length"))
        columns = ["doc_id", "part", "start", "length", "shard", "bin", "bin_start", "capacity"]
    else:
        cut = checkpointed(docs.select("doc_id", F.posexplode_outer(pieces).alias("part", "p")))
        cut = cut.select("doc_id", F.col("part").cast("bigint").alias("part"), (F.col("part").cast("bigint") * most).alias("start"), F.col("p.tokens").alias("tokens"), F.col("p.words").alias("length"))
        columns = ["doc_id", "part", "start", "length", "tokens", "shard", "bin", "bin_start", "capacity"]
    held = cut.filter("tokens > 0").withColumn("mark", F.monotonically_increasing_id())
    shards = max(1, -(-cut.count() // shard))
    own = held.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part", "tokens", "mark"), F.lit(shards)).cast("bigint"))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "mark"], ascending=[False, True], kind="stable").reset_index(drop=True)
        of, sizes = best_fit(rows["tokens"].tolist(), capacities, overhead)
        rows["bin"] = of
        rows["capacity"] = [sizes[b] for b in of]
        rows["bin_start"] = rows.groupby("bin")["tokens"].cumsum() - rows["tokens"]
        return rows[columns]

    none = lambda c: F.lit(None).cast("bigint").alias(c)
    bare = cut.filter("tokens = 0").select(*[none(c) if c in ("shard", "bin", "bin_start", "capacity") else c for c in columns])
    return own.groupBy("shard").applyInPandas(packed, ", ".join(f"{c} bigint" for c in columns)).unionByName(bare)
