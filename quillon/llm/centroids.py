"""Clusters of vectors on an integer grid: rounds of assignment by Orchard's search and of exact means.

Each centroid has a list of the others by rising distance. A vector walks the list of the nearest
centroid that it has met: a closer one is jumped to at once and its list walked from the start,
what was visited is skipped, and the walk ends where the list's next centroid is strictly more than
twice as far from the current one as the vector is, since nothing behind it can be as near.

Tasks search batches of vectors in numpy and send sums of components only: a few rows for each task,
summed by Spark as decimals. The driver holds the centroids, CENTROIDS times COMPONENTS integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from quillon.llm.common import checkpointed

CENTROIDS, ROUNDS, COMPONENTS, SCALE, SEED = 40, 5, 64, 256, 2
#: Vectors searched together in a task; components up to which 64-bit sums of squares are exact.
BATCH, SAFE = 4096, 1 << 24
ADDED = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def on_grid(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component: 64-bit integers, or Python's if one is beyond SAFE."""
    if vectors.size == 0 or np.abs(vectors).max() * scale <= SAFE:
        return np.floor(vectors * scale).astype(np.int64)
    return np.array([[math.floor(Fraction(x) * scale) for x in row] for row in vectors.tolist()], dtype=object)


def whole(vector: Column, components: int) -> Column:
    """Whether a vector has so many components, none of them null or non-finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) == components) & F.forall(vector, finite)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the numbers of all others by (squared distance, number), and these distances."""
    k = len(centroids)
    far = np.array([_squared(centroids, c) for c in centroids], dtype=centroids.dtype).reshape(k, k)
    order = np.array([sorted((j for j in range(k) if j != i), key=lambda j: (far[i, j], j)) for i in range(k)], dtype=np.int64).reshape(k, k - 1)
    return order, np.take_along_axis(far, order, axis=1)


def orchard(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance) of each vector, ties to the smaller number, and the distances computed."""
    n, k = len(vectors), len(centroids)
    best = np.zeros(n, np.int64)
    dist = _squared(vectors, centroids[0]) if n else np.zeros(0, vectors.dtype)
    visited = np.zeros((n, k), bool)
    visited[:, 0] = True
    place = np.zeros(n, np.int64)
    tried, live = n, np.arange(n if k > 1 else 0)
    while len(live):
        at, own = place[live], best[live]
        inside = np.asarray(far[own, at] <= 4 * dist[live], bool)  # squares: strictly beyond twice the distance ends the walk
        live, at, own = live[inside], at[inside], own[inside]
        other = order[own, at]
        place[live] = at + 1
        fresh = ~visited[live, other]
        rows, seen = live[fresh], other[fresh]
        visited[rows, seen] = True
        tried += len(rows)
        found = _squared(vectors[rows], centroids[seen])
        closer = np.asarray((found < dist[rows]) | ((found == dist[rows]) & (seen < best[rows])), bool)
        rows, seen = rows[closer], seen[closer]
        best[rows], dist[rows], place[rows] = seen, found[closer], 0
        live = live[place[live] < k - 1]
    return best, dist, tried


def _batches(batches: Iterator[pa.RecordBatch], components: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of at most BATCH rows with their vectors on the grid."""
    for batch in batches:
        for at in range(0, len(batch), BATCH):
            part = batch.slice(at, BATCH)
            yield part, on_grid(part.column("_vector").flatten().to_numpy(zero_copy_only=False).reshape(len(part), components), scale)


class _Search:
    """Orchard's search over fixed centroids; object integers where a batch or a centroid needs them."""

    def __init__(self, centroids: list[list[int]]):
        wide = any(abs(x) > SAFE for c in centroids for x in c)
        self.centroids = np.array(centroids, dtype=object if wide else np.int64)
        self.order, self.far = neighbour_lists(self.centroids)

    def __call__(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return orchard(vectors, self.centroids, self.order, self.far)[:2]


def _sums(rows: DataFrame, centroids: list[list[int]], components: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """(vectors, sums of components) of each cluster; sums travel as text, as they may pass 64 bits."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, total, count = _Search(centroids), np.zeros((len(centroids), components), object), np.zeros(len(centroids), np.int64)
        for _, vectors in _batches(batches, components, scale):
            best, _ = search(vectors)
            count += np.bincount(best, minlength=len(centroids))
            for c in np.unique(best).tolist():
                total[c] += vectors[best == c].sum(axis=0).astype(object)
        rows = [(c, int(count[c]), i, str(total[c, i])) for c in np.flatnonzero(count).tolist() for i in range(components)]
        names = ("cluster", "n", "i", "s")
        yield pa.RecordBatch.from_pydict({name: [r[j] for r in rows] for j, name in enumerate(names)}, pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("i", pa.int32()), ("s", pa.string())]))

    each = rows.mapInArrow(summed, "cluster int, n bigint, i int, s string")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in each.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # centroids x components rows
        out.setdefault(r["cluster"], (r["n"], [0] * components))[1][r["i"]] = int(r["s"])
    return out


def fit(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> list[list[int]]:
    """Centroids after so many rounds over rows (_id, _vector), starting from the k vectors whose digests of seed and id are smallest.

    Equal digests go by components; a null id counts as the word null. Fewer than k vectors give fewer centroids.
    """
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("null"))), 256)
    order = F.transform("_vector", lambda x: F.floor(x * F.lit(float(scale))))
    first = rows.select(drawn.alias("h"), order.alias("o"), "_vector").orderBy("h", "o").limit(k).collect()
    centroids = [[int(x) for x in c] for c in on_grid(np.array([r["_vector"] for r in first], np.float64), scale).tolist()]
    for _ in range(rounds if centroids else 0):
        for c, (n, sums) in _sums(rows.select("_vector"), centroids, components, scale).items():
            centroids[c] = [s // n for s in sums]
    return centroids


def clustered(
    docs: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id", scale: int = SCALE, seed: int = SEED
) -> DataFrame:
    """docs (all columns but the vector) with cluster, distance (squared, to the final centroid), cluster_inertia, inertia and centroid_sha256.

    Rows whose vector is null, has another number of components, or holds a null or non-finite one are
    left out. Repeated rows are kept and count each; of equal distances the smaller number wins; a
    cluster that is empty keeps its centroid. Null ids are rows like others. An empty table gives an
    empty result. Columns of docs with a name of the result come back as docs_<name>. Components beyond
    2^24 on the grid are computed in Python's integers; distances and sums must fit 64 bits in the end.
    """
    rest = [c for c in docs.columns if c != vector]
    named = {c: f"docs_{c}" if c in ADDED else c for c in rest}
    kept = docs.filter(whole(F.col(f"`{vector}`"), components))
    rows = kept.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{vector}`").cast("array<double>").alias("_vector"), *[F.col(f"`{c}`").alias(f"_of_{c}") for c in rest])
    centroids = fit(rows.select("_id", "_vector"), k, rounds, components, scale, seed)
    plain = rows.select("_vector", *[f"`_of_{c}`" for c in rest])
    schema = plain.drop("_vector").schema.add("cluster", IntegerType()).add("distance", LongType())

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(centroids) if centroids else None
        for part, vectors in _batches(batches, components, scale):
            best, dist = search(vectors)
            columns = [part.column(i) for i, name in enumerate(part.schema.names) if name != "_vector"]
            names = [name for name in part.schema.names if name != "_vector"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(best.astype(np.int32)), pa.array([int(x) for x in dist], pa.int64())], names=[*names, "cluster", "distance"])

    done = checkpointed(plain.mapInArrow(assigned, schema))
    own = {r["cluster"]: r["s"] for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
    facts = [(c, int(s), int(sum(own.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sorted(own.items())]
    table = done.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    out = done.join(F.broadcast(table), "cluster")  # one row for each cluster
    return out.select(*[F.col(f"`_of_{c}`").alias(named[c]) for c in rest], *ADDED)
