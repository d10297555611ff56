"""Dense retrieval by cells: vectors lie with their nearest centre, a query reads the cells nearest to it.

A folder holds the vectors, partitioned by cell, and one row for each cell with its centre and radius (the
widest angle of its vectors). Centres, and how many cells a query must read, are fitted on a bounded sample;
every vector is placed. The less the vectors cluster, the more cells a query reads. Vectors that
have no direction (null, empty, zero, not finite, of another length than most) lie in cell -1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import search
from quillon.operators.search import SLACK, broadcast_if_small, directed, ranked
from quillon.sources import sinks

SAMPLE, MOST_CELLS = 20_000, 4_096
#: Angles between queries and centres that the driver holds at once.
ANGLES = 4 << 20
#: The recall that the number of read cells is fitted to, with so many of the sample's vectors asking for so many neighbours in it.
TARGET, ASKING, NEIGHBOURS = 0.95, 256, 10


def fit(vectors: DataFrame, sample: int = SAMPLE, most: int = MOST_CELLS) -> tuple[np.ndarray, int]:
    """Unit centres and the number of cells to read, from the `sample` vectors of least hash.

    The centres are those of k-means with cosines: about the root of the number of vectors, at most `most`.
    """
    sizes = vectors.groupBy(F.size("vector").alias("size")).count().filter("size > 0").orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return np.zeros((0, 0)), 1
    spread = vectors.sparkSession.sparkContext.defaultParallelism
    drawn = vectors.filter(directed(F.col("vector"), sizes["size"])).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample)
    drawn = drawn.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features")).repartition(spread).persist()  # else the limit leaves one task
    try:
        rows = _units(np.array([r["features"].toArray() for r in drawn.collect()]).reshape(-1, sizes["size"]))  # at most `sample`
        if len(rows) < 2:
            return (rows if len(rows) else np.zeros((0, 0))), 1
        k = max(2, min(most, len(rows) // 4, round(sizes["count"] ** 0.5)))
        centres = _units(np.array(KMeans(k=k, seed=7, maxIter=12, distanceMeasure="cosine").fit(drawn).clusterCenters()))
    finally:
        drawn.unpersist()
    return centres, probes(rows, centres)


def probes(rows: np.ndarray, centres: np.ndarray, target: float = TARGET, asking: int = ASKING, k: int = NEIGHBOURS) -> int:
    """How many nearest cells hold the share `target` of the k nearest rows of the first `asking` ones."""
    ask = rows[:asking]
    k = min(k, len(rows))
    near = np.argpartition(-(ask @ rows.T), k - 1, axis=1)[:, :k]
    cell = (rows @ centres.T).argmax(axis=1)
    order = np.argsort(-(ask @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _angles(vectors: pd.Series, centres: np.ndarray) -> np.ndarray:
    rows = np.zeros((len(vectors), centres.shape[1]))
    for i, v in enumerate(vectors):
        if v is not None:
            rows[i] = v
    return _between(rows, centres)


def _between(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_units(rows) @ centres.T, -1.0, 1.0))


def placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vectors with their cell and their angle from its centre; ties go to the smaller number."""
    if not len(centres):
        return vectors.withColumns({"angle": F.lit(None).cast("double"), "cell": F.lit(-1)})

    @F.pandas_udf("cell int, angle double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        step = max(1, ANGLES // len(centres))
        parts = [_angles(v.iloc[at : at + step], centres) for at in range(0, max(1, len(v)), step)]
        return pd.DataFrame({"cell": np.concatenate([x.argmin(axis=1) for x in parts]).astype("int32"), "angle": np.concatenate([x.min(axis=1) for x in parts])})

    good = directed(F.col("vector"), centres.shape[1])
    rows = vectors.withColumn("_at", nearest(F.when(good, F.col("vector"))))
    return rows.withColumns({"angle": F.when(good, F.col("_at.angle")), "cell": F.when(good, F.col("_at.cell")).otherwise(-1)}).drop("_at")


def build(spark: SparkSession, vectors: DataFrame, path: str) -> None:
    """Cells of vectors (chunk_id, paper_id, vector) at path; their table is written last and marks the end."""
    centres, read = fit(vectors)
    rows = placed(vectors.select("chunk_id", "paper_id", "vector"), centres)
    rows.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    _describe(spark, centres, read, path)


def add(spark: SparkSession, vectors: DataFrame, path: str) -> None:
    """More vectors in the cells at path; the centres stay."""
    centres, _, read = _cells(spark, path)
    rows = placed(vectors.select("chunk_id", "paper_id", "vector"), centres)
    rows.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")
    _describe(spark, centres, read, path)


def _describe(spark: SparkSession, centres: np.ndarray, read: int, path: str) -> None:
    told = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    radii = _vectors(spark, path).groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    told.join(radii, "cell", "left").withColumn("probes", F.lit(read)).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chunk_id string, paper_id string, vector array<double>, angle double, cell int").parquet(f"{path}/vectors")


def _cells(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Centres and radii, at most MOST_CELLS of them, and how many cells to read."""
    rows = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])
    centres = np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 0))
    return centres, np.array([r["radius"] or 0.0 for r in rows]), rows[0]["probes"] if rows else 1


def topk(spark: SparkSession, path: str, queries: DataFrame, k: int, read: int | None = None, exact: bool = False) -> DataFrame:
    """(query_id, chunk_id, paper_id, score, rank): the k best vectors of queries (query_id, vector) by cosine.

    Each query reads its `read` nearest cells (if None, as many as were fitted), and gets exact cosines of what
    lies there. With `exact` it then also reads each cell that could hold something as good as its k-th best: no
    vector of a cell is nearer than the angle to the centre less the radius. The result is then that of
    `search.dense`, cell -1 included; without `exact`, cell -1 and queries without direction have no rows.
    """
    centres, radii, fitted = _cells(spark, path)
    read = read or fitted
    width = centres.shape[1] if len(centres) else 0
    good = directed(F.col("vector"), width)
    held = search.held(queries.filter(good), width)
    if held is None:
        return _joined(spark, path, queries, k, read, exact, centres, radii)
    kind, vectors = queries.schema["query_id"].dataType, _vectors(spark, path)
    bits = _asking(held[1], centres, lambda angles, _: _first(angles, read))
    found = _met(held, kind, vectors, k, bits)
    if not exact:
        return ranked(found, F.col("score"), k)
    found = sinks.kept(ranked(found, F.col("score"), k).drop("rank"))
    place, reach = {q: i for i, q in enumerate(held[0])}, np.full(len(held[0]), 4.0)
    for r in found.groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("n")).collect():  # at most the held queries
        if r["n"] >= k:
            reach[place[r["query_id"]]] = np.arccos(np.clip(r["worst"] - SLACK, -1.0, 1.0)) + SLACK
    more = _asking(held[1], centres, lambda angles, at: np.maximum(angles - radii, 0.0) <= reach[at][:, None])
    out = found.unionByName(_met(held, kind, vectors, k, more & ~bits))
    odd = vectors.filter("cell = -1")
    for some, rest in ((queries.filter(~good), vectors), (queries.filter(good), odd)):
        if not some.isEmpty() and not rest.isEmpty():
            out = out.unionByName(search.dense(some, rest))
    return ranked(out, F.col("score"), k)


def _first(angles: np.ndarray, read: int) -> np.ndarray:
    """Which are the `read` least of each row; of equal ones the first."""
    out = np.zeros(angles.shape, bool)
    np.put_along_axis(out, np.argsort(angles, axis=1, kind="stable")[:, :read], True, axis=1)
    return out


def _asking(rows: np.ndarray, centres: np.ndarray, chosen) -> np.ndarray:
    """For each cell the bits of the queries that read it, packed, by what `chosen` says of their angles to the centres and of their places."""
    step = max(8, ANGLES // len(centres) // 8 * 8)
    places = [np.arange(at, min(at + step, len(rows))) for at in range(0, len(rows), step)]
    return np.concatenate([np.packbits(chosen(_between(rows[at], centres), at).T, axis=1) for at in places], axis=1)


def _met(held: tuple[list, np.ndarray], kind, vectors: DataFrame, k: int, bits: np.ndarray) -> DataFrame:
    """Of the cells that any query reads what may be among the k best of each query."""
    asked = np.flatnonzero(bits.any(axis=1)).tolist()
    return search.near(held, kind, vectors.filter(F.col("cell").isin(asked)), k, bits)


def _joined(spark: SparkSession, path: str, queries: DataFrame, k: int, read: int, exact: bool, centres: np.ndarray, radii: np.ndarray) -> DataFrame:
    """`topk` of queries that tasks can't hold, or of none: they meet the vectors of their cells by a join."""
    width = centres.shape[1] if len(centres) else 0
    good = directed(F.col("vector"), width)

    @F.pandas_udf("array<double>")
    def angles(v: pd.Series) -> pd.Series:
        return pd.Series(list(_angles(v, centres)))

    @F.pandas_udf("array<double>")
    def least(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.maximum(_angles(v, centres) - radii, 0.0)))

    asked = queries.select("query_id", "vector", good.alias("good"), angles(F.when(good, F.col("vector"))).alias("angles"), least(F.when(good, F.col("vector"))).alias("least"))
    order = F.array_sort(F.transform("angles", lambda a, i: F.struct(a.alias("angle"), i.alias("cell"))))
    asked = asked.withColumn("near", F.transform(F.slice(order, 1, read), lambda x: x["cell"]))
    first = asked.filter("good").select("query_id", "vector", F.explode("near").alias("cell"))
    found = _best(spark, path, first, k)
    if not exact:
        return found
    found = sinks.kept(found.drop("rank"))
    worst = found.groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    reach = F.when(F.col("n") >= k, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("worst") - SLACK))) + SLACK).otherwise(F.lit(4.0))
    could = F.filter(F.sequence(F.lit(0), F.lit(max(len(centres), 1) - 1)), lambda i: ~F.col("good") | (~F.array_contains("near", i) & (F.get("least", i) <= F.col("reach"))))
    more = asked.join(worst, "query_id", "left").withColumn("reach", reach)
    more = more.select("query_id", "vector", F.explode(F.concat(could, F.array(F.lit(-1)))).alias("cell"))
    return ranked(found.unionByName(_best(spark, path, more, k).drop("rank")), F.col("score"), k)


def _best(spark: SparkSession, path: str, probes: DataFrame, k: int) -> DataFrame:
    """The k best vectors of the cells that each query reads (query_id, vector, cell); only these cells are read where probes are few enough for a broadcast."""
    met = _vectors(spark, path).join(broadcast_if_small(probes.withColumnRenamed("vector", "q")), "cell")
    return ranked(met.select("query_id", "chunk_id", "paper_id", F.round(T.cosine(F.col("q"), F.col("vector")), 6).alias("score")), F.col("score"), k)
