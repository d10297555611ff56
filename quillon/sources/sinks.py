"""Tables written by jobs: replaced by bucket of papers, or appended."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket(key: str = "paper_id", buckets: int = BUCKETS) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def replace_papers(spark: SparkSession, rows: DataFrame, path: str, papers: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """The rows of `papers` (or of those in rows) in the table at path become `rows`; others stay.

    Only the buckets of these papers are read and overwritten. What stays of them is checkpointed
    first, as a bucket can't be read while it is replaced. A paper of `papers` without rows is removed.
    Each written bucket also holds a row without paper_id, so that one which loses all its papers is
    overwritten too; read the table through `table`.
    """
    hit = (rows if papers is None else papers).select("paper_id").distinct().withColumn("bucket", bucket(buckets=buckets))
    new = rows.withColumn("bucket", bucket(buckets=buckets))
    if exists(spark, path):
        old = spark.read.parquet(path)
        touched = [r["bucket"] for r in hit.select("bucket").distinct().collect()]  # at most `buckets` rows
        kept = old.filter(F.col("bucket").isin(touched) & F.col("paper_id").isNotNull()).join(hit.select("paper_id"), "paper_id", "left_anti")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"{path}_checkpoints")
        new = new.unionByName(kept.checkpoint(), allowMissingColumns=True)
    new = new.unionByName(hit.select("bucket").distinct(), allowMissingColumns=True)
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table written by `replace_papers`."""
    return spark.read.parquet(path).filter("paper_id is not null").drop("bucket")


def exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def write_vectors(spark: SparkSession, rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """All vectors of the papers in rows are replaced; null vectors are not written."""
    replace_papers(spark, rows.filter("vector is not null"), path, rows, buckets)


def vector_outcome(papers: DataFrame, rows: DataFrame) -> DataFrame:
    """(paper_id, ok, n_rows) of each listed paper: ok if it has a vector."""
    counts = rows.groupBy("paper_id").agg(F.count("vector").alias("n_rows"))
    out = papers.select("paper_id").distinct().join(counts, "paper_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("bigint")))
    return out.select("paper_id", (F.col("n_rows") > 0).alias("ok"), "n_rows")


def backfill_vectors(spark: SparkSession, papers: DataFrame, rows: DataFrame, path: str, errors: int = 20) -> dict:
    """Writes the vectors that rows keep of the listed papers; papers without any are errors, of which the first are named."""
    outcome = vector_outcome(papers, rows)
    good = outcome.filter("ok").select("paper_id")
    write_vectors(spark, rows.join(good, "paper_id", "left_semi"), path)
    total = outcome.agg(F.count("*").alias("matched"), F.count_if("ok").alias("synced"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows")).first()
    bad = [r["paper_id"] for r in outcome.filter("not ok").orderBy("paper_id").limit(errors).collect()]
    return {**total.asDict(), "failed": total["matched"] - total["synced"], "errors": bad}


def append(rows: DataFrame, path: str) -> None:
    """Reports and citations are only ever added."""
    rows.write.mode("append").parquet(path)


def append_new(rows: DataFrame, path: str, key: str, owner: str, buckets: int = BUCKETS) -> None:
    """Rows whose key the table at path does not hold yet are added, in buckets of their owner, so a repeated append changes nothing.

    Only the buckets of these owners are read.
    """
    spark = rows.sparkSession
    new = kept(rows.dropDuplicates([key]).withColumn("bucket", bucket(owner, buckets)))
    if exists(spark, path):
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets` rows
        new = new.join(spark.read.parquet(path).filter(F.col("bucket").isin(touched)).select(key), key, "left_anti")
    new.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(path)


def owned(path: str, owners: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows that `append_new` wrote for owners (one column), read from their buckets only."""
    owner = owners.columns[0]
    touched = [r["bucket"] for r in owners.select(bucket(owner, buckets).alias("bucket")).distinct().collect()]  # at most `buckets` rows
    rows = owners.sparkSession.read.parquet(path).filter(F.col("bucket").isin(touched))
    return rows.join(owners, owner, "left_semi").drop("bucket")


def with_latest_score(papers: DataFrame, reports: DataFrame) -> DataFrame:
    """papers with the score of their newest report."""
    newest = reports.groupBy("paper_id").agg(F.max_by("score", "created_at").alias("new_score"))
    rows = papers.join(newest.withColumnRenamed("paper_id", "id"), "id", "left")
    return rows.withColumn("score", F.coalesce("new_score", "score")).drop("new_score")


def kept(df: DataFrame) -> DataFrame:
    """df, written to and read from the shared folder, so that it is computed once."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share.

    A local session without one gets a folder of its own, which it keeps; on a cluster that is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None and sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        folder = sc.getCheckpointDir()
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder
