"""Helpers shared by the training-data operators.

Arrays that a lambda reads by position are columns of an earlier projection, and such arrays are
exploded with explode_outer: a plain explode infers a filter on its array, which moves below the
projections and computes the array again for every element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Rows and bytes up to which a small side is broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 8 << 20

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACE = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder.

    A local session without one gets a folder under its warehouse; on a cluster a missing
    spark.checkpoint.dir is an error, since a folder of the driver's machine is not shared.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and sc.master.startswith("local"):
            import tempfile

            shared = tempfile.mkdtemp(prefix="spark-checkpoint-")
        if shared is None:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared)
    return df.checkpoint()


def _bytes(value: Column, kind: DataType) -> Column:
    """About the bytes that a value takes in a hashed relation."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, StructType, ArrayType)):
            return F.coalesce(F.aggregate(value, F.lit(16), lambda a, x: a + _bytes(x, kind.elementType)), F.lit(16))
        return F.coalesce(F.size(value), F.lit(0)) * 8 + 16
    return F.lit(8)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows and about `most` bytes, else df itself (a shuffle join).

    The size is one aggregate over df, so df should be materialised or cheap.
    """
    each = sum((_bytes(df[f"`{f.name}`"], f.dataType).cast("bigint") for f in df.schema.fields), F.lit(16).cast("bigint"))
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= most else df


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters that are not white space, in order."""
    return F.filter(F.split(text, f"{SPACE}+", -1), lambda w: w != "")


def packed(df: DataFrame) -> DataFrame:
    """All columns in one struct `_row`, so that no working column clashes with a column of the input."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])
