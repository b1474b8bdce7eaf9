"""Tables that an operator writes between its steps, in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.streaming.events import stored

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def run_and_clean(spark: SparkSession, job) -> None:
    """Run a job whose shuffle files go as it ends."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        job()
    finally:
        spark.conf.set(_CLEANUP, was) if was is not None else spark.conf.unset(_CLEANUP)


def written(df: DataFrame, **options: str) -> DataFrame:
    """Write a table and read it again: what made it isn't run again, and its shuffle files are gone."""
    spark = df.sparkSession
    path = stored(spark)
    run_and_clean(spark, lambda: df.write.options(**options).parquet(path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def free(*frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for f in frames:
        path = f.sparkSession._jvm.org.apache.hadoop.fs.Path(f._scratch)
        path.getFileSystem(f.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Longs of a table of bits that tells which rows are worth a shuffle; wrong hits are joined away.
TABLE_LONGS = 1 << 19


def _slot(*key: str) -> tuple[Column, Column]:
    h = F.xxhash64(*key, F.lit("slot"))
    return F.pmod(h, F.lit(TABLE_LONGS)).cast("int"), F.shiftright(h, 40).bitwiseAND(F.lit(63)).cast("int")


def bit_table(keys: DataFrame, *key: str) -> DataFrame:
    """One row: an array of TABLE_LONGS numbers with a bit for each key. Its size is fixed."""
    slot, bit = _slot(*key)
    rows = keys.select(slot.alias("s"), bit.alias("b")).groupBy("s").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("w"))
    every = keys.sparkSession.range(0, TABLE_LONGS, 1, 8).select(F.col("id").cast("int").alias("s"), F.lit(0).cast("long").alias("w"))
    full = rows.unionByName(every).groupBy("s").agg(F.bit_or("w").alias("w"))
    return written(full.agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "w"))), lambda x: x["w"]).alias("t")))


def may_have(df: DataFrame, table: DataFrame, *key: str) -> DataFrame:
    """The rows whose key may be in the table: all that are, and few others."""
    slot, bit = _slot(*key)
    return df.where(F.getbit(F.get(table.scalar(), slot), bit) == 1)
