"""Incremental runs on Structured Streaming (Z01-Z06): a batch and a replayed stream give equal rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stored(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        import tempfile

        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")

        path = "file://" + tempfile.mkdtemp(prefix="lodestone-stream-")
    return f"{path}/stream-{uuid.uuid4().hex}"


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Counts and sums by type and tumbling window; late events within the watermark count."""
    own = events.withColumn("t", F.col("ts").cast("timestamp"))
    if own.isStreaming:
        own = own.withWatermark("t", "1 day")
    out = own.groupBy(F.window("t", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions of a user's events."""
    own = events.withColumn("t", F.col("ts").cast("timestamp"))
    if own.isStreaming:
        own = own.withWatermark("t", "1 day")
    out = own.groupBy(F.session_window("t", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def replay(spark: SparkSession, folder: str, schema, transform, mode: str = "complete") -> DataFrame:
    """Read a folder as a stream until it is used up, and give the result as a table.

    The checkpoint is the state. A micro-batch is stored whole, under its number: one that is retried replaces itself,
    and readers of an earlier one are left alone. Of a complete result the last batch counts, else all do.
    """
    at, numbers = stored(spark), [-1]

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")
        numbers.append(number)

    transform(spark.readStream.schema(schema).parquet(folder)).writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    if max(numbers) < 0:
        return transform(spark.createDataFrame([], schema))
    found = spark.read.parquet(f"{at}/out")
    return (found.where(F.col("batch") == max(numbers)) if mode == "complete" else found).drop("batch")


def pending(requests: DataFrame, done: DataFrame, key: str, budget: int) -> DataFrame:
    """The next keys that aren't in the checkpoint yet, at most a budget of them, in order."""
    return requests.join(done.select(key), key, "left_anti").orderBy(key).limit(budget)


def append_new(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of a batch that aren't stored yet, each key once: safe to repeat."""
    return batch.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
