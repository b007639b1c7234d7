"""Event processing as Structured Streaming: once-a-day deduplication, daily buckets, merging sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import merge


def once_a_day(events: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Events without repeats of ``keys`` on one day. The state of a day goes once the watermark has
    passed it."""
    day = F.window(time, "1 day").start.alias("day_start")
    return events.withWatermark(time, late).withColumn("day_start", day).dropDuplicates(["day_start", *keys])


def daily(events: DataFrame, time: str, by: list[str], late: str = "1 day", offset: str = "0 hours") -> DataFrame:
    """Counts and sums by day; ``offset`` moves the start of the day (15 hours for +09:00)."""
    bucket = F.window(time, "1 day", "1 day", offset)
    return events.withWatermark(time, late).groupBy(bucket.alias("bucket"), *by).agg(F.count("*").alias("n"))


def expired(last_seen: Column, deadline: Column, as_of: Column, open_days: int = 30, rolling_days: int = 180) -> Column:
    """Whether a row goes: its deadline is past, or it has none and was not seen for some days."""
    rolling = F.date_diff(as_of, last_seen) > rolling_days
    return F.when(deadline.isNotNull(), F.date_diff(as_of, deadline) > open_days).otherwise(rolling)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder; nothing if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []


def merging_sink(path: str, rules: merge.Ownership) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges batch n into the table at ``path``: version n is made from
    version n - 1 and the batch, so a batch that runs again writes the same version. What the table
    held before the stream is under ``base``; without that, batch 0 starts it."""

    def merge_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        out = batch.dropDuplicates([rules.key])
        before = f"{path}/v{number - 1}" if number else f"{path}/base"
        if number or _exists(spark, before):
            out = merge.ownership_merge(spark.read.parquet(before), out, rules).drop("outcome")
        out.write.mode("overwrite").parquet(f"{path}/v{number}")

    return merge_batch


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now, each batch into a table of its own under ``path`` (a
    batch that runs again overwrites its own), and reads the result: all batches or, in mode
    ``complete``, the last. No row passes through the driver."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    started = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint)
    started.trigger(availableNow=True).start().awaitTermination()
    made = sorted(int(name.partition("=")[2]) for name in names(spark, path))  # by earlier runs as well
    if not made:
        return spark.createDataFrame([], stream.schema)
    wanted = made[-1:] if mode == "complete" else made
    return spark.read.schema(stream.schema).parquet(*[f"{path}/batch={n}" for n in wanted])
