"""State from run to run: what changed, what is missing, what is read again, what is switched off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed(df: DataFrame, judged: DataFrame, key: str, mark: str) -> DataFrame:
    """Rows whose key and fingerprint were not judged together before."""
    return df.join(judged.select(key, mark).distinct(), [key, mark], "left_anti")


def missing(stored: DataFrame, listed: DataFrame, complete: DataFrame, key: str, site: str) -> DataFrame:
    """``stored`` with whether a row is missing from its site's list, which only a list that was read to
    its end can say (``complete``: site and a flag; a site without one is not)."""
    there = listed.select(key).distinct().withColumn("_there", F.lit(True))
    out = stored.join(there, key, "left").join(complete.select(site, F.col("complete").alias("_complete")), site, "left")
    gone = F.col("_there").isNull() & F.coalesce("_complete", F.lit(False))
    return out.withColumn("missing", gone).drop("_there", "_complete")


def tails(df: DataFrame, kept: DataFrame, by: str, newest: Column, overlap: int, least: int) -> DataFrame:
    """The newest rows of each list whose total is not the ``kept`` one: as many as it has grown by and
    an overlap, ``least`` at least. A list without a kept total is read whole."""
    total = df.groupBy(by).agg(F.count("*").alias("_total"))
    want = total.join(kept, by, "left").filter(~F.col("kept").eqNullSafe(F.col("_total")))
    n = F.greatest(F.lit(least), F.col("_total") - F.coalesce("kept", F.lit(0)) + overlap)
    place = F.row_number().over(Window.partitionBy(by).orderBy(newest))
    return df.join(want.select(by, n.alias("_n")), by).withColumn("_place", place).filter("_place <= _n").drop("_place", "_n")


def daily_steps(df: DataFrame, today: str) -> DataFrame:
    """``df`` (deadline, rehab_only, verdict, title_deadline, title_closed, hidden, hidden_as_over) with
    bucket, deadline and hidden after the day's steps. Their order matters: each sees what those
    before it left."""
    now = F.lit(today).cast("date")
    out = df.withColumn("bucket", F.when(F.col("rehab_only"), "hold").otherwise("member"))
    out = out.withColumn("bucket", F.coalesce("verdict", "bucket"))
    out = out.withColumn("deadline", F.coalesce("title_deadline", "deadline"))
    revived = F.col("hidden_as_over") & F.coalesce(F.col("deadline") >= now, F.lit(False))
    out = out.withColumn("hidden", F.when(revived, False).otherwise(F.col("hidden")))
    out = out.withColumn("hidden", F.col("hidden") | F.col("title_closed"))
    return out.withColumn("hidden", F.col("hidden") | F.coalesce(F.col("deadline") < now, F.lit(False)))


def switched_off(df: DataFrame, by: str, order: str, failed: str, today: str, fails: int = 3, retry_days: int = 7) -> DataFrame:
    """For each site its failures in a row up to now, how often it was switched off (at the ``fails``-th
    failure in a row), whether it is, and the day of the next try."""
    ordered = Window.partitionBy(by).orderBy(order)
    run = F.sum((~F.col(failed)).cast("int")).over(ordered)
    runs = df.withColumn("_run", run).groupBy(by, "_run").agg(F.count_if(F.col(failed)).alias("_n"))
    out = runs.groupBy(by).agg(F.max_by("_n", "_run").alias("fails"), F.count_if(F.col("_n") >= fails).alias("n_off"))
    off = F.col("fails") >= fails
    return out.withColumns({"off": off, "retry_on": F.when(off, F.date_add(F.lit(today).cast("date"), retry_days))})
