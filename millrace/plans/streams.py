"""Streaming queries over the events, run over what is available and held against batch SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import merge
from millrace.plans.registry import query, table
from millrace.streaming import buckets, health, heartbeats, jobs


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for a query's state: in the shared folder that the cluster names; a temporary one
    only for a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="millrace-stream-")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files. The zone-less time becomes one of the session's zone, as
    watermarks need."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _ran(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    at = folder(spark, "stream")
    return jobs.run_available(stream, f"{at}/rows", f"{at}/state", mode)


@query("SELECT day, count(*) AS n_visits FROM (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id, event_type FROM events) GROUP BY day")
def daily_unique_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of a day, once for each user and type (in batch)."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), "user_id", "event_type")
    return events.distinct().groupBy("day").agg(F.count("*").alias("n_visits"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a day and type, from the stream."""
    counts = jobs.daily(_event_stream(spark, sf_dir), "ts", ["event_type"])
    return _ran(counts, spark, "complete").select(F.col("bucket.start").cast("date").alias("day"), "event_type", "n")


@query("SELECT day, count(*) AS n FROM (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id, event_type FROM events) GROUP BY day")
def streaming_once_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the stream, once for each day, user and type."""
    seen = jobs.once_a_day(_event_stream(spark, sf_dir), "ts", ["user_id", "event_type"]).select("day_start", "user_id", "event_type")
    return _ran(seen, spark, "append").groupBy(F.col("day_start").cast("date").alias("day")).agg(F.count("*").alias("n"))


#: What switches a user's visits off, and when they are tried again and forgotten (hours).
HEALTH = health.Rules(fails=2, retry=6, forget=48)


@query(
    """
    WITH e AS (SELECT CAST(user_id AS VARCHAR) AS source, epoch_us(ts) // 1000 AS ms, event_id, event_type = 'error' AS failed FROM events),
    mark AS (SELECT max(ms) - 3600000 AS ms FROM e),
    gaps AS (SELECT *, lag(ms) OVER w AS before FROM e WINDOW w AS (PARTITION BY source ORDER BY ms, event_id)),
    lives AS (SELECT *, sum(CASE WHEN ms - before >= 172800000 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY ms, event_id) AS life FROM gaps),
    runs AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY source, life ORDER BY ms, event_id) AS run FROM lives),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY source, life, run ORDER BY ms, event_id) AS nth FROM runs WHERE failed),
    streaks AS (SELECT source, life, run, count(*) AS fails, min(ms) FILTER (WHERE nth = 2) AS off_at FROM numbered GROUP BY ALL),
    good AS (SELECT source, life, run, ms FROM runs WHERE NOT failed),
    ends AS (SELECT source, life, max(ms) + 172800000 AS ms, max(run) AS run, max(life) OVER (PARTITION BY source) > life AS seen_again FROM runs GROUP BY source, life),
    gone AS (SELECT n.source, n.life, n.run, n.ms FROM ends n, mark WHERE n.seen_again OR n.ms <= mark.ms),
    spans AS (SELECT s.*, coalesce(g.ms, CASE WHEN d.ms IS NOT NULL THEN d.ms ELSE mark.ms END) AS until
        FROM streaks s CROSS JOIN mark LEFT JOIN good g ON g.source = s.source AND g.life = s.life AND g.run = s.run + 1
        LEFT JOIN gone d ON d.source = s.source AND d.life = s.life AND d.run = s.run WHERE s.off_at IS NOT NULL),
    tries AS (SELECT *, unnest(generate_series(off_at + 21600000, until, 21600000)) AS due FROM spans),
    found AS (
        SELECT source, off_at AS ms, 'off' AS kind, 2 AS fails FROM streaks WHERE off_at IS NOT NULL
        UNION ALL SELECT s.source, g.ms, 'on', s.fails FROM streaks s JOIN good g ON g.source = s.source AND g.life = s.life AND g.run = s.run + 1 WHERE s.off_at IS NOT NULL
        UNION ALL SELECT d.source, d.ms, 'forgotten', coalesce(s.fails, 0) FROM gone d LEFT JOIN streaks s ON s.source = d.source AND s.life = d.life AND s.run = d.run
        UNION ALL SELECT t.source, t.due, 'retry', count(*) FROM tries t JOIN numbered n ON n.source = t.source AND n.life = t.life AND n.run = t.run AND n.ms < t.due GROUP BY t.source, t.due)
    SELECT source, make_timestamp(ms * 1000) AS changed_at, kind, CAST(fails AS INTEGER) AS fails FROM found
    """
)
def streaming_source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sources that fail, are switched off, tried again, come back and are forgotten: state
    with timers over the stream of events, up to its watermark. Times are zone-less, as the events' are."""
    stream = _event_stream(spark, sf_dir).withColumn("failed", F.col("event_type") == "error")
    with health.state_store(spark):
        found = _ran(health.changes(stream, "user_id", "ts", "event_id", "failed", HEALTH), spark, "append")
    return found.select("source", F.timestamp_millis("at").cast("timestamp_ntz").alias("changed_at"), "kind", "fails")


@query(
    """
    WITH s AS (SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) < DATE '1997-01-01' AS stored, CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AS incoming,
        CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE 'B' END AS source FROM orders)
    SELECT o_orderkey AS id, CASE WHEN incoming AND (NOT stored OR source = 'B') THEN -o_totalprice ELSE o_totalprice END AS price,
        CASE WHEN stored THEN source ELSE 'B' END AS source FROM s WHERE stored OR incoming
    """
)
def streaming_bucket_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later orders as a stream of source B, merged into a bucketed table of the earlier ones: those of
    source A stay as they are."""
    at = folder(spark, "buckets")
    kept = buckets.BucketTable(f"{at}/table", "id", 16)
    orders, day = table(spark, sf_dir, "orders"), F.col("o_orderdate").cast("date")
    source = F.when(F.col("o_orderkey") % 3 == 0, "A").otherwise("B").alias("source")
    by_hand = F.lit(None).cast("array<string>").alias("edited_fields")
    kept.create(orders.filter(day < "1997-01-01").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), source, by_hand))
    stream = spark.readStream.schema(orders.schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    later = stream.filter(day >= "1996-01-01").select(F.col("o_orderkey").alias("id"), (-F.col("o_totalprice")).alias("price"), F.lit("B").alias("source"), by_hand)
    sink = buckets.bucket_sink(kept, merge.Ownership("id", owned=("price",)), "price")
    started = later.writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/state")
    started.trigger(availableNow=True).start().awaitTermination()
    return kept.read(spark).select("id", "price", "source")


#: The jobs of the heartbeats: an event type each, and one whose type never comes.
JOBS = ("click", "error", "purchase", "signup", "view", "refund")


@query(
    f"""
    WITH jobs(job) AS (VALUES {', '.join(f"('{j}')" for j in JOBS)}), t AS (SELECT unnest([1, 2]) AS nth),
    e AS (SELECT event_type AS job, count(*) AS n, count(*) FILTER (WHERE value >= 200) AS dear, bool_or(event_type = 'error') AS bad FROM events GROUP BY event_type),
    r AS (SELECT job, nth, CASE WHEN coalesce(bad, FALSE) THEN 'failed' WHEN nth = 1 AND n > 0 THEN 'done' ELSE 'empty' END AS outcome, n, dear FROM jobs CROSS JOIN t LEFT JOIN e USING (job))
    SELECT job, nth, outcome, CAST(CASE WHEN outcome = 'done' THEN n ELSE 0 END AS BIGINT) AS n_rows, CAST(CASE WHEN outcome = 'done' THEN dear ELSE 0 END AS BIGINT) AS n_dear,
        outcome = 'failed' AS has_why FROM r
    """
)
def streaming_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events for each job, run twice: what is new, then what is left. One row a run, also of
    those that find nothing and of those that fail (a job that refuses what it reads)."""
    at = folder(spark, "beats")
    beats = heartbeats.Heartbeats(spark, f"{at}/beats")
    for job in JOBS:
        kind, refused = F.col("event_type"), F.raise_error(F.lit("an error is no event")).cast("string")
        mine = _event_stream(spark, sf_dir).filter(kind == job)
        mine = heartbeats.counting(mine, kept=F.lit(True), dear=F.col("value") >= 200)
        mine = mine.withColumn("event_type", F.when(kind == "error", refused).otherwise(kind))
        writer = mine.writeStream.format("parquet").option("path", f"{at}/{job}/rows").option("checkpointLocation", f"{at}/{job}/state")
        for _ in range(2):
            beats.stream(job, lambda writer=writer: writer.trigger(availableNow=True).start())
    nth = F.row_number().over(Window.partitionBy("job").orderBy("started_at"))
    n = lambda name: F.coalesce(F.try_element_at("counts", F.lit(name)), F.lit(0).cast("long"))
    return beats.read().select(
        "job", nth.alias("nth"), F.when((F.col("outcome") == "done") & (n("kept") == 0), "empty").otherwise(F.col("outcome")).alias("outcome"),
        n("kept").alias("n_rows"), n("dear").alias("n_dear"), F.col("why").isNotNull().alias("has_why"),
    )
