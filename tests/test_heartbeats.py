"""Heartbeats of streams and batches: with work, without, and of runs that fail."""

import datetime

from pyspark.sql import functions as F

from millrace.streaming import heartbeats

SCHEMA = "id long, kind string"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_runs_of_a_stream(spark, tmp_path):
    source, at = str(tmp_path / "in"), str(tmp_path / "out")
    beats = heartbeats.Heartbeats(spark, str(tmp_path / "beats"))
    assert beats.read().count() == 0
    put(spark, source, [(1, "a"), (2, "b"), (3, None)])
    put(spark, source, [(4, "a")])

    def start():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        stream = heartbeats.counting(stream, a=F.col("kind") == "a", unknown=F.col("kind").isNull())
        refused = F.when(F.col("kind") == "bad", F.raise_error(F.lit("refused")).cast("string")).otherwise(F.col("kind"))
        writer = stream.withColumn("kind", refused).writeStream.option("checkpointLocation", f"{at}/state").format("parquet")
        return writer.option("path", f"{at}/rows").trigger(availableNow=True).start()

    assert beats.stream("j", start) == "done"
    assert beats.stream("j", start) == "empty"
    put(spark, source, [(5, "a")])
    put(spark, source, [(6, "bad")])
    assert beats.stream("j", start) == "failed"
    assert beats.stream("j", start) == "failed"  # nothing moved on: the same rows again
    rows = [r for r in beats.read().orderBy("started_at").collect()]
    assert [(r.outcome, r.batches, r.rows, dict(r["counts"])) for r in rows[:3]] == [
        ("done", 2, 4, {"a": 2, "unknown": 1}), ("empty", 0, 0, {}), ("failed", 1, 1, {"a": 1, "unknown": 0}),
    ]
    assert "refused" in rows[3].why and len(rows[3].why) <= heartbeats.WHY and rows[0].why is None
    assert len({r.run for r in rows}) == 4


def test_a_stream_that_does_not_start(spark, tmp_path):
    beats = heartbeats.Heartbeats(spark, str(tmp_path / "beats"))
    gone = lambda: spark.readStream.parquet(str(tmp_path / "none")).writeStream.format("noop").start()
    assert beats.stream("j", gone) == "failed" and beats.read().first().rows == 0


def test_runs_of_a_batch(spark, tmp_path):
    beats, out = heartbeats.Heartbeats(spark, str(tmp_path / "beats")), str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, None)], SCHEMA)
    assert beats.batch("b", df, lambda d: d.write.mode("overwrite").parquet(out), known=F.col("kind").isNotNull()) == "done"
    assert beats.batch("b", df.filter("id > 9"), lambda d: d.write.mode("overwrite").parquet(out)) == "empty"
    fails = df.withColumn("kind", F.raise_error(F.lit("no")).cast("string"))
    assert beats.batch("b", fails, lambda d: d.write.mode("overwrite").parquet(out)) == "failed"
    rows = beats.read().orderBy("started_at").collect()
    assert [(r.rows, dict(r["counts"])) for r in rows] == [(2, {"known": 1}), (0, {}), (0, {})]


def test_verdicts(spark):
    at = lambda h: datetime.datetime(2024, 1, 2, h)
    row = lambda job, h, outcome: (job, f"{job}{h}", at(h), 1, outcome, 0, 0, {}, None)
    beats = [row("well", 1, "failed"), row("well", 2, "done"), row("idle", 2, "empty"), row("silent", 0, "done")]
    beats += [row("bad", 1, "done"), row("bad", 2, "failed"), row("bad", 3, "failed"), row("worse", 3, "failed")]
    df = spark.createDataFrame(beats, heartbeats.BEATS)
    jobs = spark.createDataFrame([(j,) for j in ("well", "idle", "silent", "bad", "worse", "never", "never")], "job string")
    out = heartbeats.verdicts(df, jobs, F.lit(at(3)).cast("timestamp"), silent_hours=2)
    assert {r.job: (r.runs, r.failures, r.in_a_row, r.verdict) for r in out.collect()} == {
        "well": (2, 1, 0, "well"), "idle": (1, 0, 0, "idle"), "silent": (1, 0, 0, "silent"), "bad": (3, 2, 2, "failing"),
        "worse": (1, 1, 1, "failing"), "never": (0, 0, 0, "never"),
    }
