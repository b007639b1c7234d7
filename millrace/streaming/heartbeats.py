"""Heartbeats: one row for each run of a job, also of runs without work and of runs that failed.

A run without a row would look like one that never started. What a run did is told by the metrics
that ``observe`` counts on the rows as they pass (no second pass) and, for streams, by a listener. Only
sums reach the driver: a run has one small record, however many batches it makes.
"""

from __future__ import annotations

import datetime
import logging
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from millrace.streaming import jobs

BEATS = "job string, run string, started_at timestamp, took_ms long, outcome string, batches long, rows long, counts map<string,long>, why string"
#: The name under which the metrics of a stream are observed, and how much of a failure's text is kept.
OBSERVED = "beat"
WHY = 500


@dataclass
class Run:
    """What is known of a run so far. ``ended`` is set once its last event was seen."""

    batches: int = 0
    rows: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    ended: threading.Event = field(default_factory=threading.Event)

    def add(self, counts: dict[str, int | None]) -> None:
        for name, n in counts.items():
            self.counts[name] = self.counts.get(name, 0) + (n or 0)


class RunListener(StreamingQueryListener):
    """Adds up the progress of the runs of one session. Events come after the fact and in another
    thread, so whoever wants a run's sums waits for its end."""

    def __init__(self):
        self._runs: dict[str, Run] = {}
        self._lock = threading.Lock()

    def of(self, run_id: str) -> Run:
        with self._lock:
            return self._runs.setdefault(run_id, Run())

    def forget(self, run_id: str) -> None:
        with self._lock:
            self._runs.pop(run_id, None)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(OBSERVED)
        if not progress.numInputRows and seen is None:
            return  # nothing came: no batch
        run = self.of(str(progress.runId))
        run.batches += 1
        run.rows += progress.numInputRows
        if seen is not None:
            run.add(seen.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.of(str(event.runId)).ended.set()


def counting(df: DataFrame, **counts: Column) -> DataFrame:
    """``df``, a stream, with ``counts`` (conditions) counted over the rows of each batch."""
    return df.observe(OBSERVED, *[F.count_if(c).alias(name) for name, c in counts.items()]) if counts else df


class Heartbeats:
    """The table of heartbeats at ``path``, to which each run appends its row."""

    def __init__(self, spark: SparkSession, path: str, wait: float = 60.0):
        self.spark, self.path, self.wait = spark, path, wait

    def read(self) -> DataFrame:
        if not jobs.names(self.spark, self.path):
            return self.spark.createDataFrame([], BEATS)
        return self.spark.read.schema(BEATS).parquet(self.path)

    def stream(self, job: str, start: Callable[[], StreamingQuery]) -> str:
        """Runs a stream to its end (``availableNow``) and says what it did: done, empty or failed. A failure
        is kept as a row and not raised, so that one job's does not keep others from running."""
        listener = RunListener()
        self.spark.streams.addListener(listener)
        begun, run_id, why, totals = _now(), uuid.uuid4().hex, None, Run()
        try:
            started = start()
            run_id = str(started.runId)
            totals = listener.of(run_id)
            try:
                started.awaitTermination()
            finally:
                # rows that were counted before a failure count as well
                if not totals.ended.wait(self.wait):
                    logging.getLogger(__name__).warning("the end of run %s of %s was not told", run_id, job)
        except PySparkException as failure:
            why = str(failure)
        finally:
            self.spark.streams.removeListener(listener)
        return self._beat(job, run_id, begun, totals, why)

    def batch(self, job: str, df: DataFrame, act: Callable[[DataFrame], None], **counts: Column) -> str:
        """Runs ``act`` on ``df``, whose rows (and those that meet each of ``counts``) are counted as they
        pass. ``act`` has to read all of them once."""
        seen, begun, why, totals = Observation(), _now(), None, Run()
        observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(f"count {n}") for n, c in counts.items()])
        try:
            act(observed)
            told = seen.get  # would wait without end for an action that failed
            totals.rows, totals.batches = told["rows"], int(told["rows"] > 0)
            totals.add({n: told[f"count {n}"] for n in counts})
        except PySparkException as failure:
            why = str(failure)
        return self._beat(job, uuid.uuid4().hex, begun, totals, why)

    def _beat(self, job: str, run_id: str, begun: datetime.datetime, run: Run, why: str | None) -> str:
        outcome = "failed" if why is not None else "done" if run.rows else "empty"
        took = int((_now() - begun).total_seconds() * 1000)
        row = (job, run_id, begun, took, outcome, run.batches, run.rows, run.counts, None if why is None else why[:WHY])
        self.spark.createDataFrame([row], BEATS).coalesce(1).write.mode("append").parquet(self.path)
        return outcome


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc)


def verdicts(beats: DataFrame, expected: DataFrame, as_of: Column, silent_hours: int = 24) -> DataFrame:
    """For each ``job`` that is expected: its runs and failures, its last outcome, the failures in a row since
    its last success, and a verdict: ``never`` ran, ``silent`` for more than ``silent_hours``, ``failing``,
    ``idle`` (its last run found nothing) or ``well``. Runs are reduced to one row a job without a window, so
    a job that beats every second is no hot group."""
    good = F.when(F.col("outcome") != "failed", F.col("started_at"))
    of = beats.groupBy("job").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("outcome") == "failed").alias("failures"),
        F.max_by("outcome", F.struct("started_at", "run")).alias("last"),
        F.max("started_at").alias("last_at"),
        F.max(good).alias("good_at"),
    )
    since = beats.join(of.select("job", "good_at"), "job")
    since = since.filter(F.col("good_at").isNull() | (F.col("started_at") > F.col("good_at"))).groupBy("job").agg(F.count("*").alias("in_a_row"))
    out = expected.select("job").distinct().join(of, "job", "left").join(since, "job", "left")
    silent = F.col("last_at") < as_of - F.make_dt_interval(hours=F.lit(silent_hours))
    verdict = (
        F.when(F.col("last").isNull(), "never")
        .when(silent, "silent")
        .when(F.col("last") == "failed", "failing")
        .when(F.col("last") == "empty", "idle")
        .otherwise("well")
    )
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("runs", "failures", "in_a_row")]
    return out.select("job", *zero, "last", verdict.alias("verdict"))
