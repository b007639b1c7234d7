"""Sources as state of a stream: cut into batches and restarted, it tells what one batch tells."""

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.streaming import health, jobs

START = datetime.datetime(2024, 1, 1)
RULES = health.Rules(fails=2, retry=6, forget=48)
SCHEMA = "user string, ts timestamp, n long, failed boolean"


def told(events, rules=RULES):
    """One source after the other, hour by hour, up to the watermark of the last event."""
    newest = max(h for _, h, _ in events) - 1
    out = []
    for user in sorted({u for u, _, _ in events}):
        of = {}
        for u, h, bad in events:
            if u == user:
                of.setdefault(h, []).append(bad)
        fails, off, last = 0, None, None
        for h in range(max(newest, *of) + 1):
            if h > newest and not any(x >= h for x in of):
                break
            if off is not None and h > off and (h - off) % rules.retry == 0 and h <= last + rules.forget:
                out.append((user, h, "retry", fails))
            if last is not None and h == last + rules.forget:
                out.append((user, h, "forgotten", fails))
                fails, off, last = 0, None, None
            for bad in of.get(h, []):
                last = h
                if bad:
                    fails += 1
                    if fails == rules.fails:
                        off = h
                        out.append((user, h, "off", fails))
                else:
                    if off is not None:
                        out.append((user, h, "on", fails))
                    fails, off = 0, None
    return Counter(out)


EVENTS = [
    ("a", 0, True), ("a", 1, True), ("a", 1, True), ("a", 13, True), ("a", 20, False), ("a", 21, True), ("a", 40, True),
    ("b", 0, True), ("b", 50, True), ("b", 52, True), ("b", 110, False), ("b", 111, False),
    ("c", 5, False), ("c", 53, True), ("c", 54, True), ("c", 60, False), ("d", 120, False), ("d", 121, True),
]


def put(spark, events, path, first=0):
    rows = [(u, START + datetime.timedelta(hours=h), first + i, bad) for i, (u, h, bad) in enumerate(events)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, source, at):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    with health.state_store(spark):
        found = jobs.run_available(health.changes(stream, "user", "ts", "n", "failed", RULES), f"{at}/rows", f"{at}/state")
    hour = (F.col("at") / 3_600_000 - START.replace(tzinfo=datetime.timezone.utc).timestamp() / 3600).cast("int")
    return Counter((r.source, r.hour, r.kind, r.fails) for r in found.withColumn("hour", hour).collect())


@pytest.mark.parametrize("cuts", [[18], [5, 9, 18], [1, 8, 12, 15, 18]])
def test_batches_and_a_restart_tell_what_one_batch_tells(spark, tmp_path, cuts):
    events = sorted(EVENTS, key=lambda e: e[1])
    source, begin = str(tmp_path / "in"), 0
    for k, end in enumerate(cuts):
        put(spark, events[begin:end], source, begin)
        begin = end
        if k in (1, len(cuts) - 1):  # stopped and started again with what came since
            got = run(spark, source, str(tmp_path / "out"))
    assert got == told(events)
    assert run(spark, source, str(tmp_path / "out")) == got  # a start without news makes no batch


def test_rows_that_tell_nothing(spark, tmp_path):
    rows = [(None, START, 1, True), ("a", None, 2, True), ("a", START, 3, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    assert not run(spark, str(tmp_path / "in"), str(tmp_path / "out"))


def test_a_try_before_a_failure_waits_for_the_watermark(spark, tmp_path):
    source, at = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, [("a", 0, True), ("a", 1, True), ("a", 7, True), ("b", 7, False)], source)
    assert run(spark, source, at) == {("a", 1, "off", 2): 1}  # due at 7, and the watermark is at 6
    put(spark, [("a", 8, True), ("b", 9, False)], source, 4)
    assert run(spark, source, at) == {("a", 1, "off", 2): 1, ("a", 7, "retry", 2): 1}
    put(spark, [("a", 13, True), ("a", 13, False)], source, 6)  # a success tells all that was due before it
    assert run(spark, source, at) == {("a", 1, "off", 2): 1, ("a", 7, "retry", 2): 1, ("a", 13, "retry", 4): 1, ("a", 13, "on", 5): 1}


def test_late_hours_match_the_sql(spark, tmp_path):
    import duckdb

    import oracle
    from millrace.plans import catalog

    con, path = duckdb.connect(), tmp_path / "events.parquet"
    row = "i AS event_id, TIMESTAMP '2024-01-01' + to_hours(CAST(hash(i) % 60 AS INTEGER)) AS ts, hash(i, 'u') % 300 AS u, hash(i, 't') % 5 AS t"
    con.execute(
        f"COPY (SELECT CAST(event_id AS BIGINT) AS event_id, ts, CAST(u AS BIGINT) AS user_id, CASE WHEN t < 3 THEN 'error' ELSE 'view' END AS event_type "
        f"FROM (SELECT {row} FROM range(3000) r(i))) TO '{path}'"
    )
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    name = "streaming_source_health"
    oracle.check(spark, con, str(tmp_path), catalog.QUERIES[name], catalog.ORACLES[name])
