"""Dates and times that texts and codes state."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates, deadlines
from millrace.plans.registry import query, table


@query(
    """
    SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS kst_day, CAST(date_trunc('day', ts + INTERVAL 9 HOUR) - INTERVAL 9 HOUR AS TIMESTAMP) AS bucket,
           CAST(make_timestamp((event_id * 86399137 % 1700000000000 + 32400000) * 1000) AS DATE) AS day_of_millis
    FROM events
    """
)
def korean_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of Korea's clock: of times, of milliseconds, and as buckets that start at midnight there."""
    start = F.window(F.col("ts").cast("timestamp"), "1 day", "1 day", "15 hours").start
    return table(spark, sf_dir, "events").select(
        "event_id",
        dates.kst_day(F.col("ts")).alias("kst_day"),
        start.cast("timestamp_ntz").alias("bucket"),
        dates.day_of_millis(F.col("event_id") * 86399137 % 1700000000000).alias("day_of_millis"),
    )


@query(
    """
    WITH p AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS a, strftime(o_orderdate + INTERVAL 20 DAY, '%Y%m%d') AS b, o_orderkey % 4 AS m FROM orders),
    t AS (SELECT o_orderkey, m, a, CASE m WHEN 0 THEN a || ' ~ ' || b WHEN 1 THEN '20240230 ' || b WHEN 2 THEN 'always' END AS period FROM p),
    d AS (SELECT *, list_filter(list_transform(regexp_extract_all(period, '[0-9]{8}'), lambda x: TRY_CAST(substr(x, 1, 4) || '-' || substr(x, 5, 2) || '-' || substr(x, 7, 2) AS DATE)), lambda x: x IS NOT NULL) AS days FROM t)
    SELECT o_orderkey, days[1] AS first_day, days[2] AS last_day, CASE WHEN m = 0 THEN false ELSE days[1] IS NULL END AS always,
           CASE WHEN m <> 1 THEN CAST(substr(a, 1, 4) || '-' || substr(a, 5, 2) || '-' || substr(a, 7, 2) AS DATE) END AS of_digits
    FROM d
    """
)
def policy_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of eight-digit days, whether there is none, and single days."""
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    digits = lambda d: F.date_format(d, "yyyyMMdd")
    a, b = digits(day), digits(F.date_add(day.cast("date"), 20))
    period = F.when(k == 0, F.concat(a, F.lit(" ~ "), b)).when(k == 1, F.concat(F.lit("20240230 "), b)).when(k == 2, "always")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", period.alias("period"), F.when(k == 0, "fixed").otherwise("open").alias("code"), F.when(k == 1, "20240230").otherwise(a).alias("one")
    )
    first, last = dates.period_of(F.col("period"))
    return rows.select(
        "o_orderkey",
        first.alias("first_day"),
        last.alias("last_day"),
        dates.always_open(F.col("code"), F.col("period"), "fixed").alias("always"),
        dates.day_of_digits(F.col("one")).alias("of_digits"),
    )


@query(
    """
    WITH p AS (SELECT event_id, strftime(ts, '%H:%M') AS t, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS m FROM events)
    SELECT event_id, CASE WHEN t = '23:59' THEN '자정' ELSE CASE WHEN h < 12 THEN '오전 ' ELSE '오후 ' END || CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END || '시'
             || CASE WHEN m > 0 THEN ' ' || m || '분' ELSE '' END END AS words
    FROM p
    """
)
def time_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in words."""
    return table(spark, sf_dir, "events").select("event_id", dates.time_words(F.date_format("ts", "HH:mm")).alias("words"))


#: Sentences about a deadline: {0} the day with points, {1} with blanks and no zeros, {2} another day.
SENTENCES = ("접수기간 ~ {0} 23:50", "원서접수 {2} 09:00 ~ {1} (목) 17:00 까지", "마감 {0} ~ {2} 14:00", "마감 {0} 까지", "마감 {0} 25:00", "그날 {0}(일)\n9:05")


@query(
    """
    SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '23:50' WHEN 1 THEN '17:00' WHEN 5 THEN '09:05' END AS deadline_time,
           CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1997-01-01' + 730 THEN strftime(o_orderdate, '%Y-%m-%d') END AS believed,
           CASE WHEN CAST(o_orderdate AS DATE) > DATE '1997-01-01' + 730 THEN strftime(o_orderdate, '%Y-%m-%d') END AS distrusted
    FROM orders
    """
)
def deadline_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time that stands behind a deadline's date, and dates too far ahead."""
    day = F.col("o_orderdate").cast("date")
    blanks = F.concat(F.year(day).cast("string"), F.lit(". "), F.month(day).cast("string"), F.lit(". "), F.day(day).cast("string"))
    text = F.get(F.array(*[F.lit(s) for s in SENTENCES]), (F.col("o_orderkey") % len(SENTENCES)).cast("int"))
    for mark, value in (("{0}", F.date_format(day, "yyyy.MM.dd")), ("{1}", blanks), ("{2}", F.date_format(F.date_add(day, 5), "yyyy.MM.dd"))):
        text = F.replace(text, F.lit(mark), value)
    kept = dates.believed(F.date_format(day, "yyyy-MM-dd"), F.lit("1997-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.deadline_time(text, day).alias("deadline_time"), kept["day"].alias("believed"), kept["distrusted"].alias("distrusted")
    )


@query(
    """
    SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + to_months(CAST((o_orderkey % 4 + 2) * 12 - 1 AS INTEGER)) AS DATE) AS graduated,
           last_day(CAST(date_trunc('month', o_orderdate) + to_months(CAST((o_orderkey % 4 + 3) * 12 - 1 AS INTEGER)) AS DATE)) AS free_until
    FROM orders
    """
)
def study_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of graduation and the days until which a service is free."""
    graduated = dates.graduation(F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4 + 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", graduated.alias("graduated"), dates.free_until(graduated).alias("free_until"))


@query(
    """
    WITH p AS (SELECT event_id, event_id % 5 + 1 AS attempt, event_id % 3 AS m, event_id % 4000 AS s FROM events)
    SELECT event_id, CASE WHEN attempt > 3 THEN NULL WHEN m = 2 THEN CASE attempt WHEN 1 THEN 60 WHEN 2 THEN 300 ELSE 1800 END WHEN s <= 1800 THEN s END AS wait
    FROM p
    """
)
def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits before the next attempt: by the header in seconds or as a date, else by the attempt."""
    k, wait = F.col("event_id"), F.col("event_id") % 4000
    when = F.date_format(F.col("ts").cast("timestamp") + F.make_dt_interval(secs=wait), "EEE, dd MMM yyyy HH:mm:ss")
    header = F.when(k % 3 == 0, wait.cast("string")).when(k % 3 == 1, F.concat(when, F.lit(" GMT")))
    rows = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    return rows.select("event_id", dates.retry_after(k % 5 + 1, header, F.col("ts")).alias("wait"))


#: Sentences of notices about a day (d), the day two weeks later (e) and days around them: with points (p),
#: blanks (b), words (w) or short years (s); (m) is the later day without its year.
NOTICES = (
    "접수기간 : {dp}(수) ~ {ep}(수)",
    "원서접수 기간 {db} ~ {em} 18:00까지",
    "마감일 {dw}까지",
    "접수기간 ’{ds} ~ ’{es}",
    "접수기간 : {dp} ~ 채용시까지",
    "공고기간 {bp} ~ {ap} 접수기간 {dp} ~ {ep}",
    "안내 {dp} 일정 없음",
    "지원서 접수 {dp}(화) ~ {ep}(화)",
    "근무기간 : {dp} ~ {ep}",
    "제출 기간 {dp} 부터 {ep}",
    "전형 일정 ’{ds} ~ ’{es} 18시",
    "접수 {dp}(금) ~ 모집인원 충원 시까지",
    "마감일시 {dp} 18:00 이후 수시 채용",
    "지원기간 {dp} ~ {ep} | 접수마감 {ep} | 발표 {ap}",
    "응시원서 접수 {dp}까지, 발표 {ap}",
)
_WHOLE, _END_ALONE, _SHORT, _SAME_YEAR = "(0, 5, 7, 9, 13)", "(2, 14)", "(3, 10)", "(1)"


@query(
    f"""
    WITH n AS (SELECT o_orderkey, o_orderkey % {len(NOTICES)} AS k, CAST(o_orderdate AS DATE) + to_years(30) AS t FROM orders),
    p AS (SELECT o_orderkey, k, CAST(t AS DATE) AS d, CAST(t + INTERVAL 14 DAY AS DATE) AS e FROM n),
    f AS (SELECT o_orderkey,
            CASE WHEN k IN {_WHOLE} OR k IN {_SAME_YEAR} OR k IN {_SHORT} AND year(d) >= 2024 THEN strftime(d, '%Y.%m.%d') ELSE '' END AS a,
            CASE WHEN k IN {_WHOLE} OR k IN {_SHORT} AND year(d) >= 2024 THEN strftime(e, '%Y.%m.%d')
                 WHEN k IN {_SAME_YEAR} THEN strftime(d, '%Y.') || strftime(e, '%m.%d')
                 WHEN k IN {_END_ALONE} THEN strftime(d, '%Y.%m.%d') ELSE '' END AS z FROM p)
    SELECT o_orderkey, CASE WHEN z <= '2027.12.31' THEN a ELSE '' END AS first_day, CASE WHEN z <= '2027.12.31' THEN z ELSE '' END AS last_day FROM f
    """
)
def notice_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The application period that a notice's text states."""
    day = F.add_months(F.col("o_orderdate").cast("date"), 360)
    later = F.date_add(day, 14)
    forms = {"p": "yyyy.MM.dd", "b": "yyyy. M. d.", "w": "yyyy년 M월 d일", "s": "yy. M. d."}
    words = {a + k: F.date_format(d, form) for a, d in (("d", day), ("e", later), ("b", F.date_add(day, -7)), ("a", F.date_add(day, 20))) for k, form in forms.items()}
    words["em"] = F.date_format(later, "M. d.")
    text, kind = F.when(F.lit(False), ""), F.col("o_orderkey") % len(NOTICES)
    for i, notice in enumerate(NOTICES):
        parts = re.split(r"[{}]", notice)  # words and marks in turn
        text = text.when(kind == i, F.concat(*[words[p] if k % 2 else F.lit(p) for k, p in enumerate(parts)]))
    found = table(spark, sf_dir, "orders").select("o_orderkey", deadlines.period(text, "2026-01-01").alias("found"))
    return found.select("o_orderkey", "found.first_day", "found.last_day")
