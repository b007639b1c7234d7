"""Dates: validity, distances, deadlines. The day of reference is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URGENT_DAYS = 3


def lenient_date(text: Column) -> Column:
    """``YYYY[.-/]M[.-/]D`` or ``YYYYMMDD`` as an ISO text if month and day are within 1-12 and
    1-31; the 30th of February passes."""
    pattern = r"^\s*(\d{4})(?:[.\-/]\s*(\d{1,2})[.\-/]\s*(\d{1,2})\.?|(\d{2})(\d{2}))\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    month = F.when(part(2) != "", part(2)).otherwise(part(4)).try_cast("int")
    day = F.when(part(3) != "", part(3)).otherwise(part(5)).try_cast("int")
    good = month.between(1, 12) & day.between(1, 31)
    return F.when(good, F.format_string("%s-%02d-%02d", part(1), month, day))


def strict_date(text: Column) -> Column:
    """A date only where the lenient form is a day of the calendar."""
    return lenient_date(text).try_cast("date")


def days_between(start: Column, end: Column) -> Column:
    return F.date_diff(end, start)


def months_between_floor(start: Column, end: Column) -> Column:
    """Whole months, by the day of the month: the 31st to the 30th is a day short."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return months - (F.day(end) < F.day(start)).cast("int")


def months_ago(day: Column, months: int) -> Column:
    """The same day ``months`` before, at the month's end where it has no such day."""
    return F.add_months(day, -months)


def is_closed(deadline: Column, today: Column, time: Column | None = None, now: Column | None = None) -> Column:
    """No deadline: open. An earlier day: closed. Today: open all day, or until after ``time``."""
    closed = F.when(deadline.isNull(), False).when(deadline < today, True)
    if time is not None:
        closed = closed.when((deadline == today) & time.isNotNull(), now > time)
    return closed.otherwise(False)


def deadline_badge(deadline: Column, today: Column, label: Column | None = None) -> Column:
    """``closed``, an explicit label, ``today`` or ``D-n``; without a date the label or ``open``."""
    label = F.lit(None).cast("string") if label is None else label
    days = F.date_diff(deadline, today)
    return (
        F.when(deadline.isNull(), F.coalesce(label, F.lit("open")))
        .when(days < 0, "closed")
        .when(label.isNotNull(), label)
        .when(days == 0, "today")
        .otherwise(F.concat(F.lit("D-"), days.cast("string")))
    )


def is_urgent(deadline: Column, today: Column) -> Column:
    return F.coalesce(F.date_diff(deadline, today).between(0, URGENT_DAYS), F.lit(False))


def course_end(end: Column, start: Column, posted: Column, days: int = 30) -> tuple[Column, Column]:
    """The day after which a course is over and what it comes from: its end, its start, its posting
    and some days, or never."""
    day = F.coalesce(end, start, F.date_add(posted, days))
    why = F.when(end.isNotNull(), "end").when(start.isNotNull(), "start").when(posted.isNotNull(), "posted")
    return day, why.otherwise("never")


def plausible_window(begin: Column, end: Column, posted: Column, today: Column) -> Column:
    """Whether an application window can be believed: it does not end before it begins or before its
    posting (3 days of grace), and lies within 400 days of today."""
    late = F.when(posted.isNotNull(), end >= F.date_sub(posted, 3)).otherwise(end >= F.date_sub(today, 400))
    return F.coalesce(begin <= end, F.lit(True)) & late & (end <= F.date_add(today, 400))


def retry_minutes(attempt: Column) -> Column:
    """Minutes before the next attempt; null gives up."""
    return F.when(attempt == 1, 1).when(attempt == 2, 5).when(attempt == 3, 30)


#: Hours that Korea's clock is ahead of UTC.
KST_HOURS = 9


def kst_day(instant: Column) -> Column:
    """The day in Korea of a UTC time."""
    return (instant + F.expr(f"INTERVAL {KST_HOURS} HOURS")).cast("date")


def day_of_digits(text: Column) -> Column:
    """``YYYYMMDD`` as a day, only where the calendar has it."""
    return F.when(F.trim(text).rlike("^[0-9]{8}$"), F.try_to_date(F.trim(text), "yyyyMMdd"))


def day_of_millis(millis: Column) -> Column:
    """The day in Korea of milliseconds since 1970."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((millis + KST_HOURS * 3_600_000) / 86_400_000).cast("int"))


def period_of(text: Column) -> tuple[Column, Column]:
    """The first two days that a text has as eight digits; what is no day of the calendar is passed over."""
    found = F.transform(F.regexp_extract_all(text, F.lit("[0-9]{8}"), F.lit(0)), lambda d: F.try_to_date(d, "yyyyMMdd"))
    days = F.filter(found, lambda d: d.isNotNull())
    return F.get(days, F.lit(0)), F.get(days, F.lit(1))


def always_open(code: Column, text: Column, fixed: str) -> Column:
    """Whether there is no period: the code is not that of a fixed one and no day is written."""
    return ~F.coalesce(code, F.lit("")).eqNullSafe(fixed) & period_of(F.coalesce(text, F.lit("")))[0].isNull()


def time_words(time: Column) -> Column:
    """``HH:MM`` in words: the last minute of the day is midnight, the rest is before or after noon."""
    hour, minute = F.substring(time, 1, 2).cast("int"), F.substring(time, 4, 2).cast("int")
    shown = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    words = F.concat(F.when(hour < 12, "오전 ").otherwise("오후 "), shown.cast("string"), F.lit("시"), F.when(minute > 0, F.concat(F.lit(" "), minute.cast("string"), F.lit("분"))).otherwise(""))
    return F.when(time.isin("23:59", "24:00"), "자정").otherwise(words)


def deadline_time(text: Column, day: Column) -> Column:
    """``HH:MM`` within 18 characters after the deadline's own date (written with or without zeros and
    blanks), unless another date stands between; else null."""
    gap = F.lit(r"\s*[./-]\s*")
    number = lambda x: F.concat(F.lit("0?"), x.cast("string"))
    anchor = F.concat(F.year(day).cast("string"), gap, number(F.month(day)), gap, number(F.day(day)))
    rest = F.regexp_substr(text, F.concat(anchor, F.lit(r"[\s\S]{0,18}")))
    after = F.substring(rest, F.length(F.regexp_substr(text, anchor)) + 1, F.lit(18))
    before, hour, minute = (F.regexp_extract(after, r"^([\s\S]*?)([0-9]{1,2}):([0-9]{2})", i) for i in (1, 2, 3))
    good = (hour != "") & (hour.try_cast("int") <= 23) & (minute.try_cast("int") <= 59) & ~before.rlike(r"[0-9]{4}\s*[./-]")
    return F.when(good, F.concat(F.lpad(hour, 2, "0"), F.lit(":"), minute))


def too_far(day_text: Column, today: Column, days: int = 730) -> Column:
    """Whether a date, ``YYYY.MM.DD`` or with hyphens, is more than two years ahead: zero-padded dates
    compare as texts."""
    limit = F.date_format(F.date_add(today, days), "yyyy.MM.dd")
    return F.coalesce(F.replace(day_text, F.lit("-"), F.lit(".")) > limit, F.lit(False))


def graduation(entered: Column, years: Column) -> Column:
    """The first of the month of graduation: entry, the years of the course, less a month."""
    return F.add_months(F.trunc(entered, "month"), (years * 12 - 1).cast("int"))


def free_until(graduated: Column) -> Column:
    """The last day of the same month a year later."""
    return F.last_day(F.add_months(graduated, 12))


#: Minutes to wait after the first, second and third failure; the fourth gives up.
BACK_OFF = (1, 5, 30)


def retry_after(attempt: Column, header: Column, now: Column) -> Column:
    """Seconds before the next attempt: what the header asks for (seconds, or a date of HTTP), given up
    where that is more than the longest wait; else by the number of the attempt. Null gives up."""
    seconds = F.when(F.trim(header).rlike("^[0-9]+$"), F.trim(header).try_cast("long"))
    stamp = F.try_to_timestamp(F.regexp_replace(header, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    ahead = stamp.cast("timestamp").cast("long") - now.cast("timestamp").cast("long")
    wait = F.coalesce(seconds, F.when(ahead.isNotNull(), F.greatest(ahead, F.lit(0))))
    own = F.lit(None).cast("long")
    for i, minutes in reversed(list(enumerate(BACK_OFF, 1))):
        own = F.when(attempt == i, minutes * 60).otherwise(own)
    asked = F.when(wait <= BACK_OFF[-1] * 60, wait)
    return F.when(attempt > len(BACK_OFF), None).when(wait.isNotNull(), asked).otherwise(own).cast("long")


def believed(day_text: Column, today: Column, days: int = 730) -> Column:
    """A deadline as it is believed: the day, or nothing and the original text where it is too far ahead."""
    far = too_far(day_text, today, days)
    return F.struct(F.when(~far, day_text).alias("day"), F.when(far, day_text).alias("distrusted"))
