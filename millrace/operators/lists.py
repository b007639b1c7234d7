"""Maps, filters and counts of lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed_map(values: Mapping[str, Column]) -> Column:
    """A map of the values that are not null, as texts; a key without a value is left out."""
    pairs = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def optional_filter(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Rows equal to every parameter that is given; one that is None filters nothing, so no condition
    stands in the plan for it."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def staged_counts(df: DataFrame, by: Sequence[str], stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """How many rows of each group pass the first, the first two, ... of some conditions, and the name
    of the one after which none was left. One aggregate."""
    counts, upto = [F.count("*").alias("n_all")], F.lit(True)
    for name, holds in stages:
        upto = upto & F.coalesce(holds, F.lit(False))
        counts.append(F.count_if(upto).alias(f"n_after_{name}"))
    out = df.groupBy(*by).agg(*counts)
    emptied = F.when(F.lit(False), "")
    for name, _ in stages:
        emptied = emptied.when(F.col(f"n_after_{name}") == 0, name)
    return out.withColumn("emptied_by", emptied)


#: Words in the name of a program that fetches pages for no reader (fixed values).
ROBOTS = "bot|crawl|spider|slurp|yeti|headless|externalhit|curl|wget|python-requests|preview"


def is_robot(agent: Column) -> Column:
    """Whether a visitor is a program; without a name it is."""
    return F.coalesce(F.lower(agent).rlike(ROBOTS), F.lit(True))


def trailing_counts(df: DataFrame, ago: str, days: Sequence[int], by: Sequence[str], who: str) -> DataFrame:
    """Rows and different people by group over the last ``days`` days each; ``ago`` counts days back
    from today. A row is sent to every span that it lies in, after it was counted once by day."""
    spans = F.filter(F.array(*map(F.lit, days)), lambda d: d > F.col(ago))
    daily = df.filter((F.col(ago) >= 0) & (F.col(ago) < max(days))).groupBy(*by, ago, who).agg(F.count("*").alias("_n"))
    each = daily.withColumn("n_days", F.explode(spans))
    return each.groupBy("n_days", *by).agg(F.sum("_n").alias("n"), F.count_distinct(who).alias("n_people"))


def latest_date(text: Column) -> Column:
    """The latest date in a text, as ``YYYY.MM.DD``; months and days out of range are none."""
    found = F.regexp_extract_all(text, F.lit(r"(20[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2})"), F.lit(1))
    parts = F.transform(found, lambda d: F.split(d, "[./-]"))
    good = F.filter(parts, lambda p: p[1].cast("int").between(1, 12) & p[2].cast("int").between(1, 31))
    return F.array_max(F.transform(good, lambda p: F.concat(p[0], F.lit("."), F.lpad(p[1], 2, "0"), F.lit("."), F.lpad(p[2], 2, "0"))))


def stale_title(title: Column, year: int, *dates: Column) -> Column:
    """Whether a row without any date has a title whose newest year is before last year."""
    years = F.transform(F.regexp_extract_all(title, F.lit("(20[0-9]{2})"), F.lit(1)), lambda y: y.cast("int"))
    undated = F.coalesce(*dates).isNull() if dates else F.lit(True)
    return undated & F.coalesce(F.array_max(years) < year - 1, F.lit(False))
