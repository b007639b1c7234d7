"""Grouped statistics: ratios with states, suppressed percentiles, ranks, bands, facets, trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.scan import Cut, quantiles, same_groups, selected

def ratio_state(top: Column, bottom: Column) -> Column:
    """What is known of ``top / bottom``: unknown is not zero."""
    return (
        F.when(top.isNull() | bottom.isNull(), "unregistered")
        .when(bottom == 0, "uncomputable")
        .when(top == 0, "true_zero")
        .otherwise("present")
    )


def chain_ends(df: DataFrame, by: Sequence[Column], order: Column, first: Column, last: Column) -> DataFrame:
    """For each chain ``first`` of its first step, ``last`` of its last, and its steps; a null value
    of an end step stays null. A partial aggregate, no sort."""
    ends = df.groupBy(*by).agg(
        F.min_by(F.struct(first.alias("v")), order).alias("a"),
        F.max_by(F.struct(last.alias("v")), order).alias("b"),
        F.count("*").alias("n_steps"),
    )
    return ends.withColumns({"first_value": F.col("a.v"), "last_value": F.col("b.v")}).drop("a", "b")


def rounded(x: Column, digits: int) -> Column:
    """Half up at ``digits`` decimals of a number that counts whole units of the last of them."""
    return F.floor(x + 0.5) / 10**digits


def five_numbers(df: DataFrame, by: Sequence[str], value: str, least: int, digits: int = 2, cut: Cut = Cut()) -> DataFrame:
    """Count, minimum, quartiles and maximum by group; all but the count are null in groups of fewer
    than ``least`` rows, inside the query. Values are whole units of the last decimal, so quartiles
    between two of them are exact and halves are rounded alike everywhere."""
    units = F.round(F.col(value) * 10**digits)
    rows = df.select(*by, units.alias("_units"))
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    out = same_groups(counts, quantiles(rows, by, "_units", [0.0, 0.25, 0.5, 0.75, 1.0], "q", cut), by)
    names = ("low", "q1", "median", "q3", "high")
    return out.select(*by, "n", *[F.when(F.col("n") >= least, rounded(F.col("q")[i], digits)).alias(c) for i, c in enumerate(names)])


def upper_median(df: DataFrame, by: Sequence[str], value: str, name: str = "upper_median", cut: Cut = Cut()) -> DataFrame:
    """The value at ``n div 2`` of each group's sorted values: no mean of the middle two. Equal values
    are counted first, and a group's values are streamed in order, never held as one array. Nulls are left out."""
    middle = lambda n: [F.floor(n / 2).cast("long")]
    return selected(df, by, value, middle, cut).select(*by, F.element_at("at", middle(F.col("n"))[0]).alias(name))


def counts_below(df: DataFrame, value: str, name: str = "below", parts: int = 64) -> DataFrame:
    """For each numeric value how many rows are smaller. Values fall into ``parts`` ranges of about
    equal size; each range is summed in order by itself, and what the ranges before it hold, one
    small table, is added. Nulls are neither counted nor told."""
    df = df.filter(F.col(value).isNotNull())
    marks = df.approxQuantile(value, [i / parts for i in range(1, parts)], 0.2 / parts)
    bounds = F.array(*[F.lit(x) for x in sorted(set(marks))]).cast("array<double>")
    # the first range is 0; a value that is a bound belongs to the range above it
    part = F.size(F.filter(bounds, lambda b: b <= F.col(value)))
    counts = df.groupBy(value).agg(F.count("*").alias("_n")).withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    sums = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = counts.withColumn("_own", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return own.join(F.broadcast(sums), "_part").select(value, (F.col("_base") + F.col("_own")).alias(name))


def ranked(df: DataFrame, value: str, within: str) -> DataFrame:
    """Competition ranks, greatest first (1 + how many are greater), of all rows and within
    ``within``. A row without a value has no ranks and is in nobody's way."""
    below = counts_below(df.select((-F.col(value)).alias("_down")), "_down", "_greater")
    inside = F.when(F.col(value).isNotNull(), F.rank().over(Window.partitionBy(within).orderBy(F.desc_nulls_last(value))))
    out = df.withColumns({"rank_within": inside.cast("long"), "_down": -F.col(value)}).join(below, "_down", "left")
    return out.withColumn("rank_all", F.col("_greater") + 1).drop("_down", "_greater")


def peer_band(df: DataFrame, within: str, value: str, names=("easy", "middle", "busy"), cut: Cut = Cut()) -> DataFrame:
    """The band of each row in its group: bottom quarter, middle, top quarter."""
    marks = quantiles(df, [within], value, [0.25, 0.75], "_q", cut)
    band = F.when(F.col(value) <= F.col("_q")[0], names[0]).when(F.col(value) >= F.col("_q")[1], names[2]).otherwise(names[1])
    return df.join(marks, within).withColumn("band", band).drop("_q")


def fill_rates(df: DataFrame, columns: Sequence[str], denominators: dict[str, Column] | None = None) -> DataFrame:
    """The share of filled values of each column, one row each; a column may have its own rows as
    denominator. One pass over the table."""
    denominators = denominators or {}
    parts = []
    for c in columns:
        of = denominators.get(c, F.lit(True))
        parts += [F.count_if(of).alias(f"of_{c}"), F.count_if(of & F.col(c).isNotNull()).alias(f"has_{c}")]
    one = df.agg(*parts)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"of_{c}").alias("n_of"), F.col(f"has_{c}").alias("n_filled")) for c in columns])).alias("r")
    return one.select(rows).select("r.*").withColumn("fill_rate", F.round(F.col("n_filled") / F.col("n_of"), 4))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark cuts the groups before the shuffle as well."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= k)


def with_total(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows with the total beside each. The total is its own aggregate, not a window over
    all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def trailing(df: DataFrame, day: str, value: str, days: int = 7, share: float = 0.5) -> DataFrame:
    """Daily values with the mean of the ``days`` days before and an alarm where the value is below
    a share of it. ``df`` has a row for each day."""
    before = Window.orderBy(day).rowsBetween(-days, -1)
    out = df.withColumn("mean_before", F.avg(value).over(before))
    return out.withColumn("alarm", F.coalesce(F.col(value) < share * F.col("mean_before"), F.lit(False)))


def retention(df: DataFrame, who: str, day: Column, days: int, as_of) -> DataFrame:
    """For each day that people came first on: how many, and how many came again 1 to ``days`` days
    after; null where that time has not passed by ``as_of``."""
    visits = df.select(F.col(who).alias("who"), day.alias("day")).distinct()
    first = visits.groupBy("who").agg(F.min("day").alias("cohort"))
    back = visits.join(first, "who").select("cohort", "who", F.date_diff("day", "cohort").alias("after"))
    out = back.groupBy("cohort").agg(
        F.count_if(F.col("after") == 0).alias("n_people"),
        *[F.count_if(F.col("after") == d).alias(f"d{d}") for d in range(1, days + 1)],
    )
    mature = F.date_add("cohort", days) <= F.lit(as_of).cast("date")
    return out.select("cohort", "n_people", mature.alias("mature"), *[F.when(mature, F.col(f"d{d}")).alias(f"d{d}") for d in range(1, days + 1)])


def gap_stats(df: DataFrame, by: Sequence[str], day: Column, least: int = 5) -> DataFrame:
    """Median and longest gap in days between the days on which a route has rows; judged only with
    ``least`` gaps."""
    days = df.select(*by, day.alias("day")).distinct()
    gap = F.date_diff("day", F.lag("day").over(Window.partitionBy(*by).orderBy("day")))
    out = days.withColumn("gap", gap).groupBy(*by).agg(F.count("gap").alias("n_gaps"), F.median("gap").alias("m"), F.max("gap").alias("longest_gap"))
    return out.select(*by, "n_gaps", "longest_gap", F.when(F.col("n_gaps") >= least, F.col("m")).alias("median_gap"))


def streaks(df: DataFrame, by: Sequence[str], order: Column, failed: Column, least: int) -> DataFrame:
    """Runs of ``least`` failures in a row (gaps and islands): group, first and last place, length."""
    w = Window.partitionBy(*by).orderBy(order)
    good = F.sum((~failed).cast("int")).over(w)
    runs = df.withColumns({"_run": good, "_at": order}).filter(failed)
    return runs.groupBy(*by, "_run").agg(F.min("_at").alias("first_at"), F.max("_at").alias("last_at"), F.count("*").alias("n_failed")).filter(F.col("n_failed") >= least).drop("_run")
