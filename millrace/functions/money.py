"""Pay, tax and leave. Rounding is half up, at the stage where the rule has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours of a month that a base salary pays for (fixed value).
MONTH_HOURS = 174


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def floor_to(x: Column, unit: int) -> Column:
    """Rounded to a whole number first, then down to the unit."""
    return F.floor(half_up(x) / unit) * unit


def annual_pay(base: Column, extra: Column, bonus: Column, duty=(), weekend=()) -> Column:
    """A year's pay from monthly base and extra, yearly bonus and (pay, number) of duties a month;
    what is missing is zero."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = 12 * zero(base) + 12 * zero(extra) + zero(bonus)
    for pay, number in (*duty, *weekend):
        total = total + 12 * zero(pay) * zero(number)
    return total


def hourly_wage(annual: Column, duty_hours: Column, weekend_hours: Column) -> Column:
    """Won an hour from a year's pay in units of ten thousand."""
    hours = MONTH_HOURS + F.coalesce(duty_hours, F.lit(0)) + F.coalesce(weekend_hours, F.lit(0))
    return half_up(annual / 12 * 10000 / hours)


def rank_from_below(n: Column, below: Column) -> tuple[Column, Column]:
    """Rank and the share from the top in percent, from how many are below."""
    return n - below, half_up((1 - below / n) * 100)


def annual_leave(days_worked: Column, months_worked: Column) -> Column:
    """Days of leave: one for each month of the first year (11 at most), then 15 and one more for
    every two years after the third, 25 at most."""
    years = F.floor(months_worked / 12)
    later = F.least(F.lit(25), 15 + F.floor(F.greatest(years - 1, F.lit(0)) / 2))
    return F.when(years < 1, F.least(months_worked, F.lit(11))).otherwise(later)


def severance(daily_average: Column, days_worked: Column) -> Column:
    """Thirty days' average for each year; nothing under a year."""
    return F.when(days_worked >= 365, half_up(daily_average * 30 * days_worked / 365)).otherwise(0)


def gross_from_net(net: Column, net_of, high: Column, steps: int = 40, low: Column | None = None) -> Column:
    """The gross pay whose ``net_of(gross)`` is ``net``, by bisection between ``low`` (0) and ``high``."""
    start = F.struct((F.lit(0.0) if low is None else low.cast("double")).alias("low"), high.cast("double").alias("high"))

    def halve(s, _):
        mid = (s["low"] + s["high"]) / 2
        under = net_of(mid) < net
        return F.struct(
            F.when(under, mid).otherwise(s["low"]).alias("low"), F.when(under, s["high"]).otherwise(mid).alias("high")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["high"])


#: Shares of a month's pay (fixed values of 2026): pension, health, care as a share of health,
#: employment insurance.
PENSION, HEALTH, CARE_OF_HEALTH, EMPLOYMENT = 0.0475, 0.03595, 0.1314, 0.009
#: Income tax on what a month's pay exceeds ten million by: up to, tax at the bracket's start, start,
#: share of the excess (fixed values).
EXCESS = (
    (14_000_000, 25_000, 10_000_000, 0.98 * 0.35),
    (28_000_000, 1_397_000, 14_000_000, 0.98 * 0.38),
    (30_000_000, 6_610_600, 28_000_000, 0.98 * 0.40),
    (45_000_000, 7_394_600, 30_000_000, 0.40),
    (87_000_000, 13_394_600, 45_000_000, 0.42),
    (None, 31_034_600, 87_000_000, 0.45),
)
#: Persons that a withholding table has columns for.
PERSONS = 11


def won10(x: Column) -> Column:
    """Rounded to a whole won, then down to ten."""
    return floor_to(x, 10)


def excess_tax(gross: Column) -> Column:
    """What is added to the tax of ten million for pay beyond it."""
    out = F.when(gross <= 10_000_000, F.lit(0.0))
    for high, base, start, share in EXCESS[:-1]:
        out = out.when(gross <= high, base + (gross - start) * share)
    _, base, start, share = EXCESS[-1]
    return out.otherwise(base + (gross - start) * share)


def table_tax(gross: Column, persons: Column, brackets: Column, top: Column) -> Column:
    """Tax by a withholding table: ``brackets`` is an array of structs (low, high, amounts) in
    thousands, low <= x < high, ``top`` the amounts at ten million; both have a column for each of 1
    to PERSONS persons. Below the first bracket there is none."""
    at = lambda amounts: F.get(amounts, (F.least(persons, F.lit(PERSONS)) - 1).cast("int"))
    row = F.get(F.filter(brackets, lambda b: (gross / 1000 >= b["low"]) & (gross / 1000 < b["high"])), F.lit(0))
    return F.when(gross < 10_000_000, F.coalesce(at(row["amounts"]), F.lit(0))).otherwise(at(top) + excess_tax(gross))


def withheld(gross: Column, persons: Column, brackets: Column, top: Column) -> Column:
    """The month's income tax. Beyond the table's persons, each one lessens it as the last did."""
    n = F.greatest(F.floor(persons), F.lit(1))
    last, before = (table_tax(gross, F.lit(i), brackets, top) for i in (PERSONS, PERSONS - 1))
    many = F.greatest(F.lit(0), last - (before - last) * (n - PERSONS))
    return won10(F.when(n <= PERSONS, table_tax(gross, n, brackets, top)).otherwise(many))


def net_from_gross(gross: Column, persons: Column, brackets: Column, top: Column) -> Column:
    """A struct of what is taken from a month's pay, and the net."""
    g = F.greatest(half_up(gross), F.lit(0))
    pension, health, employment = won10(g * PENSION), won10(g * HEALTH), won10(g * EMPLOYMENT)
    care, tax = won10(health * CARE_OF_HEALTH), withheld(g, persons, brackets, top)
    local = won10(tax * 0.1)
    total = pension + health + care + employment + tax + local
    parts = {"pension": pension, "health": health, "care": care, "employment": employment, "tax": tax, "local": local, "net": g - total}
    return F.struct(*[x.cast("long").alias(c) for c, x in parts.items()])


def severance_pay(monthly: Column, bonus: Column, leave_pay: Column, joined: Column, left: Column, months: int = 3) -> Column:
    """Severance from the average of the last months: their real calendar days, and three twelfths of
    a year's bonus and leave pay. Under a year of work there is none."""
    days = F.date_diff(left, F.add_months(left, -months))
    wage = monthly * months + F.coalesce(bonus, F.lit(0)) * months / 12 + F.coalesce(leave_pay, F.lit(0)) * months / 12
    return severance(wage / days, F.date_diff(left, joined))


#: Job-seeker's allowance (fixed values of 2026): its share of the daily wage, its upper and lower
#: bounds, and the days by time insured (from, under 50, 50 and more).
ALLOWANCE, ALLOWANCE_HIGH, ALLOWANCE_LOW = 0.6, 68_100, 66_048
ALLOWANCE_DAYS = ((0, 120, 120), (1, 150, 180), (3, 180, 210), (5, 210, 240), (10, 240, 270))


def unemployment(monthly: Column, days3: Column, years: Column, over_fifty: Column) -> Column:
    """The daily wage (rounded down), the daily allowance (from the wage before rounding, half up), the
    bound that it met, its days and its total."""
    share = monthly * 3 / days3
    own = half_up(share * ALLOWANCE)
    day = F.least(F.greatest(own, F.lit(ALLOWANCE_LOW)), F.lit(ALLOWANCE_HIGH))
    bound = F.when(own > ALLOWANCE_HIGH, "upper").when(own < ALLOWANCE_LOW, "lower").otherwise("none")
    days = F.lit(None).cast("int")
    for least, young, old in ALLOWANCE_DAYS:
        days = F.when(years >= least, F.when(over_fifty, old).otherwise(young)).otherwise(days)
    return F.struct(
        F.floor(share).alias("daily_wage"), day.cast("long").alias("allowance"), bound.alias("bound"), days.alias("days"), (day * days).cast("long").alias("total")
    )


def thousands(x: Column) -> Column:
    """A whole number with separators."""
    return F.format_number(x, 0)


def in_ten_thousands(x: Column) -> Column:
    """An amount in units of ten thousand: from 10,000 of them on in hundred millions with up to two
    decimals, else whole with separators."""
    large = F.regexp_replace(F.format_string("%.2f", half_up(x / 100) / 100), r"\.?0+$", "")
    return F.when(x >= 10_000, F.concat(large, F.lit("억원"))).otherwise(F.concat(thousands(half_up(x)), F.lit("만원")))


def amount_text(won: Column) -> Column:
    """A sum of won in units of ten thousand, with whether it is only about so much."""
    rest = won % 10_000
    return F.struct(F.concat(thousands(F.floor(won / 10_000)), F.lit("만원")).alias("text"), (rest > 0).alias("about"))


def pay_text(low: Column, high: Column, period: Column) -> Column:
    """How a pay is shown: hourly, daily and weekly pay in won, monthly and yearly in units of ten
    thousand, one sum or a range, with "약" only where less than a unit is cut off."""
    lead = F.when(period == "월", "월 ").when(period == "연", "").otherwise(F.concat(period, F.lit(" ")))
    won = lambda x: F.concat(thousands(x), F.lit("원"))
    two = high.isNotNull() & (high != low)
    small = F.concat(won(low), F.when(two, F.concat(F.lit("~"), won(high))).otherwise(""))
    a, b = amount_text(low), amount_text(high)
    about = lambda x: F.when(x, "약 ").otherwise("")
    ranged = F.concat(about(a["about"] | b["about"]), F.replace(a["text"], F.lit("만원"), F.lit("")), F.lit("~"), b["text"])
    large = F.when(two, ranged).otherwise(F.concat(about(a["about"]), a["text"]))
    return F.concat(lead, F.when(period.isin("시급", "일급", "주급"), small).otherwise(large))


#: Goals of a sample: under, goal (fixed values); beyond the last, the next hundred.
GOALS = ((10, 10), (30, 30), (100, 100))


def sample_goal(n: Column) -> Column:
    """The goal that a sample of ``n`` is on the way to, and the percent that is reached."""
    goal = F.ceil((n + 1) / 100) * 100
    for under, own in reversed(GOALS):
        goal = F.when(n < under, own).otherwise(goal)
    return F.struct(goal.cast("long").alias("goal"), F.least(half_up(n / goal * 100), F.lit(100)).cast("long").alias("percent"))
