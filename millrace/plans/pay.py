"""Pay, tax, severance and allowances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import money
from millrace.plans.registry import query, table

#: A withholding table made by a rule: brackets of 500 thousand from 770 thousand on.
LOW, STEP, N_BRACKETS = 770, 500, 19


def _amount(k: int, person: int) -> int:
    return max(0, 2000 * k * k - 700 * k * (person - 1))


def _brackets() -> tuple[Column, Column]:
    row = lambda k: F.array(*[F.lit(_amount(k, p)) for p in range(1, money.PERSONS + 1)])
    rows = [F.struct(F.lit(LOW + STEP * k).alias("low"), F.lit(LOW + STEP * (k + 1)).alias("high"), row(k).alias("amounts")) for k in range(N_BRACKETS)]
    return F.array(*rows), row(N_BRACKETS)


W10 = "floor(floor({} + 0.5) / 10) * 10"
TAX_ROW = "greatest(0, 2000 * {k} * {k} - 700 * {k} * ({p} - 1))"
EXCESS_SQL = (
    "CASE WHEN g <= 10000000 THEN 0 WHEN g <= 14000000 THEN 25000 + (g - 10000000) * (0.98::DOUBLE * 0.35::DOUBLE) "
    "WHEN g <= 28000000 THEN 1397000 + (g - 14000000) * (0.98::DOUBLE * 0.38::DOUBLE) "
    "WHEN g <= 30000000 THEN 6610600 + (g - 28000000) * (0.98::DOUBLE * 0.40::DOUBLE) "
    "WHEN g <= 45000000 THEN 7394600 + (g - 30000000) * 0.40::DOUBLE WHEN g <= 87000000 THEN 13394600 + (g - 45000000) * 0.42::DOUBLE "
    "ELSE 31034600 + (g - 87000000) * 0.45::DOUBLE END"
)


def _table_tax(p: str) -> str:
    k = f"floor((g / 1000.0 - {LOW}) / {STEP})"
    low = f"CASE WHEN g / 1000.0 < {LOW} OR {k} >= {N_BRACKETS} THEN 0 ELSE {TAX_ROW.format(k=k, p=p)} END"
    return f"(CASE WHEN g < 10000000 THEN {low} ELSE {TAX_ROW.format(k=N_BRACKETS, p=p)} + {EXCESS_SQL} END)"


NET_SQL = f"""
    t AS (SELECT *, {W10.format('g * 0.0475::DOUBLE')} AS pension, {W10.format('g * 0.03595::DOUBLE')} AS health, {W10.format('g * 0.009::DOUBLE')} AS employment,
            {W10.format(f"CASE WHEN persons <= 11 THEN {_table_tax('persons')} ELSE greatest(0, {_table_tax('11')} - ({_table_tax('10')} - {_table_tax('11')}) * (persons - 11)) END")} AS tax
          FROM p),
    u AS (SELECT *, {W10.format('health * 0.1314::DOUBLE')} AS care, {W10.format('tax * 0.1::DOUBLE')} AS local FROM t)
"""


@query(
    f"""
    WITH p AS (SELECT o_orderkey, CAST(floor(o_totalprice) * 100 AS DOUBLE) AS g, o_custkey % 14 + 1 AS persons FROM orders), {NET_SQL}
    SELECT o_orderkey, CAST(pension AS BIGINT) AS pension, CAST(health AS BIGINT) AS health, CAST(care AS BIGINT) AS care, CAST(employment AS BIGINT) AS employment,
           CAST(tax AS BIGINT) AS tax, CAST(local AS BIGINT) AS local, CAST(g - pension - health - care - employment - tax - local AS BIGINT) AS net
    FROM u
    """
)
def net_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is withheld from a month's pay, by a bracket table and beyond it, and the net."""
    gross, persons = F.floor("o_totalprice").cast("double") * 100, F.col("o_custkey") % 14 + 1
    taken = money.net_from_gross(gross, persons, *_brackets())
    return table(spark, sf_dir, "orders").select("o_orderkey", taken.alias("t")).select("o_orderkey", "t.*")


@query(
    f"""
    WITH RECURSIVE b AS (
      SELECT s_suppkey, floor(abs(s_acctbal)) * 1000 AS target, s_suppkey % 5 + 1 AS persons, CAST(floor(abs(s_acctbal)) * 1000 AS DOUBLE) AS low,
             CAST(floor(abs(s_acctbal)) * 2000 + 1000000 AS DOUBLE) AS high, 0 AS i FROM supplier
      UNION ALL
      (WITH p AS (SELECT *, floor((low + high) / 2 + 0.5) AS g, (low + high) / 2 AS mid FROM b WHERE i < 40), {NET_SQL},
      v AS (SELECT *, g - pension - health - care - employment - tax - local AS net FROM u)
      SELECT s_suppkey, target, persons, CASE WHEN net < target THEN mid ELSE low END, CASE WHEN net < target THEN high ELSE mid END, i + 1 FROM v))
    SELECT s_suppkey, CASE WHEN target = 0 THEN 0 ELSE CAST(floor(high + 0.5) AS BIGINT) END AS gross FROM b WHERE i = 40
    """
)
def gross_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gross pay of a net one, by forty halvings."""
    target, persons = F.floor(F.abs("s_acctbal")) * 1000, F.col("s_suppkey") % 5 + 1
    brackets, top = _brackets()
    net_of = lambda g: money.net_from_gross(g, persons, brackets, top)["net"]
    found = money.gross_from_net(F.col("target"), net_of, low=F.col("target"), high=F.col("target") * 2 + 1_000_000)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", target.alias("target"))
    return rows.select("s_suppkey", F.when(F.col("target") == 0, 0).otherwise(money.half_up(found)).cast("long").alias("gross"))


@query(
    """
    WITH p AS (SELECT c_custkey, floor(abs(c_acctbal)) * 900 AS monthly, 89 + c_custkey % 4 AS d3, c_custkey % 13 AS years, c_custkey % 3 = 0 AS old FROM customer),
    q AS (SELECT *, monthly * 3 / d3 AS share, floor(monthly * 3 / d3 * 0.6::DOUBLE + 0.5) AS own,
            CASE WHEN years >= 10 THEN CASE WHEN old THEN 270 ELSE 240 END WHEN years >= 5 THEN CASE WHEN old THEN 240 ELSE 210 END
                 WHEN years >= 3 THEN CASE WHEN old THEN 210 ELSE 180 END WHEN years >= 1 THEN CASE WHEN old THEN 180 ELSE 150 END ELSE 120 END AS days FROM p)
    SELECT c_custkey, CAST(floor(share) AS BIGINT) AS daily_wage, CAST(least(68100, greatest(66048, own)) AS BIGINT) AS allowance,
           CASE WHEN own > 68100 THEN 'upper' WHEN own < 66048 THEN 'lower' ELSE 'none' END AS bound, days,
           CAST(least(68100, greatest(66048, own)) * days AS BIGINT) AS total
    FROM q
    """
)
def unemployment_allowance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job-seeker's allowance with the bound that it met."""
    k = F.col("c_custkey")
    found = money.unemployment(F.floor(F.abs("c_acctbal")) * 900, 89 + k % 4, k % 13, k % 3 == 0)
    return table(spark, sf_dir, "customer").select("c_custkey", found.alias("u")).select("c_custkey", "u.*")


@query(
    """
    WITH p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, floor(o_totalprice) * 10 AS monthly, CASE WHEN o_orderkey % 4 > 0 THEN 1200 * (o_orderkey % 50) END AS bonus,
                 CAST(o_orderdate AS DATE) - CAST(o_custkey % 2000 AS INTEGER) AS j FROM orders)
    SELECT o_orderkey, CAST(CASE WHEN d - j >= 365 THEN floor((monthly * 3 + coalesce(bonus, 0) * 3 / 12) / (d - CAST(d - INTERVAL 3 MONTH AS DATE)) * 30 * (d - j) / 365 + 0.5) ELSE 0 END AS BIGINT) AS severance
    FROM p
    """
)
def severance_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severance from the last three months' real calendar days."""
    k, left = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    bonus = F.when(k % 4 > 0, 1200 * (k % 50))
    joined = F.date_sub(left, (F.col("o_custkey") % 2000).cast("int"))
    pay = money.severance_pay(F.floor("o_totalprice") * 10, bonus, F.lit(None).cast("int"), joined, left)
    return table(spark, sf_dir, "orders").select("o_orderkey", pay.cast("long").alias("severance"))


THOUSANDS = "format('{{:,}}', CAST({} AS BIGINT))"
MAN = "floor({} / 10000)"


@query(
    f"""
    WITH p AS (SELECT p_partkey, ['월', '연', '시급', '일급', '주급'][CAST(p_partkey % 5 + 1 AS INTEGER)] AS period,
                 CAST(floor(p_retailprice * 100) * CASE WHEN p_partkey % 3 = 0 THEN 100 ELSE 37 END AS BIGINT) AS low, p_size FROM part),
    q AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN low + p_size * 10000 WHEN p_partkey % 4 = 1 THEN low END AS high,
            CASE period WHEN '월' THEN '월 ' WHEN '연' THEN '' ELSE period || ' ' END AS lead FROM p),
    r AS (SELECT *, coalesce(high <> low, false) AS two FROM q)
    SELECT p_partkey, lead || CASE WHEN period IN ('시급', '일급', '주급')
             THEN {THOUSANDS.format('low')} || '원' || CASE WHEN two THEN '~' || {THOUSANDS.format('high')} || '원' ELSE '' END
             WHEN two THEN CASE WHEN low % 10000 > 0 OR high % 10000 > 0 THEN '약 ' ELSE '' END || {THOUSANDS.format(MAN.format('low'))} || '~' || {THOUSANDS.format(MAN.format('high'))} || '만원'
             ELSE CASE WHEN low % 10000 > 0 THEN '약 ' ELSE '' END || {THOUSANDS.format(MAN.format('low'))} || '만원' END AS shown,
           CASE WHEN p_size < 10 THEN 10 WHEN p_size < 30 THEN 30 ELSE 100 END AS goal,
           CAST(least(100, floor(p_size / (CASE WHEN p_size < 10 THEN 10 WHEN p_size < 30 THEN 30 ELSE 100 END) * 100 + 0.5)) AS BIGINT) AS percent
    FROM r
    """
)
def pay_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How pay is shown, and the goal that a sample is on the way to."""
    k = F.col("p_partkey")
    period = F.get(F.array(*[F.lit(x) for x in ("월", "연", "시급", "일급", "주급")]), (k % 5).cast("int"))
    low = (F.floor(F.col("p_retailprice") * 100) * F.when(k % 3 == 0, 100).otherwise(37)).cast("long")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", period.alias("period"), low.alias("low"))
    high = F.when(k % 2 == 0, F.col("low") + F.col("p_size") * 10000).when(k % 4 == 1, F.col("low"))
    goal = money.sample_goal(F.col("p_size"))
    return rows.select(
        "p_partkey", money.pay_text(F.col("low"), high, F.col("period")).alias("shown"), goal["goal"].alias("goal"), goal["percent"].alias("percent")
    )


@query(
    """
    SELECT p_partkey, CASE WHEN x >= 10000 THEN regexp_replace(printf('%.2f', floor(x / 100 + 0.5) / 100), '\\.?0+$', '') || '억원'
                           ELSE format('{:,}', CAST(floor(x + 0.5) AS BIGINT)) || '만원' END AS shown
    FROM (SELECT p_partkey, p_partkey * 37 % 60000 + 0.5 AS x FROM part)
    """
)
def ten_thousands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums in units of ten thousand and hundred million."""
    x = F.col("p_partkey") * 37 % 60000 + 0.5
    return table(spark, sf_dir, "part").select("p_partkey", money.in_ten_thousands(x).alias("shown"))


@query(
    """
    WITH p AS (SELECT c_mktsegment, CASE WHEN c_nationkey < 5 THEN 'a' ELSE 'b' END AS kind, floor(abs(c_acctbal)) AS pay FROM customer WHERE c_custkey % 3 > 0)
    SELECT c_mktsegment, kind, count(*) AS n, CASE WHEN count(*) >= 20 THEN median(pay) END AS median_pay,
           CASE WHEN count(*) >= 20 THEN round(count(*) FILTER (pay < 4000) / count(*), 6) END AS reach
    FROM p GROUP BY c_mktsegment, kind
    """
)
def salary_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, median and the share below a given pay by job and kind, hidden under twenty."""
    rows = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 3 > 0).select(
        "c_mktsegment", F.when(F.col("c_nationkey") < 5, "a").otherwise("b").alias("kind"), F.floor(F.abs("c_acctbal")).alias("pay")
    )
    enough = F.count("*") >= 20
    return rows.groupBy("c_mktsegment", "kind").agg(
        F.count("*").alias("n"),
        F.when(enough, F.median("pay")).alias("median_pay"),
        F.when(enough, F.round(F.count_if(F.col("pay") < 4000) / F.count("*"), 6)).alias("reach"),
    )
