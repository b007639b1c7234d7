"""Statistics over chains, groups, ranks, days and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates, money
from millrace.operators import match, stats
from millrace.plans.registry import query, table

@query(
    """
    WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id,
                 CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END AS applicants,
                 CASE WHEN event_type <> 'error' THEN CAST(floor(value / 100) AS BIGINT) END AS hires
               FROM events),
    e AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) AS a,
                 row_number() OVER (PARTITION BY user_id, day ORDER BY event_id DESC) AS b FROM s),
    c AS (SELECT user_id, day, max(CASE WHEN a = 1 THEN applicants END) AS applicants,
                 max(CASE WHEN b = 1 THEN hires END) AS hires FROM e GROUP BY user_id, day),
    r AS (SELECT *, CASE WHEN applicants IS NULL OR hires IS NULL THEN 'unregistered'
                         WHEN hires = 0 THEN 'uncomputable' WHEN applicants = 0 THEN 'true_zero'
                         ELSE 'present' END AS state FROM c),
    v AS (SELECT *, CASE WHEN state = 'present' THEN round(applicants / hires, 2) END AS ratio FROM r)
    SELECT user_id, count(*) AS n_chains, count(ratio) AS n_present, round(avg(ratio), 4) AS avg_ratio,
           min(ratio) AS min_ratio, max(ratio) AS max_ratio,
           count(*) FILTER (state = 'uncomputable') AS n_uncomputable,
           count(*) FILTER (state = 'unregistered') AS n_unregistered,
           min(day) AS first_day, max(day) AS last_day
    FROM v GROUP BY user_id
    """
)
def competition_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicants of a chain's first step over hires of its last, averaged over what is known."""
    known = F.col("event_type") != "error"
    chains = stats.chain_ends(
        table(spark, sf_dir, "events"),
        [F.col("user_id"), F.col("ts").cast("date").alias("day")],
        F.col("event_id"),
        F.when(known, F.floor("value").cast("long")),
        F.when(known, F.floor(F.col("value") / 100).cast("long")),
    )
    chains = chains.withColumn("state", stats.ratio_state(F.col("first_value"), F.col("last_value")))
    ratio = F.when(F.col("state") == "present", F.round(F.col("first_value") / F.col("last_value"), 2))
    return (
        chains.withColumn("ratio", ratio)
        .groupBy("user_id")
        .agg(
            F.count("*").alias("n_chains"),
            F.count("ratio").alias("n_present"),
            F.round(F.avg("ratio"), 4).alias("avg_ratio"),
            F.min("ratio").alias("min_ratio"),
            F.max("ratio").alias("max_ratio"),
            F.count_if(F.col("state") == "uncomputable").alias("n_uncomputable"),
            F.count_if(F.col("state") == "unregistered").alias("n_unregistered"),
            F.min("day").alias("first_day"),
            F.max("day").alias("last_day"),
        )
    )


@query(
    """
    SELECT n_name, o_orderpriority, count(*) AS n_orders, count(DISTINCT o_orderstatus) AS n_status,
           count(DISTINCT o_orderstatus) > 1 AS ambiguous,
           array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS status_list
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name, o_orderpriority
    """
)
def group_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose members disagree in a residual field."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        F.broadcast(nation), customer.c_nationkey == nation.n_nationkey
    )
    kinds = F.array_sort(F.collect_set("o_orderstatus"))
    out = joined.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n_orders"), kinds.alias("kinds"))
    return out.select(
        "n_name",
        "o_orderpriority",
        "n_orders",
        F.size("kinds").cast("long").alias("n_status"),
        (F.size("kinds") > 1).alias("ambiguous"),
        F.array_join("kinds", ",").alias("status_list"),
    )


@query(
    """
    WITH g AS (SELECT c_mktsegment, c_nationkey, count(*) AS n, quantile_cont(round(c_acctbal * 100), [0, 0.25, 0.5, 0.75, 1]) AS q
               FROM customer GROUP BY c_mktsegment, c_nationkey)
    SELECT c_mktsegment, c_nationkey, n,
           CASE WHEN n >= 12 THEN floor(q[1] + 0.5) / 100 END AS low, CASE WHEN n >= 12 THEN floor(q[2] + 0.5) / 100 END AS q1,
           CASE WHEN n >= 12 THEN floor(q[3] + 0.5) / 100 END AS median, CASE WHEN n >= 12 THEN floor(q[4] + 0.5) / 100 END AS q3,
           CASE WHEN n >= 12 THEN floor(q[5] + 0.5) / 100 END AS high
    FROM g
    """
)
def five_number_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-number summaries, hidden for small groups."""
    return stats.five_numbers(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], "c_acctbal", 12)


@query(
    """
    SELECT s_suppkey, s_nationkey, s_acctbal,
           rank() OVER (ORDER BY s_acctbal DESC) AS rank_all,
           rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS rank_within
    FROM supplier
    """
)
def peer_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National and regional competition rank."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return stats.ranked(suppliers, "s_acctbal", "s_nationkey").select(
        "s_suppkey", "s_nationkey", "s_acctbal", "rank_all", "rank_within"
    )


@query(
    """
    WITH m AS (SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.75) AS b
               FROM part GROUP BY p_brand)
    SELECT p_partkey, p.p_brand, CASE WHEN p_retailprice <= a THEN 'easy' WHEN p_retailprice >= b THEN 'busy'
           ELSE 'middle' END AS band
    FROM part p JOIN m ON p.p_brand = m.p_brand
    """
)
def peer_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom quarter, middle and top quarter within a kind."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    return stats.peer_band(parts, "p_brand", "p_retailprice").select("p_partkey", "p_brand", "band")


@query(
    """
    SELECT r_name, n_name, count(*) AS n, grouping(r_name) AS no_region, grouping(n_name) AS no_nation
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY GROUPING SETS ((r_name, n_name), (r_name), ())
    """
)
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by region and nation, by region, and in all."""
    for name in ("customer", "nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"facet_{name}")
    return spark.sql(
        """
        SELECT r_name, n_name, count(*) AS n, CAST(grouping(r_name) AS BIGINT) AS no_region,
               CAST(grouping(n_name) AS BIGINT) AS no_nation
        FROM facet_customer JOIN facet_nation ON c_nationkey = n_nationkey
        JOIN facet_region ON n_regionkey = r_regionkey
        GROUP BY GROUPING SETS ((r_name, n_name), (r_name), ())
        """
    )


@query(
    """
    SELECT count(*) AS n_all, count(*) FILTER (o_orderstatus = 'O') AS n_open,
           count(*) FILTER (o_orderstatus = 'F') AS n_done,
           count(*) FILTER (o_orderpriority LIKE '1-%') AS n_urgent,
           count(*) FILTER (o_totalprice >= 100000) AS n_large,
           count(*) FILTER (o_orderdate >= TIMESTAMP '2000-01-01') AS n_late
    FROM orders
    """
)
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of several states in one pass."""
    return table(spark, sf_dir, "orders").agg(
        F.count("*").alias("n_all"),
        F.count_if(F.col("o_orderstatus") == "O").alias("n_open"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_done"),
        F.count_if(F.col("o_orderpriority").like("1-%")).alias("n_urgent"),
        F.count_if(F.col("o_totalprice") >= 100000).alias("n_large"),
        F.count_if(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).alias("n_late"),
    )


@query(
    """
    WITH p AS (SELECT p_size, CASE WHEN p_size > 10 THEN p_brand END AS brand,
                      CASE WHEN p_retailprice < 1500 THEN p_type END AS kind FROM part)
    SELECT 'brand' AS column_name, count(*) AS n_of, count(brand) AS n_filled, round(count(brand) / count(*), 4) AS fill_rate FROM p
    UNION ALL
    SELECT 'kind', count(*) FILTER (p_size > 25), count(kind) FILTER (p_size > 25),
           round(count(kind) FILTER (p_size > 25) / count(*) FILTER (p_size > 25), 4) FROM p
    """
)
def fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How filled columns are, one with a denominator of its own."""
    parts = table(spark, sf_dir, "part").select(
        "p_size",
        F.when(F.col("p_size") > 10, F.col("p_brand")).alias("brand"),
        F.when(F.col("p_retailprice") < 1500, F.col("p_type")).alias("kind"),
    )
    return stats.fill_rates(parts, ["brand", "kind"], {"kind": F.col("p_size") > 25})


@query(
    """
    WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1),
    m AS (SELECT day, n, avg(n) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean FROM d)
    SELECT day, n, round(mean, 6) AS mean_before, coalesce(n < 0.5 * mean, false) AS alarm FROM m
    """
)
def trailing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day against the mean of the week before. Days are few, so one sorted window is enough."""
    days = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return stats.trailing(days, "day", "n").withColumn("mean_before", F.round("mean_before", 6))


RETENTION_SQL = ", ".join(
    f"CASE WHEN cohort + 7 <= DATE '2024-01-30' THEN count(DISTINCT CASE WHEN day - cohort = {d} THEN who END) END AS d{d}"
    for d in range(1, 8)
)


@query(
    f"""
    WITH v AS (SELECT DISTINCT user_id AS who, CAST(ts AS DATE) AS day FROM events WHERE user_id % 3 > 0 OR day(ts) > 9),
    b AS (SELECT who, day, min(day) OVER (PARTITION BY who) AS cohort FROM v)
    SELECT cohort, count(DISTINCT who) AS n_people, cohort + 7 <= DATE '2024-01-30' AS mature, {RETENTION_SQL}
    FROM b GROUP BY cohort
    """
)
def cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns on days 1 to 7 by the day of the first visit; young cohorts are null."""
    late = (F.col("user_id") % 3 > 0) | (F.day("ts") > 9)  # else everybody comes on the first day
    return stats.retention(table(spark, sf_dir, "events").filter(late), "user_id", F.col("ts").cast("date"), 7, "2024-01-30")


@query(
    """
    WITH u AS (SELECT CAST(ts AS DATE) AS day, user_id, bool_or(event_type = 'view') AS v,
                      bool_or(event_type = 'signup') AS s, bool_or(event_type = 'purchase') AS p
               FROM events GROUP BY 1, 2),
    c AS (SELECT day, count(*) FILTER (v) AS n_view, count(*) FILTER (v AND s) AS n_signup,
                 count(*) FILTER (v AND s AND p) AS n_purchase FROM u GROUP BY day)
    SELECT *, CASE WHEN n_view > 0 THEN round(100 * (1 - n_purchase / n_view), 2) END AS drop_percent FROM c
    """
)
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View, then signup, then purchase on one day, and what is lost."""
    did = lambda kind: F.bool_or(F.col("event_type") == kind)
    people = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"), "user_id").agg(
        did("view").alias("v"), did("signup").alias("s"), did("purchase").alias("p")
    )
    days = people.groupBy("day").agg(
        F.count_if("v").alias("n_view"),
        F.count_if(F.col("v") & F.col("s")).alias("n_signup"),
        F.count_if(F.col("v") & F.col("s") & F.col("p")).alias("n_purchase"),
    )
    share = F.when(F.col("n_view") > 0, F.round(100 * (1 - F.col("n_purchase") / F.col("n_view")), 2))
    return days.withColumn("drop_percent", share)


@query(
    """
    SELECT o_custkey, o_orderkey, o_totalprice, place FROM
      (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)
    WHERE place <= 3
    """
)
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest orders of each customer."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return stats.top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query(
    """
    SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total
    FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40
    """
)
def paged_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of twenty, with the total beside each row."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return stats.with_total(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 40, 20)


@query(
    """
    WITH r AS (SELECT user_id, CASE WHEN value < 100 THEN 'low' WHEN value < 300 THEN 'mid' ELSE 'high' END AS reason,
                      count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2)
    SELECT user_id, CAST(sum(n) AS BIGINT) AS n_errors,
           array_to_string(list(reason || ':' || n ORDER BY n DESC, reason), ',') AS reasons
    FROM r GROUP BY user_id
    """
)
def failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by place, and in each place by reason, most frequent first."""
    reason = match.bracket(F.col("value"), [(100, "low"), (300, "mid")], "high")
    counts = (
        table(spark, sf_dir, "events").filter(F.col("event_type") == "error").groupBy("user_id", reason.alias("reason")).agg(F.count("*").alias("n"))
    )
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "reason")))
    text = F.transform(listed, lambda x: F.concat_ws(":", x["reason"], (-x["m"]).cast("string")))
    return counts.groupBy("user_id").agg(F.sum("n").alias("n_errors"), F.array_join(text, ",").alias("reasons"))


@query(
    """
    WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'),
    g AS (SELECT user_id, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS gap FROM d)
    SELECT user_id, count(gap) AS n_gaps, max(gap) AS longest_gap,
           CASE WHEN count(gap) >= 5 THEN median(gap) END AS median_gap
    FROM g GROUP BY user_id
    """
)
def gap_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and longest gap between days with a purchase, judged from five gaps on."""
    bought = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    out = stats.gap_stats(bought, ["user_id"], F.col("ts").cast("date"))
    return out.withColumn("longest_gap", F.col("longest_gap").cast("long"))


@query(
    """
    WITH e AS (SELECT user_id, event_id, event_type = 'error' AS failed,
                 count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events)
    SELECT user_id, min(event_id) AS first_at, max(event_id) AS last_at, count(*) AS n_failed
    FROM e WHERE failed GROUP BY user_id, run HAVING count(*) >= 3
    """
)
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three or more failures in a row."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return stats.streaks(events, ["user_id"], F.col("event_id"), F.col("event_type") == "error", 3)


@query(
    """
    SELECT user_id, list_sort(list(value))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_median, round(median(value), 6) AS median
    FROM events GROUP BY user_id
    """
)
def two_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median and the mean of the middle two; they are not the same."""
    events = table(spark, sf_dir, "events").select("user_id", "value")
    mean = events.groupBy("user_id").agg(F.round(F.median("value"), 6).alias("median"))
    return stats.upper_median(events, ["user_id"], "value").join(mean, "user_id")


@query(
    """
    WITH p AS (SELECT c_custkey, floor(abs(c_acctbal)) AS base, c_custkey % 7 AS extra, CASE WHEN c_custkey % 5 > 0 THEN 300 END AS bonus,
                      c_custkey % 4 AS n FROM customer),
    y AS (SELECT *, 12 * base + 12 * extra + coalesce(bonus, 0) + 12 * 15 * n AS annual FROM p),
    b AS (SELECT *, (SELECT count(*) FROM y z WHERE z.annual < y.annual) AS below, (SELECT count(*) FROM y) AS n_all FROM y)
    SELECT c_custkey, CAST(annual AS BIGINT) AS annual, CAST(floor(annual / 12 * 10000 / (174 + n) + 0.5) AS BIGINT) AS hourly,
           n_all - below AS rank, CAST(floor((1 - below / n_all) * 100 + 0.5) AS BIGINT) AS top_percent
    FROM b
    """
)
def pay_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year's pay, an hour's, and the rank among all by how many are below."""
    n = F.col("c_custkey") % 4
    bonus = F.when(F.col("c_custkey") % 5 > 0, 300)
    annual = money.annual_pay(F.floor(F.abs("c_acctbal")), F.col("c_custkey") % 7, bonus, duty=[(F.lit(15), n)])
    rows = table(spark, sf_dir, "customer").select("c_custkey", annual.cast("long").alias("annual"), n.alias("n"))
    below = stats.counts_below(rows, "annual")
    total = rows.agg(F.count("annual").alias("n_all"))
    rank, share = money.rank_from_below(F.col("n_all"), F.col("below"))
    return rows.join(below, "annual", "left").join(F.broadcast(total)).select(
        "c_custkey",
        "annual",
        money.hourly_wage(F.col("annual"), F.col("n"), F.lit(0)).alias("hourly"),
        rank.alias("rank"),
        share.alias("top_percent"),
    )


@query(
    """
    SELECT o_orderkey, CASE WHEN d < 0 THEN 'closed' WHEN label IS NOT NULL THEN label WHEN d = 0 THEN 'today' ELSE 'D-' || d END AS badge,
           d BETWEEN 0 AND 3 AS urgent, d < 0 AS closed
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) - DATE '1998-06-01' AS d,
                 CASE WHEN o_orderkey % 11 = 0 THEN 'rolling' END AS label FROM orders)
    """
)
def deadline_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines against a stated day."""
    day, today = F.col("o_orderdate").cast("date"), F.lit("1998-06-01").cast("date")
    label = F.when(F.col("o_orderkey") % 11 == 0, "rolling")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        dates.deadline_badge(day, today, label).alias("badge"),
        dates.is_urgent(day, today).alias("urgent"),
        dates.is_closed(day, today).alias("closed"),
    )


@query(
    """
    SELECT o_orderkey, d,
           (year(t) - year(d)) * 12 + month(t) - month(d) - CASE WHEN day(t) < day(d) THEN 1 ELSE 0 END AS months,
           CAST(d - INTERVAL 1 MONTH AS DATE) AS month_before
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, DATE '2001-10-30' AS t FROM orders)
    """
)
def calendar_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole months to a day, and a month before with the month's end where days are missing."""
    day, today = F.col("d"), F.lit("2001-10-30").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")).select(
        "o_orderkey",
        "d",
        dates.months_between_floor(day, today).cast("long").alias("months"),
        dates.months_ago(day, 1).alias("month_before"),
    )
