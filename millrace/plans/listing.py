"""Projections, filters and orders of lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import lists
from millrace.plans.registry import query, table
from millrace.plans.wording import chosen

RENAMED = {"o_orderkey": "id", "o_orderstatus": "status", "o_orderpriority": "tab"}


@query(
    """
    SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS tab,
           concat_ws(',', CASE WHEN o_orderkey % 2 > 0 THEN 'cust=' || o_custkey END, CASE WHEN o_orderkey % 3 > 0 THEN 'status=' || o_orderstatus END) AS detail,
           (o_orderkey % 2 > 0)::INTEGER + (o_orderkey % 3 > 0)::INTEGER AS n_keys
    FROM orders
    """
)
def packed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns renamed by a map, others packed into a map without its nulls."""
    k = F.col("o_orderkey")
    detail = lists.packed_map({"cust": F.when(k % 2 > 0, F.col("o_custkey")), "status": F.when(k % 3 > 0, F.col("o_orderstatus"))})
    rows = table(spark, sf_dir, "orders").withColumn("detail", detail)
    pairs = F.transform(F.map_entries("detail"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.withColumnsRenamed(RENAMED).select("id", "status", "tab", F.array_join(pairs, ",").alias("detail"), F.size("detail").alias("n_keys"))


@query(
    """
    SELECT part.p_partkey, NOT (p_type LIKE 'PROMO%') AND brand IS NOT NULL AND p_size IN (1, 5, 9, 13, 17, 21) AND p_retailprice BETWEEN 1000 AND 1800 AS wanted,
           (list_contains(edited, 'size') OR list_contains(edited, 'type')) AND (locked OR p_size > 20) AS touched
    FROM part JOIN (SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS brand, p_partkey % 3 = 0 AS locked,
                      CASE p_partkey % 3 WHEN 0 THEN ['size'] WHEN 1 THEN ['name', 'type'] ELSE ['name'] END AS edited FROM part) e USING (p_partkey)
    """
)
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not like, is not null, in, a range, and arrays that hold one of some values beside booleans."""
    k = F.col("p_partkey")
    edited = F.when(k % 3 == 0, F.array(F.lit("size"))).when(k % 3 == 1, F.array(F.lit("name"), F.lit("type"))).otherwise(F.array(F.lit("name")))
    part = table(spark, sf_dir, "part").withColumns({"brand": F.when(k % 4 > 0, F.col("p_brand")), "edited": edited, "locked": k % 3 == 0})
    wanted = ~F.col("p_type").like("PROMO%") & F.col("brand").isNotNull() & F.col("p_size").isin(1, 5, 9, 13, 17, 21) & F.col("p_retailprice").between(1000, 1800)
    touched = F.arrays_overlap("edited", F.array(F.lit("size"), F.lit("type"))) & (F.col("locked") | (F.col("p_size") > 20))
    return part.select("p_partkey", wanted.alias("wanted"), touched.alias("touched"))


@query(
    """
    SELECT 'none' AS asked, count(*) AS n FROM customer UNION ALL SELECT 'segment', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT 'both', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3
    """
)
def optional_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters whose parameters may be missing; a missing one filters nothing."""
    customer = table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey")
    asked = {"none": (None, None), "segment": ("BUILDING", None), "both": ("BUILDING", 3)}
    found = [
        lists.optional_filter(customer, {"c_mktsegment": a, "c_nationkey": b}).agg(F.count("*").alias("n")).select(F.lit(name).alias("asked"), "n")
        for name, (a, b) in asked.items()
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    """
    WITH t AS (SELECT p_brand, p_name, p_name NOT LIKE '%blue%' AS a, regexp_matches(p_name, 'a|o') AS b FROM part)
    SELECT p_brand, count(*) AS n_all, count(*) FILTER (a) AS n_after_skip, count(*) FILTER (a AND b) AS n_left,
           CASE WHEN count(*) FILTER (a) = 0 THEN 'skip' WHEN count(*) FILTER (a AND b) = 0 THEN 'need' END AS emptied_by
    FROM t GROUP BY p_brand
    """
)
def filter_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title filters of a site in their order, how many rows each leaves, and which one left none."""
    stages = [("skip", ~F.col("p_name").rlike("blue")), ("need", F.col("p_name").rlike("a|o"))]
    return lists.staged_counts(table(spark, sf_dir, "part"), ["p_brand"], stages).withColumnsRenamed({"n_after_need": "n_left"})


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_custkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 'field missing' WHEN d < 1 THEN 'over' WHEN d > 30 THEN 'too far'
             WHEN NOT (o_orderpriority LIKE '1%' OR o_totalprice >= 400000) THEN 'too small' END AS reason
    FROM (SELECT *, CAST(o_orderdate AS DATE) - DATE '1998-03-01' AS d FROM orders)
    """
)
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason for which a row is not eligible, null for those that are."""
    k, days = F.col("o_orderkey"), F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1998-03-01").cast("date"))
    fields = [F.when(k % 7 > 0, k), F.when(F.col("o_custkey") % 11 > 0, k), F.when(k % 13 > 0, k)]
    missing = F.exists(F.array(*fields), lambda x: x.isNull())
    large = F.col("o_orderpriority").startswith("1") | (F.col("o_totalprice") >= 400000)
    reason = F.when(missing, "field missing").when(days < 1, "over").when(days > 30, "too far").when(~large, "too small")
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


AGENTS = ("Mozilla/5.0 Chrome", "Googlebot/2.1", "Mozilla/5.0 Safari", "curl/8", "facebookexternalhit", "HeadlessChrome", "Mozilla Yeti")


@query(
    """
    SELECT event_type, count(*) AS n FROM events WHERE event_id % 7 IN (0, 2) AND event_id % 5 > 0 AND value BETWEEN 1 AND 400 GROUP BY event_type
    """
)
def human_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without robots, prefetches and values that nobody sends."""
    k = F.col("event_id")
    events = table(spark, sf_dir, "events").withColumns({"agent": chosen(AGENTS, k), "purpose": F.when(k % 5 == 0, "prefetch")})
    human = ~lists.is_robot(F.col("agent")) & ~F.coalesce(F.col("purpose").rlike("(?i)prefetch|preview"), F.lit(False))
    return events.filter(human & F.col("value").between(1, 400)).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    """
    WITH r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END, o_orderkey) AS by_grade,
             row_number() OVER (ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN '9999' ELSE o_orderpriority END, o_orderkey) AS nulls_last,
             row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS hot FROM orders)
    SELECT 'grade' AS mode, by_grade AS place, o_orderkey FROM r WHERE by_grade <= 10 UNION ALL SELECT 'nulls last', nulls_last, o_orderkey FROM r WHERE nulls_last <= 10
    UNION ALL SELECT 'hot', hot, o_orderkey FROM r WHERE hot <= 10
    UNION ALL SELECT 'deadline', row_number() OVER (ORDER BY d, o_orderkey), o_orderkey FROM (SELECT d, o_orderkey FROM r WHERE o_orderkey % 4 > 0 ORDER BY d, o_orderkey LIMIT 10)
    UNION ALL SELECT 'new', row_number() OVER (ORDER BY o_orderkey DESC), o_orderkey FROM (SELECT o_orderkey FROM r ORDER BY o_orderkey DESC LIMIT 10)
    """
)
def sort_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rows in each order: by grade and then arrival, nulls last, score and then newest,
    by deadline (rows without one go), newest. Each is a top-k, no sort of all rows."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_totalprice",
        F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2).alias("grade"),
        F.when(k % 3 > 0, F.col("o_orderpriority")).alias("tab"),
        F.when(k % 4 > 0, F.col("o_orderdate").cast("date")).alias("deadline"),
    )
    modes = {
        "grade": [F.asc("grade"), F.asc("o_orderkey")],
        "nulls last": [F.asc_nulls_last("tab"), F.asc("o_orderkey")],
        "hot": [F.desc("o_totalprice"), F.desc("o_orderkey")],
        "deadline": [F.asc("deadline"), F.asc("o_orderkey")],
        "new": [F.desc("o_orderkey")],
    }
    out = None
    for mode, order in modes.items():
        rows = orders.filter("deadline is not null") if mode == "deadline" else orders
        top = rows.orderBy(*order).limit(10)
        # a window over ten rows
        place = F.row_number().over(Window.orderBy(*order))
        one = top.select(F.lit(mode).alias("mode"), place.cast("long").alias("place"), "o_orderkey")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """
    WITH w AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) AS place,
                 count(*) OVER (PARTITION BY l_orderkey, l_suppkey) AS size FROM lineitem)
    SELECT l_orderkey, l_suppkey, l_partkey, place, size, place = size AS is_last FROM w WHERE l_orderkey % 5 = 0
    """
)
def steps_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each step in its group, the group's size, and whether it is the last."""
    group = Window.partitionBy("l_orderkey", "l_suppkey")
    steps = table(spark, sf_dir, "lineitem").filter("l_orderkey % 5 = 0").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")
    out = steps.withColumns({"place": F.row_number().over(group.orderBy("l_linenumber", "l_partkey")).cast("long"), "size": F.count("*").over(group)})
    return out.select("l_orderkey", "l_suppkey", "l_partkey", "place", "size", (F.col("place") == F.col("size")).alias("is_last"))


TRAILING = (1, 7, 21, 30)


@query(
    "SELECT n_days, event_type, count(*) AS n, count(DISTINCT user_id) AS n_people FROM events JOIN (VALUES (1), (7), (21), (30)) t(n_days) "
    "ON CAST(ts AS DATE) > DATE '2024-01-30' - n_days AND CAST(ts AS DATE) <= DATE '2024-01-30' GROUP BY n_days, event_type"
)
def trailing_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type over the last 1, 7, 21 and 30 days, in one pass over the events."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.date_diff(F.lit("2024-01-30").cast("date"), F.col("ts").cast("date")).alias("ago"))
    return lists.trailing_counts(events, "ago", TRAILING, ["event_type"], "user_id")


@query(
    """
    SELECT doc_id, coalesce(max(d), '') AS latest FROM (SELECT doc_id, unnest(CASE doc_id % 3 WHEN 0 THEN ['2024.05.01', '2024.04.30'] WHEN 1 THEN ['2023.12.31', '2024.01.02'] ELSE [NULL] END) AS d FROM documents) GROUP BY doc_id
    """
)
def latest_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest date that a list page has: zero-padded dates compare as texts."""
    rows = chosen(("2024.5.1 a 2024.04.30", "b 2023-12-31 2024/1/2", "none 2024.13.40"), F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(lists.latest_date(rows), F.lit("")).alias("latest"))


@query(
    """
    SELECT doc_id, year(DATE '2026-01-01') - 1 > y AS stale FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 2019 WHEN 1 THEN 2026 WHEN 3 THEN 2030 END AS y FROM documents)
    WHERE doc_id % 4 IN (0, 1)
    UNION ALL SELECT doc_id, false FROM documents WHERE doc_id % 4 IN (2, 3)
    """
)
def undated_stale_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles whose newest year is before last year's, of rows that have no date at all."""
    k = F.col("doc_id")
    title, posted = chosen(("2018 and 2019 jobs", "jobs of 2026", "jobs", "2001 jobs"), k), F.when(k % 4 == 3, F.lit("2025-01-01"))
    return table(spark, sf_dir, "documents").select("doc_id", lists.stale_title(title, 2026, posted).alias("stale"))
