"""Filters, lookups beside a row, and merged groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import dates, labels, text
from millrace.operators import match, dedup, stats
from millrace.plans.registry import query, table


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%2%' OR p_brand ILIKE '%brand#1%' OR p_type ILIKE '%steel%'")
def search_three_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term in any of three columns, whatever its case."""
    found = F.col("p_name").ilike("%2%") | F.col("p_brand").ilike("%brand#1%") | F.col("p_type").ilike("%steel%")
    return table(spark, sf_dir, "part").filter(found).select("p_partkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')")
def multi_valued_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comma-separated filter after an allow list; one value stands for two, unknown ones go."""
    wide = {"BUILDING": ["BUILDING"], "HOME": ["MACHINERY", "HOUSEHOLD"]}
    asked = "BUILDING,HOME,NONSENSE"
    values = [v for a in asked.split(",") for v in wide.get(a, [])]
    return table(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin(values)).select("c_custkey", "c_mktsegment")


@query(
    """
    SELECT o_orderkey, d >= p - 3 AND b <= d AND d <= DATE '1998-01-01' + 400 AS plausible,
           CASE WHEN d > DATE '1998-01-01' + 730 THEN NULL ELSE d END AS trusted
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 5 AS INTEGER) + 2 AS b,
                 CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 AS INTEGER) AS p FROM orders)
    """
)
def plausible_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application windows that can be believed; days too far ahead are not trusted."""
    day, k, today = F.col("o_orderdate").cast("date"), F.col("o_orderkey"), F.lit("1998-01-01").cast("date")
    begin, posted = F.date_add(day, (2 - k % 5).cast("int")), F.date_add(day, (k % 7).cast("int"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        dates.plausible_window(begin, day, posted, today).alias("plausible"),
        F.when(day <= F.date_add(today, 730), day).alias("trusted"),
    )


@query(
    """
    SELECT p_partkey, similar_key, place FROM (SELECT a.p_partkey, b.p_partkey AS similar_key,
      row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(a.p_size - b.p_size), b.p_partkey) AS place
      FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey) WHERE place <= 3
    """
)
def similar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows of equal brand and type, nearest in size."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    near = match.nearest_in_group(part, ["p_brand", "p_type"], "p_size", "p_partkey", 3)
    return near.withColumnRenamed("similar_p_partkey", "similar_key")


@query(
    """
    SELECT p_partkey, size IS NULL AND bool_or(size IS NOT NULL) OVER (PARTITION BY p_brand, p_type) AS sibling_knows
    FROM (SELECT *, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS size FROM part)
    """
)
def sibling_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a value of which a row of their group has one."""
    part = table(spark, sf_dir, "part").withColumn("size", F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")))
    any_known = F.max(F.col("size").isNotNull()).over(Window.partitionBy("p_brand", "p_type"))
    return part.select("p_partkey", (F.col("size").isNull() & any_known).alias("sibling_knows"))


@query(
    """
    SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids,
           CASE WHEN count(*) = count(h) THEN CAST(sum(h) AS BIGINT) END AS headcount,
           CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS status
    FROM (SELECT *, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 4 END AS h FROM orders) GROUP BY o_custkey
    """
)
def merged_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one notice as one: ids joined, numbers added if all are known, a kind if unanimous."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").withColumn("h", F.when(k % 9 > 0, k % 4))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(k)), lambda x: x.cast("string")), ",")
    out = orders.groupBy("o_custkey").agg(
        ids.alias("ids"),
        F.when(F.count("*") == F.count("h"), F.sum("h")).alias("headcount"),
        F.when(F.min("o_orderstatus") == F.max("o_orderstatus"), F.min("o_orderstatus")).alias("status"),
    )
    return out


@query(
    """
    SELECT p_partkey, concat_ws(',', CASE WHEN p_size <= 10 THEN 'brand' END, CASE WHEN p_retailprice >= 1500 THEN 'kind' END) AS missing
    FROM part WHERE p_size <= 10 OR p_retailprice >= 1500
    """
)
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with blanks, and which fields are blank."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_size") > 10, F.col("p_brand")).alias("brand"),
        F.when(F.col("p_retailprice") < 1500, F.col("p_type")).alias("kind"),
    )
    blanks = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("brand", "kind")]))
    return part.select("p_partkey", blanks.alias("blanks")).filter(F.size("blanks") > 0).select("p_partkey", F.array_join("blanks", ",").alias("missing"))


@query(
    """
    WITH k AS (SELECT c_nationkey, CASE c_custkey % 3 WHEN 0 THEN 'ID:' || c_custkey WHEN 1 THEN 'NAME:' || c_custkey % 20 END AS key FROM customer)
    SELECT count(*) FILTER (key LIKE 'ID:%') AS n_id, count(*) FILTER (key LIKE 'NAME:%') AS n_name, count(*) FILTER (key IS NULL) AS n_none,
           (SELECT count(*) FROM (SELECT key FROM k WHERE key LIKE 'NAME:%' GROUP BY key HAVING count(DISTINCT c_nationkey) > 1)) AS n_suspect
    FROM k
    """
)
def match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How rows were matched, and names that span several regions."""
    n = F.col("c_custkey")
    key = F.when(n % 3 == 0, F.concat(F.lit("ID:"), n.cast("string"))).when(n % 3 == 1, F.concat(F.lit("NAME:"), (n % 20).cast("string")))
    keyed = table(spark, sf_dir, "customer").select("c_nationkey", key.alias("key"))
    spans = keyed.groupBy("key").agg(F.count("*").alias("n"), (F.min("c_nationkey") < F.max("c_nationkey")).alias("spans"))
    count = lambda holds: F.coalesce(F.sum(F.when(holds, F.col("n"))), F.lit(0))
    return spans.agg(
        count(F.col("key").startswith("ID:")).alias("n_id"),
        count(F.col("key").startswith("NAME:")).alias("n_name"),
        count(F.col("key").isNull()).alias("n_none"),
        F.count_if(F.col("key").startswith("NAME:") & F.col("spans")).alias("n_suspect"),
    )


@query(
    """
    SELECT event_type, round(s / 3600, 3) AS hours_late, s > 36 * 3600 AS late FROM
      (SELECT event_type, floor(epoch(TIMESTAMP '2024-02-01') - epoch(max(ts))) AS s FROM events GROUP BY event_type)
    """
)
def lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours since the last beat of each route, against what is expected."""
    last = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("last"))
    seconds = F.timestamp_diff("SECOND", F.col("last").cast("timestamp"), F.lit("2024-02-01").cast("timestamp"))
    return last.select("event_type", F.round(seconds / 3600, 3).alias("hours_late"), (seconds > 36 * 3600).alias("late"))


@query("SELECT user_id, arg_min(event_id, (-CAST(floor(value / 50) AS BIGINT), event_id)) AS event_id FROM events GROUP BY user_id")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate of the best score; the first of equals."""
    score = F.floor(F.col("value") / 50)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", score.alias("score"))
    return dedup.first_wins(rows, [F.col("user_id")], F.struct((-F.col("score")).alias("s"), "event_id")).select("user_id", "event_id")


@query(
    """
    WITH h AS (SELECT p_partkey, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(ord(c) AS BIGINT))),
                 lambda a, c: (a * 31 + c) % 4294967296) AS h FROM part)
    SELECT p_partkey, CASE h % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS choice FROM h
    """
)
def stable_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A choice that looks random and is always the same for a name."""
    unsigned = F.pmod(text.string_hash(F.col("p_name")), F.lit(1 << 32))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, "abc")), (unsigned % 3).cast("int")).alias("choice"))


@query(
    """
    SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, 'extra' FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 > 0
    """
)
def config_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a second list are added only for names that the first does not have."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    first = part.filter(k % 3 == 0).select("p_partkey", "p_name")
    second = part.filter(k % 2 == 0).select("p_partkey", F.lit("extra").alias("p_name"))
    return first.unionByName(second.join(first.select("p_partkey"), "p_partkey", "left_anti"))


@query(
    """
    SELECT c_mktsegment, count(*) AS n_of, count(*) FILTER (c_acctbal > 0) AS n_covered,
           round(100 * count(*) FILTER (c_acctbal > 0) / count(*), 2) AS percent, count(*) < 100 AS few
    FROM customer GROUP BY c_mktsegment
    """
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by category, with a mark on small denominators."""
    out = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n_of"), F.count_if(F.col("c_acctbal") > 0).alias("n_covered"))
    return out.withColumns({"percent": F.round(100 * F.col("n_covered") / F.col("n_of"), 2), "few": F.col("n_of") < 100})


@query(
    """
    SELECT o.o_orderkey, coalesce(s.hidden, false) AS hidden, coalesce(s.priority, o.o_orderpriority) AS o_orderpriority
    FROM orders o LEFT JOIN (SELECT o_orderkey, o_orderkey % 8 = 0 AS hidden, CASE WHEN o_orderkey % 16 = 0 THEN 'stored' END AS priority
                             FROM orders WHERE o_orderkey % 4 = 0) s ON o.o_orderkey = s.o_orderkey
    """
)
def preserved_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows keep what a stored row says of them."""
    orders, k = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("o_orderkey")
    stored = orders.filter(k % 4 == 0).select("o_orderkey", (k % 8 == 0).alias("hidden"), F.when(k % 16 == 0, "stored").alias("priority"))
    return orders.join(stored, "o_orderkey", "left").select(
        "o_orderkey", F.coalesce("hidden", F.lit(False)).alias("hidden"), F.coalesce("priority", "o_orderpriority").alias("o_orderpriority")
    )


@query(
    """
    SELECT c_custkey, nation_tags, other_tags FROM (SELECT c_custkey, list_filter(t, lambda x: x LIKE 'n%') AS nation_tags,
      list_filter(t, lambda x: x NOT LIKE 'n%') AS other_tags FROM
      (SELECT c_custkey, list_filter(['n' || c_nationkey % 3, 's' || c_custkey % 2, 'n' || c_custkey % 3], lambda x: x IS NOT NULL) AS t FROM customer))
    """
)
def subscriber_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a kind beside all others."""
    n, c = F.col("c_nationkey"), F.col("c_custkey")
    tag = lambda name, x: F.concat(F.lit(name), x.cast("string"))
    tags = F.array(tag("n", n % 3), tag("s", c % 2), tag("n", c % 3))
    nations, rest = labels.partition_tags(tags, [f"n{i}" for i in range(3)])
    return table(spark, sf_dir, "customer").select("c_custkey", nations.alias("nation_tags"), rest.alias("other_tags"))


@query(
    """
    SELECT user_id, event_id, place FROM (SELECT user_id, event_id, day, nth, row_number() OVER (PARTITION BY user_id ORDER BY day) AS place FROM
      (SELECT user_id, event_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS nth
       FROM events WHERE event_type <> 'error') WHERE nth = 1) WHERE place <= 5
    """
)
def first_complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first complete row of each day, five at most for a user."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type") != "error").select("user_id", "event_id", F.col("ts").cast("date").alias("day"))
    firsts = dedup.first_wins(events, [F.col("user_id"), F.col("day")], F.col("event_id"))
    return stats.top_per_group(firsts, ["user_id"], [F.asc("day")], 5).select("user_id", "event_id", "place")


@query(
    """
    SELECT doc_id, y AS newest_year, y < 1990 AS stale FROM
      (SELECT doc_id, list_max(list_transform(regexp_extract_all(text, '(19[0-9][0-9]|20[0-9][0-9])'), lambda x: CAST(x AS BIGINT))) AS y FROM documents)
    WHERE y IS NOT NULL
    """
)
def stale_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest year that a text names."""
    years = F.transform(F.regexp_extract_all("text", F.lit("(19[0-9][0-9]|20[0-9][0-9])"), F.lit(1)), lambda y: y.cast("long"))
    out = table(spark, sf_dir, "documents").select("doc_id", F.array_max(years).alias("newest_year"))
    return out.filter(F.col("newest_year").isNotNull()).withColumn("stale", F.col("newest_year") < 1990)
