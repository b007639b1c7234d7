"""Inputs of other forms made from the tables and read back, and functions of single values over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates, labels, money, text
from millrace.plans.registry import query, table
from millrace.plans.streams import folder
from millrace.sources import pages, readers
from millrace.streaming import jobs


@query(
    """
    SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || chr(10) || 'said "' || p_brand || '", twice' AS title, CASE WHEN p_partkey % 4 > 0 THEN trim(p_type) END AS kind
    FROM part WHERE p_partkey % 7 > 0
    """
)
def csv_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file whose header names nothing useful: quotes, embedded lines and blanks; rows without a title go."""
    path, k = folder(spark, "csv"), F.col("p_partkey")
    title = F.when(k % 7 > 0, F.concat("p_name", F.lit('\nsaid "'), "p_brand", F.lit('", twice'))).otherwise("  ")
    kind = F.when(k % 4 > 0, F.concat(F.lit(" "), "p_type", F.lit(" ")))
    written = table(spark, sf_dir, "part").select(k.alias("x1"), title.alias("x2"), kind.alias("x3"))
    written.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/part")
    return readers.positional_csv(spark, f"{path}/part", ["id", "title", "kind"], "title")


@query("SELECT c_custkey, c_name, c_nationkey AS site, c_custkey // 100 AS version FROM customer")
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files with an array of rows and a version of the file, which stands beside each row."""
    path = folder(spark, "json")
    rows = F.collect_list(F.struct("c_custkey", "c_name", F.col("c_nationkey").alias("site"))).alias("rows")
    customer = table(spark, sf_dir, "customer").withColumn("version", F.floor(F.col("c_custkey") / 100))
    files = customer.groupBy("version").agg(rows).select(F.to_json(F.struct("version", "rows")).alias("value"), (F.col("version") % 1000).alias("file"), "version")
    files.repartition("version").write.partitionBy("file", "version").text(f"{path}/customer")
    found = readers.json_rows(spark, f"{path}/customer/*/*", "rows", "c_custkey long, c_name string, site long", "version long")
    return found.select("c_custkey", "c_name", "site", "version")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name || ' & <co>' AS name, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_nationkey AS VARCHAR) ELSE '' END AS place FROM supplier")
def xml_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated elements of XML files; an element that is missing is an empty text."""
    path, k = folder(spark, "xml"), F.col("s_suppkey")
    items = table(spark, sf_dir, "supplier").select(
        k.alias("id"), F.concat("s_name", F.lit(" & <co>")).alias("name"), F.when(k % 3 > 0, F.col("s_nationkey")).alias("place")
    )
    items.write.format("xml").option("rowTag", "item").option("rootTag", "items").save(f"{path}/supplier")
    return readers.xml_items(spark, f"{path}/supplier", "item", "id string, name string, place string")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS total FROM orders")
def declared_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of entries that a list page declares, in the ways in which pages do."""
    n, k = F.format_number(F.floor("o_totalprice"), 0), F.col("o_orderkey") % 4
    html = (
        F.when(k == 0, F.concat(F.lit("<p>전체 : <b>"), n, F.lit("</b>건 (1/30)</p>")))
        .when(k == 1, F.concat(F.lit("<span>Total <i><b>"), n, F.lit("</b></i></span>")))
        .when(k == 2, F.concat(F.lit("2024-01-02 총 "), n, F.lit("건")))
        .otherwise(F.concat(n, F.lit(" rows")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", pages.declared_total(html).alias("total"))


@query(
    """
    WITH p AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, CASE WHEN starts_with(path, '/de/1') THEN TRUE WHEN starts_with(path, '/de') THEN FALSE
        WHEN starts_with(path, '/en/' || page_id % 10) THEN FALSE ELSE TRUE END AS allowed FROM p
    """
)
def robots_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a robots.txt lets a page be read: the longest rule of the groups for all agents decides."""
    lines = ["User-agent: other", "Disallow: /", "", "User-agent: some", "User-agent: *", "Disallow: /de # all", "Allow: /de/1"]
    robots = F.concat(F.lit("\n".join(lines) + "\nDisallow: /en/"), F.col("page_id") % 10)
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^.*?://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", pages.robots_allow(pages.robots_rules(robots), path).alias("allowed"))


@query(
    """
    SELECT page_id, string_split(string_split(url, '?')[1], '#')[1] ||
        CASE WHEN contains(url, '?page=') THEN '?' || string_split(string_split(url, '?')[2], '#')[1] ELSE '' END ||
        CASE WHEN contains(url, '#') THEN '#' || string_split(url, '#')[2] ELSE '' END AS url FROM pages
    """
)
def urls_without_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls of pages without a session's id, which each was given, and without campaign marks."""
    url = F.col("url")
    given = F.concat(F.regexp_extract(url, "^([^?#]*)", 1), F.lit(";jsessionid="), F.hex("page_id"), F.regexp_extract(url, "^[^?#]*(.*)$", 1))
    return table(spark, sf_dir, "pages").select("page_id", text.without_session(given).alias("url"))


@query(
    """
    WITH c AS (SELECT c_custkey, CAST(floor(abs(c_acctbal)) AS BIGINT) % 420 AS m FROM customer)
    SELECT c_custkey, CAST(CASE WHEN m < 12 THEN len(generate_series(1, least(m, 11))) ELSE least(25, 15 + len(generate_series(3, m // 12, 2))) END AS BIGINT) AS leave FROM c
    """
)
def leave_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of leave by the months worked: the first year by months, then by years."""
    months = F.floor(F.abs("c_acctbal")) % 420
    return table(spark, sf_dir, "customer").select("c_custkey", money.annual_leave(months * 30, months).cast("long").alias("leave"))


@query(
    """
    WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS k, 100 + CAST(floor(o_totalprice) AS BIGINT) % 900 AS n FROM orders)
    SELECT o_orderkey, CASE k WHEN 0 THEN n * 10000 WHEN 1 THEN n * 100000 WHEN 2 THEN n * 10000 + 1000000 WHEN 3 THEN n * 1000 END AS low,
        CASE k WHEN 0 THEN (n + 50) * 10000 WHEN 1 THEN n * 100000 WHEN 2 THEN n * 10000 + 1000000 WHEN 3 THEN n * 1000 END AS high,
        CASE k WHEN 0 THEN 'month' WHEN 1 THEN 'year' WHEN 2 THEN CASE WHEN n >= 900 THEN 'year' ELSE 'month' END WHEN 3 THEN 'day' END AS period FROM o
    """
)
def pay_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range and period that a pay text names: both ends under one unit, thousands, bare numbers."""
    k, n = F.col("o_orderkey") % 5, 100 + F.floor("o_totalprice") % 900
    said = (
        F.when(k == 0, F.concat(F.lit("월급 "), n, F.lit("~"), n + 50, F.lit("만원")))
        .when(k == 1, F.concat(F.lit("연봉 "), F.format_number(n * 10, 0), F.lit("만원")))
        .when(k == 2, F.concat(F.format_number(n * 10_000 + 1_000_000, 0), F.lit("원")))
        .when(k == 3, F.concat(F.lit("일급 "), n, F.lit("천원")))
        .otherwise(F.concat(F.lit("시급 "), n, F.lit("원")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.pay_range(said).alias("p")).select("o_orderkey", "p.low", "p.high", "p.period")


@query(
    """
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END AS posted, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 10 END AS begin,
        CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) + 40 END AS until FROM orders)
    SELECT o_orderkey, CASE WHEN until IS NOT NULL THEN until WHEN begin IS NOT NULL THEN begin ELSE posted + 30 END AS day,
        CASE WHEN until IS NOT NULL THEN 'end' WHEN begin IS NOT NULL THEN 'start' WHEN posted IS NOT NULL THEN 'posted' ELSE 'never' END AS why FROM o
    """
)
def course_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day after which a course is over: of its end, its start or its posting."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    end, why = dates.course_end(F.when(k % 4 == 0, F.date_add(day, 40)), F.when(k % 3 == 0, F.date_add(day, 10)), F.when(k % 5 > 0, day))
    return table(spark, sf_dir, "orders").select("o_orderkey", end.cast("date").alias("day"), why.alias("why"))


@query(
    """
    SELECT p_partkey, p_brand || chr(CAST(44032 + p_partkey % 11172 AS INTEGER)) || CASE WHEN (p_partkey % 11172) % 28 > 0 THEN '은' ELSE '는' END AS topic FROM part
    """
)
def topics_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with the particle that their last syllable asks for."""
    code = F.conv((44032 + F.col("p_partkey") % 11172).cast("string"), 10, 16)
    name = F.concat("p_brand", F.decode(F.unhex(code), "UTF-16BE"))
    return table(spark, sf_dir, "part").select("p_partkey", text.topic_particle(name).alias("topic"))


@query(
    """
    WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS seen, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) END AS deadline FROM orders)
    SELECT o_orderkey, CASE WHEN deadline IS NULL THEN seen < DATE '1997-06-01' - 180 ELSE deadline < DATE '1997-06-01' - 30 END AS gone FROM o
    """
)
def expired_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that go: a month after their deadline or, without one, half a year after they were last seen."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    deadline = F.when(k % 3 > 0, F.date_add(day, (k % 90).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", jobs.expired(day, deadline, F.lit("1997-06-01").cast("date")).alias("gone"))
