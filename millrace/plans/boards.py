"""Boards of several kinds as rows of one shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import query, table
from millrace.plans.wording import chosen
from millrace.sources import pages, readers, tables

BOARD = {"rows": "data.list", "title": "name", "from_date": "begin", "link": "https://h.io/view?no={no}&t={kind}", "total": "data.count"}


def _boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON body for each nation, of its suppliers."""
    supplier = table(spark, sf_dir, "supplier")
    row = F.struct(F.col("s_suppkey").alias("no"), F.col("s_name").alias("name"), F.lit("2024-05-01").alias("begin"), (F.col("s_suppkey") % 3).alias("kind"))
    lists = supplier.groupBy("s_nationkey").agg(F.sort_array(F.collect_list(row)).alias("list"), F.count("*").alias("count"))
    body = F.to_json(F.struct(F.struct("list", "count").alias("data")))
    return lists.select(F.col("s_nationkey").alias("site"), F.when(F.col("s_nationkey") % 6 == 5, "no JSON").otherwise(body).alias("body"))


@query(
    """
    SELECT s_nationkey AS site, s_name AS title, 'https://h.io/view?no=' || s_suppkey || '&t=' || s_suppkey % 3 AS link, '2024-05-01' AS from_date, CAST(NULL AS VARCHAR) AS to_date,
           count(*) OVER (PARTITION BY s_nationkey) AS total
    FROM supplier WHERE s_nationkey % 6 < 5
    """
)
def json_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards in JSON by dotted paths and a template for links; bodies that are no JSON have no rows."""
    return readers.json_board(_boards(spark, sf_dir), BOARD)


LINE = {"row": r"<li>.*?</li>", "title": r">([^<]+)</a>", "link": r'href="([^"]*)"', "date": r"([0-9]{4}-[0-9]{2}-[0-9]{2})", "skip": "notice"}


@query(
    """
    SELECT 'json' AS kind, s_nationkey AS site, s_name AS title, CAST(NULL AS VARCHAR) AS to_date, CAST(NULL AS VARCHAR) AS posted FROM supplier WHERE s_nationkey % 6 < 5
    UNION ALL SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'html' ELSE 'deadline' END, n_nationkey, n_name || ' board', CASE WHEN n_nationkey % 2 = 1 THEN '2024-06-01' END, CASE WHEN n_nationkey % 2 = 0 THEN '2024-06-01' END FROM nation
    """
)
def typed_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards by their type: JSON, list pages whose one date is the posting's, and those where it is the
    deadline; types that no reader knows have no rows."""
    json_ = _boards(spark, sf_dir).withColumn("kind", F.lit("json"))
    name, k = F.col("n_name"), F.col("n_nationkey")
    line = F.concat(F.lit('<ul><li><a href="/1">'), name, F.lit(' board</a> 2024-06-01</li><li><a href="/2">notice of all</a> 2024-06-02</li><li><a href="/3">abc</a></li></ul>'))
    lists = table(spark, sf_dir, "nation").select(k.alias("site"), line.alias("body"), F.when(k % 2 == 0, "html").otherwise("deadline").alias("kind"))
    unknown = lists.filter("site < 3").withColumn("kind", F.lit("other"))
    kinds = {
        "json": lambda df: readers.json_board(df, BOARD),
        "html": lambda df: readers.html_rows(df, LINE, "body", ["site"]),
        "deadline": lambda df: readers.html_rows(df, {**LINE, "single": "deadline"}, "body", ["site"]),
    }
    return readers.by_type(json_.unionByName(lists).unionByName(unknown), kinds).select("kind", "site", "title", "to_date", "posted")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id, CASE WHEN r_regionkey % 2 = 0 THEN r_name END AS name, CAST(NULL AS VARCHAR) AS memo FROM region")
def sheets_by_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets that come wrapped in a call, whose columns stand in differing places."""
    value = lambda c: F.struct(F.struct(c.cast("string").alias("v")).alias("x"))["x"]
    k, name = value(F.col("r_regionkey")), value(F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")).otherwise(" "))
    even = F.col("r_regionkey") % 2 == 0
    label = lambda x: F.struct(F.lit(x).alias("label"))
    cols = F.when(even, F.array(label("번호"), label("이름"))).otherwise(F.array(label("이름"), label("기타"), label("번호")))
    cells = F.when(even, F.array(k, name)).otherwise(F.array(name, value(F.lit("x")), k))
    body = F.concat(F.lit("google.visualization.setResponse("), F.to_json(F.struct(cols.alias("cols"), F.array(F.struct(cells.alias("c"))).alias("rows"))), F.lit(");"))
    sheets = table(spark, sf_dir, "region").select(body.alias("body"))
    return readers.sheet_rows(sheets, {"id": "번호", "name": "이름", "memo": "비고"})


@query(
    """
    WITH m AS (SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey % 2 = 0), a AS (SELECT p_partkey AS id, p_brand AS title FROM part WHERE p_partkey % 3 = 0),
    b AS (SELECT p_partkey AS id, p_type AS title FROM part WHERE p_partkey % 5 = 0), k AS (SELECT id FROM m UNION SELECT id FROM a UNION SELECT id FROM b)
    SELECT k.id, coalesce(m.title, a.title, b.title) AS title, concat_ws(',', CASE WHEN a.id IS NOT NULL THEN 'keyword' END, CASE WHEN b.id IS NOT NULL THEN 'licence' END) AS tags, m.id IS NOT NULL AS in_main
    FROM k LEFT JOIN m ON k.id = m.id LEFT JOIN a ON k.id = a.id LEFT JOIN b ON k.id = b.id
    """
)
def supplemented_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A main list with extra slices: every id once, with the slices that have it."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    rows = lambda where, title: part.filter(where).select(k.alias("id"), F.col(title).alias("title"))
    out = readers.supplemented(rows(k % 2 == 0, "p_name"), {"keyword": rows(k % 3 == 0, "p_brand"), "licence": rows(k % 5 == 0, "p_type")}, "id")
    return out.withColumn("tags", F.array_join("tags", ","))


ROBOTS = ("User-agent: *\nCrawl-delay: 5\nDisallow: /a", "User-agent: x\nCrawl-delay: 1\n\nUser-agent: *\nDisallow:", "User-agent: y\nUser-agent: *\nCrawl-delay: 0.5 # slow", None)


@query(
    """
    SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 5.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE END AS delay, n_nationkey % 3 = 0 AS pages FROM nation
    """
)
def paging_and_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long to wait between requests, and whether a second page has other rows than the first."""
    k = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", pages.crawl_delay(chosen(ROBOTS, k)).alias("delay"))
    number = F.explode(F.array(F.lit(1), F.lit(2))).alias("number")
    rows = F.when((F.col("n_nationkey") % 3 == 0) & (F.col("number") == 2), F.array(F.lit("c"))).when((k % 3 == 1) & (F.col("number") == 2), F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b")))
    read = table(spark, sf_dir, "nation").select("n_nationkey", number)
    return nation.join(pages.pages_differ(read, "n_nationkey", "number", rows), "n_nationkey")


@query(
    """
    SELECT 'orders' AS source, count(*) AS n, count(day) AS n_days, count(price) AS n_prices FROM (SELECT CAST(o_orderdate AS DATE) AS day, o_totalprice AS price FROM orders)
    UNION ALL SELECT 'events', count(*), count(CAST(ts AS DATE)), 0 FROM events UNION ALL SELECT 'parts', count(*), 0, count(p_retailprice) FROM part
    """
)
def one_table_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of differing columns as one table."""
    rows = readers.union_sources(
        {
            "orders": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("price")),
            "events": table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("date").alias("day")),
            "parts": table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price")),
        }
    )
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("day").alias("n_days"), F.count("price").alias("n_prices"))


#: The patterns of three kinds of sites, by the end of their host.
SITES = [
    ("com", r"<li>.*?</li>", {"title": r">([^<]+)</a>", "link": r'href="([^"]*)"'}),
    ("org", r"<h1>[^<]*</h1>", {"title": r"<h1>([^<]*)</h1>"}),
    ("net", r"<p>[^<]+</p>", {"title": r"<p>([^<]+)</p>", "link": r'href="([^"]*)"'}),
]


@query(
    """
    WITH p AS (SELECT page_id, regexp_extract(url, '://[^/?#]*\\.([a-z]+)(?:[/?#]|$)', 1) AS kind, html FROM pages),
    m AS (SELECT page_id, kind, CASE kind WHEN 'com' THEN regexp_extract_all(html, '(?s)<li>.*?</li>') WHEN 'org' THEN regexp_extract_all(html, '<h1>[^<]*</h1>')
        WHEN 'net' THEN regexp_extract_all(html, '<p>[^<]+</p>') END AS found FROM p),
    r AS (SELECT page_id, kind, CAST(unnest(generate_series(1, len(found))) AS INTEGER) AS place, unnest(found) AS x FROM m)
    SELECT page_id, place, CASE kind WHEN 'com' THEN string_split(string_split(x, '</a>')[1], '>')[3] ELSE string_split(string_split(x, '>')[2], '</')[1] END AS title,
        CASE WHEN kind = 'com' THEN string_split(x, '"')[2] END AS link FROM r
    """
)
def site_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of pages by the patterns of their kind of site, which are a table: a table function called for each page."""
    kind = F.regexp_extract("url", r"://[^/?#]*\.([a-z]+)(?:[/?#]|$)", 1)
    sites = spark.createDataFrame(SITES, "kind string, row string, parts map<string,string>")
    rows = table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), "html")
    return tables.board_rows(rows, sites, "kind", "title,link").drop("kind")
