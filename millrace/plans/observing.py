"""What is seen of pages and lists, and who may see what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import observing, text, visible
from millrace.plans.registry import query, table
from millrace.plans.wording import chosen, chosen_sql

PAGES = (
    ("<title> A  b</title><p>one<b>two</b><p hidden>no<p>no</p></p>three", "one two three", "A b", False, False),
    ("<a href=x>link</a><div style='display: none !important'>x<div>y</div>z</div>seen &amp; read", "seen & read", None, False, False),
    ("<form><input type=PASSWORD></form>", "", None, True, False),
    ("<script>var a='<p>'</script>text<br>more<!-- c -->", "text more", None, False, False),
    ("text <!-- never ends", "text", None, False, True),
    ("<p>a < b</p>", "a < b", None, False, False),
)


@query(
    f"""
    SELECT p_partkey, {chosen_sql([p[1] for p in PAGES], 'p_partkey')} AS text, {chosen_sql([p[2] for p in PAGES], 'p_partkey')} AS title,
           p_partkey % {len(PAGES)} = 2 AS has_password, p_partkey % {len(PAGES)} = 4 AS cut_off
    FROM part
    """
)
def seen_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text, title, password fields and cuts of pages."""
    rows = table(spark, sf_dir, "part").select("p_partkey", chosen([p[0] for p in PAGES], F.col("p_partkey")).alias("page"))
    return rows.select("p_partkey", visible.visible_text("page").alias("v")).select("p_partkey", "v.*")


#: Status, network error, whether there is a page, its title, rows; state and reason.
SEEN = (
    (200, None, True, "Jobs", 3, "rows", None),
    (200, None, True, "Jobs", 0, "no rows", "cause unknown"),
    (200, None, True, "404 Not Found", 3, "page of an error", "signature"),
    (503, None, True, "x", 3, "status", None),
    (None, True, False, None, None, "network", None),
    (200, True, False, None, None, "undetermined", "contradiction"),
    (None, None, True, "x", 1, "undetermined", "no status"),
    (700, None, True, "x", 1, "undetermined", "bad status"),
    (200, None, False, None, 1, "undetermined", "no page"),
    (200, None, True, "x", None, "undetermined", "no row count"),
    (200, None, True, "x", -1, "undetermined", "bad row count"),
)


@query(
    f"SELECT event_id, {chosen_sql([s[5] for s in SEEN], 'event_id')} AS state, {chosen_sql([s[6] for s in SEEN], 'event_id')} AS reason, "
    f"CASE WHEN event_id % {len(SEEN)} IN (0, 1, 2, 8) THEN CAST({chosen_sql([s[4] for s in SEEN], 'event_id')} AS INTEGER) END AS n_rows FROM events"
)
def list_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an attempt to read a list came to: six states, with the reason of those that say little."""
    k = F.col("event_id")
    status, network, page, title, rows = (chosen([s[i] for s in SEEN], k) for i in range(5))
    found = observing.list_state(status, network.cast("boolean"), page, title, F.lit(""), F.lit(False), rows)
    return table(spark, sf_dir, "events").select("event_id", found.alias("o")).select("event_id", "o.*")


NAMES = ("주식회사 한빛（재활）병원", "인당의료재단 부민병원", "참재단병원", "서울특별시 강남구보건소", "(주)가나-다·라", None)
KEYS = ("한빛재활병원", "부민병원", "참재단병원", "서울특별시강남구보건소", "가나다라", "")
SHORT = ("한빛재활병원", "부민병원", "참재단병원", "강남구보건소", "가나다라", "")


@query(
    f"""
    WITH RECURSIVE s AS (SELECT s_suppkey AS k, s_name || '😀' AS t FROM supplier),
    h AS (SELECT k, t, 1 AS i, CAST(unicode(substr(t, 1, 1)) AS BIGINT) AS v FROM s UNION ALL SELECT k, t, i + 1, (v * 31 + unicode(substr(t, i + 1, 1))) % 4294967296 FROM h WHERE i < length(t))
    SELECT k AS s_suppkey, v AS hash, {chosen_sql(KEYS, 'k')} AS key, {chosen_sql(SHORT, 'k')} AS short_key FROM h WHERE i = length(t)
    """
)
def institution_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of institutions with and without their province, and hashes over code points."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        text.code_point_hash(F.concat("s_name", F.lit("😀"))).alias("hash"),
        text.institution_key(chosen(NAMES, k)).alias("key"),
        text.institution_key(chosen(NAMES, k), drop_province=True).alias("short_key"),
    )


@query(
    """
    SELECT 'member' AS role, c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT 'guest', c_custkey, substr(c_name, 1, 3) || '***', NULL FROM customer
    UNION ALL SELECT * FROM (SELECT 'preview', c_custkey, substr(c_name, 1, 3) || '***', NULL FROM customer ORDER BY c_custkey LIMIT 20)
    """
)
def masked_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows and columns that each role sees."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    seen = [observing.seen_by(customer, role, "c_custkey", names=["c_name"], secrets=["c_acctbal"]).withColumn("role", F.lit(role)) for role in ("member", "guest", "preview")]
    return seen[0].unionByName(seen[1]).unionByName(seen[2])


FILL = "본문 " * 80
#: Status, source, text, address that was reached; state and reason. The title is "[모집] 물리치료사 채용".
LIVE = (
    (200, "", "물리치료사 채용 " + FILL, "http://a/1", "alive", "title"),
    (200, "", FILL, "http://a/1", "alive", "opens"),
    (200, "", FILL, "http://a/list", "gone", "elsewhere"),
    (404, "", "", "http://a/1", "gone", "status"),
    (503, "", "", "http://a/1", "unknown", "status"),
    (None, "", "", "http://a/1", "unknown", "no answer"),
    (200, "", "삭제된 게시물입니다", "http://a/1", "gone", "text"),
    (200, "<script>alert('접수 마감되었습니다')</script>", "x", "http://a/1", "closed", "alert"),
    (200, "", "짧은 글", "http://a/1", "unknown", "little text"),
    (200, "", "[마감] 물리치료사 채용 " + FILL, "http://a/1", "closed", "title"),
    (200, "", "접수기간 : <마감> " + FILL, "http://a/1", "closed", "period"),
    (200, "", "(마감) 간호사 채용 물리치료사 채용 " + FILL, "http://a/1", "alive", "title"),
)


@query(f"SELECT event_id, {chosen_sql([x[4] for x in LIVE], 'event_id')} AS state, {chosen_sql([x[5] for x in LIVE], 'event_id')} AS why FROM events")
def liveness_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pages of postings are alive, gone, closed or unknown, by tests in their order."""
    k = F.col("event_id")
    status, html, body, landed = (chosen([x[i] for x in LIVE], k) for i in range(4))
    found = observing.liveness(status, html, body, F.lit("[모집] 물리치료사 채용"), landed, F.lit("http://a/1"))
    return table(spark, sf_dir, "events").select("event_id", found.alias("l")).select("event_id", "l.*")
