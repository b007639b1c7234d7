"""Keys, hashes, redaction and markup of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.plans.registry import query, table
from millrace.sources import pages


@query(
    """
    SELECT p_partkey, regexp_replace(p_name, '\\s+', '', 'g') AS squeezed, lower(regexp_replace(p_brand, '[^0-9A-Za-z]', '', 'g')) AS brand_key,
           lower(regexp_replace(p_name, '[\\s,.()\\[\\]{}''"_/&-]+', '', 'g')) AS name_key FROM part
    """
)
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names squeezed and as keys."""
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.squeeze(F.col("p_name")).alias("squeezed"),
        text.alnum_key(F.col("p_brand")).alias("brand_key"),
        text.org_name_key(F.col("p_name")).alias("name_key"),
    )


@query(
    """
    WITH u AS (SELECT p_partkey, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM part)
    SELECT p_partkey, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash FROM u
    """
)
def java_string_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32-bit polynomial hash of names."""
    return table(spark, sf_dir, "part").select("p_partkey", text.string_hash(F.col("p_name")).alias("hash"))


@query("SELECT event_id, substr(sha256(concat_ws('|', 'salt', CAST(CAST(ts AS DATE) AS VARCHAR), CAST(user_id AS VARCHAR), event_type)), 1, 32) AS token FROM events")
def visit_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key of the day for a visitor and target."""
    token = text.visit_token("salt", F.col("ts").cast("date"), F.col("user_id"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", token.alias("token"))


#: The patterns of ``text.SECRETS`` as DuckDB's engine writes them, over a text that holds all of them.
PLAIN_SECRETS = (
    (r"\b(?:[Bb]earer|BEARER)\s+[A-Za-z0-9._~+/=-]+", "[token]"),
    (r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*", "[token]"),
    (r"""\b((?:api[_-]?key|apikey|secret|token|password|passwd|cookie)["'']?\s*[:=]\s*)["'']?[^\s"'',;&]+["'']?""", r"\1[secret]"),
    (r"(https?://)[^\s/@:]+:[^\s/@]+@", r"\1[login]@"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "[mail]"),
    (r"[0-9]{6}-[1-8][0-9]{6}", "[id]"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[ip]"),
    (r"\+?[0-9][0-9() -]{7,}[0-9]", "[phone]"),
    (r"[A-Za-z0-9_-]{32,}", "[token]"),
)
SECRETIVE = "api_key: abc, Bearer a.b-c; https://me:pw@h.io eyJab.cd.ef 900101-1234567 token = \"x\" "


def _redacted_sql(text: str) -> str:
    for pattern, label in PLAIN_SECRETS:
        text = f"regexp_replace({text}, '{pattern}', '{label}', 'g')"
    return text


@query(f"SELECT doc_id, md5(substr({_redacted_sql(f"concat('{SECRETIVE}', text)")}, 1, 500)) AS cut_md5 FROM documents")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, behind a line of secrets, redacted and then cut."""
    whole = F.concat(F.lit(SECRETIVE), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.redact(whole, 500)).alias("cut_md5"))


@query(
    """
    SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
           len(regexp_extract_all(html, 'href="[^"]*"')) AS n_links,
           coalesce(array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), ' '), '') AS links
    FROM pages
    """
)
def html_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and links of a page by patterns."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.size(links).cast("long").alias("n_links"),
        F.array_join(links, " ").alias("links"),
    )


@query("SELECT page_id, md5(regexp_replace(html, '</?[A-Za-z][^>]*>|<!--[^>]*-->', '', 'g')) AS text_md5 FROM pages")
def tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without tags."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("text_md5"))


@query(
    """
    SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role,
           CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id
    """
)
def first_and_last_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of a conversation, by a partial aggregate."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.min_by("role", "turn").alias("first_role"),
        F.max_by("role", "turn").alias("last_role"),
        F.sum(F.length("text")).alias("n_chars"),
    )


@query(
    """
    SELECT page_id, name, number FROM (SELECT page_id, lower(split_part(pair, '=', 1)) AS name, CAST(split_part(pair, '=', 2) AS BIGINT) AS number
      FROM (SELECT page_id, unnest(regexp_extract_all(url, '[?&;]([A-Za-z_]+=[0-9]+)', 1)) AS pair FROM pages))
    WHERE name = 'page'
    """
)
def paging_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paging parameters with their numbers, found in links (here each page's own url as one)."""
    linked = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit('<a href="'), F.col("url"), F.lit('">')).alias("html"))
    return pages.paging_links(linked, keep=["page_id"]).select("page_id", "name", "number")
