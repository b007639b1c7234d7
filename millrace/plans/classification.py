"""Ordered rule ladders over texts, pages and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import labels
from millrace.operators.ladder import Rule, first_evidence, ladder
from millrace.plans.registry import query, table


@query(
    """
    SELECT doc_id, CASE WHEN n_chars < 60 THEN 'trash' WHEN contains(t, 'the') AND lang = 'en' THEN 'member'
                        WHEN regexp_matches(t, '[#$%&]{3}') THEN 'hold' WHEN contains(t, 'der ') THEN 'member' ELSE 'trash' END AS bucket,
           CASE WHEN n_chars < 60 THEN 'short' WHEN contains(t, 'the') AND lang = 'en' THEN 'word'
                WHEN regexp_matches(t, '[#$%&]{3}') THEN 'symbols' WHEN contains(t, 'der ') THEN 'other word' ELSE 'none' END AS stage
    FROM (SELECT doc_id, n_chars, lang, lower(text) AS t FROM documents)
    """
)
def triage_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents into buckets, with the stage that decided."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", F.lower("text").alias("t"))
    rules = [
        Rule(F.col("n_chars") < 60, "trash", "short"),
        Rule(F.col("t").contains("the") & (F.col("lang") == "en"), "member", "word"),
        Rule(F.col("t").rlike("[#$%&]{3}"), "hold", "symbols"),
        Rule(F.col("t").contains("der "), "member", "other word"),
    ]
    return ladder(docs, rules, ("trash", "none"), "bucket").select("doc_id", "bucket", "stage")


@query(
    """
    SELECT page_id, CASE WHEN html IS NULL OR html = '' THEN 'gone' WHEN NOT contains(html, '</html>') THEN 'unknown'
                         WHEN contains(url, 'cheap') THEN 'closed' ELSE 'alive' END AS state,
           CASE WHEN html IS NULL OR html = '' THEN 'empty' WHEN NOT contains(html, '</html>') THEN 'cut'
                WHEN contains(url, 'cheap') THEN 'url' ELSE 'none' END AS stage
    FROM pages
    """
)
def liveness_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page is alive, by ordered tests."""
    page = F.col("html")
    rules = [
        Rule(page.isNull() | (page == ""), "gone", "empty"),
        Rule(~page.contains("</html>"), "unknown", "cut"),
        Rule(F.col("url").contains("cheap"), "closed", "url"),
    ]
    return ladder(table(spark, sf_dir, "pages"), rules, ("alive", "none"), "state").select("page_id", "state", "stage")


@query(
    """
    SELECT p_partkey, coalesce(a, b, c) AS kind, CASE WHEN a IS NOT NULL THEN 'type' WHEN b IS NOT NULL THEN 'brand' WHEN c IS NOT NULL THEN 'size' ELSE '' END AS source
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS a, CASE WHEN p_partkey % 3 = 1 THEN p_brand END AS b,
                 CASE WHEN p_size > 10 THEN 'large' END AS c FROM part)
    """
)
def evidence_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first evidence that there is, and where it comes from."""
    k = F.col("p_partkey")
    kind, source = first_evidence(
        [
            ("type", F.when(k % 3 == 0, F.col("p_type"))),
            ("brand", F.when(k % 3 == 1, F.col("p_brand"))),
            ("size", F.when(F.col("p_size") > 10, "large")),
        ]
    )
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), F.coalesce(source, F.lit("")).alias("source"))


@query(
    """
    SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 'offer' WHEN p_type LIKE 'STANDARD%' OR p_type LIKE 'SMALL%' THEN 'plain' ELSE 'other' END AS category,
           CASE p_size % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE '3' END AS meaning, p_size % 4 < 3 AS known
    FROM part
    """
)
def prefix_and_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by prefix, and codes with their meaning where it is known."""
    category = labels.prefix_label(F.col("p_type"), [("PROMO", "offer"), ("STANDARD", "plain"), ("SMALL", "plain")], "other")
    meaning, known = labels.decoded((F.col("p_size") % 4).cast("string"), {"0": "none", "1": "one", "2": "two"})
    return table(spark, sf_dir, "part").select("p_partkey", category.alias("category"), meaning.alias("meaning"), known.alias("known"))


@query(
    """
    SELECT p_partkey, list_filter(w, lambda t: t IN ('brass', 'tin', 'steel')) AS metals, list_filter(w, lambda t: t NOT IN ('brass', 'tin', 'steel')) AS rest
    FROM (SELECT p_partkey, string_split(lower(p_type), ' ') AS w FROM part)
    """
)
def tag_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a group and the others, in their order."""
    metals, rest = labels.partition_tags(F.split(F.lower("p_type"), " "), ["brass", "tin", "steel"])
    return table(spark, sf_dir, "part").select("p_partkey", metals.alias("metals"), rest.alias("rest"))


@query(
    """
    SELECT p_partkey, CASE WHEN contains(w, 'brass') THEN 'brass' WHEN contains(w, 'steel') THEN 'steel' WHEN contains(w, 'tin') THEN 'tin' END AS hit
    FROM (SELECT p_partkey, lower(p_type) AS w FROM part)
    """
)
def dictionary_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest dictionary word in a name."""
    return table(spark, sf_dir, "part").select("p_partkey", labels.longest_hit(F.lower("p_type"), ["tin", "brass", "steel"]).alias("hit"))
