"""Merging, deduplication, matching and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import dedup, ladder, match, merge
from millrace.plans.registry import query, table


@query(
    """
    WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 < 3 THEN 'A' ELSE 'B' END AS source,
                 o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS tab,
                 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS cust, 'x' || o_orderkey % 3 AS src_of_status,
                 o_orderkey % 4 = 1 AS by_hand FROM orders WHERE o_orderkey % 10 < 8),
    n AS (SELECT o_orderkey AS id, 'A' AS source, CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE o_orderstatus END AS status,
                 o_totalprice + 1 AS price, 'new' AS tab, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey + 1 END AS cust,
                 'new' AS src_of_status FROM orders WHERE o_orderkey % 10 >= 3)
    SELECT coalesce(o.id, n.id) AS id,
           CASE WHEN o.id IS NULL THEN n.source ELSE o.source END AS source,
           CASE WHEN o.id IS NULL OR (n.id IS NOT NULL AND o.source = n.source AND NOT o.by_hand) THEN n.status ELSE o.status END AS status,
           CASE WHEN o.id IS NULL OR (n.id IS NOT NULL AND o.source = n.source) THEN n.price ELSE o.price END AS price,
           CASE WHEN o.id IS NULL THEN n.tab ELSE o.tab END AS tab,
           CASE WHEN o.id IS NULL OR (n.id IS NOT NULL AND o.source = n.source AND n.cust IS NOT NULL) THEN n.cust ELSE o.cust END AS cust,
           CASE WHEN o.id IS NULL OR (n.id IS NOT NULL AND o.source = n.source AND NOT o.by_hand AND o.status IS DISTINCT FROM n.status)
                THEN n.src_of_status ELSE o.src_of_status END AS src_of_status,
           CASE WHEN n.id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'inserted'
                WHEN o.source = n.source OR o.source IS NULL THEN 'updated' ELSE 'refused' END AS outcome
    FROM o FULL OUTER JOIN n ON o.id = n.id
    """
)
def ownership_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored and an incoming table under field-level ownership."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    stored = orders.filter(k % 10 < 8).select(
        k.alias("id"),
        F.when(k % 5 == 0, None).when(k % 5 < 3, "A").otherwise("B").alias("source"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("tab"),
        F.when(k % 7 != 0, F.col("o_custkey")).alias("cust"),
        F.concat(F.lit("x"), (k % 3).cast("string")).alias("src_of_status"),
        F.when(k % 4 == 1, F.array(F.lit("status"))).alias("edited_fields"),
    )
    incoming = orders.filter(k % 10 >= 3).select(
        k.alias("id"),
        F.lit("A").alias("source"),
        F.when(k % 2 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("status"),
        (F.col("o_totalprice") + 1).alias("price"),
        F.lit("new").alias("tab"),
        F.when(k % 3 != 0, F.col("o_custkey") + 1).alias("cust"),
        F.lit("new").alias("src_of_status"),
    )
    rules = merge.Ownership(
        "id", owned=("status", "price"), insert_only=("tab",), keep_if_null=("cust",), follows={"src_of_status": "status"}
    )
    return merge.ownership_merge(stored, incoming, rules).drop("edited_fields")


@query(
    """
    WITH e AS (SELECT c_custkey AS id, 'c_mktsegment' AS field, CASE WHEN c_custkey % 6 = 0 THEN ' ' ELSE 'EDITED' END AS value, 1 AS seq
               FROM customer WHERE c_custkey % 3 = 0
               UNION ALL SELECT c_custkey, 'c_name', CASE WHEN c_custkey % 8 = 0 THEN c_name ELSE 'N' || c_custkey END, 2 FROM customer WHERE c_custkey % 4 = 0),
    w AS (SELECT id, max(CASE WHEN field = 'c_mktsegment' THEN nullif(trim(value), '') END) AS seg,
                 max(CASE WHEN field = 'c_name' THEN nullif(trim(value), '') END) AS name FROM e GROUP BY id),
    j AS (SELECT c.*, w.* FROM customer c LEFT JOIN w ON c_custkey = id WHERE c_custkey % 9 > 0)
    SELECT c_custkey, coalesce(name, c_name) AS c_name, coalesce(seg, c_mktsegment) AS c_mktsegment,
           concat_ws(',', CASE WHEN seg <> c_mktsegment THEN 'c_mktsegment' END, CASE WHEN name <> c_name THEN 'c_name' END) AS edited
    FROM j
    """
)
def overlay_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits by hand over a base table; blank ones are none, equal ones change nothing."""
    customer, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return merge.overlay(
        customer.filter(k % 9 > 0).select("c_custkey", "c_name", "c_mktsegment"), _edits(customer), "c_custkey", ["c_mktsegment", "c_name"]
    ).select("c_custkey", "c_name", "c_mktsegment", F.array_join("edited_fields", ",").alias("edited"))


def _edits(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    one = customer.filter(k % 3 == 0).select(
        "c_custkey", F.lit("c_mktsegment").alias("field"), F.when(k % 6 == 0, " ").otherwise("EDITED").alias("value"), F.lit(1).alias("seq")
    )
    name = F.when(k % 8 == 0, F.col("c_name")).otherwise(F.concat(F.lit("N"), k.cast("string")))
    two = customer.filter(k % 4 == 0).select("c_custkey", F.lit("c_name").alias("field"), name.alias("value"), F.lit(2).alias("seq"))
    return one.unionByName(two)


@query(
    """
    SELECT field, count(*) AS n_orphans FROM
      (SELECT c_custkey AS id, 'c_mktsegment' AS field FROM customer WHERE c_custkey % 3 = 0
       UNION ALL SELECT c_custkey, 'c_name' FROM customer WHERE c_custkey % 4 = 0)
    WHERE id % 9 = 0 GROUP BY field
    """
)
def orphan_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits whose row is gone, counted by field."""
    customer = table(spark, sf_dir, "customer")
    base = customer.filter(F.col("c_custkey") % 9 > 0)
    return merge.orphan_edits(base, _edits(customer), "c_custkey").groupBy("field").agg(F.count("*").alias("n_orphans"))


@query(
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'type' WHEN value < 5 THEN 'low' WHEN value > 450 THEN 'high' END AS reason
    FROM events
    """
)
def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row, with the first check that it fails."""
    checks = [("type", F.col("event_type") != "error"), ("low", F.col("value") >= 5), ("high", F.col("value") <= 450)]
    return ladder.quarantine(table(spark, sf_dir, "events"), checks).select("event_id", "reason")


DOC_KEY = "md5(lower(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')))"


@query(f"SELECT min(doc_id) AS doc_id, {DOC_KEY} AS key, count(*) AS n_copies FROM documents GROUP BY 2")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each normalised text."""
    return _deduplicated(spark, sf_dir, F.min_by)


@query(f"SELECT max(doc_id) AS doc_id, {DOC_KEY} AS key, count(*) AS n_copies FROM documents GROUP BY 2")
def last_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last document of each normalised text."""
    return _deduplicated(spark, sf_dir, F.max_by)


def _deduplicated(spark: SparkSession, sf_dir: str, pick) -> DataFrame:
    """The key is worked out once, before the aggregate."""
    key = F.md5(F.lower(F.regexp_replace("text", "[^0-9A-Za-z]+", "")))
    docs = table(spark, sf_dir, "documents").select("doc_id", key.alias("key"))
    return dedup.counted(docs, [F.col("key")], F.col("doc_id"), pick)


@query(
    """
    SELECT arg_min(doc_id, (CASE WHEN source LIKE '%1' THEN 0 ELSE 1 END, doc_id)) AS doc_id, lang, n_chars // 100 AS band
    FROM documents GROUP BY lang, band
    """
)
def stronger_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of a trusted source beats others of its key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.floor(F.col("n_chars") / 100).alias("band"))
    return dedup.stronger_wins(docs, [F.col("lang"), F.col("band")], F.col("source").endswith("1"), F.col("doc_id")).drop("source")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def known_ids_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that nobody has judged."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_anti")


@query(
    """
    SELECT p_partkey, p_brand FROM part WHERE p_partkey IN
      (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-02-01')
    """
)
def visible_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that were shipped in a month; the date reaches the scan."""
    at = F.col("l_shipdate")
    month = (at >= F.lit("1998-01-01").cast("timestamp_ntz")) & (at < F.lit("1998-02-01").cast("timestamp_ntz"))
    shipped = table(spark, sf_dir, "lineitem").filter(month).select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(shipped, "p_partkey", "left_semi")


@query(
    """
    WITH o AS (SELECT p_partkey, p_size, p_retailprice AS price FROM part WHERE p_partkey % 5 > 0),
    n AS (SELECT p_partkey, p_size + CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END AS p_size,
                 p_retailprice + CASE WHEN p_partkey % 8 = 0 THEN 1 ELSE 0 END AS price FROM part WHERE p_partkey % 7 > 0),
    j AS (SELECT o.p_partkey AS a, n.p_partkey AS b, o.p_size AS s, n.p_size AS t, o.price AS p, n.price AS q FROM o FULL OUTER JOIN n ON o.p_partkey = n.p_partkey)
    SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN b IS NULL THEN 'only_old' WHEN a IS NULL THEN 'only_new'
       WHEN s = t AND p = q THEN 'equal' WHEN s = t THEN 'price' ELSE 'differs' END AS bucket FROM j) GROUP BY bucket
    """
)
def collector_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two collections of one table compared, differences explained where they can be."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    old = part.filter(k % 5 > 0).select("p_partkey", "p_size", F.col("p_retailprice").alias("price"))
    new = part.filter(k % 7 > 0).select(
        "p_partkey",
        (F.col("p_size") + (k % 6 == 0).cast("int")).alias("p_size"),
        (F.col("p_retailprice") + (k % 8 == 0).cast("int")).alias("price"),
    )
    explain = [("price", F.col("old_p_size") == F.col("new_p_size"))]
    return merge.reconciled(old, new, "p_partkey", ["p_size", "price"], explain).groupBy("bucket").agg(F.count("*").alias("n"))


@query(
    """
    WITH r AS (SELECT s_nationkey, min(s_suppkey) AS m, count(*) AS n FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY s_nationkey)
    SELECT c_custkey, CASE WHEN n = 1 THEN m END AS matched, coalesce(n, 0) AS n_found FROM customer LEFT JOIN r ON c_nationkey = s_nationkey
    """
)
def unique_or_null_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier for a customer only where exactly one fits."""
    right = table(spark, sf_dir, "supplier").filter(F.col("s_suppkey") % 3 == 0).select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    left = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return match.unique_or_null(left, right, "nation", "s_suppkey").select("c_custkey", "matched", "n_found")


@query(
    """
    SELECT a.o_custkey AS o_custkey, a.o_orderkey AS o_orderkey_a, b.o_orderkey AS o_orderkey_b
    FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate
    WHERE a.o_orderkey < b.o_orderkey AND a.o_orderpriority <> b.o_orderpriority
    """
)
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer and day that differ in priority."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    pairs = match.self_pairs(orders, ["o_custkey", "o_orderdate"], "o_orderkey", "o_orderpriority")
    return pairs.select("o_custkey", "o_orderkey_a", "o_orderkey_b")


@query(
    """
    WITH c AS (SELECT o_custkey, o_orderstatus, o_orderpriority AS s, min(o_orderkey) AS rep, count(*) AS n, min(year(o_orderdate)) AS lo, max(year(o_orderdate)) AS hi
        FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority),
    apart AS (SELECT min(o_orderkey) AS x, max(o_orderkey) AS y FROM orders WHERE o_orderkey % 4 = 0 GROUP BY o_custkey)
    SELECT a.o_custkey, a.o_orderstatus, a.rep AS rep_a, b.rep AS rep_b, a.s AS source_a, b.s AS source_b, a.n * b.n AS n_pairs,
        NOT (a.lo = a.hi AND b.lo = b.hi AND a.lo = b.lo) AS kinds_differ
    FROM c a JOIN c b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus AND a.rep < b.rep
    WHERE NOT EXISTS (SELECT 1 FROM apart WHERE x = a.rep AND y = b.rep)
    """
)
def merge_candidate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer and status from different priorities, as pairs of classes: each class's first order
    stands for it, pairs once judged to be different are left out, and pairs of different years are marked."""
    orders, year = table(spark, sf_dir, "orders"), F.year("o_orderdate").alias("year")
    rows = orders.select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey", year)
    # judged before: the last and first of every fourth order of a customer
    judged = orders.filter("o_orderkey % 4 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("rep_a"), F.min("o_orderkey").alias("rep_b"))
    return match.class_pairs(rows, ["o_custkey", "o_orderstatus"], "o_orderpriority", "o_orderkey", judged, "year")[1]


@query(
    """
    SELECT event_id, signup_id FROM (SELECT event_id, event_type,
      last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS signup_id FROM events)
    WHERE event_type = 'purchase'
    """
)
def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest signup before each purchase of a user."""
    kind = F.col("event_type")
    return match.nearest_before(
        table(spark, sf_dir, "events"), ["user_id"], F.col("ts"), F.col("event_id"), kind == "purchase", kind == "signup", F.col("event_id"), "signup_id"
    ).select("event_id", "signup_id")


@query(
    """
    SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'A' WHEN o_totalprice < 150000 THEN 'B' WHEN o_totalprice < 300000 THEN 'C' ELSE 'D' END AS bracket
    FROM orders
    """
)
def bracket_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bracket of a price."""
    bounds = [(50000, "A"), (150000, "B"), (300000, "C")]
    return table(spark, sf_dir, "orders").select("o_orderkey", match.bracket(F.col("o_totalprice"), bounds, "D").alias("bracket"))


SUBSCRIPTIONS = [(1, "view", 250.0), (2, "*", 400.0), (3, "purchase", 0.0), (4, "error", 100.0)]


@query(
    f"""
    WITH r(sub_id, event_type, least) AS (VALUES {', '.join(str(s) for s in SUBSCRIPTIONS)})
    SELECT sub_id, e.event_type, count(*) AS n FROM events e JOIN r ON (r.event_type = e.event_type OR r.event_type = '*') AND value >= least
    GROUP BY sub_id, e.event_type
    """
)
def wildcard_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events for each subscription to their type, and for subscriptions to all."""
    rules = spark.createDataFrame(SUBSCRIPTIONS, "sub_id long, event_type string, least double")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    met = match.wildcard_match(events, rules, "event_type").filter("value >= least")
    return met.groupBy("sub_id", "event_type").agg(F.count("*").alias("n"))


@query(
    """
    SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id % 2 = 0 AND NOT EXISTS
      (SELECT 1 FROM documents c WHERE c.doc_id % 2 = 1 AND c.source = d.source AND c.lang = d.lang AND abs(c.n_chars - d.n_chars) <= 3)
    """
)
def interval_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one board without a counterpart on the other: equal place, and size within three.
    The interval becomes an equi join on buckets of the interval's width."""
    docs, width = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), 4
    cell = F.floor(F.col("n_chars") / width)
    theirs = docs.filter(F.col("doc_id") % 2 == 1).select(
        F.col("source").alias("s"), F.col("lang").alias("l"), F.col("n_chars").alias("n"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")
    )
    mine = docs.filter(F.col("doc_id") % 2 == 0).withColumn("own", cell)
    near = (F.col("source") == F.col("s")) & (F.col("lang") == F.col("l")) & (F.col("own") == F.col("cell"))
    return mine.join(theirs, near & (F.abs(F.col("n") - F.col("n_chars")) <= 3), "left_anti").select("doc_id", "lang")


@query(
    """
    SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN k = event_id % 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_same
    FROM (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY user_id
    """
)
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored maps under incoming ones: the incoming side wins key by key; an empty map changes
    nothing."""
    maps = F.from_json("props", "map<string,string>")
    incoming = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("seen"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>"))
    stored = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", maps.alias("props"), F.lit("A").alias("source"), F.lit(None).cast("array<string>").alias("edited_fields"))
    new = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), incoming.alias("props"), F.lit("A").alias("source"))
    out = merge.ownership_merge(stored, new, merge.Ownership("id", maps=("props",)))
    k = F.try_element_at("props", F.lit("k")).cast("long")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(k == F.col("id") % 3).alias("n_same"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'new' FROM part WHERE p_partkey % 2 = 1")
def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rows replace stored ones of their key."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    incoming = part.filter(F.col("p_partkey") % 2 == 1).withColumn("p_name", F.lit("new"))
    return merge.upsert(part, incoming, ["p_partkey"])


@query(
    f"""
    SELECT page_id, coalesce(nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', ''), ''), '') ||
       regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*(.*)$', 1), '#.*$', ''), '/+$', '') AS key FROM pages
    """
)
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key that twins of a url share."""
    return table(spark, sf_dir, "pages").select("page_id", text.url_key(F.col("url")).alias("key"))
