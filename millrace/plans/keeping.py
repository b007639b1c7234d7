"""What stored tables keep, hide, relabel and bring back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import match, merge, state
from millrace.plans.registry import query, table
from millrace.plans.streams import folder
from millrace.plans.wording import chosen


@query(
    """
    WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 < 4 THEN 'A' ELSE 'B' END AS source, o_orderkey % 4 = 0 AS hidden,
                 o_orderkey % 3 = 0 AS hold, o_orderkey % 8 = 1 AS by_hand, o_orderkey % 9 = 2 AS locked, CASE WHEN o_orderkey % 2 = 0 THEN 'old' END AS method, 1 AS stamp FROM orders WHERE o_orderkey % 10 < 8),
    n AS (SELECT o_orderkey AS id, true AS hold, CASE WHEN o_orderkey % 5 > 0 THEN 'new' END AS method, 2 AS stamp, o_orderkey % 7 > 2 AS some FROM orders WHERE o_orderkey % 10 >= 3)
    SELECT coalesce(o.id, n.id) AS id,
      CASE WHEN o.id IS NULL THEN n.hold WHEN n.id IS NULL OR NOT coalesce(o.source = 'A', true) OR o.locked OR o.by_hand THEN o.hold WHEN o.hidden THEN false WHEN o.source = 'A' THEN n.hold ELSE o.hold END AS hold,
      CASE WHEN o.id IS NULL THEN n.method WHEN n.id IS NOT NULL AND coalesce(o.source = 'A', true) THEN coalesce(n.method, o.method) ELSE o.method END AS method,
      CASE WHEN o.id IS NULL OR n.id IS NOT NULL AND coalesce(o.source = 'A', true) AND n.some THEN coalesce(n.stamp, 0) ELSE o.stamp END AS stamp
    FROM o FULL OUTER JOIN n ON o.id = n.id
    """
)
def ownership_of_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held, fallback and stamped columns under ownership: hidden rows are never held, a method takes
    what there is, and a stamp moves on with its map alone."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    stored = orders.filter(k % 10 < 8).select(
        k.alias("id"),
        F.when(k % 6 == 0, None).when(k % 6 < 4, "A").otherwise("B").alias("source"),
        (k % 4 == 0).alias("hidden"),
        (k % 3 == 0).alias("hold"),
        F.when(k % 8 == 1, F.array(F.lit("hold"))).alias("edited_fields"),
        (k % 9 == 2).alias("locked"),
        F.when(k % 2 == 0, "old").alias("method"),
        F.lit(1).alias("stamp"),
        F.create_map().cast("map<string,string>").alias("extracted"),
    )
    incoming = orders.filter(k % 10 >= 3).select(
        k.alias("id"),
        F.lit("A").alias("source"),
        F.lit(True).alias("hold"),
        F.when(k % 5 > 0, "new").alias("method"),
        F.lit(2).alias("stamp"),
        F.when(k % 7 > 2, F.create_map(F.lit("a"), F.lit("b"))).otherwise(F.create_map().cast("map<string,string>")).alias("extracted"),
    )
    rules = merge.Ownership("id", locked="locked", maps=("extracted",), holds={"hold": "hidden"}, fallback=("method",), stamps={"stamp": "extracted"})
    return merge.ownership_merge(stored, incoming, rules).select("id", "hold", "method", "stamp")


@query(
    """
    WITH r AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'type: ' || repeat('x', 200) WHEN value < 5 THEN 'low' END AS why FROM events)
    SELECT substr(why, 1, 160) AS reason, count(*) AS n, array_to_string(list_sort(list(event_id))[1:20], ',') AS keys FROM r WHERE why IS NOT NULL GROUP BY 1
    """
)
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows by reason, with a sample of each."""
    why = F.when(F.col("event_type") == "error", F.concat(F.lit("type: "), F.repeat(F.lit("x"), 200))).when(F.col("value") < 5, "low")
    rows = table(spark, sf_dir, "events").select("event_id", why.alias("why"))
    return merge.rejected(rows, "why", "event_id").select("reason", "n", F.array_join(F.transform("keys", lambda x: x.cast("string")), ",").alias("keys"))


@query("SELECT count(*) AS n_written, count(*) AS n_read FROM customer WHERE c_acctbal > 0")
def checked_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced as a whole, with its counts compared."""
    path = f"{folder(spark, 'reload')}/{uuid.uuid4().hex}"
    written, read = merge.reload(table(spark, sf_dir, "customer").filter("c_acctbal > 0"), path)
    return spark.createDataFrame([(written, read)], "n_written long, n_read long")


@query(
    """
    SELECT o_orderkey, o_orderkey % 5 = 0 OR o_totalprice < 50000 AND o_orderkey % 7 > 0 AS hidden,
           CASE WHEN o_orderkey % 7 = 0 THEN 'by hand' WHEN o_totalprice < 50000 THEN 'small' END AS hidden_reason,
           CASE WHEN o_totalprice < 50000 AND o_orderkey % 7 > 0 THEN DATE '2024-02-01' END AS hidden_on
    FROM orders
    """
)
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows hidden with reason and day; a reason that stands is kept."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", (k % 5 == 0).alias("hidden"), F.when(k % 7 == 0, "by hand").alias("hidden_reason"), F.lit(None).cast("date").alias("hidden_on")
    )
    return merge.soft_deleted(rows, F.col("o_totalprice") < 50000, "small", "2024-02-01").drop("o_totalprice")


@query(
    """
    WITH p AS (SELECT p_type AS a, CASE WHEN p_type LIKE 'PROMO%' THEN 'OFFER' ELSE p_type END AS b FROM part)
    SELECT label, CAST(sum(x) AS BIGINT) AS n_before, CAST(sum(y) AS BIGINT) AS n_after FROM (SELECT a AS label, 1 AS x, 0 AS y FROM p UNION ALL SELECT b, 0, 1 FROM p) GROUP BY label
    """
)
def relabelled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels replaced by prefix, with the counts of each before and after."""
    return merge.relabelled(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", F.when(F.col("p_type").like("PROMO%"), "OFFER"))[1]


@query(
    """
    SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.doc_id % 3 > 0 WHERE l.doc_id IS NULL OR l.quality <> 1
    """
)
def changed_since_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are new or whose fingerprint is not that of the last judgement."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).cast("int").alias("mark"))
    judged = table(spark, sf_dir, "labels").filter("doc_id % 3 > 0").select("doc_id", F.col("quality").cast("int").alias("mark"))
    return state.changed(docs, judged, "doc_id", "mark").select("doc_id")


@query(
    """
    WITH s AS (SELECT p_partkey FROM part WHERE p_partkey % 4 > 0), seen AS (SELECT p_partkey, p_brand FROM part WHERE p_size < 40),
    whole AS (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) FILTER (p_size >= 48) < 4)
    SELECT p.p_partkey, w.p_brand IS NOT NULL AND p.p_size >= 40 AS missing
    FROM part p JOIN s USING (p_partkey) LEFT JOIN whole w ON p.p_brand = w.p_brand
    """
)
def missing_from_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows that a site's list no longer has, only for sites whose list was read to its end."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    listed = part.filter("p_size < 40").select("p_partkey")
    complete = part.groupBy("p_brand").agg((F.count_if(F.col("p_size") >= 48) < 4).alias("complete"))
    return state.missing(part.filter("p_partkey % 4 > 0"), listed, complete, "p_partkey", "p_brand").select("p_partkey", "missing")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey % 4 = 0 AND o_orderstatus = 'O'")
def hidden_but_visible_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a person hid and that are visible again."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    visible = orders.filter("o_orderkey % 4 = 0 AND o_orderstatus = 'O'")
    return visible.join(orders.filter("o_orderkey % 6 = 0").select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey")


@query(
    """
    WITH c AS (SELECT n_nationkey, count(*) AS total, count(*) - n_nationkey % 3 * 5 AS before FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey),
    r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS place FROM customer)
    SELECT c_nationkey, c_custkey FROM r JOIN c ON c_nationkey = n_nationkey WHERE total <> before AND place <= greatest(20, total - before + 10)
    """
)
def tail_of_grown_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows of lists that have grown since the total was last kept, with an overlap; lists of
    the same total are skipped."""
    customer = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    kept = customer.groupBy("c_nationkey").agg((F.count("*") - F.col("c_nationkey") % 3 * 5).alias("kept"))
    return state.tails(customer, kept, "c_nationkey", F.desc("c_custkey"), overlap=10, least=20).select("c_nationkey", "c_custkey")


@query(
    """
    WITH p AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS deadline, o_orderkey % 3 = 0 AS rehab, CASE WHEN o_orderkey % 4 = 0 THEN 'trash' END AS verdict,
                 CASE WHEN o_orderkey % 5 = 0 THEN DATE '1999-01-01' END AS title_deadline, o_orderkey % 7 = 0 AS title_closed, o_orderkey % 2 = 0 AS was_hidden, o_orderkey % 8 = 2 AS was_stale FROM orders),
    a AS (SELECT *, CASE WHEN rehab THEN 'hold' ELSE 'member' END AS b1 FROM p),
    b AS (SELECT *, coalesce(verdict, b1) AS bucket, coalesce(title_deadline, deadline) AS d FROM a),
    c AS (SELECT *, CASE WHEN was_stale AND d >= DATE '1998-06-01' THEN false ELSE was_hidden END AS h0 FROM b),
    e AS (SELECT *, title_closed OR d < DATE '1998-06-01' OR h0 AS hidden FROM c)
    SELECT bucket, hidden, count(*) AS n, count(*) FILTER (was_stale AND NOT hidden) AS n_revived, count(*) FILTER (bucket = 'member' AND NOT hidden AND d < DATE '1998-06-01') AS n_leaks FROM e GROUP BY bucket, hidden
    """
)
def ordered_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily steps in their order: hold, verdicts again, deadline from the title, revival of what was
    hidden as over and has a later deadline, closed by title, over, and a count of leaks."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("deadline"),
        (k % 3 == 0).alias("rehab_only"),
        F.when(k % 4 == 0, "trash").alias("verdict"),
        F.when(k % 5 == 0, F.lit("1999-01-01").cast("date")).alias("title_deadline"),
        (k % 7 == 0).alias("title_closed"),
        (k % 2 == 0).alias("hidden"),
        (k % 8 == 2).alias("hidden_as_over"),
    )
    done = state.daily_steps(rows, "1998-06-01")
    leak = (F.col("bucket") == "member") & ~F.col("hidden") & (F.col("deadline") < F.lit("1998-06-01").cast("date"))
    return done.groupBy("bucket", "hidden").agg(
        F.count("*").alias("n"), F.count_if(F.col("hidden_as_over") & ~F.col("hidden")).alias("n_revived"), F.count_if(leak).alias("n_leaks")
    )


@query(
    """
    WITH e AS (SELECT user_id, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    r AS (SELECT *, max(CASE WHEN NOT bad THEN k ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS last_good FROM e),
    z AS (SELECT user_id, arg_max(k - last_good, event_id) AS fails, count(*) FILTER (k - last_good = 3) AS n_off FROM r GROUP BY user_id)
    SELECT user_id, fails, n_off, fails >= 3 AS off, CASE WHEN fails >= 3 THEN DATE '2024-02-01' + 7 END AS retry_on FROM z
    """
)
def sites_switched_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites after three failures in a row: off, tried again a week later, on with the first success."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"))
    return state.switched_off(events, "user_id", "event_id", "failed", "2024-02-01")


@query(
    """
    WITH a AS (SELECT s_suppkey, lower(regexp_replace(s_name, '[^0-9A-Za-z]', '', 'g')) AS k, s_nationkey AS r FROM supplier),
    b AS (SELECT c_custkey, 'supplier' || lpad(CAST(c_custkey % 120 AS VARCHAR), 9, '0') AS k, c_nationkey AS r FROM customer WHERE c_custkey % 5 = 0),
    full_ AS (SELECT k, r, min(c_custkey) AS id, count(*) AS n FROM b GROUP BY k, r), short AS (SELECT k, min(c_custkey) AS id, count(*) AS n FROM b GROUP BY k)
    SELECT s_suppkey, CASE WHEN f.n >= 1 THEN f.id WHEN s.n = 1 THEN s.id END AS matched, CASE WHEN f.n >= 1 THEN 'key' WHEN s.n = 1 THEN 'without region' END AS by
    FROM a LEFT JOIN full_ f ON a.k = f.k AND a.r = f.r LEFT JOIN short s ON a.k = s.k
    """
)
def names_without_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names matched with their region, else without it where only one has that name."""
    left = table(spark, sf_dir, "supplier").select("s_suppkey", text.alnum_key(F.col("s_name")).alias("key"), F.col("s_nationkey").alias("region"))
    k = F.col("c_custkey")
    right = table(spark, sf_dir, "customer").filter(k % 5 == 0).select(
        F.concat(F.lit("supplier"), F.lpad((k % 120).cast("string"), 9, "0")).alias("key"), F.col("c_nationkey").alias("region"), k.alias("id")
    )
    return match.with_or_without(left, right, "key", "region", "id").select("s_suppkey", "matched", "by")


@query(
    """
    WITH a AS (SELECT p_partkey, p_brand, substr(p_type, 1, CAST(3 + p_partkey % 9 AS INTEGER)) AS r FROM part WHERE p_partkey % 2 = 0),
    b AS (SELECT p_partkey AS other, p_brand, substr(p_type, 1, 9) AS r FROM part WHERE p_partkey % 20 = 1)
    SELECT a.p_partkey, CASE WHEN count(b.other) = 1 THEN min(b.other) END AS matched, count(b.other) AS n_found
    FROM a LEFT JOIN b ON a.p_brand = b.p_brand AND (starts_with(a.r, b.r) OR starts_with(b.r, a.r)) GROUP BY a.p_partkey
    """
)
def mutual_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one row of equal name whose region begins the other's or is begun by it; several are none."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    left = part.filter(k % 2 == 0).select("p_partkey", "p_brand", F.substring("p_type", F.lit(1), (3 + k % 9).cast("int")).alias("region"))
    right = part.filter(k % 20 == 1).select(k.alias("other"), "p_brand", F.substring("p_type", 1, 9).alias("region"))
    return match.by_mutual_prefix(left, right, "p_partkey", ["p_brand"], "region", "other")


@query(
    """
    WITH u AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'www.' || regexp_extract(url, '://([^/?#]*)', 1) ELSE regexp_extract(url, '://([^/?#]*)', 1) END AS host FROM pages),
    p AS (SELECT page_id, regexp_replace(lower(host), '^(www\\.)+', '') AS h, starts_with(lower(host), 'www.') AS w FROM u),
    g AS (SELECT h, min(CASE WHEN w THEN page_id END) AS with_www, min(CASE WHEN NOT w THEN page_id END) AS without_www, count(*) AS n FROM p GROUP BY h)
    SELECT h AS host, with_www, without_www, n FROM g WHERE with_www IS NOT NULL AND without_www IS NOT NULL
    """
)
def www_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that pages name with and without www., one page of each."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    host = F.lower(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("www."), host)).otherwise(host))
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(host, r"^(www\.)+", "").alias("host"), host.startswith("www.").alias("www"))
    both = pages.groupBy("host").agg(
        F.min(F.when(F.col("www"), F.col("page_id"))).alias("with_www"), F.min(F.when(~F.col("www"), F.col("page_id"))).alias("without_www"), F.count("*").alias("n")
    )
    return both.filter("with_www IS NOT NULL AND without_www IS NOT NULL")


@query(
    """
    WITH a AS (SELECT o_custkey, o_orderkey, o_orderdate AS t FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT o_custkey, o_orderdate AS t FROM orders WHERE o_orderkey % 3 = 1),
    m AS (SELECT a.o_orderkey, min(abs(date_diff('day', a.t, b.t))) AS far, arg_min(date_diff('day', a.t, b.t), (abs(date_diff('day', a.t, b.t)), date_diff('day', a.t, b.t))) AS days FROM a LEFT JOIN b ON a.o_custkey = b.o_custkey GROUP BY a.o_orderkey)
    SELECT o_orderkey, CASE WHEN far <= 60 THEN days END AS days, CASE WHEN far IS NULL OR far > 60 THEN 'missing' WHEN days < 0 THEN 'faster' WHEN days > 0 THEN 'slower' ELSE 'same' END AS verdict FROM m
    """
)
def rival_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who was first: for each row of a rival the nearest own one of the customer within 60 days, from one
    sorted pass in each direction."""
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 3 < 2").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    theirs = F.col("o_orderkey") % 3 == 0
    return match.rival_verdicts(orders, "o_custkey", "day", "o_orderkey", theirs, 60).select("o_orderkey", "days", "verdict")


BUCKETS = ("only_old", "only_new", "equal", "closed since", "case only", "price rounded", "differs")


@query(
    """
    WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, floor(o_totalprice) AS p FROM orders WHERE o_orderkey % 9 > 0),
    n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN lower(o_orderstatus) WHEN o_orderkey % 7 = 0 THEN 'closed' ELSE o_orderstatus END AS s,
            CASE WHEN o_orderkey % 4 = 0 THEN floor(o_totalprice) + 0.4 WHEN o_orderkey % 11 = 0 THEN 0 ELSE floor(o_totalprice) END AS p FROM orders WHERE o_orderkey % 10 > 0),
    b AS (SELECT CASE WHEN n.k IS NULL THEN 'only_old' WHEN o.k IS NULL THEN 'only_new' WHEN o.s = n.s AND o.p = n.p THEN 'equal' WHEN n.s = 'closed' THEN 'closed since'
                 WHEN lower(o.s) = lower(n.s) AND o.p = n.p THEN 'case only' WHEN o.s = n.s AND abs(o.p - n.p) < 0.5 THEN 'price rounded' ELSE 'differs' END AS bucket
          FROM o FULL OUTER JOIN n ON o.k = n.k)
    SELECT bucket, count(*) AS n FROM b GROUP BY bucket
    """
)
def explained_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two collectors through a cascade of explanations."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    whole = F.floor("o_totalprice").cast("double")
    old = orders.filter(k % 9 > 0).select(k.alias("k"), F.col("o_orderstatus").alias("s"), whole.alias("p"))
    status = F.when(k % 5 == 0, F.lower("o_orderstatus")).when(k % 7 == 0, "closed").otherwise(F.col("o_orderstatus"))
    new = orders.filter(k % 10 > 0).select(k.alias("k"), status.alias("s"), F.when(k % 4 == 0, whole + 0.4).when(k % 11 == 0, 0.0).otherwise(whole).alias("p"))
    explain = [
        ("closed since", F.col("new_s") == "closed"),
        ("case only", (F.lower("old_s") == F.lower("new_s")) & (F.col("old_p") == F.col("new_p"))),
        ("price rounded", (F.col("old_s") == F.col("new_s")) & (F.abs(F.col("old_p") - F.col("new_p")) < 0.5)),
    ]
    return merge.reconciled(old, new, "k", ["s", "p"], explain).groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS run, count(*) AS n, sum(c_custkey)::BIGINT AS total FROM customer GROUP BY 1")
def appended_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended by run; a run that is repeated is there once."""
    customer, path = table(spark, sf_dir, "customer").select("c_custkey"), f"{folder(spark, 'runs')}/{uuid.uuid4().hex}"
    for name, where in (("even", "c_custkey % 2 = 0"), ("odd", "c_custkey % 2 = 1"), ("even", "c_custkey % 2 = 0")):
        merge.append_run(customer.filter(where), path, name)
    return spark.read.parquet(path).groupBy("run").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("total"))
