"""Tables as paged listings, read back as batches and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import query, table
from millrace.plans.streams import folder
from millrace.sources import paged
from millrace.streaming import jobs

#: Rows that a page has at most.
PAGE = 500


def _listed(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    paged.register(spark)
    return spark.read.format(paged.NAME).schema(schema).options(**options).load(path)


def _listing(spark: SparkSession, name: str) -> str:
    at = folder(spark, name)
    return at if "://" in at else f"file://{at}"


@query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey < 700 THEN 'low' ELSE 'high' END AS part FROM customer")
def paged_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in pages of a stable key, read as two ranges of the key: each asks for its own pages only."""
    path = f"{_listing(spark, 'scan')}/customer"
    paged.write_listing(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path, "c_custkey", PAGE)
    # a read of its own for each range: scans of one relation would share what was pushed down
    read = lambda: _listed(spark, path, "c_custkey long, c_name string, c_acctbal double", key="c_custkey")
    low = read().filter("c_custkey < 700").withColumn("part", F.lit("low"))
    return low.unionByName(read().filter("c_custkey >= 700").withColumn("part", F.lit("high")))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate >= DATE '1997-01-01'")
def newest_until_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders listed with the newest first, read until three pages in a row are all too old."""
    path = f"{_listing(spark, 'newest')}/orders"
    day = F.col("o_orderdate").cast("date")
    place = (F.lit(100_000) - F.unix_date(day)).cast("long") * 10_000_000_000_000 + F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(place.alias("place"), "o_orderkey", day.cast("string").alias("day"))
    paged.write_listing(rows, path, "place", PAGE)
    found = _listed(spark, path, "o_orderkey long, day string", staleColumn="day", staleBefore="1997-01-01")
    return found.select("o_orderkey", F.col("day").cast("date").alias("day"))


@query("SELECT o_orderkey, o_totalprice, 1 + CAST(o_orderkey % 3 AS INTEGER) AS came FROM orders")
def streaming_paged_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of orders that grows twice, as a stream: each batch reads what was added and an overlap,
    rows are taken by key, and a start without growth reads nothing."""
    at = _listing(spark, "tail")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (1 + F.col("o_orderkey") % 3).cast("int").alias("came"))
    paged.register(spark)
    stream = spark.readStream.format(paged.NAME).schema("o_orderkey long, o_totalprice double, came int").option("overlap", 2 * PAGE).load(f"{at}/orders")
    total = 0
    for came in (1, 2, 3, None):
        if came is not None:
            total = paged.write_listing(orders.filter(F.col("came") == came), f"{at}/orders", "o_orderkey", PAGE, after=total)
        found = jobs.run_available(stream, f"{at}/rows", f"{at}/state")
    return found.select("o_orderkey", "o_totalprice", "came").dropDuplicates(["o_orderkey"])
