"""Paged listings: what is read, how many pages are asked for, growth, failures and restarts."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.sources import paged

SCHEMA = "id long, day string"


class Counting(paged.FolderListing):
    """A listing that leaves a mark for each page asked for, from whatever process."""

    def __init__(self, path):
        super().__init__(path)
        self.asked = path + "-asked"

    def page(self, number):
        with open(self.asked, "a") as f:
            f.write(f"{number}\n")
        return super().page(number)


def put(path, rows, size, after=0):
    """The rows behind those that are there, by hand."""
    for k, row in enumerate(rows, after):
        os.makedirs(f"{path}/page={k // size}", exist_ok=True)
        with open(f"{path}/page={k // size}/a.json", "a") as f:
            f.write(json.dumps(row) + "\n")
    declare(path, after + len(rows), size)


def declare(path, total, size):
    os.makedirs(f"{path}/declared", exist_ok=True)
    with open(f"{path}/declared/a.json", "a") as f:
        f.write(json.dumps({"total": total, "size": size}) + "\n")


def listed(n, first=0):
    return [{"id": i, "day": f"2024-{1 + i % 12:02}-01" if i % 5 else None} for i in range(first, first + n)]


def asked(path):
    with open(path + "-asked") as f:
        return sorted(int(x) for x in f.read().split())


def read(spark, path, **options):
    paged.register(spark)
    return spark.read.format("paged").schema(SCHEMA).options(listing="test_paged:Counting", **options).load(path)


def test_a_whole_listing_and_its_ranges(spark, tmp_path):
    path = str(tmp_path / "l")
    put(path, listed(1003), 10)
    out = read(spark, path, key="id", pagesATask=7)
    assert out.rdd.getNumPartitions() == 15
    assert sorted((r.id, r.day) for r in out.collect()) == [(r["id"], r["day"]) for r in listed(1003)]
    assert asked(path) == list(range(101))


@pytest.mark.parametrize(
    ("where", "ids", "most"),
    [
        ("id >= 405 AND id < 421", range(405, 421), 3 + 16), ("id = 7", [7], 2 + 16), ("id > 1002", [], 2 + 16), ("id < 0", [], 1 + 16),
        ("id IN (3, 12) AND day IS NOT NULL", [3, 12], 2 + 16), ("id <= 5 OR id = 900", [*range(6), 900], 101),
    ],
)
def test_predicates_on_the_key_become_pages(spark, tmp_path, where, ids, most):
    path = str(tmp_path / "l")
    put(path, listed(1003), 10)
    assert sorted(r.id for r in read(spark, path, key="id").filter(where).collect()) == list(ids)
    assert len(asked(path)) <= most


def test_short_pages_and_stale_pages_end_a_part(spark, tmp_path):
    path = str(tmp_path / "l")
    put(path, listed(35), 10)
    declare(path, 900, 10)
    assert read(spark, path).count() == 35 and asked(path) == [0, 1, 2, 3, 64]
    newest = str(tmp_path / "n")
    days = [{"id": i, "day": None if i == 3 else f"20{40 - i // 10:02}-01-01"} for i in range(300)]
    put(newest, days, 10)
    out = read(spark, newest, staleColumn="day", staleBefore="2031-01-01").collect()
    assert sorted(r.id for r in out) == list(range(100)) and asked(newest) == list(range(13))


def test_empty_listings(spark, tmp_path):
    path = str(tmp_path / "l")
    assert read(spark, path).count() == 0
    declare(path, 0, 10)
    assert read(spark, path, key="id").filter("id = 1").count() == 0


def test_pages_written_from_a_table(spark, tmp_path):
    path = f"file://{tmp_path}/l"
    df = spark.range(0, 1234).select("id", F.when(F.col("id") % 3 == 0, "2024-01-01").alias("day"))
    assert paged.write_listing(df.filter("id < 1000"), path, "id", 30) == 1000
    assert paged.write_listing(df.filter("id >= 1000"), path, "id", 30, after=1000) == 1234
    assert paged.write_listing(df.filter("id < 0"), path, "id", 30, after=1234) == 1234
    listing = paged.FolderListing(path)
    assert listing.declared() == (1234, 30)
    # the page that both wrote is of both, in whatever order of files
    pages = [sorted(r["id"] for r in listing.page(n)) for n in range(43)]
    assert [len(p) for p in pages] == [30] * 41 + [4, 0] and sum(pages, []) == list(range(1234))


def run(spark, path, at, into, fails=False):
    paged.register(spark)
    stream = spark.readStream.format("paged").schema(SCHEMA).options(listing="test_paged:Counting", overlap=15, pagesATask=2).load(path)

    def keep(batch, number):
        if fails:
            batch.limit(3).collect()
            raise RuntimeError("killed")
        into.append([r.id for r in batch.collect()])

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", at).trigger(availableNow=True).start()
    query.awaitTermination()


def test_a_stream_reads_growth_with_an_overlap_and_again_after_a_failure(spark, tmp_path):
    path, at, got = str(tmp_path / "l"), str(tmp_path / "state"), []
    put(path, listed(47), 10)
    run(spark, path, at, got)
    run(spark, path, at, got)  # nothing new: no batch
    assert [sorted(b) for b in got] == [list(range(47))]
    put(path, listed(30, 47), 10, after=47)
    with pytest.raises(Exception, match="killed"):
        run(spark, path, at, got, fails=True)
    assert len(got) == 1
    put(path, listed(20, 77), 10, after=77)  # it grew on in between
    run(spark, path, at, got)  # the failed batch again
    run(spark, path, at, got)
    assert [(min(b), max(b), len(b)) for b in got] == [(0, 46, 47), (32, 76, 45), (62, 96, 35)]
    assert set(Counter(i for b in got for i in b)) == set(range(97))
    put(path, [], 10, after=97)  # declared again without growth
    run(spark, path, at, got)
    assert len(got) == 3
