"""A merge into a bucketed table rewrites the buckets that it touches, and nothing else."""

import pathlib

import pytest

from millrace.operators import merge
from millrace.streaming import buckets

SCHEMA = "id long, v string, at long, source string, edited_fields array<string>"
RULES = merge.Ownership("id", owned=("v", "at"))


def rows(spark, pairs, at=0, source="s"):
    return spark.createDataFrame([(i, v, at, source, None) for i, v in pairs], SCHEMA)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}


def values(df):
    return dict(df.select("id", "v").collect())


@pytest.fixture
def kept(spark, tmp_path):
    table = buckets.BucketTable(str(tmp_path / "t"), "id", 8)
    table.create(rows(spark, [(i, "old") for i in range(100)]))
    return table


def test_untouched_files_stay_and_old_versions_are_read(spark, kept):
    before = files(kept.path)
    assert len(before) == 8
    touched = kept.merge(rows(spark, [(3, "new"), (1000, "more")]), lambda o, n: merge.ownership_merge(o, n, RULES), 1)
    assert 1 <= len(touched) <= 2
    after = files(kept.path)
    assert all(after[f] == t for f, t in before.items())
    assert {f.split("/")[1] for f in after.keys() - before.keys()} == {f"_bucket={b}" for b in touched}
    want = {i: "old" for i in range(100)}
    assert values(kept.read(spark, 0)) == want
    assert values(kept.read(spark)) == want | {3: "new", 1000: "more"}
    assert kept.read(spark).count() == 101


def test_a_batch_again_and_a_lost_attempt(spark, kept):
    sink = buckets.bucket_sink(kept, RULES, "at")
    batch = rows(spark, [(1, "a"), (2, "b")], at=1).unionAll(rows(spark, [(1, "later")], at=2)).unionAll(rows(spark, [(None, "x")]))
    kept._write(rows(spark, [(1, "lost"), (77, "lost")]), 1)  # written, but never in a manifest
    assert values(kept.read(spark))[1] == "old"
    sink(batch, 0)
    once, seen = values(kept.read(spark)), files(kept.path)
    assert (once[1], once[2], len(once)) == ("later", "b", 100)
    sink(rows(spark, [(1, "other")], at=9), 0)  # version 1 is there
    assert values(kept.read(spark)) == once and files(kept.path) == seen
    sink(rows(spark, []), 1)  # a batch without rows is a version as well
    assert kept.versions(spark) == [0, 1, 2] and values(kept.read(spark)) == once
    sink(rows(spark, [(1, "theirs")], at=9, source="other"), 2)
    assert values(kept.read(spark)) == once


def test_a_merge_may_empty_a_bucket(spark, kept):
    gone = rows(spark, [(5, None)])
    touched = kept.merge(gone, lambda o, n: o.filter("false"), 1)
    assert len(touched) == 1
    left = kept.read(spark).select(kept.bucket().alias("b")).distinct().count()
    assert left == 7 and len(files(kept.path)) == 8


def test_empty_tables_and_other_counts(spark, tmp_path):
    table = buckets.BucketTable(str(tmp_path / "e"), "id", 4)
    table.create(rows(spark, []))
    assert table.read(spark).count() == 0
    buckets.bucket_sink(table, RULES, "at")(rows(spark, [(1, "a")]), 0)
    assert values(table.read(spark)) == {1: "a"}
    with pytest.raises(ValueError, match="4 buckets"):
        buckets.BucketTable(table.path, "id", 5).read(spark)
    with pytest.raises(ValueError, match="already"):
        table.create(rows(spark, []))
    assert values(table.read(spark)) == {1: "a"}
