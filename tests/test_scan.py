"""Nearest rows of groups that are cut into cells, against one pass over sorted rows."""

import random
from statistics import median

import numpy
import pytest
from pyspark.sql import functions as F

from millrace.operators import scan, stats

SCHEMA = "k string, at {}, tie long, v long"


def nearest(rows):
    """{tie: (value before, value after)} by walking each group both ways."""
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[2]))
        for place, walk in ((0, own), (1, own[::-1])):
            last = None
            for r in walk:
                out.setdefault(r[2], [None, None])[place] = last
                last = r[3] if r[3] is not None else last
    return {t: tuple(v) for t, v in out.items()}


def table(kind):
    """A group with half of all rows, one of nulls, many small ones; ties in order, few values."""
    rng = random.Random(7)
    rows = []
    for tie in range(3000):
        key = rng.choice(["hot", "hot", "hot", None, f"k{rng.randrange(200)}", f"k{rng.randrange(200)}"])
        at = rng.choice([None, *range(400)]) if rng.random() < 0.1 else rng.randrange(400)
        rows.append((key, at, tie, rng.randrange(1000) if rng.random() < 0.02 else None))
    return rows


@pytest.mark.parametrize("kind", ["long", "date", "timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("cut", [scan.Cut(), scan.Cut(0.05, 100, 16), scan.Cut(0.001, 1, 3)])
def test_cells_change_nothing(spark, kind, cut):
    rows = table(kind)
    df = spark.createDataFrame(rows, SCHEMA.format("long"))
    at = {"long": F.col("at"), "date": F.date_from_unix_date(F.col("at").cast("int"))}.get(kind, F.timestamp_seconds("at").cast(kind))
    df = df.withColumn("at", at)
    v = F.col("v")
    out = scan.carried(df, ["k"], F.col("at"), F.col("tie"), {"back": (v, True), "ahead": (v, False)}, cut)
    assert out.columns == [*df.columns, "back", "ahead"]
    got = {r.tie: (r.back, r.ahead) for r in out.collect()}
    assert got == nearest(rows)


def test_a_hot_group_is_cut_evenly(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 100)).alias("k"), F.col("id").alias("at"))
    cells = scan.with_cells(df, ["k"], F.col("at"), scan.Cut(0.01, 1000, 50)).groupBy("k", "_cell").count().collect()
    sizes = [r["count"] for r in cells]
    assert max(sizes) <= 1.5 * median(sizes) and sum(sizes) == 20000
    assert scan.with_cells(df, ["k"], F.col("at")) is None


def test_empty_and_unordered_tables(spark):
    df = spark.createDataFrame([], SCHEMA.format("long"))
    assert scan.carried(df, ["k"], F.col("at"), F.col("tie"), {"back": (F.col("v"), True)}).count() == 0
    with pytest.raises(TypeError):
        scan.with_cells(df.unionByName(spark.createDataFrame([("a", 1, 1, 1)], df.schema)), ["k"], F.col("k"), scan.Cut(0.1, 1, 2))


@pytest.mark.parametrize("cut", [scan.Cut(), scan.Cut(0.05, 100, 16), scan.Cut(0.001, 1, 3)])
def test_quantiles_of_cut_groups(spark, cut):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", None, f"k{rng.randrange(40)}"]), rng.choice([None, rng.randrange(5000), 77])) for _ in range(4000)]
    rows += [("none", None)] * 300 + [("one", 5)]
    df = spark.createDataFrame(rows, "k string, v long")
    marks = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r.q for r in scan.quantiles(df, ["k"], "v", marks, cut=cut).collect()}
    middles = {r.k: r.upper_median for r in stats.upper_median(df, ["k"], "v", cut=cut).collect()}
    values = {}
    for k, v in rows:
        values.setdefault(k, [])
        if v is not None:
            values[k].append(v)
    assert set(got) == set(values) and got["none"] is None and "none" not in middles
    for k, v in values.items():
        if v:
            assert got[k] == pytest.approx([float(x) for x in numpy.quantile(v, marks)])
            assert middles[k] == sorted(v)[len(v) // 2]


def test_only_cells_with_a_wanted_place_are_sorted(spark):
    df = spark.range(30000).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 30011).alias("v"))
    out = scan.selected(df, ["k"], "v", lambda n: [F.floor(n / 2).cast("long")], scan.Cut(0.01, 1000, 50))
    assert dict(out.first()["at"]) == {15000: sorted(i * 7919 % 30011 for i in range(30000))[15000]} and out.first().n == 30000
