"""Mutual prefixes and classes of merge candidates against pairs by hand."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from millrace.operators import match


def test_mutual_prefixes_against_all_pairs(spark):
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", *("".join(rng.choice("abä") for _ in range(rng.randrange(1, 6))) for _ in range(12))])
    left = [(i, rng.choice(["x", "y", None]), text()) for i in range(400)]
    right = [(1000 + i, rng.choice(["x", "y", "z", None]), text()) for i in range(60)]
    out = match.by_mutual_prefix(
        spark.createDataFrame(left, "id long, name string, region string"), spark.createDataFrame(right, "other long, name string, region string"), "id", ["name"], "region", "other"
    )
    want = {}
    for i, name, t in left:
        fits = [o for o, n, r in right if name is not None and n == name and t is not None and r is not None and (t.startswith(r) or r.startswith(t))]
        want[i] = (fits[0] if len(fits) == 1 else None, len(fits))
    assert {r.id: (r.matched, r.n_found) for r in out.collect()} == want
    assert any(m is not None for m, _ in want.values()) and any(n > 1 for _, n in want.values())


def test_a_name_with_very_many_rows(spark):
    n = 100_000
    left = spark.range(n).select("id", F.lit("one").alias("name"), F.concat(F.lit("r"), F.col("id") % 1000).alias("region"))
    right = spark.range(n).select(F.col("id").alias("other"), F.lit("one").alias("name"), F.concat(F.lit("r"), F.col("id") % 500).alias("region"))
    out = match.by_mutual_prefix(left, right, "id", ["name"], "region", "other")
    # each number of 1000 is begun by, or begins, some of those below 500
    texts = {str(k): sum(str(k).startswith(str(j)) or str(j).startswith(str(k)) for j in range(500)) for k in range(1000)}
    assert out.agg(F.sum("n_found")).first()[0] == sum(texts.values()) * (n // 1000) * (n // 500)
    empty = match.by_mutual_prefix(left, right.limit(0), "id", ["name"], "region", "other")
    assert empty.agg(F.max("n_found"), F.count("*")).first() == (0, n)


def test_classes_of_candidates_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["o1", "o2", None]), rng.choice(["a", "b", "c", None]), rng.choice(["k", "l", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, org string, source string, kind string")
    none = spark.createDataFrame([], "rep_a long, rep_b long")
    classes, pairs = match.class_pairs(df, ["org"], "source", "id", none, "kind")
    got = pairs.collect()
    want = sum(x[1] == y[1] and x[2] != y[2] and None not in (x[1], x[2], y[2]) for x, y in combinations(rows, 2))
    assert sum(r.n_pairs for r in got) == want and len(got) == 6
    assert sum(r.n for r in classes.collect()) == sum(r[1] is not None and r[2] is not None for r in rows)
    first = got[0]
    apart = spark.createDataFrame([(first.rep_b, first.rep_a)] * 2, "rep_a long, rep_b long")
    left = match.class_pairs(df, ["org"], "source", "id", apart, "kind")[1].collect()
    assert sorted(left) == sorted(r for r in got if r != first)
