"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import written

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins each vertex's greater neighbours to the least vertex that it sees."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("least").alias("a"), "b").filter("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins each vertex and its lesser neighbours to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("least"))
    met = edges.join(least, "b")
    return (
        met.select(F.col("least").alias("a"), F.col("a").alias("b"))
        .unionAll(least.select(F.col("least").alias("a"), "b"))
        .filter("a < b")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (id, component): the least vertex that each vertex reaches, for all
    vertices but the least ones themselves. Loops and repeated edges do no harm."""
    edges = written(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges"
    )
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        edges = written(_small_star(written(_large_star(edges), "edges")), "edges")
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
    if state[0]:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
