"""Joins of the domain: unique matches, nearest rows, brackets, wildcard subscriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.scan import Cut, carried

def unique_or_null(left: DataFrame, right: DataFrame, key: str, take: str, min_alias: str = "matched") -> DataFrame:
    """``left`` with ``take`` of the right row of equal key if exactly one has that key. The right
    side is reduced to one row a key first, so the join cannot multiply rows."""
    only = right.groupBy(key).agg(F.min(take).alias(min_alias), F.count("*").alias("n_found"))
    out = left.join(only, key, "left")
    return out.withColumn(min_alias, F.when(F.col("n_found") == 1, F.col(min_alias))).withColumn("n_found", F.coalesce("n_found", F.lit(0)))


def nearest_before(df: DataFrame, by: Sequence[str], at: Column, tie: Column, is_left: Column, is_right: Column, take: Column, name: str, cut: Cut = Cut()) -> DataFrame:
    """For each row that ``is_left``, ``take`` of the latest earlier row of its group that
    ``is_right``: an as-of join of a table with itself without a join. Groups with a large share of the rows are
    sorted in parts."""
    return carried(df.withColumn("_left", is_left), by, at, tie, {name: (F.when(is_right, take), True)}, cut).filter("_left").drop("_left")


def nearest_in_group(df: DataFrame, by: Sequence[str], value: str, key: str, k: int) -> DataFrame:
    """For each row the ``k`` other rows of its group that are nearest in ``value``, of equally near
    ones those of smaller key: (key, similar_key, place). Only the k + 1 least keys of a value can be
    among them, and only the k values on each side, so no pairs of rows are made."""
    least = df.groupBy(*by, value, key).count().withColumn("_n", F.row_number().over(Window.partitionBy(*by, value).orderBy(key)))
    least = least.filter(F.col("_n") <= k + 1).groupBy(*by, value).agg(F.collect_list(key).alias("_keys"))
    around = Window.partitionBy(*by).orderBy(value).rowsBetween(-k, k)
    near = least.withColumn("_near", F.collect_list(F.struct(F.col(value).alias("v"), F.col("_keys").alias("keys"))).over(around))
    out = df.select(*by, value, key).join(near.select(*by, value, "_near"), [*by, value])
    each = F.flatten(F.transform("_near", lambda x: F.transform(x["keys"], lambda i: F.struct(F.abs(x["v"] - F.col(value)).alias("far"), i.alias("key")))))
    best = F.slice(F.array_sort(F.filter(each, lambda x: x["key"] != F.col(key))), 1, k)
    return out.select(key, F.posexplode(best).alias("_at", "_best")).select(
        key, F.col("_best.key").alias(f"similar_{key}"), (F.col("_at") + 1).alias("place")
    )


def bracket(value: Column, bounds: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first bound that the value is under: ``lo <= x < hi`` for sorted bounds."""
    out = F.when(F.lit(False), "")
    for high, label in bounds:
        out = out.when(value < high, label)
    return out.otherwise(otherwise)


#: Rules up to which they are broadcast.
BROADCAST_RULES = 100_000
#: Rules for all values that one row of a table of them holds.
RULES_TOGETHER = 1000


def wildcard_match(facts: DataFrame, rules: DataFrame, on: str, any_value: str = "*") -> DataFrame:
    """Facts with each rule for their value and each rule for all values: equi joins with the rules
    on the broadcast side while they are few, rather than one disjunctive join, which could only be
    a nested loop. Rules for all values are packed, some to a row, and a fact is sent to each row."""
    n = rules.count()
    near = F.broadcast if n <= BROADCAST_RULES else (lambda df: df)
    exact = facts.join(near(rules.filter(F.col(on) != any_value)), on)
    others = [c for c in rules.columns if c != on]
    packs = max(1, n // RULES_TOGETHER)
    packed = (
        rules.filter(F.col(on) == any_value)
        .groupBy(F.pmod(F.xxhash64(*others), F.lit(packs)).cast("int").alias("_pack"))
        .agg(F.collect_list(F.struct(*others)).alias("_rules"))
    )
    sent = facts.withColumn("_pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    rest = sent.join(near(packed), "_pack").select(*facts.columns, F.explode("_rules").alias("_rule"))
    return exact.unionByName(rest.select(*facts.columns, *[F.col("_rule")[c].alias(c) for c in others]))


def self_pairs(df: DataFrame, on: Sequence[str], key: str, differ: str, carry: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows that agree in ``on`` and differ in ``differ``, smaller key first."""
    side = lambda n: df.select(*on, F.col(key).alias(f"{key}_{n}"), F.col(differ).alias(f"{differ}_{n}"), *[F.col(c).alias(f"{c}_{n}") for c in carry])
    return side("a").join(side("b"), list(on)).filter((F.col(f"{key}_a") < F.col(f"{key}_b")) & (F.col(f"{differ}_a") != F.col(f"{differ}_b")))


def with_or_without(left: DataFrame, right: DataFrame, key: str, region: str, take: str) -> DataFrame:
    """``left`` with the least ``take`` of the right rows of equal key and region, else that of the only
    right row of equal key, and by which of them it was found. Both sides of the joins have one row
    a key, so no row is multiplied."""
    whole = right.groupBy(key, region).agg(F.min(take).alias("_whole"))
    short = right.groupBy(key).agg(F.min(take).alias("_short"), F.count("*").alias("_n"))
    out = left.join(whole, [key, region], "left").join(short.filter("_n = 1").drop("_n"), key, "left")
    by = F.when(F.col("_whole").isNotNull(), "key").when(F.col("_short").isNotNull(), "without region")
    return out.withColumns({"matched": F.coalesce("_whole", "_short"), "by": by}).drop("_whole", "_short")


def by_mutual_prefix(left: DataFrame, right: DataFrame, key: str, on: Sequence[str], text: str, take: str) -> DataFrame:
    """For each left row the one right row that agrees in ``on`` and whose text begins the left one's or
    is begun by it, and how many do. Rows without a text or a value of ``on`` fit none.

    No pairs are made: texts are cut to the lengths that the other side has, and meet by equality. A text is begun by
    those right texts that equal one of its prefixes; it begins those of which it equals a prefix, and these are counted
    before they meet. Different texts are looked up once, however many rows have them."""
    named = [*on, text]
    asked = left.select(*named).dropna().distinct()
    have = right.dropna(subset=named).groupBy(*named).agg(F.count("*").alias("_n"), F.min(take).alias("_only"))
    cut = F.substring(text, F.lit(1), F.col("_length"))
    at_most = lambda other, longest: F.explode(F.filter(_lengths(other, text), lambda n: n <= longest)).alias("_length")
    begun = asked.select(*named, at_most(have, F.length(text))).withColumn("_text", cut)
    begun = begun.join(have.withColumnRenamed(text, "_text"), [*on, "_text"]).select(*named, "_n", "_only")
    begins = have.select(*named, "_n", "_only", at_most(asked, F.length(text) - 1)).withColumn(text, cut)
    found = begun.unionByName(begins.drop("_length")).groupBy(*named).agg(F.sum("_n").alias("n_found"), F.min("_only").alias("_only"))
    out = left.select(key, *named).join(found, named, "left").withColumn("n_found", F.coalesce("n_found", F.lit(0).cast("long")))
    return out.select(key, F.when(F.col("n_found") == 1, F.col("_only")).alias("matched"), "n_found")


def _lengths(df: DataFrame, text: str) -> Column:
    """The different lengths of the texts, at most as many as the longest text has characters."""
    found = sorted(r[0] for r in df.select(F.length(text)).distinct().collect())
    return F.array(*map(F.lit, found)) if found else F.array().cast("array<int>")


def class_pairs(df: DataFrame, on: Sequence[str], source: str, key: str, apart: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Candidates for merging: rows that agree in ``on`` and come from different sources, without pairs of rows.
    Returns the classes (``on``, ``source``, the least key as ``rep``, ``n``, and the least and greatest ``kind``) and the pairs of
    representatives of the same ``on``: rep_a < rep_b, how many pairs of rows they stand for, and whether their kinds differ.
    Pairs in ``apart`` (rep_a, rep_b in either order), judged before to be different, are left out. Nulls in ``on`` or
    ``source`` fit nothing.

    A group's classes are as many as its sources, so its pairs are bounded by their square."""
    classes = df.dropna(subset=[*on, source]).groupBy(*on, source).agg(
        F.min(key).alias("rep"), F.count("*").alias("n"), F.min(kind).alias("kind_least"), F.max(kind).alias("kind_most")
    )
    of = F.struct("rep", F.col(source).alias("source"), "n", "kind_least", "kind_most")
    groups = classes.groupBy(*on).agg(F.sort_array(F.collect_list(of)).alias("_of")).filter(F.size("_of") > 1)
    pairs = groups.select(*on, "_of", F.posexplode("_of").alias("_at", "a")).select(*on, "a", F.explode(F.slice("_of", F.col("_at") + 2, F.size("_of"))).alias("b"))
    one = lambda x, y: (F.col(f"{x}.kind_least") == F.col(f"{y}.kind_least")) & (F.col(f"{x}.kind_most") == F.col(f"{y}.kind_most"))
    same = one("a", "b") & (F.col("a.kind_least") == F.col("a.kind_most"))
    pairs = pairs.select(
        *on, F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b"), F.col("a.source").alias("source_a"), F.col("b.source").alias("source_b"),
        (F.col("a.n") * F.col("b.n")).alias("n_pairs"), (~F.coalesce(same, F.lit(False))).alias("kinds_differ"),
    )
    judged = apart.select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b")).distinct()
    return classes, pairs.join(judged, ["rep_a", "rep_b"], "left_anti")


def rival_verdicts(df: DataFrame, by: str, day: str, key: str, theirs: Column, within: int, cut: Cut = Cut()) -> DataFrame:
    """For each row that is ``theirs``, the days to the nearest of the others of its group (negative: the
    other was before), of two equally near ones the earlier, and who was faster; beyond ``within``
    days there is none. Two running windows, no join; groups with a large share of the rows are sorted in parts."""
    mine = F.when(~theirs, F.col(day))
    out = carried(df.withColumn("_theirs", theirs), [by], F.col(day), theirs.cast("int"), {"_before": (mine, True), "_after": (mine, False)}, cut)
    back, ahead = F.date_diff("_before", day), F.date_diff("_after", day)
    near = F.when(F.col("_after").isNull() | (-back <= ahead), back).otherwise(ahead)
    out = out.filter("_theirs").drop("_theirs")
    days = F.when(F.abs(near) <= within, near)
    out = out.withColumn("days", F.when(F.col("_before").isNull(), F.when(F.abs(ahead) <= within, ahead)).otherwise(days))
    verdict = F.when(F.col("days").isNull(), "missing").when(F.col("days") < 0, "faster").when(F.col("days") > 0, "slower").otherwise("same")
    return out.withColumn("verdict", verdict).drop("_before", "_after")
