"""Nearest rows before and after in the order of a group, also where one group has a large share of all rows.

A window sorts a group in one task. Groups with a large share of the rows are cut into cells by their own quantiles;
each cell is sorted by itself, gives its last (or first) value to a table of one row a cell, and gets what the cells before (or
after) it have to carry. Groups of ordinary size are one cell. No row is dropped or approximated: the quantiles only
say where cells end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType


@dataclass(frozen=True)
class Cut:
    """Groups of ``share`` of all rows and of ``least`` rows or more are cut into ``parts`` cells. At most
    1 / share groups are, so their table is bounded."""

    share: float = 0.001
    least: int = 100_000
    parts: int = 256


def _number(df: DataFrame, at: Column) -> Column:
    """A number that orders rows as ``at`` does (several values may share one)."""
    kind = df.select(at.alias("at")).schema["at"].dataType
    if isinstance(kind, DateType):
        return F.unix_date(at).cast("double")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return at.cast("timestamp").cast("double")
    if isinstance(kind, NumericType):
        return at.cast("double")
    raise TypeError(f"rows cannot be cut by values of type {kind.simpleString()}")


def _same(by: Sequence[str]) -> Column:
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return same


def same_groups(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """The inner join of two tables of one row a group, nulls being a group as well."""
    taken = [f"b.{c}" for c in right.columns if c not in by]
    return left.alias("a").join(right.alias("b"), _same(by)).select("a.*", *taken)


def _met(df: DataFrame, few: DataFrame, by: Sequence[str], take: str) -> DataFrame:
    """``df`` with ``take`` of the row of ``few``, a bounded table, that agrees in ``by``, nulls included."""
    return df.alias("a").join(F.broadcast(few).alias("b"), _same(by), "left").select("a.*", f"b.{take}")


def hot_groups(df: DataFrame, by: Sequence[str], cut: Cut = Cut()) -> DataFrame | None:
    """The groups that are cut, as a small table with ``_hot``; None if there is none."""
    counts = df.groupBy(*by).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.filter(F.col("_n") >= max(cut.least, cut.share * total)).drop("_n")
    keys = hot.collect()  # 1 / share rows at most
    return df.sparkSession.createDataFrame(keys, hot.schema).withColumn("_hot", F.lit(True)) if keys else None


def with_cells(df: DataFrame, by: Sequence[str], at: Column, cut: Cut = Cut()) -> DataFrame | None:
    """``df`` with ``_cell``, the place of a row's cell in its group: 0 but for groups that are cut. None if no group is.
    Rows that are equal in ``at`` are in one cell; a null is before all values."""
    hot = hot_groups(df, by, cut)
    if hot is None:
        return None
    rows = df.withColumn("_at", _number(df, at))
    marked = _met(rows, hot, by, "_hot")
    shares = [k / cut.parts for k in range(1, cut.parts)]
    splits = marked.filter("_hot").groupBy(*by).agg(F.array_distinct(F.percentile_approx("_at", shares)).alias("_splits"))
    splits = df.sparkSession.createDataFrame(splits.collect(), splits.schema)
    cell = F.size(F.filter("_splits", lambda s: s < F.col("_at")))
    return _met(rows, splits, by, "_splits").withColumn("_cell", F.when(F.col("_splits").isNull(), 0).otherwise(cell)).drop("_splits", "_at")


def carried(df: DataFrame, by: Sequence[str], at: Column, tie: Column, takes: dict[str, tuple[Column, bool]], cut: Cut = Cut()) -> DataFrame:
    """``df`` with a column for each of ``takes`` (name to value and direction): the value of the nearest row before
    (True) or after (False) in the order of ``at`` and ``tie`` in its group whose value is not null."""
    df = df.withColumns({f"_take_{name}": value for name, (value, _) in takes.items()}).withColumn("_tie", tie)
    cells = with_cells(df, by, at, cut)
    group = [*by] if cells is None else [*by, "_cell"]
    rows = df if cells is None else cells
    order = Window.partitionBy(*group).orderBy(at, F.col("_tie"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    near = {}
    for name, (_, back) in takes.items():
        value = F.col(f"_take_{name}")
        near[f"_near_{name}"] = F.last(value, ignorenulls=True).over(before) if back else F.first(value, ignorenulls=True).over(after)
    out = rows.withColumns(near)
    if cells is not None:
        out = _from_other_cells(out, cells, by, at, takes)
    else:
        out = out.withColumns({name: F.col(f"_near_{name}") for name in takes})
    gone = [f"_take_{name}" for name in takes] + [f"_near_{name}" for name in takes]
    return out.drop(*gone, "_tie", "_cell")


def _from_other_cells(out: DataFrame, cells: DataFrame, by: Sequence[str], at: Column, takes: dict) -> DataFrame:
    """What a cell lacks is carried from the cells beside it. Only groups that are cut have cells beside 0, so
    the table of cells is bounded by their number and ``parts``."""
    place = F.struct(at.alias("at"), F.col("_tie").alias("tie"))
    ends = []
    for name, (_, back) in takes.items():
        value = F.col(f"_take_{name}")
        pick = F.max_by if back else F.min_by
        ends.append(pick(value, F.when(value.isNotNull(), place)).alias(f"_end_{name}"))
    cut = cells.filter("_cell > 0").select(*by).distinct().withColumn("_hot", F.lit(True))
    table = _met(cells, cut, by, "_hot").filter("_hot").groupBy(*by, "_cell").agg(*ends)
    order = Window.partitionBy(*by).orderBy("_cell")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    carry = []
    for name, (_, back) in takes.items():
        end = F.col(f"_end_{name}")
        carry.append((F.last(end, ignorenulls=True).over(before) if back else F.first(end, ignorenulls=True).over(after)).alias(name))
    table = table.select(*by, "_cell", F.struct(*carry).alias("_carry"))
    out = _met(out, table, [*by, "_cell"], "_carry")
    return out.withColumns({name: F.coalesce(f"_near_{name}", F.col(f"_carry.{name}")) for name in takes}).drop("_carry")


def selected(df: DataFrame, by: Sequence[str], value: str, places: Callable[[Column], list[Column]], cut: Cut = Cut()) -> DataFrame:
    """For each group the number ``n`` of its values and, as a map ``at``, those at some ``places`` of ``n`` (from 0) in their
    sorted order. Equal values are counted first. A group with very many different ones is a histogram of cells: only the
    cells in which a wanted place falls are sorted. Nulls are not counted; a group without values has no row."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    cells = with_cells(counts, by, F.col(value), cut)
    rows = counts.withColumn("_cell", F.lit(0)) if cells is None else cells
    group = Window.partitionBy(*by)
    base = F.coalesce(F.sum("_sum").over(group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy(*by, "_cell").agg(F.sum("_n").alias("_sum")).withColumns({"_base": base, "n": F.sum("_sum").over(group)})
    inside = lambda low, n: lambda p: (low <= p) & (p < low + n)
    want = F.filter(F.array_distinct(F.array(*places(F.col("n")))), inside(F.col("_base"), F.col("_sum")))
    sums = sums.withColumn("_want", want).filter(F.size("_want") > 0)
    met = rows.alias("a").join(sums.alias("b"), _same([*by, "_cell"])).select("a.*", "b._base", "b.n", "b._want")
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = met.withColumn("_low", F.col("_base") + below).withColumn("_hits", F.filter("_want", inside(F.col("_low"), F.col("_n"))))
    found = found.select(*by, "n", value, F.explode("_hits").alias("_place"))
    return found.groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct("_place", value))).alias("at"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, marks: Sequence[float], name: str = "q", cut: Cut = Cut()) -> DataFrame:
    """Exact quantiles ``name`` by group, between two values in proportion. Groups with a large share of the rows are
    selected from cells; others are one aggregate, which holds a group's different values."""
    hot = hot_groups(df, by, cut)
    whole = F.percentile(value, [float(m) for m in marks]).alias(name)
    if hot is None:
        return df.groupBy(*by).agg(whole)
    marked = _met(df.select(*by, value), hot, by, "_hot")
    cold = marked.filter(F.col("_hot").isNull()).groupBy(*by).agg(whole)
    at = lambda n, m: (n - 1) * F.lit(float(m))
    ends = lambda n: [f(at(n, m)).cast("long") for m in marks for f in (F.floor, F.ceil)]
    found = selected(marked.filter("_hot").drop("_hot"), by, value, ends, cut)

    def between(m: float) -> Column:
        place = at(F.col("n"), m)
        low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
        of = lambda p: F.element_at("at", p).cast("double")
        return F.when(low == high, of(low)).otherwise((high - place) * of(low) + (place - low) * of(high))

    # a large group of nulls alone has no quantiles, but its row
    found = _met(hot.drop("_hot"), found.select(*by, F.array(*[between(m) for m in marks]).alias(name)), by, name)
    return cold.unionByName(found)
