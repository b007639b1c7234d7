"""Merging tables under ownership rules, overlays of edits, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ownership:
    """How the columns of a stored row follow an incoming one.

    ``owned``: taken from the incoming row if its source owns the stored row and nobody edited the
    field by hand. ``insert_only``: never updated. ``keep_if_null``: owned, but an incoming null
    erases nothing. ``follows``: column -> the owned column with which alone it changes. ``maps``:
    merged key by key, the incoming side wins, an empty map changes nothing. ``holds``: a flag -> the
    flag of hidden rows, on which it is always false. ``fallback``: takes what is not null, incoming
    first, locked or not. ``stamps``: a time -> the map with whose entries alone it moves on.
    """

    key: str
    source: str = "source"
    edited: str = "edited_fields"
    locked: str | None = None
    owned: tuple[str, ...] = ()
    insert_only: tuple[str, ...] = ()
    keep_if_null: tuple[str, ...] = ()
    follows: dict[str, str] = field(default_factory=dict)
    maps: tuple[str, ...] = ()
    holds: dict[str, str] = field(default_factory=dict)
    fallback: tuple[str, ...] = ()
    stamps: dict[str, str] = field(default_factory=dict)
    #: Old names of sources that have a new one: new -> old.
    renamed: dict[str, str] = field(default_factory=dict)


def ownership_merge(stored: DataFrame, incoming: DataFrame, rules: Ownership, outcome: str = "outcome") -> DataFrame:
    """The stored table after ``incoming`` (one row for each key), with what became of each row:
    ``kept`` (no incoming row), ``inserted``, ``updated``, or ``refused`` (another source's row).

    A stored row without a source takes no field from anybody: whether the sources are equal is
    unknown, which is not yes. One shuffle by the key on each side.
    """
    key = rules.key
    o, n = stored.alias("o"), incoming.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    had, has = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    theirs, mine = F.col(f"o.{rules.source}"), F.col(f"n.{rules.source}")
    paired = F.lit(False)
    for new, old in rules.renamed.items():
        paired = paired | ((mine == new) & (theirs == old))
    owner = F.coalesce((theirs == mine) | paired, F.lit(False))
    locked = F.coalesce(F.col(f"o.{rules.locked}"), F.lit(False)) if rules.locked else F.lit(False)
    by_hand = lambda c: F.coalesce(F.array_contains(F.col(f"o.{rules.edited}"), c), F.lit(False))
    free = lambda c: had & has & owner & ~by_hand(c) & ~locked
    touched = owner | theirs.isNull()  # other rows are refused whole

    def merged(c: str) -> Column:
        old, new = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == rules.source:
            return F.when(~had | owner & has, new).otherwise(old)
        if c in rules.maps:
            some = free(c) & (F.size(F.coalesce(new, F.create_map().cast("map<string,string>"))) > 0)
            kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
            return F.when(~had, new).when(some, F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), new)).otherwise(old)
        if c in rules.holds:
            hidden = F.coalesce(F.col(f"o.{rules.holds[c]}"), F.lit(False))
            return F.when(~had, new).when(has & touched & ~locked & ~by_hand(c) & hidden, False).when(free(c), new).otherwise(old)
        if c in rules.fallback:
            return F.when(~had, new).when(has & touched, F.coalesce(new, old)).otherwise(old)
        if c in rules.stamps:
            some = F.size(F.coalesce(F.col(f"n.{rules.stamps[c]}"), F.create_map().cast("map<string,string>"))) > 0
            return F.when(~had | has & touched & some, new).otherwise(old)
        if c in rules.follows:
            lead = rules.follows[c]
            changes = ~F.col(f"o.{lead}").eqNullSafe(F.col(f"n.{lead}"))
            return F.when(~had | free(lead) & changes, new).otherwise(old)
        if c in rules.keep_if_null:
            return F.when(~had | free(c) & new.isNotNull(), new).otherwise(old)
        if c in rules.owned:
            return F.when(~had | free(c), new).otherwise(old)
        return F.when(had, old).otherwise(new)  # insert only

    what = F.when(~has, "kept").when(~had, "inserted").when(owner | theirs.isNull(), "updated").otherwise("refused")
    cols = [F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key)]
    for c in stored.columns:
        if c == key:
            continue
        cols.append((merged(c) if c in incoming.columns else F.col(f"o.{c}")).alias(c))
    return both.select(*cols, what.alias(outcome))


def blanks_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Blank texts of some columns as nulls, as dates, times and numbers are read from them."""
    return df.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in columns})


def rejected(df: DataFrame, reason: str, key: str, sample: int = 20, length: int = 160) -> DataFrame:
    """For each reason (cut at ``length``) how many rows were rejected for it, and the least ``sample``
    keys of them; rows without a reason are good. Samples are kept small before they meet."""
    why = F.substring(reason, 1, length)
    bad = df.filter(F.col(reason).isNotNull()).select(why.alias("reason"), F.col(key).alias("key"))
    counts = bad.groupBy("reason").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("reason").orderBy("key"))
    few = bad.withColumn("_at", first).filter(F.col("_at") <= sample).groupBy("reason").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    return counts.join(few, "reason")


def soft_deleted(df: DataFrame, when: Column, reason: str, on, hidden: str = "hidden", why: str = "hidden_reason", date: str = "hidden_on") -> DataFrame:
    """Rows hidden with a reason and a day where ``when`` holds and no reason stands yet; none is dropped."""
    now = F.coalesce(when, F.lit(False)) & F.col(why).isNull()
    return df.withColumns(
        {
            hidden: F.when(now, True).otherwise(F.col(hidden)),
            why: F.when(now, reason).otherwise(F.col(why)),
            date: F.when(now, F.lit(on).cast("date")).otherwise(F.col(date)),
        }
    )


def relabelled(df: DataFrame, label: str, new: Column) -> tuple[DataFrame, DataFrame]:
    """``df`` with its label replaced where ``new`` is not null, and the rows of each label before and
    after, from one pass."""
    marked = df.withColumn("_new", F.coalesce(new, F.col(label)))
    each = F.explode(F.array(F.struct(F.col(label).alias("label"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct(F.col("_new").alias("label"), F.lit(0).alias("b"), F.lit(1).alias("a"))))
    counts = marked.select(each.alias("x")).groupBy("x.label").agg(F.sum("x.b").alias("n_before"), F.sum("x.a").alias("n_after"))
    return marked.withColumn(label, F.col("_new")).drop("_new"), counts


def reload(df: DataFrame, path: str) -> tuple[int, int]:
    """The table at ``path`` replaced by ``df``; rows written, as the writer saw them, and rows read
    back. They differ only if the store lost some, which is an error."""
    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(path)
    written, read = seen.get["n"], df.sparkSession.read.parquet(path).count()
    if written != read:
        raise ValueError(f"{written} rows were written to {path}, and {read} are there")
    return written, read


def append_run(df: DataFrame, path: str, run: str) -> None:
    """The rows of a run added to the table at ``path``, under the run's name: a run that is repeated
    replaces its own rows, so nothing is added twice. A run without rows leaves its (empty) mark."""
    df.write.mode("overwrite").parquet(f"{path}/run={run}")


def overlay(base: DataFrame, edits: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``base`` with ``edits`` (key, field, value, seq) laid over its text ``fields``: the latest
    edit of a field counts, a blank one is none, an equal one changes nothing. Adds
    ``edited_fields``, sorted. Edits are turned to one row a key before they are joined."""
    value = F.nullif(F.trim("value"), F.lit(""))
    wide = (
        edits.withColumn("value", value)
        .filter(F.col("value").isNotNull())
        .groupBy(F.col(key).alias("edit_key"))
        .agg(*[F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("seq"))).alias(f"new_{f}") for f in fields])
    )
    out = base.join(wide, base[key] == wide["edit_key"], "left")
    changed = lambda f: F.col(f"new_{f}").isNotNull() & ~F.col(f"new_{f}").eqNullSafe(F.col(f))
    marks = F.array_compact(F.array(*[F.when(changed(f), F.lit(f)) for f in sorted(fields)]))
    keep = [F.when(changed(c), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns]
    return out.select(*keep, marks.alias("edited_fields"))


def orphan_edits(base: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Edits of keys that the base does not have."""
    return edits.join(base.select(key), key, "left_anti")


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace stored ones of equal keys."""
    return stored.join(incoming.select(*keys), list(keys), "left_anti").unionByName(incoming, allowMissingColumns=True)


def reconciled(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], explain: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """Each key of either table with a bucket: ``only_old``, ``only_new``, ``equal``, the name of the
    first explanation that holds (over columns ``old_c`` and ``new_c``), or ``differs``."""
    o = old.select(key, *[F.col(c).alias(f"old_{c}") for c in columns]).withColumn("in_old", F.lit(True))
    n = new.select(key, *[F.col(c).alias(f"new_{c}") for c in columns]).withColumn("in_new", F.lit(True))
    both = o.join(n, key, "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    bucket = F.when(F.col("in_new").isNull(), "only_old").when(F.col("in_old").isNull(), "only_new").when(same, "equal")
    for name, holds in explain:
        bucket = bucket.when(holds, name)
    return both.withColumn("bucket", bucket.otherwise("differs")).drop("in_old", "in_new")
