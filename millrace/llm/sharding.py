"""Sharding by histogram sort.

Rows are sorted by (hash of the text, id) into shards of nearly equal bytes. Exact bytes and rows
below candidate key boundaries are counted across partitions, the candidates around each wanted
splitter are refined until they meet the tolerance, and then the rows are exchanged once: straight
into the task that their key belongs to, and sorted there. Since the rows below each splitter are
known exactly, a row's slot in its shard is its place in the task plus a constant; no shard is
gathered in one task.

Rows that are equal in hash and id are first taken as one place of the order. Where so many are that
no splitter can be right (a third of all rows, say), each row gets a number, written with it, that
takes the place of the id, and the splitters are looked for again.

A round counts candidates by a prefix of the key: at most ``2 ** ROUND_BITS`` for each splitter
that is still open, so what reaches the driver does not grow with the rows. Where one text holds
more than a shard may (a third of all rows, say), its rows are split by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import unpacked, written

#: Bits of the text hash that make the first key component; the second is the id.
KEY_BITS = 60
#: Bits of a key component that a round adds to the candidate boundaries.
ROUND_BITS = 12
#: A splitter may miss its place by this share of a part.
TOLERANCE = 0.002


@dataclass(frozen=True)
class Splitter:
    """The first key (hash, id) of a part, and the exact rows and bytes below it."""

    key: tuple[int, int]
    rows: int
    bytes: int


LOWEST = -(1 << 63)


def text_key(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS)


def sized(text: Column) -> Column:
    """The size of a text: its UTF-8 bytes (none for null) plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _counted(thin: DataFrame, group: list[Column]) -> list:
    """Rows and bytes of each candidate interval, in key order."""
    found = thin.groupBy(*group).agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    return sorted((tuple(r)[: len(group)], r["n"], r["b"]) for r in found)


def find_splitters(
    thin: DataFrame, wanted: list[tuple[float, float, float]], first_bits: int, id_range: tuple[int, int]
) -> tuple[list[Splitter], bool]:
    """A splitter for each (wanted weight below, tolerance, weight of a row) of ``wanted``.

    ``thin`` has k (0 to 2 ** KEY_BITS - 1), id and size. The weight below a key is the bytes
    below it plus the given weight of a row times the rows below it. Each round counts the
    intervals that hold an open splitter, divided by the next bits of the hash and, once those
    are used up, of the id. Rows that are equal in hash and id stay together: also returns
    whether that kept a splitter from its place.
    """

    def weight(at: tuple[int, int, int], each: float) -> float:
        return at[2] + each * at[1]

    found: dict[int, Splitter] = {}
    # intervals that hold open splitters: key prefix -> rows below, bytes below, the open ones
    intervals: dict[tuple, tuple[int, int, list[int]]] = {(): (0, 0, list(range(len(wanted))))}
    shift, id_shift = KEY_BITS, max((id_range[1] - id_range[0]).bit_length(), 1)
    on_id, was, torn = False, 0, False
    while intervals:
        if not on_id:
            was, shift = shift, shift - first_bits if () in intervals else max(0, shift - ROUND_BITS)
            group = [F.shiftright("k", shift)]
            inside = None if () in intervals else F.shiftright("k", was).isin([key[0] for key in intervals])
            parent = lambda key, by=was - shift: () if () in intervals else (key[0] >> by,)
            start = lambda key, by=shift: (key[0] << by, LOWEST)
        else:
            was, id_shift = id_shift, max(0, id_shift - ROUND_BITS)
            group = [F.col("k"), F.shiftright("id", id_shift)]
            first = all(len(key) == 1 for key in intervals)
            inside = F.col("k").isin(sorted({key[0] for key in intervals}))
            parent = lambda key, by=was - id_shift, first=first: key[:1] if first else (key[0], key[1] >> by)
            start = lambda key, by=id_shift: (key[0], key[1] << by)
        rows = _counted(thin if inside is None else thin.filter(inside), group)
        final = on_id and id_shift == 0
        below = {key: [at[0], at[1]] for key, at in intervals.items()}
        bounds: dict[tuple, list[tuple[tuple, int, int]]] = {key: [] for key in intervals}
        for key, n, b in rows:
            up = parent(key)
            if up in below:
                bounds[up].append((key, *below[up]))
                below[up][0] += n
                below[up][1] += b
        following: dict[tuple, tuple[int, int, list[int]]] = {}
        for up, (_, _, targets) in intervals.items():
            ends = [*bounds[up], (None, *below[up])]
            for t in targets:
                goal, slack, each = wanted[t]
                i = 0
                while i + 1 < len(ends) and weight(ends[i + 1], each) <= goal:
                    i += 1
                left = ends[i]
                right = ends[i + 1] if i + 1 < len(ends) else ends[i]
                near = min(left, right, key=lambda e: abs(weight(e, each) - goal))
                if abs(weight(near, each) - goal) <= slack or final or left is right:
                    if near[0] is not None:
                        first_key = start(near[0])
                    elif len(up) == 2:  # the start of what follows this interval
                        first_key = (up[0], (up[1] + 1) << was)
                    else:
                        first_key = ((up[0] + 1) << (0 if on_id else was) if up else 1 << KEY_BITS, LOWEST)
                    found[t] = Splitter(first_key, near[1], near[2])
                    torn = torn or (abs(weight(near, each) - goal) > slack and right[1] - left[1] > 1)
                else:
                    following.setdefault(left[0], (left[1], left[2], []))[2].append(t)
        intervals = following
        on_id = shift == 0
    return [found[t] for t in range(len(wanted))], torn


def sharded(
    df: DataFrame,
    shards: int = 16,
    text_col: str = "text",
    id_col: str = "doc_id",
    tasks: int | None = None,
    tolerance: float = TOLERANCE,
    carry: list[str] | None = None,
) -> DataFrame:
    """The rows of ``df`` in the order of the sort: the columns in ``carry`` (all of them), with
    ``size``, ``shard`` and ``slot`` added.

    Shards hold nearly equal bytes (within ``tolerance`` of a shard and the size of the text at
    the splitter); slots are gapless from 0. Equal texts are neighbours, and in one shard unless
    a splitter has to fall among them. A null text has size 1; a null id sorts first; rows that
    are equal in text hash and id are parted where the tolerance asks for it, and then equal texts are in the
    order in which they were read, not of their ids; an empty table gives an empty result. Added
    columns replace input columns of the same name. ``tasks``: parts of the exchange, a multiple
    of ``shards`` at least; more are taken where spark.sql.shuffle.partitions is larger.
    """
    spark = df.sparkSession
    carry = df.columns if carry is None else carry
    text, row_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    keys = df.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        text_key(F.coalesce(text, F.lit(""))).alias("k"),
        F.coalesce(row_id.cast("long"), F.lit(LOWEST)).alias("id"),
        sized(text).alias("size"),
        F.xxhash64(*[F.col(f"`{c}`") for c in carry if c != text_col]).alias("tie"),
    )
    thin = written(keys.select("k", "id", "size"), "shard-keys")
    rows, total, low, high = thin.agg(F.count("*"), F.sum("size"), F.min("id"), F.max("id")).first()
    per_shard = max(1, -(-(tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))) // shards))
    splits = [Splitter((0, LOWEST), 0, 0)]
    if rows:
        mean = total / rows
        wanted = [(total * s / shards, tolerance * total / shards, 0.0) for s in range(1, shards)]
        # parts within the shards are even in rows and bytes together: work, not a promise
        work = total + mean * rows
        wanted += [
            (work * p / (shards * per_shard), work / (4 * shards * per_shard), mean)
            for p in range(1, shards * per_shard)
            if per_shard > 1
        ]
        bits = min(20, max(ROUND_BITS, (8 * len(wanted)).bit_length()))
        places, torn = find_splitters(thin, wanted, bits, (low, high))
        if torn:
            keys = written(keys.withColumn("id", F.monotonically_increasing_id()), "shard-rows")
            places, _ = find_splitters(keys.select("k", "id", "size"), wanted, bits, keys.agg(F.min("id"), F.max("id")).first())
        splits += places
    shard_keys = sorted(splits[:shards], key=lambda s: s.key)
    shard_keys += [Splitter((1 << KEY_BITS, LOWEST), rows, total or 0)] * (shards - len(shard_keys))
    parts = sorted({s.key: s for s in splits}.values(), key=lambda s: s.key)

    key = F.struct(F.col("k"), F.col("id"))
    at = F.array(*[F.struct(F.lit(s.key[0]).alias("k"), F.lit(s.key[1]).alias("id")) for s in parts])
    ordered = (
        keys.withColumn("part", _place(key, at, len(parts)))
        .repartitionById(len(parts), F.col("part"))
        .sortWithinPartitions("k", "id", "tie")
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    shard_of = [sum(s.key <= p.key for s in shard_keys[1:]) for p in parts]
    shift = [p.rows - shard_keys[s].rows for p, s in zip(parts, shard_of, strict=True)]
    out = ordered.withColumns(
        {
            "shard": F.get(F.array(*map(F.lit, shard_of)), F.col("part")).cast("int"),
            "slot": F.col("place") + F.get(F.array(*[F.lit(x).cast("long") for x in shift]), F.col("part")),
        }
    )
    return unpacked(out, carry, ["size", "shard", "slot"])


def _place(key: Column, at: Column, n: int) -> Column:
    """The last of the ``n`` ordered keys in ``at`` that is at most ``key``, by binary search."""
    low = F.lit(0)
    step = 1 << max(0, (n - 1).bit_length() - 1)
    steps = []
    while step:
        steps.append(step)
        step >>= 1
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]) if n > 1 else F.array().cast("array<int>"),
        low,
        lambda found, step: F.when(F.get(at, found + step) <= key, found + step).otherwise(found),
    )
