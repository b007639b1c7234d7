"""A Merkle manifest of a dataset: one root for all rows, and for each row the path that proves it.

Rows are leaves, in one tree for each group (a language, say); the groups' roots are the leaves of the
tree above. While a level has several nodes, every two consecutive ones become their hash, and a last
one without a partner becomes the hash of itself alone.

Leaves get their places from one sort by ranges and the counts of its tasks, so no group is sorted in
one task. They are cut into aligned blocks of 2 ** BLOCK_BITS places, which are whole subtrees: a task
climbs a block with one treehash stack and keeps its root, the roots are the nodes of the next level,
and so on up. On the way down each block is traversed by Merkle traversal scheduling: for
every height one stack grows the node that the path will need next, a few steps for each leaf,
always on the stack whose work is lowest, so that each is ready when it is due and no more than a
logarithm of nodes is held beside the leaves. What lies above a block is the same for all its leaves and is
appended to their paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.shared import unpacked, written

#: Leaves of a block: 2 to this power.
BLOCK_BITS = 10
#: First places of groups in tasks are broadcast up to this number, and joined by a shuffle beyond it.
BROADCAST_STARTS = 100_000
#: How a step of a path begins: the sibling stands on the left or right; a step without one is empty.
LEFT, RIGHT = "L", "R"


def leaf_of(fields: list[Column]) -> Column:
    """The hash of a row: of each field ``-`` if it is null, else its UTF-8 bytes' count, a colon and
    itself."""
    texts = [f.cast("string") for f in fields]
    told = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*told), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def step(node: Column, way: Column) -> Column:
        sibling = F.substring(way, 2, 64)
        return (
            F.when(way.startswith(LEFT), F.sha2(F.concat(sibling, node), 256))
            .when(way.startswith(RIGHT), F.sha2(F.concat(node, sibling), 256))
            .otherwise(F.sha2(node, 256))
        )

    return F.aggregate(proof, leaf, step)


def siblings(proof: Column) -> Column:
    """The hashes of a path's siblings, from the leaf up."""
    return F.transform(F.filter(proof, lambda s: s != ""), lambda s: F.substring(s, 2, 64))


def hashed(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def pair(left: str | None, right: str | None) -> str | None:
    """A node above two places, of which the right one, or both, may lie beyond the last leaf."""
    if left is None:
        return None
    return hashed(left) if right is None else hashed(left, right)


class Treehash:
    """A stack that grows the node of ``height`` above the leaves from ``first`` on, a step at a time."""

    __slots__ = ("height", "next", "nodes", "low")

    def __init__(self, first: int, height: int):
        self.height, self.next, self.low = height, first, height
        self.nodes: list[tuple[int, str | None]] = []

    def step(self, leaf: Callable[[int], str | None]) -> None:
        """One leaf or one hash. ``low`` is the height of the last node, and beyond all heights
        when the node is there."""
        nodes = self.nodes
        if len(nodes) > 1 and nodes[-1][0] == nodes[-2][0]:
            height, right = nodes.pop()
            nodes[-1] = (height + 1, pair(nodes[-1][1], right))
        else:
            nodes.append((0, leaf(self.next)))
            self.next += 1
        self.low = nodes[-1][0] if nodes[0][0] < self.height else DONE


DONE = 1 << 30


def root_of(leaves: list[str], height: int | None = None) -> str:
    """The root above some leaves, at their own height or, with lone nodes hashed on, at ``height``."""
    nodes: list[tuple[int, str]] = []
    for leaf in leaves:
        nodes.append((0, leaf))
        while len(nodes) > 1 and nodes[-1][0] == nodes[-2][0]:
            at, right = nodes.pop()
            nodes[-1] = (at + 1, hashed(nodes[-1][1], right))
    at, node = nodes.pop()
    while nodes or height is not None and at < height:
        if nodes and nodes[-1][0] == at:
            node = hashed(nodes.pop()[1], node)
        else:
            node = hashed(node)
        at += 1
    return node


def paths(leaves: list[str], height: int) -> Iterator[list[str | None]]:
    """The siblings of each leaf in turn, by height; None where a node stands alone."""
    n = len(leaves)
    leaf = lambda i: leaves[i] if i < n else None
    first: list[list[str | None]] = [[None, None] for _ in range(height)]  # nodes 0 and 1 of each height
    stack: list[tuple[int, int, str | None]] = []
    for i in range(1 << height):
        at, place, node = 0, i, leaf(i)
        while True:
            if at < height and place < 2:
                first[at][place] = node
            if not stack or stack[-1][0] != at:
                break
            node = pair(stack.pop()[2], node)
            at, place = at + 1, place >> 1
        stack.append((at, place, node))
    path = [right for _, right in first]
    growing = []
    for h, (left, _) in enumerate(first):
        ready = Treehash(0, h)
        ready.nodes, ready.low = [(h, left)], DONE
        growing.append(ready)
    for i in range(n):
        yield path
        path = list(path)
        for h in range(height):
            if (i + 1) % (1 << h):
                break
            path[h] = growing[h].nodes[0][1] if growing[h].nodes else None
            growing[h] = Treehash((i + 1 + (1 << h)) ^ (1 << h), h)
            if growing[h].next >= 1 << height:  # beyond the block: nothing will be due
                growing[h].low = DONE
        for _ in range(2 * height - 1):
            lowest = min(growing, key=lambda t: t.low)
            if lowest.low == DONE:
                break
            lowest.step(leaf)


def _nodes(table: pa.Table) -> tuple[pa.Table, list[str], int]:
    """A block's nodes by their places, their hashes, and the block's number."""
    table = table.sort_by("pos")
    block = table["block"][0].as_py()
    only = len(table) == 1 and block == 0
    return table, table["alone" if only else "hash"].to_pylist(), block


def _climb(table: pa.Table) -> pa.Table:
    table, leaves, block = _nodes(table)
    return pa.table(
        {"g": table["g"][:1], "pos": pa.array([block]), "hash": [root_of(leaves, BLOCK_BITS)], "alone": [root_of(leaves)]}
    )


def _descend(table: pa.Table, above: pa.Table) -> pa.Table:
    """The nodes of a block with their paths: those in the block, and then the path above it."""
    table, leaves, block = _nodes(table)
    last = above["only"][0].as_py()
    height = (len(leaves) - 1).bit_length() if last else BLOCK_BITS
    higher = above["steps"][0].as_py()
    steps = []
    for i, path in enumerate(paths(leaves, height)):
        ways = ["" if s is None else (LEFT if i >> h & 1 else RIGHT) + s for h, s in enumerate(path)]
        steps.append(ways + higher)
    n = len(table)
    return pa.table(
        {
            "g": table["g"],
            "pos": table["pos"],
            "row": table["row"],
            "only": pa.array([n == 1 and block == 0] * n),
            "steps": pa.array(steps, pa.list_(pa.string())),
            "said": pa.chunked_array([above["said"].combine_chunks().take(pa.array([0] * n))]),
        }
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place of each in its group ``g`` in the given order; of equal rows,
    any order."""
    spark = rows.sparkSession
    keyed = written(rows.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    keys = ["g", *order, "tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(
        keyed.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}),
        "merkle-order",
    )
    starts = ranged.groupBy("part", "g").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = written(starts.select("part", "g", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")), "merkle-starts")
    if starts.count() <= BROADCAST_STARTS:
        starts = F.broadcast(starts)
    return ranged.join(starts, ["part", "g"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift", "tie")


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", BLOCK_BITS))


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of blocks over ``nodes`` (g, pos, hash, alone, row), and each group's root (g, alone)."""
    levels = [nodes]
    while True:
        up = _blocks(levels[-1]).select("g", "block", "pos", "hash", "alone")
        roots = written(
            up.groupBy("g", "block").applyInArrow(_climb, "g string, pos long, hash string, alone string"), "merkle-blocks"
        )
        if (roots.agg(F.max("pos")).first()[0] or 0) == 0:
            return levels, roots.select("g", "alone")
        levels.append(roots.withColumn("row", F.lit(None).cast("boolean")))


def descended(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The nodes of the lowest level with their paths. ``tops``: (g, steps, said) of each group's
    root, where ``said`` is handed down to all."""
    above = tops.withColumns({"block": F.lit(0).cast("long"), "only": F.lit(True)})
    for nodes in reversed(levels):
        kinds = {c: nodes.schema[c].dataType.simpleString() for c in ("g", "pos", "row")}
        kinds |= {"only": "boolean", "steps": "array<string>", "said": above.schema["said"].dataType.simpleString()}
        found = (
            _blocks(nodes)
            .groupBy("g", "block")
            .cogroup(above.groupBy("g", "block"))
            .applyInArrow(_descend, ", ".join(f"{k} {v}" for k, v in kinds.items()))
        )
        above = found.drop("row").withColumnRenamed("pos", "block")
    return found


def proved(
    df: DataFrame,
    fields: list[str],
    group_col: str = "lang",
    order_col: str = "doc_id",
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns in ``carry`` (all) of ``df`` with ``leaf``, ``subroot`` (of its group), ``root`` and
    ``proof``: a step for each level from the leaf to the root, L or R and the sibling that stands on
    the left or right, or nothing where a node is alone. ``folded`` leads back to the root.

    A null group is one of its own and the first, a null in the order comes first, and a null field
    has its own mark. Rows that share their order are ordered by their leaves; repeated rows are
    leaves of their own, each with its path. An empty table gives an empty result, one row is root
    and leaf in one. Added columns replace input columns of the same name."""
    carry = df.columns if carry is None else carry
    group = F.col(f"`{group_col}`").cast("string")
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("g"),
        F.col(f"`{order_col}`").alias("o"),
        leaf_of([F.col(f"`{c}`") for c in fields]).alias("hash"),
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"),
    )
    ordered = placed(rows, ["o", "hash"])
    nodes = ordered.select("g", "pos", "hash", F.col("hash").alias("alone"), F.struct("carried", "hash").alias("row"))
    nodes = written(nodes, "merkle-nodes")
    levels, subroots = climbed(nodes)

    groups = subroots.select(F.lit("").alias("g"), F.col("g").alias("o"), F.col("alone").alias("hash"))
    groups = placed(groups, ["o"]).select("g", "pos", "hash", F.col("hash").alias("alone"), F.struct("o", "hash").alias("row"))
    groups = written(groups, "merkle-groups")
    high, root = climbed(groups)
    root = root.select("g", F.array().cast("array<string>").alias("steps"), F.struct(F.col("alone").alias("root")).alias("said"))
    tops = descended(high, root).select(
        F.col("row.o").alias("g"), "steps", F.struct(F.col("row.hash").alias("subroot"), F.col("said.root").alias("root")).alias("said")
    )
    found = descended(levels, written(tops, "merkle-subroots")).select(
        F.col("row.carried").alias("row"),
        F.col("row.hash").alias("leaf"),
        F.col("said.subroot").alias("subroot"),
        F.col("said.root").alias("root"),
        F.col("steps").alias("proof"),
    )
    return unpacked(found, carry, ["leaf", "subroot", "root", "proof"])
