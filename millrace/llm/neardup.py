"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A document's set of word shingles has a signature of POSITIONS MinHash values of BITS bits. Two
signatures that differ in at most DISTANCE positions agree, in one chunk of CHUNKS at least, up to
``DISTANCE // CHUNKS`` positions (pigeonhole). So each chunk is entered in an index once for each
allowed choice of positions to be wrong, without those positions, and every pair within DISTANCE
shares an entry. Sets with a Jaccard similarity of 0.85 exceed DISTANCE with a probability of about
6e-7 at the default sizes (the binomial tail beyond 25 of 64 at 0.15). Candidates are then checked on
their whole sets.

Documents with equal sets are one vertex from the start. The members of an entry are not all paired:
in the first rounds every entry compares its pivot with those members that are not yet in the
pivot's component, which joins the groups of near copies. What is left (members of different
components in one entry) is then compared in full, so that no link is lost: in blocks of bounded
size, in place, on signatures that are longer and made for these vertices only. The rows that are
near another then come together once more with their whole sets; only links leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.components import components
from millrace.llm.shared import packed, unpacked, written

U64 = np.uint64


@dataclass(frozen=True)
class Options:
    """``percent``: link at 100 * intersection >= percent * union."""

    shingle: int = 3
    percent: int = 85
    positions: int = 64
    bits: int = 16
    distance: int = 25
    chunks: int = 13
    seed: int = 20
    #: The longer signatures: positions of 8 bits, and the distance that a similarity of 0.85
    #: exceeds with a probability of about 2e-7.
    long_positions: int = 256
    long_distance: int = 70

    def chunk_positions(self) -> list[np.ndarray]:
        return np.array_split(np.arange(self.positions), self.chunks)

    def entries(self) -> list[tuple[int, ...]]:
        """The positions that each index entry of a signature holds."""
        wrong = self.distance // self.chunks
        out = []
        for chunk in self.chunk_positions():
            for left_out in combinations(chunk.tolist(), min(wrong, len(chunk) - 1)):
                out.append(tuple(p for p in chunk.tolist() if p not in left_out))
        return out

    def holds(self) -> np.ndarray:
        """Which positions each index entry holds, as zeros and ones."""
        out = np.zeros((len(self.entries()), self.positions), dtype=np.float32)
        for tag, positions in enumerate(self.entries()):
            out[tag, list(positions)] = 1
        return out

    def multipliers(self, positions: int) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(self.seed + positions).integers(0, 2**64, size=(2, positions), dtype=U64)
        return draw[0] | U64(1), draw[1]


#: Rounds of pivots. In the complete round after them, an entry of more than BLOCK members is cut into
#: the root of their number by BLOCK blocks, and each member meets each block once: n members are
#: copied n * sqrt(n / BLOCK) times, and a task holds 2 * sqrt(n * BLOCK) of them.
PIVOT_ROUNDS = 2
TAG_MASK = 127
BLOCK = 2048
#: Ids up to which a semi join is done by broadcast.
BROADCAST_IDS = 1_000_000


def shingle_sets(found: W.Words, width: int) -> list[np.ndarray]:
    """For each row the sorted, distinct hashes of its shingles; a text of fewer than ``width``
    words, but not none, has one: all its words."""
    h = found.hashes()
    grams = W.rolling(h, width, 0xC6A4A7935BD1E995)
    out = []
    for r in range(found.n_rows):
        first, last = found.ptr[r], found.ptr[r + 1]
        n = int(last - first)
        if n >= width:
            out.append(np.unique(grams[first : last - width + 1]))
        elif n:
            out.append(W.rolling(h[first:last], n, 0x9E3779B185EBCA87 + 2 * n))
        else:
            out.append(h[:0])
    return out


def signatures(sets: list[np.ndarray], options: Options) -> np.ndarray:
    """A row of ``positions`` values of ``bits`` bits for each set, none of which is empty."""
    if not sets:
        return np.empty((0, options.positions), dtype=np.uint16)
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), options.positions), dtype=np.uint16)
    for j, (a, c) in enumerate(zip(*options.multipliers(options.positions), strict=True)):
        least = np.minimum.reduceat((flat ^ c) * a, at)
        out[:, j] = (least & U64((1 << options.bits) - 1)).astype(np.uint16)
    return out


def _long_signatures(batches: Iterator[pa.RecordBatch], options: Options) -> Iterator[pa.RecordBatch]:
    """(id, text), no text without words, to (id, long)."""
    draws = list(zip(*options.multipliers(options.long_positions), strict=True))
    for batch in batches:
        for first, found in W.scans(batch.column(1), W.SPACED, lower=True):
            sets = shingle_sets(found, options.shingle)
            flat = np.concatenate(sets)
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
            out = np.empty((len(sets), options.long_positions), dtype=np.uint8)
            for j, (a, c) in enumerate(draws):
                out[:, j] = (np.minimum.reduceat((flat ^ c) * a, at) & U64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(sets)), pa.array([x.tobytes() for x in out], pa.binary())],
                names=["id", "long"],
            )


CELL = "cell long, side int, entry long, id long, component long, signature binary, long binary"


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by cell, cut again where cells end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # what may go on in the next batch is held back: the last cell
        last = batch.column(0)[batch.num_rows - 1].as_py()
        ends = np.flatnonzero(batch.column(0).to_numpy() != last)
        n = int(ends[-1]) + 1 if len(ends) else 0
        if n or held and held[-1].column(0)[0].as_py() != last:
            yield pa.Table.from_batches([*held, batch.slice(0, n)])
            held = []
        held.append(batch.slice(n))
    if held:
        yield pa.Table.from_batches(held)


def _near_rows(whole: pa.Table, options: Options, holds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of cells that are within both distances of a row of another component, for each row
    that has any. A cell has some members of one entry: of side 0, which are compared with those of
    side 1 or, where there are none, with each other. A pair comes in the first entry it shares."""
    n = whole.num_rows
    cell, side, entry, _, component = (whole.column(i).to_numpy() for i in range(5))
    short = _matrix(whole.column(5), options)
    long = np.frombuffer(b"".join(whole.column(6).to_pylist()), dtype=np.uint8).reshape(n, -1)
    cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        here = np.arange(x, y)
        left, right = here[side[x:y] == 0], here[side[x:y] == 1]
        alone = not len(right)
        for k, a in enumerate(left):
            others = left[k + 1 :] if alone else right
            others = others[component[others] != component[a]]
            if not len(others):
                continue
            others = others[(long[others] != long[a]).sum(axis=1) <= options.long_distance]
            others = others[(short[others] != short[a]).sum(axis=1) <= options.distance]
            if len(others):
                apart = (short[others] != short[a]).astype(np.float32) @ holds.T
                others = others[(apart == 0).argmax(axis=1) == entry[a] & TAG_MASK]
            if len(others):
                yield int(a), others


def _involved(batches: Iterator[pa.RecordBatch], options: Options) -> Iterator[pa.RecordBatch]:
    """The rows of CELL, sorted by cell, that are near a row of another component in their cell."""
    holds = options.holds()
    for whole in _whole_cells(batches):
        near = np.zeros(whole.num_rows, dtype=bool)
        for a, others in _near_rows(whole, options, holds):
            near[a] = near[others] = True
        yield from whole.filter(pa.array(near)).combine_chunks().to_batches()


def _linked_in_cells(batches: Iterator[pa.RecordBatch], options: Options) -> Iterator[pa.RecordBatch]:
    """CELL and shingles, sorted by cell, to the links (a, b): near rows with similar whole sets."""
    holds = options.holds()
    for whole in _whole_cells(batches):
        ids = whole.column(3).to_numpy()
        sets = [np.frombuffer(x, dtype=U64) for x in whole.column(7).to_pylist()]
        lows, highs = [], []
        for a, others in _near_rows(whole, options, holds):
            for b in others:
                if _similar(sets[a], sets[b], options):
                    lows.append(min(ids[a], ids[b]))
                    highs.append(max(ids[a], ids[b]))
        yield pa.RecordBatch.from_arrays([pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], names=["a", "b"])


def _similar(x: np.ndarray, y: np.ndarray, options: Options) -> bool:
    """Whether two sorted sets are similar enough."""
    if 100 * min(len(x), len(y)) < options.percent * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return 100 * both >= options.percent * (len(x) + len(y) - both)


def _entry_keys(signed: np.ndarray, tag: int, positions: tuple[int, ...]) -> np.ndarray:
    """The keys of one index entry of some signatures; the low bits are the entry's number."""
    key = np.full(len(signed), tag * 0x9E3779B97F4A7C15 & (2**64 - 1), dtype=U64)
    for p in positions:
        key = W.mixed(key ^ signed[:, p].astype(U64))
    return ((key & ~U64(TAG_MASK)) | U64(tag)).view(np.int64)


SIGNED = "doc long, tie long, sum binary, n long, signature binary"


def _signed(batches: Iterator[pa.RecordBatch], options: Options) -> Iterator[pa.RecordBatch]:
    """(doc, tie, text) to (doc, tie, sum, n, signature); sum is a 128-bit hash of the set."""
    import xxhash

    for batch in batches:
        for first, found in W.scans(batch.column(2), W.SPACED, lower=True):
            sets = shingle_sets(found, options.shingle)
            some = [s for s in sets if len(s)]
            signed = iter(signatures(some, options))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, found.n_rows),
                    batch.column(1).slice(first, found.n_rows),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([next(signed).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc", "tie", "sum", "n", "signature"],
            )


def _entered(batches: Iterator[pa.RecordBatch], options: Options) -> Iterator[pa.RecordBatch]:
    """(id, signature) to (entry, id), once for each index entry."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        signed = _matrix(batch.column(1), options)
        for tag, positions in enumerate(options.entries()):
            key = _entry_keys(signed, tag, positions)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids)], names=["entry", "id"])


def _matrix(column: pa.Array, options: Options) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, options.positions)


def _near(batches: Iterator[pa.RecordBatch], options: Options) -> Iterator[pa.RecordBatch]:
    """The (a, b) of (a, b, signature, signature) whose signatures are within the distance."""
    for batch in batches:
        if batch.num_rows:
            apart = (_matrix(batch.column(2), options) != _matrix(batch.column(3), options)).sum(axis=1)
            yield batch.select([0, 1]).filter(pa.array(apart <= options.distance))


def _sets(batches: Iterator[pa.RecordBatch], options: Options) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, found in W.scans(batch.column(1), W.SPACED, lower=True):
            sets = shingle_sets(found, options.shingle)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, found.n_rows), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["id", "shingles"],
            )


def _linked(batches: Iterator[pa.RecordBatch], options: Options) -> Iterator[pa.RecordBatch]:
    """The (a, b) of (a, b, set, set) whose sets are similar enough."""
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            good.append(_similar(np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64), options))
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


class _Search:
    """The links among the vertices of one table."""

    def __init__(self, docs: DataFrame, options: Options):
        self.options = options
        self.docs = docs.select("doc", F.xxhash64("text").alias("tie"), "text")  # no null doc
        self.signed = written(self.docs.mapInArrow(lambda batches: _signed(batches, options), SIGNED), "near-signatures")
        self.repeated = not self.signed.groupBy("doc").count().filter("count > 1").isEmpty()
        # a vertex has the least id of its rows or, where an id may stand for several texts, a hash of its set
        own = F.conv(F.hex(F.substring("sum", 1, 7)), 16, 10).cast("long") if self.repeated else F.col("place.doc")
        classes = self.signed.filter("n > 0").groupBy("sum").agg(
            F.min(F.struct("doc", "tie")).alias("place"), F.max("doc").alias("last"), F.min("signature").alias("signature")
        )
        self.classes = written(
            classes.select("sum", own.alias("id"), "place.doc", "place.tie", "last", "signature"), "near-classes"
        )

    def entries(self) -> DataFrame:
        """(entry, id) of the index entries that more than one vertex has."""
        options = self.options
        index = self.classes.select("id", "signature").mapInArrow(
            lambda batches: _entered(batches, options), "entry long, id long"
        )
        shared = index.groupBy("entry").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
        return written(index.join(shared.select("entry"), "entry"), "near-entries")

    def texts(self, ids: DataFrame) -> DataFrame:
        """(id, text) of the vertices in ``ids`` (id), which is a written table."""
        few = ids.count() <= BROADCAST_IDS
        if self.repeated:
            ids = self.classes.join(ids, "id").select("id", "doc", "tie")
        else:
            ids = ids.select("id", F.col("id").alias("doc"))
        found = self.docs.join(F.broadcast(ids) if few else ids, ["doc", "tie"] if self.repeated else "doc")
        # equal rows are one
        return (found.dropDuplicates(["id"]) if self.repeated else found).select("id", "text")

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, shingles) of the vertices in ``ids`` (id), which is a written table."""
        options = self.options
        sets = self.texts(ids).mapInArrow(lambda batches: _sets(batches, options), "id long, shingles binary")
        return written(sets, "near-sets")

    def links_in_place(self, members: DataFrame, open_: DataFrame) -> DataFrame:
        """The links (a, b) among all ``members`` (entry, id, component) that share an entry and are
        of different components. Cells are compared twice: on signatures alone, to find the rows
        that are near another, and then, for these rows only, with their whole sets."""
        options = self.options
        members = written(members.join(open_.select("entry", "n"), "entry"), "near-members")
        ids = written(members.select("id").distinct(), "near-ids")
        long = self.texts(ids).mapInArrow(lambda batches: _long_signatures(batches, options), "id long, long binary")
        signed = long.join(self.classes.select("id", "signature"), "id")
        # each pair of an entry's blocks is a cell
        blocks = F.ceil(F.sqrt(F.col("n") / BLOCK)).cast("int")
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        low, high = F.least("block", "other"), F.greatest("block", "other")
        cells = (
            members.withColumn("blocks", blocks)
            .withColumn("block", block)
            .select("*", other.alias("other"))
            .withColumn("cell", F.xxhash64("entry", low, high))
            .withColumn("side", F.when(F.col("block") == low, 0).otherwise(1))
            .join(signed, "id")
            .select("cell", "side", "entry", "id", "component", "signature", "long")
        )
        sorted_ = lambda df: df.repartition("cell").sortWithinPartitions("cell")
        near = written(sorted_(cells).mapInArrow(lambda batches: _involved(batches, options), CELL), "near-rows")
        ids = written(near.select("id").distinct(), "near-ids")
        whole = sorted_(near.join(self.sets(ids), "id").select(*near.columns, "shingles"))
        return whole.mapInArrow(lambda batches: _linked_in_cells(batches, options), "a long, b long")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the candidate ``pairs`` (a, b) that are similar, on whole sets."""
        options = self.options
        side = lambda x: self.classes.select(F.col("id").alias(x), F.col("signature").alias(f"signature_{x}"))
        near = written(
            pairs.join(side("a"), "a")
            .join(side("b"), "b")
            .select("a", "b", "signature_a", "signature_b")
            .mapInArrow(lambda batches: _near(batches, options), "a long, b long"),
            "near-candidates",
        )
        ids = written(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-ids")
        sets = self.sets(ids)
        member = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"shingles_{x}"))
        return (
            near.join(member("a"), "a")
            .join(member("b"), "b")
            .select("a", "b", "shingles_a", "shingles_b")
            .mapInArrow(lambda batches: _linked(batches, options), "a long, b long")
        )

    def components(self) -> DataFrame:
        """(id, component) of the vertices that are not the least of their component."""
        entries = self.entries()
        found = tested = None
        for turn in range(PIVOT_ROUNDS + 1):
            members = entries.withColumn("component", F.col("id"))
            if found is not None:
                members = entries.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
            # entries with members of more than one component
            parts = members.groupBy("entry", "component").count()
            open_ = written(
                parts.groupBy("entry")
                .agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("within"))
                .filter("n * n > within"),
                "near-open",
            )
            if open_.isEmpty():
                break
            if turn == PIVOT_ROUNDS:
                new = self.links_in_place(members, open_)
            else:
                members = members.join(open_.select("entry"), "entry")
                order = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
                pivots = members.groupBy("entry").agg(F.min_by(F.struct("id", "component"), order).alias("pivot"))
                pivots = pivots.select("entry", F.col("pivot.id").alias("a"), F.col("pivot.component").alias("of"))
                pairs = members.join(pivots, "entry").filter("a != id and of != component")
                pairs = pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
                if tested is not None:
                    pairs = pairs.join(tested, ["a", "b"], "left_anti")
                pairs = written(pairs, "near-pairs")
                tested = pairs if tested is None else tested.unionAll(pairs)
                new = self.links(pairs)
            if found is not None:
                new = new.unionAll(found.select(F.col("component").alias("a"), F.col("id").alias("b")))
            found = components(new)
        return found


def near_duplicates(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    options: Options = Options(),
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns in ``carry`` (all) of ``df`` with ``n_shingles``, ``component_id`` and ``kept``.

    Vertices are ids: rows of one id (repeated rows, or different texts) are one vertex, and all
    have its component; ``kept`` is true for the rows whose id is the component's least. A null
    or empty text has no shingles and no links; a row with a null id has no links, a null
    component and is kept. An empty table gives an empty result; added columns replace input
    columns of the same name.
    """
    carry = df.columns if carry is None else carry
    text, doc = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long")
    docs = df.select(doc.alias("doc"), F.coalesce(text, F.lit("")).alias("text")).filter("doc is not null")
    search = _Search(docs, options)
    found = search.components()
    # the component of each class of equal sets, where it is not the id itself; then of each id
    classes = search.classes.select("sum", "id", "last")
    if found is not None:
        classes = classes.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    else:
        classes = classes.withColumn("component", F.col("id"))
    if search.repeated:
        # rows of one id are of one component, with all that their sets are linked to
        of = search.signed.select("doc", "sum").join(classes.select("sum", "component"), "sum")
        least = of.groupBy("component").agg(F.min("doc").alias("a"))
        found = components(of.join(least, "component").select("a", F.col("doc").alias("b")))
        docs_of = search.signed.select("doc", "sum", "n").join(found.withColumnRenamed("id", "doc"), "doc", "left")
    else:
        moved = classes.filter("last != id or component != id").select("sum", "component")
        docs_of = search.signed.select("doc", "sum", "n").join(moved, "sum", "left")
    docs_of = docs_of.select("doc", "sum", "n", F.coalesce("component", "doc").alias("component"))
    if [c.lower() for c in carry] == [id_col.lower()]:
        # nothing but the id is asked for: the rows are those of the signatures
        nulls = df.filter(doc.isNull()).select(doc.alias("doc"), F.lit(0).cast("long").alias("tie"), F.coalesce(text, F.lit("")).alias("text"))
        nulls = nulls.mapInArrow(lambda batches: _signed(batches, options), SIGNED).select(
            "doc", "sum", "n", F.lit(None).cast("long").alias("component")
        )
        out = docs_of.unionAll(nulls).withColumn("row", F.struct(F.col("doc").alias(carry[0])))
    else:
        rows = packed(df.select(*[f"`{c}`" for c in carry])).withColumn("doc", F.col("row").getField(id_col).cast("long"))
        if search.repeated:
            docs_of = docs_of.groupBy("doc").agg(F.max("n").alias("n"), F.min("component").alias("component"))
        out = rows.join(docs_of, "doc", "left")
    out = out.withColumns(
        {
            "n_shingles": F.coalesce("n", F.lit(0)),
            "component_id": F.col("component"),
            "kept": F.col("doc").eqNullSafe(F.col("component")),
        }
    )
    return unpacked(out, carry, ["n_shingles", "component_id", "kept"])
