"""Removal of repeated passages: count-min prefilter, then exact grouping.

A window is WIDTH consecutive words of a document. A first pass builds count-min sketches and merges
them; a second pass groups exactly only the windows that the merged sketch estimates to occur twice
or more. A sketch never counts too low, so no repeat is lost.

The sketch counts a window's minimizer (the least hash of its GRAM-word grams) instead of the window:
equal windows have equal minimizers at equal places, and one minimizer stands for about seven
windows that follow each other, so the sketch is that much smaller. Cells saturate at two, which is
all that the second pass asks for, so the merged sketch is a bit for each cell.

A sketch has CELLS_EACH cells for each minimizer at every size. While its bits are few they are
merged over the partitions and broadcast. Beyond MAX_CELLS the minimizers are dealt to tasks by
hash range, each task counts those of its range in a sketch of its own and answers the documents that
asked; no sketch is collected or broadcast then.

A task decides what it can by itself: of equal windows in its texts all but the first are later ones,
so only that one meets those of other tasks. Whole texts that occur before are found by their digests
first and leave the window passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.shared import HOT_SHARE, joined_to_groups, unpacked, written

WIDTH = 20
GRAM = 8
#: Rows of the sketch, and cells in a row for each expected minimizer, at least.
ROWS = 3
CELLS_EACH = 4
#: Cells in a row of a sketch that is broadcast (so it has ROWS * MAX_CELLS / 8 bytes, 50 MB, at
#: most); beyond, minimizers are dealt by hash range.
MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 27
#: Bytes of text for each minimizer, about: seven words.
BYTES_EACH = 42
#: Cells in a slice of the sketch, and slices that are merged together.
SLICE_BITS, SLICES_TOGETHER = 16, 16
#: Minimizers in a range that is dealt to one task, about, and cells of the range's sketch.
RANGE, RANGE_CELLS = 1 << 20, 1 << 22
#: Bytes of text whose windows a task compares by itself.
TOGETHER_BYTES = 4 << 20
#: Bits of a window's hash by which windows are counted to find those that very many rows have.
CELL_BITS = 16
#: Bytes of a table up to which it is broadcast; beyond, it is joined by a shuffle.
BROADCAST_BYTES = 48 << 20

LOWEST = -(1 << 63)
U64 = np.uint64


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """The best (np.minimum or np.maximum) of each ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while 2 * have <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def windows(found: W.Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For some rows: the word hashes, which words start a whole window, and the minimizer of each
    such window (0 elsewhere)."""
    h = found.hashes()
    n = len(h) - width + 1
    if n <= 0:
        return h, np.empty(0, dtype=bool), np.empty(0, dtype=U64)
    row = found.row_of()
    whole = row[:n] == row[width - 1 :]
    least = _sliding(W.rolling(h, gram, 0x9DDFEA08EB382D69), width - gram + 1, np.minimum)
    return h, whole, np.where(whole, least, U64(0))


def cells(minimizers: np.ndarray, size: int) -> list[np.ndarray]:
    """The cell of each minimizer in each row of the sketch."""
    return [
        (W.mixed(minimizers ^ U64((r + 1) * 0xA0761D6478BD642F & (2**64 - 1))) & U64(size - 1)).astype(np.int64)
        for r in range(ROWS)
    ]


def _minimizer_places(found: W.Words, width: int, gram: int) -> np.ndarray:
    """The minimizers of some rows, each once for each place (a place serves many windows)."""
    h, whole, least = windows(found, width, gram)
    span = width - gram + 1
    if not whole.any():
        return np.empty(0, dtype=U64)
    grams = W.rolling(h, gram, 0x9DDFEA08EB382D69)
    padded = np.concatenate([np.zeros(span - 1, dtype=U64), least, np.zeros(span - 1, dtype=U64)])
    most = _sliding(padded, span, np.maximum)[: len(grams)]
    return grams[(most == grams) & (most != 0)]


def _sketch(batches: Iterator[pa.RecordBatch], size: int, width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The sketch of a partition: for each slice, the cells counted once and those counted more."""
    seen: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
    for batch in batches:
        for _, found in W.scans(batch.column(0), W.SPACED):
            places = _minimizer_places(found, width, gram)
            for r, c in enumerate(cells(places, size)):
                seen[r].append(c.astype(np.uint32))
    out: list[tuple[int, bytes, bytes]] = []
    per_row = max(1, size >> SLICE_BITS)
    for r in range(ROWS):
        if not seen[r]:
            continue
        cell, n = np.unique(np.concatenate(seen[r]), return_counts=True)
        low, many = (cell & ((1 << SLICE_BITS) - 1)).astype(np.uint16), n > 1
        cuts = np.searchsorted(cell, np.arange(per_row + 1, dtype=np.int64) << SLICE_BITS)
        for s in range(per_row):
            part = slice(cuts[s], cuts[s + 1])
            if cuts[s] < cuts[s + 1]:
                out.append((r * per_row + s, low[part][~many[part]].tobytes(), low[part][many[part]].tobytes()))
    if out:
        slices, once, more = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x // SLICES_TOGETHER for x in slices], pa.int32()),
                pa.array(slices, pa.int32()),
                pa.array(once, pa.binary()),
                pa.array(more, pa.binary()),
            ],
            names=["together", "slice", "once", "more"],
        )


def _merge(group: pa.Table) -> pa.Table:
    """The bits of the cells of some slices that are counted twice or more over all partitions."""
    counts: dict[int, np.ndarray] = {}
    for s, once, more in zip(*(group.column(c).to_pylist() for c in ("slice", "once", "more")), strict=True):
        count = counts.setdefault(s, np.zeros(1 << SLICE_BITS, dtype=np.uint8))
        cell = np.frombuffer(once, dtype=np.uint16)
        count[cell] += count[cell] < 2
        count[np.frombuffer(more, dtype=np.uint16)] = 2
    kept = {s: np.packbits(c >= 2) for s, c in counts.items() if (c >= 2).any()}
    return pa.table(
        {"slice": pa.array(list(kept), pa.int32()), "bits": pa.array([b.tobytes() for b in kept.values()], pa.binary())}
    )


def merged_sketch(texts: DataFrame, size: int, width: int = WIDTH, gram: int = GRAM) -> bytes:
    """Bits of the merged sketch of ``texts`` (one column): ROWS * size of them."""
    sketches = texts.mapInArrow(
        lambda batches: _sketch(batches, size, width, gram), "together int, slice int, once binary, more binary"
    )
    merged = sketches.groupBy("together").applyInArrow(_merge, "slice int, bits binary").collect()
    bits = np.zeros(ROWS * size // 8, dtype=np.uint8)
    each = (1 << SLICE_BITS) // 8
    for row in merged:
        bits[row["slice"] * each : (row["slice"] + 1) * each] = np.frombuffer(row["bits"], dtype=np.uint8)
    return bits.tobytes()


def _asked(batches: Iterator[pa.RecordBatch], ranges: int, width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(doc, tie, text) to (range, minimizer, doc, tie, n): what the minimizers' ranges have to count.
    A minimizer that a slice of texts has twice is repeated for certain: its range only counts it
    (n = 2, without a document), and its documents are answered here (without a range)."""
    for batch in batches:
        doc, tie = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for first, found in W.scans(batch.column(2), W.SPACED):
            h, whole, least = windows(found, width, gram)
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            at = at[np.concatenate([[True], least[at][1:] != least[at][:-1]])]
            value, row = least[at], first + np.searchsorted(found.ptr, at, side="right") - 1
            # one row for each document and minimizer, with how often the slice has it
            places = np.sort(_minimizer_places(found, width, gram))
            twice = np.searchsorted(places, value, side="right") - np.searchsorted(places, value) > 1
            order = np.lexsort((row, value))
            new = np.concatenate([[True], (value[order][1:] != value[order][:-1]) | (row[order][1:] != row[order][:-1])])
            value, row, twice = value[order][new], row[order][new], twice[order][new]
            head = np.concatenate([[True], value[1:] != value[:-1]])
            range_ = (W.mixed(value) % U64(ranges)).astype(np.int32)
            parts = ((~twice, 1, True, True), (twice & head, 2, True, False), (twice, 0, False, True))
            for some, n, dealt, answered in parts:
                k = int(some.sum())
                none = lambda values, kept, k=k: pa.array(values) if kept else pa.nulls(k, pa.array(values).type)
                yield pa.RecordBatch.from_arrays(
                    [
                        none(range_[some], dealt),
                        pa.array(value[some].view(np.int64)),
                        none(doc[row[some]], answered),
                        none(tie[row[some]], answered),
                        pa.array(np.full(k, n, dtype=np.int32)),
                    ],
                    names=["range", "minimizer", "doc", "tie", "n"],
                )


def _answered(group: pa.Table) -> pa.Table:
    """The documents whose minimizers a range's sketch counts twice or more."""
    value = group.column("minimizer").to_numpy().view(U64)
    n, asks = group.column("n").to_numpy(), group.column("doc").is_valid().to_numpy()
    hit = asks.copy()
    for c in cells(value, RANGE_CELLS):
        count = np.minimum(np.bincount(c, weights=n, minlength=RANGE_CELLS), 2)
        hit &= count[c] >= 2
    return group.select(["doc", "tie", "minimizer"]).filter(pa.array(hit))


def dealt_repeats(texts: DataFrame, n_minimizers: float, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc, tie, minimizers) of the documents of ``texts`` (doc, tie, text) with minimizers that are
    estimated repeated. A range has RANGE minimizers on average; one that very many texts have comes
    to its range once from each slice of texts."""
    ranges = max(1, int(n_minimizers / RANGE) + 1)
    asked = written(
        texts.mapInArrow(
            lambda batches: _asked(batches, ranges, width, gram), "range int, minimizer long, doc long, tie long, n int"
        ),
        "passage-minimizers",
    )
    schema = "doc long, tie long, minimizer long"
    answers = asked.filter("range is not null").groupBy("range").applyInArrow(_answered, schema)
    sure = asked.filter("range is null").select("doc", "tie", "minimizer")
    return answers.unionByName(sure).groupBy("doc", "tie").agg(F.collect_set("minimizer").alias("minimizers"))


class _Windows:
    """The windows of some texts that are estimated repeated."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.bytes = 0

    def add(self, h: np.ndarray, at: np.ndarray, row: np.ndarray, start: np.ndarray, width: int) -> None:
        one, two = (W.rolling(h, width, base)[at] for base in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
        self.parts.append((one, two, row[0], row[1], start))

    def decided(self) -> pa.RecordBatch | None:
        """(one, two, doc, tie, start, run): the first of equal windows with their hash and a run of
        0; of the others, runs of windows that start one after the other, without a hash."""
        if not self.parts:
            return None
        one, two, doc, tie, start = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.bytes = [], 0
        # the order of documents, as one number
        head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])]))
        _, rank = np.unique(np.array(list(zip(doc[head].tolist(), tie[head].tolist())), dtype="i8,i8"), return_inverse=True)
        place = np.repeat(rank.astype(np.int64), np.diff(np.append(head, len(doc)))) << 32 | start
        order = np.argsort(one, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]))
        least = np.repeat(np.minimum.reduceat(place[order], cuts), np.diff(np.append(cuts, len(order))))
        later = np.empty(len(order), dtype=bool)
        later[order] = place[order] != least
        first, late = np.flatnonzero(~later), np.flatnonzero(later)
        new = np.concatenate([[True], place[late][1:] != place[late][:-1] + 1]) if len(late) else np.empty(0, dtype=bool)
        begin = late[new]
        run = np.diff(np.append(np.flatnonzero(new), len(late))).astype(np.int32)
        every = np.concatenate([first, begin])
        hash_ = lambda x: pa.concat_arrays([pa.array(x[first].view(np.int64)), pa.nulls(len(begin), pa.int64())])
        return pa.RecordBatch.from_arrays(
            [
                hash_(one),
                hash_(two),
                pa.array(doc[every]),
                pa.array(tie[every]),
                pa.array(start[every].astype(np.int32)),
                pa.array(np.concatenate([np.zeros(len(first), dtype=np.int32), run])),
            ],
            names=["one", "two", "doc", "tie", "start", "run"],
        )


WINDOWS = "one long, two long, doc long, tie long, start int, run int"


def _estimated_repeats(batches: Iterator[pa.RecordBatch], repeated, width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The windows of (doc, tie, text, ...) rows that are estimated to be repeated, as WINDOWS.
    ``repeated``: from minimizers, the batch and the slice of its rows, which of them are."""
    held = _Windows()
    for batch in batches:
        doc, tie = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for first, found in W.scans(batch.column(2), W.SPACED):
            h, whole, least = windows(found, width, gram)
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            # minimizers stay the same for some windows: look each run up once
            value = least[at]
            new = np.concatenate([[True], value[1:] != value[:-1]])
            at = at[repeated(value[new], batch, first, found.n_rows)[np.cumsum(new) - 1]]
            if not len(at):
                continue
            row = np.searchsorted(found.ptr, at, side="right") - 1
            held.add(h, at, (doc[first + row], tie[first + row]), at - found.ptr[row], width)
            held.bytes += len(found.data)
            if held.bytes >= TOGETHER_BYTES:
                yield held.decided()
    last = held.decided()
    if last is not None:
        yield last


def _in_sketch(bits, size: int):
    def repeated(value: np.ndarray, *_) -> np.ndarray:
        table = np.frombuffer(bits.value, dtype=np.uint8)
        hit = np.ones(len(value), dtype=bool)
        for r, c in enumerate(cells(value, size)):
            c += r * size
            hit &= (table[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
        return hit

    return repeated


def _in_answers(value: np.ndarray, batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    """Whether minimizers are among those that the rows of a slice were answered."""
    return np.isin(value, batch.column(3).slice(first, n).flatten().to_numpy(zero_copy_only=False).view(U64))


def _without(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(row, text, starts, ends, copy) to (row, n_words, n_removed, kept_text)."""
    for batch in batches:
        text = batch.column(1)
        copy = batch.column(4).fill_null(False).to_numpy(zero_copy_only=False)
        begins, ends = batch.column(2), batch.column(3)
        for first, found in W.scans(text, W.SPACED):
            n = found.n_rows
            counts, edge = found.counts(), np.zeros(len(found.start) + 1, dtype=np.int64)
            for r in np.flatnonzero(copy[first : first + n] & (counts >= width)):
                edge[found.ptr[r]] += 1
                edge[found.ptr[r + 1]] -= 1
            b, e = begins.slice(first, n), ends.slice(first, n)
            for r in np.flatnonzero(b.is_valid().to_numpy(zero_copy_only=False)):
                np.add.at(edge, found.ptr[r] + np.asarray(b[int(r)].as_py(), dtype=np.int64), 1)
                np.add.at(edge, found.ptr[r] + np.asarray(e[int(r)].as_py(), dtype=np.int64), -1)
            keep = np.cumsum(edge)[:-1] == 0
            left = np.add.reduceat(np.append(keep, False).astype(np.int64), found.ptr[:-1]) if n else counts
            left = np.where(counts > 0, left, 0)
            data, offsets = _kept_words(found, keep)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, n),
                    pa.array(counts.astype(np.int64)),
                    pa.array((counts - left).astype(np.int64)),
                    pa.LargeStringArray.from_buffers(
                        n, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())
                    ).cast(pa.string()),
                ],
                names=["row", "n_words", "n_removed", "kept_text"],
            )


def _kept_words(found: W.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each row joined by one space: bytes and offsets."""
    n = len(found.data)
    start, end = found.start[keep], found.end[keep]
    row = found.row_of()[keep]
    more = np.zeros(len(row), dtype=bool)
    more[:-1] = row[1:] == row[:-1]  # a kept word follows in the row, so a space does
    edge = np.zeros(n + 2, dtype=np.int64)
    edge[start] += 1
    np.add.at(edge, end + more, -1)
    mask = np.cumsum(edge)[:n] > 0
    data = found.data.copy()
    data[end[more]] = 0x20
    return data[mask], np.concatenate([[0], np.cumsum(mask)])[found.offsets]


def deduplicated(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    width: int = WIDTH,
    gram: int = GRAM,
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns in ``carry`` (all) of ``df`` with ``n_words``, ``n_removed`` and ``kept_text`` added: the words that no window
    covers whose words also start earlier (in a document of smaller id, or earlier in the same
    document), joined by one space.

    Windows are judged on the input. A null text has no words and an empty ``kept_text``; a null
    id is smaller than all others; of rows with one id, each different text is a document of its
    own, ordered by a hash of the text, and equal rows are one document (none is earlier). An
    empty table gives an empty result; added columns replace input columns of the same name.
    """
    spark = df.sparkSession
    text, doc = F.col(f"`{text_col}`"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LOWEST))
    whole = F.coalesce(text, F.lit(""))
    thin = written(
        df.select(
            doc.alias("doc"), F.xxhash64(whole).alias("tie"), F.md5(whole).alias("sum"), F.octet_length(whole).alias("n")
        ),
        "passage-texts",
    )
    n_minimizers = (thin.agg(F.sum("n")).first()[0] or 0) / BYTES_EACH
    # texts that occur whole in a document of smaller id
    firsts = thin.groupBy("sum").agg(F.min("doc").alias("earliest"), F.max("doc").alias("latest"), F.count("*").alias("rows"))
    firsts = written(firsts.filter("earliest < latest"), "passage-repeated-texts")
    copies = joined_to_groups(thin.select("sum", "doc", "tie"), firsts, ["sum"], "rows").filter("doc > earliest")
    copies = written(copies.select("doc", "tie").distinct(), "passage-copies")
    n_copies = copies.count()

    texts = df.select(doc.alias("doc"), F.xxhash64(whole).alias("tie"), whole.alias("text"))
    texts = _joined(texts, copies, 40 * n_copies, "left_anti")
    if 40 * n_copies > BROADCAST_BYTES:
        texts = written(texts, "passage-others")  # the texts are shuffled once, not in each pass
    size = MIN_CELLS
    while size < CELLS_EACH * n_minimizers:
        size *= 2
    if size <= MAX_CELLS:
        bits = spark.sparkContext.broadcast(merged_sketch(texts.select("text"), size, width, gram))
        repeated = _in_sketch(bits, size)
    else:
        answers = written(dealt_repeats(texts, n_minimizers, width, gram), "passage-answers")
        some = answers.agg(F.count("*"), F.sum(F.size("minimizers"))).first()
        texts = _joined(texts, answers, 40 * some[0] + 8 * (some[1] or 0), "inner")
        repeated = _in_answers
    candidates = written(
        texts.mapInArrow(lambda batches: _estimated_repeats(batches, repeated, width, gram), WINDOWS), "passage-windows"
    )
    later = later_windows(candidates.filter("run = 0").drop("run")).withColumn("run", F.lit(1))
    runs = written(
        later.unionByName(candidates.filter("run > 0").select("doc", "tie", "start", "run"))
        .groupBy("doc", "tie")
        .agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("run") - 1 + width).alias("end")))).alias("at"))
        .select(
            "doc",
            "tie",
            _ends(lambda k: F.get("at", k - 1)["end"], lambda s, before: s["start"] > before, "start"),
            _ends(lambda k: F.get("at", k + 1)["start"], lambda s, after: s["end"] < after, "end"),
        ),
        "passage-removals",
    )
    sums = runs.agg(F.count("*"), F.sum(F.size("starts"))).first()
    copy = copies.withColumn("copy", F.lit(True))

    carry = df.columns if carry is None else carry
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        doc.alias("doc"),
        F.xxhash64(whole).alias("tie"),
        whole.alias("text"),
    )
    out = _joined(rows, runs, 40 * sums[0] + 8 * (sums[1] or 0), "left")
    out = _joined(out, copy, 40 * n_copies, "left").select("row", "text", "starts", "ends", "copy")
    schema = out.select("row").schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    done = out.mapInArrow(lambda batches: _without(batches, width), schema)
    return unpacked(done, carry, ["n_words", "n_removed", "kept_text"])


def _ends(neighbour, apart, what: str):
    """The ends of runs: the elements of ``at`` that are apart from their neighbour, or have none."""
    keep = lambda s, k: F.coalesce(apart(s, neighbour(k)), F.lit(True))
    return F.transform(F.filter("at", keep), lambda s: s[what]).alias(f"{what}s")


def later_windows(windows: DataFrame) -> DataFrame:
    """(doc, tie, start) of the ``windows`` (one, two, doc, tie, start) that are not the earliest of
    their hash. Windows that a HOT_SHARE of all rows have or more (so 1 / HOT_SHARE of them at most)
    are decided beside a broadcast of their earliest places; they are looked for only in those cells
    of hashes that have so many rows. The others meet in one shuffle."""
    place = F.struct("doc", "tie", "start")
    cell = F.shiftrightunsigned("one", 64 - CELL_BITS)
    counts = written(windows.groupBy(cell.alias("cell")).count(), "passage-cells")
    least = max(2, int(HOT_SHARE * (counts.agg(F.sum("count")).first()[0] or 0)))
    busy = [r["cell"] for r in counts.filter(F.col("count") >= least).select("cell").collect()] if least > 1 << 10 else []
    found = []
    if busy:
        firsts = windows.filter(cell.isin(busy)).groupBy("one", "two").agg(F.count("*").alias("n"), F.min(place).alias("first"))
        hot = written(firsts.filter(F.col("n") >= least).select("one", "two", "first"), "passage-hot")
        found.append(windows.join(F.broadcast(hot), ["one", "two"]))
        windows = windows.join(F.broadcast(hot), ["one", "two"], "left_anti")
    first = F.first(place).over(Window.partitionBy("one", "two").orderBy("doc", "tie", "start"))
    found.append(windows.withColumn("first", first))
    out = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return out.filter(place != F.col("first")).select("doc", "tie", "start")


def _joined(rows: DataFrame, table: DataFrame, size: int, how: str) -> DataFrame:
    return rows.join(F.broadcast(table) if size <= BROADCAST_BYTES else table, ["doc", "tie"], how)
