"""Benchmark decontamination by a positional inverted index of the training texts.

The index is a table of blocks. A block holds some documents and, for each term, the sorted
positions of the term in them; positions of different documents are GAP apart, so no match runs
over a document's end. A window of test words is found by taking the positions of its rarest term
(by its count over all blocks), moved by the term's offset in the window, and intersecting them with
the moved positions of the next rarer terms, until none are left or all terms are. With a slop, a
term may stand that many places off: a proximity match.

The index is cut by documents, so queries go to the blocks and nothing is shuffled but the hits.
Test items are sent to the tasks in parts of ITEM_BYTES at most, and the index keeps the terms of
the test items only, or all terms where these are more than MAX_TERMS.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.shared import packed, unpacked, written

WINDOW = 10
GAP = 64
#: Test terms up to which they are broadcast (as numbers of 8 bytes), so that only their postings are
#: stored; with more, all terms are indexed.
MAX_TERMS = 4_000_000
ITEM_BYTES = 32 << 20

INDEX = (
    "block long, docs array<long>, lengths array<int>, terms array<long>, counts array<int>, positions binary"
)


@dataclass
class Windows:
    """Test windows: window w has the terms ``vocabulary[flat[ptr[w]:ptr[w + 1]]]`` in order and
    comes from the item ``items[w]``; ``order`` sorts the places of each window, rarest first."""

    vocabulary: np.ndarray
    flat: np.ndarray
    ptr: np.ndarray
    items: list
    order: list[np.ndarray]


def term_hashes(column: pa.Array) -> Iterator[tuple[int, W.Words, np.ndarray]]:
    for first, found in W.scans(column, W.ALNUM, lower=True):
        yield first, found, found.hashes().view(np.int64)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, found, h in term_hashes(batch.column(1)):
            terms = [h[found.ptr[r] : found.ptr[r + 1]] for r in range(found.n_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, found.n_rows), pa.array(terms, pa.list_(pa.int64()))],
                names=["item_id", "terms"],
            )


def item_terms(items: DataFrame, text_col: str = "text", id_col: str = "item_id") -> DataFrame:
    """(item_id, terms) of the items that have words; terms are 64-bit hashes of words."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(_item_terms, "item_id long, terms array<long>").filter(F.size("terms") > 0)


def _indexed(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    vocabulary = wanted.value if wanted is not None else None
    for batch in batches:
        for first, found, h in term_hashes(batch.column(1)):
            at = np.arange(len(h)) + GAP * found.row_of()
            if vocabulary is not None:
                near = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
                hit = vocabulary[near] == h if len(vocabulary) else np.zeros(len(h), dtype=bool)
                h, at = h[hit], at[hit]
            order = np.argsort(h, kind="stable")
            terms, counts = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    pa.array([batch.column(0).slice(first, found.n_rows)], pa.list_(pa.int64())),
                    pa.array([found.counts().astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([terms], pa.list_(pa.int64())),
                    pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([at[order].astype(np.int32).tobytes()], pa.binary()),
                ],
                names=["block", "docs", "lengths", "terms", "counts", "positions"],
            )
            block += 1


def build_index(docs: DataFrame, terms: DataFrame | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The stored index of ``docs`` (one row for each block). ``terms``: the table of the terms
    (``term``) to keep; all are kept without it or where it has more than MAX_TERMS rows."""
    wanted = None
    if terms is not None and terms.count() <= MAX_TERMS:
        vocabulary = np.sort(terms.select("term").toArrow().column(0).to_numpy()).astype(np.int64)
        wanted = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return written(rows.mapInArrow(lambda batches: _indexed(batches, wanted), INDEX), "positional-index")


def make_windows(items: list, counts: dict[int, int], width: int = WINDOW) -> Windows:
    """The windows of ``items`` ((id, terms) pairs): each ``width`` consecutive terms, or all terms
    of an item with fewer. ``counts``: how often each term occurs in the index."""
    vocabulary = np.array(sorted({t for _, terms in items for t in terms}), dtype=np.int64)
    often = np.array([counts.get(int(t), 0) for t in vocabulary], dtype=np.int64)
    flat, ptr, ids, order = [], [0], [], []
    for item, terms in items:
        at = np.searchsorted(vocabulary, np.array(terms, dtype=np.int64))
        for i in range(max(1, len(at) - width + 1)):
            window = at[i : i + width]
            flat.append(window)
            ptr.append(ptr[-1] + len(window))
            ids.append(item)
            order.append(np.argsort(often[window], kind="stable"))
    return Windows(vocabulary, np.concatenate(flat) if flat else np.empty(0, dtype=np.int64), np.array(ptr), ids, order)


def starts_of(postings, window: np.ndarray, order: np.ndarray, slop: int) -> np.ndarray:
    """Where a window begins: the moved positions of its rarest term that the moved positions of
    all other terms meet, each within ``slop``."""
    starts = postings(window[order[0]]) - order[0]
    for place in order[1:]:
        if not len(starts):
            break
        other = postings(window[place])
        near = np.searchsorted(other, starts + place - slop)
        found = other[np.minimum(near, len(other) - 1)]
        starts = starts[(near < len(other)) & (found <= starts + place + slop)]
    return starts


def _matched(batches: Iterator[pa.RecordBatch], windows, slop: int) -> Iterator[pa.RecordBatch]:
    """Index blocks to hits: (block, row, items, near, begins, ends) for each document with any."""
    test: Windows = windows.value
    for batch in batches:
        for i in range(batch.num_rows):
            block, lengths = batch.column(0)[i].as_py(), np.asarray(batch.column(2)[i].values)
            terms, counts = np.asarray(batch.column(3)[i].values), np.asarray(batch.column(4)[i].values)
            positions = np.frombuffer(batch.column(5)[i].as_buffer(), dtype=np.int32).astype(np.int64)
            if not len(terms) or not len(test.items):
                continue
            upto = np.concatenate([[0], np.cumsum(counts)])
            near = np.minimum(np.searchsorted(terms, test.vocabulary), len(terms) - 1)
            present = terms[near] == test.vocabulary
            row_start = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))]) + GAP * np.arange(len(lengths) + 1)
            postings = lambda t: positions[upto[near[t]] : upto[near[t] + 1]]  # noqa: B023, E731
            exact: dict[int, list] = {}
            close: dict[int, set] = {}
            whole = np.logical_and.reduceat(present[test.flat], test.ptr[:-1])
            for w in np.flatnonzero(whole):
                window = test.flat[test.ptr[w] : test.ptr[w + 1]]
                starts = starts_of(postings, window, test.order[w], 0)
                for r, s in zip(np.searchsorted(row_start, starts, side="right") - 1, starts, strict=True):
                    begin = int(s - row_start[r])
                    exact.setdefault(int(r), []).append((begin, begin + len(window), test.items[w]))
                if slop:
                    loose = starts_of(postings, window, test.order[w], slop)
                    for r in np.unique(np.searchsorted(row_start, loose + test.order[w][0], side="right") - 1):
                        close.setdefault(int(r), set()).add(test.items[w])
            rows = sorted(exact.keys() | close.keys())
            if rows:
                found = [exact.get(r, []) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(rows), pa.int64()),
                        pa.array(rows, pa.int32()),
                        pa.array([list({x[2] for x in f}) for f in found], pa.list_(pa.int64())),
                        pa.array([list(close.get(r, ())) for r in rows], pa.list_(pa.int64())),
                        pa.array([sorted({x[:2] for x in f}) for f in found], pa.list_(pa.list_(pa.int32()))),
                    ],
                    names=["block", "row", "items", "near", "spans"],
                )


def matches(
    docs: DataFrame,
    items: DataFrame,
    width: int = WINDOW,
    slop: int = 0,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_col: str = "item_id",
) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, n_hit (words inside an occurrence of a window),
    spans (its occurrences, as [begin, end) word places), items (the ids of the items with an
    occurring window) and near_items (with one within ``slop`` places; empty for slop 0).

    A null text has no words. A null id is kept as it is; repeated rows are matched alike. An
    item without words has no window; an item with a null id counts once, with the other items of
    that id. Empty tables give an empty result, or no matches. ``slop`` is at most GAP // 4.
    """
    if not 0 <= slop <= GAP // 4:
        raise ValueError(f"slop must be from 0 to {GAP // 4}")
    spark = docs.sparkSession
    terms = written(item_terms(items, text_col, item_col), "test-terms")
    vocabulary = terms.select(F.explode(F.array_distinct("terms")).alias("term")).distinct()
    index = build_index(docs, vocabulary, text_col, id_col)
    parts = max(1, -(-(terms.agg(F.sum(8 * width * F.size("terms"))).first()[0] or 0) // ITEM_BYTES))
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("x.terms", "x.counts")
    often = pairs.groupBy(F.col("terms").alias("term")).agg(F.sum("counts").alias("n"))
    hits = None
    for part in range(parts):
        some = terms.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(parts)) == part)
        own = some.select(F.explode("terms").alias("term")).distinct()
        counts = {r["term"]: r["n"] for r in often.join(own, "term", "left_semi").collect()}
        test = make_windows([(r["item_id"], r["terms"]) for r in some.collect()], counts, width)
        windows = spark.sparkContext.broadcast(test)
        found = index.mapInArrow(
            lambda batches, windows=windows: _matched(batches, windows, slop),
            "block long, row int, items array<long>, near array<long>, spans array<array<int>>",
        )
        found = written(found, "test-hits")
        hits = found if hits is None else hits.unionAll(found)
    merged = hits.groupBy("block", "row").agg(
        *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near", "spans")]
    )
    rows = index.select(
        "block", F.posexplode(F.arrays_zip("docs", "lengths")).alias("row", "x")
    ).select("block", "row", "x.docs", "x.lengths")
    out = rows.join(merged, ["block", "row"], "left")
    none = lambda t: F.array().cast(t)
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(F.get(s, 0), F.get(s, 1) - 1))))
    return out.select(
        F.col("docs").alias("doc_id"),
        F.col("lengths").cast("long").alias("n_words"),
        F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", none("array<array<int>>")).alias("spans"),
        F.coalesce("items", none("array<long>")).alias("items"),
        F.coalesce("near", none("array<long>")).alias("near_items"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold a test window. Rows with the id of such a document
    go with it; rows with a null id are judged as one document."""
    dirty = matches(docs, items, width, id_col=id_col).filter("n_hit > 0").select("doc_id").distinct()
    dirty = written(dirty, "dirty-ids").withColumnRenamed("doc_id", "dirty_id")
    rows = packed(docs)
    same = F.col("row").getField(id_col).cast("long").eqNullSafe(F.col("dirty_id"))
    return unpacked(rows.join(dirty, same, "left_anti"), docs.columns, [])
