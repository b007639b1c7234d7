"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes.

A text is encoded by both tokenizers; where a token of each ends at the same byte, the text is cut,
and the tokens between two cuts are a group. All tokens of one side of a group are linked with all of
the other. A pair of ids is counted once for each document that links it.

A pair is one packed int64 key. Each task makes distinct keys of its documents, merges them to partial
counts with ``np.unique``, and the counts are sorted once by key range over all tasks, where the runs of
a key are summed; each range is kept as a shard, a file of sorted keys and one of their counts. The
links, written when the texts are read, are looked up in the shards by binary search; shards are mapped into
memory, so workers of one machine share them and none holds them. There are no more keys than pairs of the two
vocabularies, whatever the corpus.

Neither tokenizer joins bytes across the end of a word before a space (``Tokenizers.cut`` is only set
where that is sure), so texts are cut there into chunks and a worker aligns each different chunk
once for as long as it remembers it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from millrace.llm import words as W
from millrace.llm.shared import shared_path, unpacked, written

#: A chunk: white space and words up to the end of a word that a space follows.
CHUNK = re.compile(r"(?!\Z)\s*+\S*+(?:[^\S ]\s*+\S*+)*+")
#: Bytes of text aligned at once, and tokens of chunks that a worker remembers.
SLICE_BYTES, KEPT_TOKENS = 1 << 20, 4_000_000
#: Pairs that are listed at once; a group of more is taken by its different ids.
LISTED_PAIRS = 1 << 20
#: Keys that a task gathers before it merges them, and different ones that it holds.
GATHERED, HELD = 4_000_000, 8_000_000


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: the byte's own character if it is
    printable, else the next one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers of a worker. A: a byte-level tokenizer's file, given a space and the text; B: a
    SentencePiece model's, which puts the space itself. Strings of special tokens are text."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        vocabulary = self.a.get_vocab()
        self.n_a, self.n_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        self.a_bytes = [b""] * self.n_a
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_size = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        said = json.loads(self.a.to_str())
        before = said.get("pre_tokenizer") or {}
        plain_a = said.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex")
        plain_b = self.b.normalize(" x  y ") == "▁▁x▁▁y▁" and not any(re.search("[^▁]▁", p) for p in pieces)
        self.cut = bool(plain_a and plain_b and not before.get("add_prefix_space"))

    def chunks(self, text: str) -> list[str]:
        """The parts of a space and the text that are encoded alone, each a space and more."""
        if not self.cut:
            return [" " + text]
        found = CHUNK.findall(" " + text)
        if found[-1] == " ":  # B puts no space before nothing
            found[-2:] = [found[-2] + " "]
        return found

    def encoded(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of each chunk in A and in B; none where they don't stand for its bytes."""
        a = [x.ids for x in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        b = self.b.encode([c[1:] for c in chunks], num_threads=1)
        data = [c.encode() for c in chunks]
        whole = b"".join(data)
        if not all(_joined(ids, entries) == whole for ids, entries in ((a, self.a_bytes), (b, self.b_bytes))):
            for k, (x, y, chunk) in enumerate(zip(a, b, data, strict=True)):
                if not _joined([x], self.a_bytes) == chunk == _joined([y], self.b_bytes):
                    a[k], b[k] = [], []
        return a, b


def _joined(ids: list[list[int]], entries: list[bytes]) -> bytes:
    return b"".join(map(entries.__getitem__, chain.from_iterable(ids)))


def ends_of(counts) -> np.ndarray:
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for ``count`` numbers, of each entry in turn."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sum of each one's times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(times, first)


def linked(a, a_ptr, b, b_ptr, of, n_b: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of groups: ``of * width + a * n_b + b`` for each different triple, and how often it
    occurs. ``a_ptr``, ``b_ptr``: where the ids of each group start; ``of``: what each belongs to."""
    n, m = np.diff(a_ptr), np.diff(b_ptr)
    pairs = n * m
    found = []
    for g in np.flatnonzero(pairs > LISTED_PAIRS):
        left, at_left = np.unique(a[a_ptr[g] : a_ptr[g + 1]], return_counts=True)
        right, at_right = np.unique(b[b_ptr[g] : b_ptr[g + 1]], return_counts=True)
        rows = max(1, LISTED_PAIRS // len(right))
        for i in range(0, len(left), rows):
            keys = of[g] * width + left[i : i + rows, None] * n_b + right[None, :]
            found.append((keys.ravel(), (at_left[i : i + rows, None] * at_right[None, :]).ravel()))
    pairs = np.where(pairs > LISTED_PAIRS, 0, pairs)
    total, at = ends_of(pairs), 0
    while at < len(pairs):
        to = max(at + 1, int(np.searchsorted(total, total[at] + LISTED_PAIRS, side="right")) - 1)
        count = pairs[at:to]
        g = np.repeat(np.arange(at, to), count)
        place = np.arange(len(g)) - np.repeat(total[at:to] - total[at], count)
        keys = of[g] * width + a[a_ptr[g] + place // m[g]] * n_b + b[b_ptr[g] + place % m[g]]
        found.append(summed(keys, np.ones(len(keys), dtype=np.int64)))
        at = to
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return summed(np.concatenate([k for k, _ in found]), np.concatenate([t for _, t in found]))


#: What is counted of each text, and what its links' counts add.
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
NUMBERS = (*COUNTS, "n_best", "count_sum")
#: Numbers of chunks that may be large.
WIDE = ("key", "times", "n_links")


def _listed(a, a_ptr, b, b_ptr, groups) -> list[str]:
    """The groups of each chunk as text."""
    said = [
        f"{a[i]}|{b[k]}" if j - i == m - k == 1 else ",".join(map(str, a[i:j])) + "|" + ",".join(map(str, b[k:m]))
        for i, j, k, m in zip(a_ptr, a_ptr[1:], b_ptr, b_ptr[1:])
    ]
    return [";".join(said[i:j]) for i, j in zip(groups, groups[1:])]


@dataclass
class Chunks:
    """The chunks that a worker remembers: the ids of each in A and B by groups, its different links,
    and, if they are to be ``told``, its groups as text. Of chunk c, groups are ``group[c]:group[c + 1]``, and so on."""

    tools: Tokenizers
    told: bool
    known: dict[str, int] = field(default_factory=dict)
    listed: list[str] = field(default_factory=list)
    parts: dict[str, list[np.ndarray]] = field(default_factory=dict)
    n_tokens: int = 0

    def forget(self) -> None:
        self.known, self.listed, self.parts, self.n_tokens = {}, [], {}, 0

    def add(self, chunks: list[str]) -> None:
        """Chunks that are not known yet, each once."""
        tools = self.tools
        ids_a, ids_b = tools.encoded(chunks)
        n_a, n_b = np.array([*map(len, ids_a)], dtype=np.int64), np.array([*map(len, ids_b)], dtype=np.int64)
        a = np.fromiter(chain.from_iterable(ids_a), dtype=np.int64)
        b = np.fromiter(chain.from_iterable(ids_b), dtype=np.int64)
        end_a, end_b = np.cumsum(tools.a_size[a]), np.cumsum(tools.b_size[b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        a_ptr = np.concatenate(([0], np.searchsorted(end_a, both) + 1))
        b_ptr = np.concatenate(([0], np.searchsorted(end_b, both) + 1))
        groups = ends_of(np.diff(np.searchsorted(a_ptr, ends_of(n_a))))
        of = np.repeat(np.arange(len(chunks)), np.diff(groups))
        width = tools.n_a * tools.n_b
        keys, times = linked(a, a_ptr, b, b_ptr, of, tools.n_b, width)
        per_group = np.diff(a_ptr) * np.diff(b_ptr)
        made = {
            "a": a, "b": b, "group_a": np.diff(a_ptr), "group_b": np.diff(b_ptr), "n_groups": np.diff(groups),
            "n_a": n_a, "n_b": n_b, "good": (n_a > 0).astype(np.int64), "key": keys % width, "times": times,
            "n_keys": np.bincount(keys // width, minlength=len(chunks)),
            "n_links": np.diff(ends_of(per_group)[groups]),
        }
        for name, x in made.items():
            self.parts.setdefault(name, []).append(x if name in WIDE else x.astype(np.int32))
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))
        if self.told:
            self.listed += _listed(a.tolist(), a_ptr.tolist(), b.tolist(), b_ptr.tolist(), groups.tolist())
        self.n_tokens += len(a) + len(b)

    def array(self, name: str) -> np.ndarray:
        """One array of all chunks added so far."""
        parts = self.parts[name]
        if len(parts) > 1:
            parts[:] = [np.concatenate(parts)]
        return parts[0]


@dataclass
class Texts:
    """Some texts as numbers of chunks: text t has ``chunk[ptr[t]:ptr[t + 1]]``; none if it is null
    or empty, or if the tokens don't stand for its bytes."""

    chunk: np.ndarray
    ptr: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def chunked(texts: list[str | None], store: Chunks) -> Texts:
    if store.n_tokens > KEPT_TOKENS:
        store.forget()
    cut = [store.tools.chunks(t) if t else [] for t in texts]
    new = set(chain.from_iterable(cut)).difference(store.known)
    if new:
        store.add([*new])
    counts = np.array([*map(len, cut)], dtype=np.int64)
    chunk = np.fromiter(map(store.known.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(counts.sum()))
    if len(chunk):
        row = np.repeat(np.arange(len(cut)), counts)
        bad = np.bincount(row[store.array("good")[chunk] == 0], minlength=len(cut)) > 0
        chunk, counts = chunk[~bad[row]], np.where(bad, 0, counts)
    return Texts(chunk, ends_of(counts))


def links_of(texts: Texts, store: Chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, times) of the different links of each text."""
    if not len(texts.chunk):
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    many = len(store.known)
    seen, often = np.unique(texts.row() * many + texts.chunk, return_counts=True)
    row, chunk = seen // many, seen % many
    n_keys, width = store.array("n_keys"), store.tools.n_a * store.tools.n_b
    count = n_keys[chunk]
    at = spread((np.cumsum(n_keys) - n_keys)[chunk], count)
    keys, times = summed(np.repeat(row, count) * width + store.array("key")[at], np.repeat(often, count) * store.array("times")[at])
    return keys // width, keys % width, times


@lru_cache(maxsize=1)
def _remembered(a_path: str, b_path: str, told: bool) -> Chunks:
    """The chunks of a worker, which outlive a task."""
    return Chunks(Tokenizers(a_path, b_path), told)


def _slices(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], told: bool = False):
    """(batch, its texts, store) of pieces of the batches, the text in the last column."""
    store = _remembered(*paths, told)
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        for first, n in W.slices(column, SLICE_BYTES):
            part = batch.slice(first, n)
            yield part, chunked(part.column(batch.num_columns - 1).to_pylist(), store), store


def _aligned(batches, paths) -> Iterator[pa.RecordBatch]:
    """(row, text) to (row, groups)."""
    for part, texts, store in _slices(batches, paths):
        if len(texts.chunk):
            chunk, n_groups = texts.chunk, store.array("n_groups")
            n = n_groups[chunk]
            group = spread((np.cumsum(n_groups) - n_groups)[chunk], n)
            sides = []
            for side in ("a", "b"):
                size = store.array(f"group_{side}")
                token = spread((np.cumsum(size) - size)[group], size[group])
                sides.append(
                    pa.ListArray.from_arrays(pa.array(ends_of(size[group]).astype(np.int32)), pa.array(store.array(side)[token].astype(np.int32)))
                )
            of_row = np.bincount(texts.row(), weights=n, minlength=part.num_rows).astype(np.int64)
        else:
            sides = [pa.array([], pa.list_(pa.int32()))] * 2
            of_row = np.zeros(part.num_rows, dtype=np.int64)
        groups = pa.ListArray.from_arrays(pa.array(ends_of(of_row).astype(np.int32)), pa.StructArray.from_arrays(sides, names=["a", "b"]))
        yield pa.RecordBatch.from_arrays([part.column(0), groups], names=["row", "groups"])


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of ``values[ends[i]:ends[i + 1]]`` for each i."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of such a column, and where each row's begin."""
    data, at = W.text_bytes(column)
    kind = np.dtype(kind)
    return data.view(kind).astype(np.int64), at // kind.itemsize


def key_kind(width: int) -> str:
    """How packed keys are stored: in four bytes while all pairs of the vocabularies fit."""
    return "<u4" if width <= 1 << 32 else "<i8"


def _linked(batches, paths) -> Iterator[pa.RecordBatch]:
    """(row, text) to (row, numbers, groups_sha256, keys, times)."""
    for part, texts, store in _slices(batches, paths, told=True):
        n, row = part.num_rows, texts.row()
        told = {c: np.zeros(n, dtype=np.int64) for c in COUNTS}
        if len(texts.chunk):
            for c in COUNTS:
                np.add.at(told[c], row, store.array(c)[texts.chunk])
        digest = [
            hashlib.sha256(";".join(map(store.listed.__getitem__, texts.chunk[i:j].tolist())).encode()).hexdigest() if i < j else ""
            for i, j in zip(texts.ptr.tolist(), texts.ptr[1:].tolist())
        ]
        of, key, times = links_of(texts, store)
        ends = ends_of(np.bincount(of, minlength=n))
        keys = key.astype(key_kind(store.tools.n_a * store.tools.n_b))
        columns = [part.column(0), *map(pa.array, told.values()), pa.array(digest, pa.string()), _binary(keys, ends), _binary(times.astype("<u4"), ends)]
        yield pa.RecordBatch.from_arrays(columns, names=["row", *COUNTS, "groups_sha256", "keys", "times"])


def _counted(batches, kind: str) -> Iterator[pa.RecordBatch]:
    """(keys) to (key, n): partial counts of the rows of a task that have a key."""
    keys, counts, gathered = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), []

    def merged():
        new, n = np.unique(np.concatenate([*gathered, np.empty(0, dtype=np.int64)]), return_counts=True)
        gathered.clear()
        return summed(np.concatenate((keys, new)), np.concatenate((counts, n)))

    def told():
        for i in range(0, len(keys), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 17)]), pa.array(counts[i : i + (1 << 17)])], names=["key", "n"])

    n = 0
    for batch in batches:
        key, _ = _values(batch.column(0), kind)
        gathered.append(key)
        n += len(key)
        if n >= GATHERED:
            (keys, counts), n = merged(), 0
            if len(keys) > HELD:
                yield from told()
                keys, counts = keys[:0], counts[:0]
    keys, counts = merged()
    yield from told()


def _shard(batches, root: str, n_b: int) -> Iterator[pa.RecordBatch]:
    """(key, n) in order to one row that tells of a shard: its keys' range, its file, and the highest
    count of each id of A in it."""
    store, path = fs.FileSystem.from_uri(root)
    name = uuid.uuid4().hex  # a task that runs again writes files of its own
    first = last = None
    rows, best_a, best_n = 0, [], []
    key, n = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    with store.open_output_stream(f"{path}/{name}.keys") as keys_out, store.open_output_stream(f"{path}/{name}.counts") as counts_out:

        def put(key, n):
            nonlocal first, last, rows
            first, last, rows = int(key[0]) if first is None else first, int(key[-1]), rows + len(key)
            keys_out.write(key.tobytes())
            counts_out.write(n.tobytes())
            a = key // n_b
            start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            best_a.extend(a[start].tolist())
            best_n.extend(np.maximum.reduceat(n, start).tolist())

        for batch in batches:
            key, n = summed(np.concatenate((key, batch.column(0).to_numpy())), np.concatenate((n, batch.column(1).to_numpy())))
            if len(key) > 1:  # the last key may go on
                put(key[:-1], n[:-1])
                key, n = key[-1:], n[-1:]
        if len(key):
            put(key, n)
    if rows:
        told = {"first": [first], "last": [last], "rows": [rows], "name": [name], "ids": [best_a], "best": [best_n]}
        yield pa.RecordBatch.from_pydict(told, schema=SHARD)


SHARD = pa.schema(
    [("first", pa.int64()), ("last", pa.int64()), ("rows", pa.int64()), ("name", pa.string()), ("ids", pa.list_(pa.int64())), ("best", pa.list_(pa.int64()))]
)


@dataclass(frozen=True)
class Shards:
    """Sorted counts in files: (first key, last key, rows, name) of each in order, and the highest count
    of each id of A. Its size depends on the vocabularies and the number of tasks alone."""

    root: str
    parts: tuple[tuple[int, int, int, str], ...]
    best: np.ndarray

    def mapped(self) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        store, path = fs.FileSystem.from_uri(self.root)
        out = []
        for first, last, rows, name in self.parts:
            files = [_local(store, f"{path}/{name}.{kind}") for kind in ("keys", "counts")]
            out.append((first, last, *[np.memmap(f, dtype=np.int64, mode="r", shape=(rows,)) for f in files]))
        return out


def _local(store: fs.FileSystem, path: str) -> str:
    """A file that can be mapped: the file itself, or a copy that the workers of this machine share."""
    if isinstance(store, fs.LocalFileSystem):
        return path
    copy = os.path.join(tempfile.gettempdir(), f"millrace-{os.path.basename(path)}")
    if not os.path.exists(copy):
        with tempfile.NamedTemporaryFile(dir=tempfile.gettempdir(), delete=False) as out, store.open_input_stream(path) as data:
            while part := data.read(1 << 22):
                out.write(part)
        os.replace(out.name, copy)
    return copy


def looked_up(keys: np.ndarray, shards) -> np.ndarray:
    """The counts of ordered keys; each is in one of the shards."""
    out = np.zeros(len(keys), dtype=np.int64)
    for first, last, known, counts in shards:
        i, j = np.searchsorted(keys, first), np.searchsorted(keys, last, side="right")
        if i < j:
            at = np.minimum(np.searchsorted(known, keys[i:j]), len(known) - 1)
            out[i:j] = np.where(known[at] == keys[i:j], counts[at], 0)
    return out


def _scored(batches, shared, n_b: int, kind: str) -> Iterator[pa.RecordBatch]:
    """(row, numbers, groups_sha256, keys, times) to (row, numbers with n_best and count_sum, groups_sha256)."""
    shards: Shards = shared.value
    mapped = shards.mapped()
    for batch in batches:
        key, ends = _values(batch.column("keys"), kind)
        times, _ = _values(batch.column("times"), "<u4")
        of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        different, where = np.unique(key, return_inverse=True)
        count = looked_up(different, mapped)[where]
        total, best = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
        np.add.at(total, of, count * times)
        top = count == shards.best[key // n_b]
        np.add.at(best, of[top], times[top])
        kept = [batch.column(c) for c in ("row", *COUNTS)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(best), pa.array(total), batch.column("groups_sha256")], names=["row", *NUMBERS, "groups_sha256"])


def _packed_rows(df: DataFrame, text_col: str, carry: list[str] | None) -> tuple[DataFrame, list[str]]:
    carry = df.columns if carry is None else carry
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    return df.select(row, F.col(f"`{text_col}`").alias("text")), carry


def aligned(df: DataFrame, paths: tuple[str, str], text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns in ``carry`` (all) of ``df`` with ``groups``: an array of (a, b), the ids of both
    tokenizers between two byte offsets where tokens of both end. ``paths``: the files of A and B.
    There are no groups for a text that is null or empty, or that the ids of either don't stand for.
    Repeated rows are alike; an empty table gives an empty result; an input column named groups is
    replaced."""
    rows, carry = _packed_rows(df, text_col, carry)
    ids = ArrayType(IntegerType())
    schema = rows.select("row").schema.add("groups", ArrayType(StructType().add("a", ids).add("b", ids)))
    return unpacked(rows.mapInArrow(lambda batches: _aligned(batches, paths), schema), carry, ["groups"])


def links(df: DataFrame, paths: tuple[str, str], text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Each row of ``df`` as (row: the columns in ``carry``, the numbers of its tokens, groups and links,
    ``groups_sha256``, and its different packed keys with how often each is linked), written in the
    shared folder, so that both passes over the links read what one pass over the texts made."""
    rows, _ = _packed_rows(df, text_col, carry)
    schema = rows.select("row").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("groups_sha256", "string").add("keys", "binary").add("times", "binary")
    return written(rows.mapInArrow(lambda batches: _linked(batches, paths), schema), "pair-links")


def pair_counts(found: DataFrame, paths: tuple[str, str]) -> Shards:
    """How many rows of ``links`` have each key, in shards in the shared folder. Repeated rows count as often
    as they occur."""
    spark = found.sparkSession
    tools = Tokenizers(*paths)
    n_b, kind = tools.n_b, key_kind(tools.n_a * tools.n_b)
    root = shared_path(spark, "pair-counts")
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    store, path = fs.FileSystem.from_uri(root)
    store.create_dir(path, recursive=True)
    partial = written(found.select("keys").mapInArrow(lambda batches: _counted(batches, kind), "key long, n long"), "pair-partials")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = partial.repartitionByRange(parts, "key").sortWithinPartitions("key")
    schema = "first long, last long, rows long, name string, ids array<long>, best array<long>"
    index = ranges.mapInArrow(lambda batches: _shard(batches, root, n_b), schema).collect()
    best = np.zeros(tools.n_a, dtype=np.int64)
    for r in index:
        np.maximum.at(best, r["ids"], r["best"])
    return Shards(root, tuple(sorted((r["first"], r["last"], r["rows"], r["name"]) for r in index)), best)


def scored(
    df: DataFrame, paths: tuple[str, str], text_col: str = "text", carry: list[str] | None = None, shards: Shards | None = None
) -> DataFrame:
    """The columns in ``carry`` (all) of ``df`` with the numbers of tokens, groups and links of each text
    (``n_a``, ``n_b``, ``n_groups``, ``n_links``), ``n_best`` (links whose pair has the highest count of
    its A id), ``count_sum`` (of the links' counts) and ``groups_sha256`` (of the groups as text).
    ``shards``: what ``pair_counts`` found, by default in ``df`` itself. A text without tokens has
    zeros and ''. Repeated rows are alike; an empty table gives an empty result; added columns
    replace input columns of the same name."""
    carry = df.columns if carry is None else carry
    found = links(df, paths, text_col, carry)
    shared = df.sparkSession.sparkContext.broadcast(pair_counts(found, paths) if shards is None else shards)
    tools = Tokenizers(*paths)
    n_b, kind = tools.n_b, key_kind(tools.n_a * tools.n_b)
    schema = found.select("row").schema
    for c in NUMBERS:
        schema = schema.add(c, "long")
    out = found.mapInArrow(lambda batches: _scored(batches, shared, n_b, kind), schema.add("groups_sha256", "string"))
    return unpacked(out, carry, [*NUMBERS, "groups_sha256"])
