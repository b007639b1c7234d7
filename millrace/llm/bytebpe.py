"""Byte-level BPE encoding and decoding as a tree of joins.

Encodings of neighbouring spans form a monoid: two of them are joined by encoding anew a window of
tokens on both sides of the seam, which grows until the tokens outside it are proved to stay. The
proof is by pairs: tokens are the encoding of their bytes if and only if each two neighbours are, as
no merge ever crosses a boundary that no pair of neighbours crosses by itself. So a window may end
where its outer token and the next one fit, and nothing farther off can change. That holds for
vocabularies whose tokens encode to themselves, which ``load_ranks`` makes sure of.

The same is done one level up for the words (matches of the pattern) that are encoded one by one: a
word at a seam is matched anew together with its neighbours until a match starts where one of the
right half's did; the pattern looks at most LOOK characters ahead of a match's start and one beyond
its end, so words that end before that stay. A text is cut in halves down to LEAF characters, a word
down to SHORT bytes; one of a million letters costs as many steps as other text, but for a factor
log n. Decoding joins the bytes of halves.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from millrace.llm.shared import unpacked

#: The pattern of the words that are encoded one by one (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters from its start that a match of the pattern depends on, whatever its length.
LOOK = 3
#: Characters of a text, bytes of a word and tokens that are handled without halving them.
LEAF, SHORT, FLAT = 4096, 24, 1 << 16
#: The rank of a pair that is no token.
NEVER = 1 << 62
#: Words and pairs of tokens that a worker remembers.
KEPT_WORDS, KEPT_PAIRS = 600_000, 200_000


@dataclass(frozen=True)
class Ranks:
    """A vocabulary: the rank of each token's bytes, which is its id."""

    rank: dict[bytes, int]

    @property
    def token(self) -> dict[int, bytes]:
        return {i: b for b, i in self.rank.items()}


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Ranks:
    """The vocabulary of a file of lines of base64 and rank. One that has a token that is not the
    encoding of its own bytes, or that lacks a byte, is refused, as joins would not be proved."""
    with open(path, "rb") as lines:
        rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoder = Encoder(Ranks(rank))
    if any(bytes([b]) not in rank for b in range(256)) or any(encoder.merged(b) != [i] for b, i in rank.items()):
        raise ValueError(f"{path}: not every byte is a token, or a token does not encode to itself")
    return Ranks(rank)


def _of_ascii(pattern: str) -> str:
    """The pattern for ASCII text: letters and numbers by their ranges, in brackets or out of them."""
    out, inside = "", False
    for part in re.findall(r"\\p\{[LN]\}|\\.|.", pattern):
        inside = (inside or part == "[") and part != "]"
        span = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}.get(part)
        out += part if span is None else span if inside else f"[{span}]"
    return out


class _Kept(dict):
    """A mapping that makes what it lacks, and forgets all beyond ``most`` entries."""

    def __init__(self, make, most: int, fits=lambda key: True):
        self.make, self.most, self.fits = make, most, fits

    def __missing__(self, key):
        made = self.make(key)
        if self.fits(key):
            if len(self) >= self.most:
                self.clear()
            self[key] = made
        return made


class Encoder:
    """What a worker needs to encode texts, with the words that it remembers."""

    def __init__(self, ranks: Ranks, pattern: str = PATTERN):
        self.rank, self.token = ranks.rank, ranks.token
        self.find = regex.compile(pattern)
        #: Words of ASCII text, for which the plain library is faster.
        self.find_ascii = re.compile(_of_ascii(pattern), re.ASCII)
        self.word = _Kept(lambda w: self.encode(w.encode()), KEPT_WORDS, lambda w: len(w) <= 64)
        self.fit = _Kept(lambda p: self.merged(self.token[p[0]] + self.token[p[1]]) == [*p], KEPT_PAIRS)

    def merged(self, data: bytes) -> list[int]:
        """The tokens of ``data``: the pair of least rank is merged first, the leftmost of equal ones."""
        return self._merged_long(data) if len(data) > 4 * SHORT else self._merged_short(data)

    def _merged_short(self, data: bytes) -> list[int]:
        rank, n = self.rank, len(data)
        parts = [data[i : i + 1] for i in range(n)]
        pairs = [rank.get(data[i : i + 2], NEVER) for i in range(n - 1)]
        while pairs and (least := min(pairs)) < NEVER:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = rank.get(parts[i - 1] + parts[i], NEVER)
            if i < len(pairs):
                pairs[i] = rank.get(parts[i] + parts[i + 1], NEVER)
        return [*map(rank.__getitem__, parts)]

    def _merged_long(self, data: bytes) -> list[int]:
        """As the short form, with a heap of pairs: n log n steps."""
        n = len(data)
        end = list(range(1, n + 1))  # of the token that starts at a place
        before = list(range(-1, n - 1))  # the start of the token before
        rank = self.rank
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if middle == 0 or middle >= stop or middle >= n or end[middle] != stop:
                continue  # one of the two has been merged since
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := rank.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(rank[data[i : end[i]]])
            i = end[i]
        return out

    def encode(self, data: bytes) -> list[int]:
        """The tokens of a word's bytes, by halves."""
        if (whole := self.rank.get(data)) is not None:
            return [whole]
        if len(data) <= SHORT:
            return self.merged(data)
        half = len(data) // 2
        return self.joined(self.encode(data[:half]), self.encode(data[half:]))

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two neighbouring spans together."""
        if not left or not right or self.fit[left[-1], right[0]]:
            return left + right
        i = j = 1
        while True:
            inner = self.merged(b"".join(map(self.token.__getitem__, left[-i:] + right[:j])))
            fits_left = i == len(left) or self.fit[left[-i - 1], inner[0]]
            fits_right = j == len(right) or self.fit[inner[-1], right[j]]
            if fits_left and fits_right:
                return left[: len(left) - i] + inner + right[j:]
            i = i if fits_left else min(2 * i, len(left))
            j = j if fits_right else min(2 * j, len(right))

    def words(self, text: str) -> tuple[list[str], list[list[int]]]:
        """The words of a text and the tokens of each, by halves."""
        if len(text) <= LEAF:
            found = (self.find_ascii if text.isascii() else self.find).findall(text)
            return found, [*map(self.word.__getitem__, found)]
        half = len(text) // 2
        return self.joined_words(self.words(text[:half]), self.words(text[half:]))

    def joined_words(self, left, right):
        """The words and tokens of two neighbouring spans of a text together."""
        (a, a_ids), (b, b_ids) = left, right
        if not a or not b:
            return (a + b, a_ids + b_ids)
        # words of the left half that its end has cut off, or that end too near to it
        first, behind = len(a), 0
        while first and (behind < 2 or behind + len(a[first - 1]) < LOOK):
            first -= 1
            behind += len(a[first])
        seam = behind
        take = 1
        while True:
            old, old_ids = a[first:] + b[:take], a_ids[first:] + b_ids[:take]
            window, whole = "".join(old), take >= len(b)
            starts = {at: k for k, at in enumerate(accumulate(map(len, old), initial=0))}
            new, new_ids, stop = [], [], None
            for m in self.find.finditer(window):
                s, e = m.span()
                if s >= seam and s in starts:
                    stop = s
                    break
                if not whole and (s + LOOK > len(window) or e + 2 > len(window)):
                    break  # it may depend on what follows
                new.append(m.group())
                if s in starts and e in starts:  # of whole old words
                    ids = old_ids[starts[s]]
                    for k in range(starts[s] + 1, starts[e]):
                        ids = self.joined(ids, old_ids[k])
                else:
                    ids = self.word[new[-1]]
                new_ids.append(ids)
            else:
                stop = len(window) if whole else None
            if stop is not None:
                rest = starts[stop] - (len(a) - first)
                return a[:first] + new + b[rest:], a_ids[:first] + new_ids + b_ids[rest:]
            take *= 2

    def text(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(self.words(text)[1]), dtype=np.int32)


def _encode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(row, text) to (row, tokens)."""
    encoder = Encoder(*shared.value)
    for batch in batches:
        ids = [None if t is None else encoder.text(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids)], names=["row", "tokens"])


def _lists(ids: list[np.ndarray | None]) -> pa.Array:
    ends = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([0 if x is None else len(x) for x in ids], out=ends[1:])
    flat = np.concatenate([x for x in ids if x is not None] or [np.empty(0, dtype=np.int32)])
    gone = pa.array([x is None for x in ids]) if any(x is None for x in ids) else None
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=gone)


class Decoder:
    """The bytes of tokens, from one array of all of them."""

    def __init__(self, ranks: Ranks):
        token = ranks.token
        n = max(token, default=-1) + 1
        size = np.array([len(token.get(i, b"")) for i in range(n)], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(token.get(i, b"") for i in range(n)), dtype=np.uint8)
        self.size, self.start = size, np.cumsum(size) - size

    def bytes(self, ids: np.ndarray) -> bytes:
        if len(ids) > FLAT:
            half = len(ids) // 2
            return self.bytes(ids[:half]) + self.bytes(ids[half:])
        size = self.size[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        return self.flat[at + np.arange(len(at))].tobytes()


def _decode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(row, tokens) to (row, decoded)."""
    decoder = Decoder(shared.value[0])
    for batch in batches:
        data = [decoder.bytes(x.values.to_numpy()) if x.is_valid else None for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["row", "decoded"])


def encode(
    df: DataFrame, ranks: Ranks, text_col: str = "text", pattern: str = PATTERN, carry: list[str] | None = None
) -> DataFrame:
    """The columns in ``carry`` (all) of ``df`` with ``tokens`` (array<int>), the ids of its text. A
    null text has null tokens, an empty one none; nothing in a text is a special token. Rows are
    encoded alike wherever they are, so repeated rows are; a text is one task's, as it was. An empty
    table gives an empty result; an input column named tokens is replaced. ``pattern`` may look at
    LOOK characters at most from a match's start and one beyond its end."""
    carry = df.columns if carry is None else carry
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = rows.select("row").schema.add("tokens", ArrayType(IntegerType()))
    return unpacked(rows.mapInArrow(lambda batches: _encode(batches, shared), schema), carry, ["tokens"])


def decode(df: DataFrame, ranks: Ranks, tokens_col: str = "tokens", carry: list[str] | None = None) -> DataFrame:
    """The columns in ``carry`` (all) of ``df`` with ``decoded`` (binary), the bytes of its tokens;
    null for null. An id that the vocabulary lacks within its range stands for no bytes."""
    carry = df.columns if carry is None else carry
    shared = df.sparkSession.sparkContext.broadcast((ranks,))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{tokens_col}`").alias("tokens")
    )
    schema = rows.select("row").schema.add("decoded", "binary")
    return unpacked(rows.mapInArrow(lambda batches: _decode(batches, shared), schema), carry, ["decoded"])
