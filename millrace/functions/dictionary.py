"""Words of many lists found in one pass over a text.

All words of all lists are one Aho-Corasick automaton, built once in each worker and run once over each text
without its white space. What it finds comes with the place in the text as it is and with whether
white space stood within the word, so one pass serves rules that look at a text with and without
its white space.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "array<struct<word:int,begin:int,apart:boolean>>"
#: White space as ``text.ANY_SPACE`` has it (fixed values).
BLANKS = " \t\n\x0b\f\r\xa0\u3000\ufeff"
#: Whether a character of the first plane is one of them.
_BLANK = np.zeros(0x10000, dtype=bool)
_BLANK[[ord(c) for c in BLANKS]] = True


def squeezed(text: str) -> str:
    for c in BLANKS:
        text = text.replace(c, "")
    return text


@lru_cache(maxsize=16)
def automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """An automaton that knows each word's numbers (a word may be in several lists)."""
    numbers: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        numbers.setdefault(squeezed(w), []).append(i)
    out = ahocorasick.Automaton()
    for w, known in numbers.items():
        if w:
            out.add_word(w, (len(w), known))
    out.make_automaton()
    return out


def occurrences(text: str, words: tuple[str, ...]) -> list[tuple[int, int, bool]]:
    """(number of the word, place in the text, whether white space is within it) of all words found,
    those that overlap included, by place and number."""
    bare = squeezed(text)
    known = automaton(words)
    if not len(known):
        return []
    found = [(end - size + 1, end, i) for end, (size, numbers) in known.iter(bare) for i in numbers]
    if not found:
        return []
    if len(bare) == len(text):
        return sorted((i, begin, False) for begin, _, i in found)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    place = np.flatnonzero(~_BLANK[np.minimum(points, 0xFFFF)])
    return sorted((i, int(place[b]), bool(place[e] - place[b] != e - b)) for b, e, i in found)


def _array(rows: list[list[tuple[int, int, bool]] | None]) -> pa.Array:
    flat = [x for r in rows if r for x in r]
    ends = np.cumsum([0, *(len(r or ()) for r in rows)], dtype=np.int32)
    kinds = (pa.int32(), pa.int32(), pa.bool_())
    columns = [pa.array([x[i] for x in flat], kind) for i, kind in enumerate(kinds)]
    values = pa.StructArray.from_arrays(columns, names=["word", "begin", "apart"])
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([r is None for r in rows], pa.bool_()))


@dataclass(frozen=True)
class Dictionary:
    """Named lists of words, which are looked for without their white space. A word's number is its place
    in all lists one after the other."""

    lists: tuple[tuple[str, tuple[str, ...]], ...]

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(w for _, words in self.lists for w in words)

    def find(self, text: Column) -> Column:
        """All words of all lists in a text: (word, begin, apart), null for null. Python in Arrow batches,
        one pass over each text."""
        words = self.words

        @F.arrow_udf(FOUND)
        def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in texts:
                yield _array([None if t is None else occurrences(t, words) for t in batch.to_pylist()])

        return found(text)

    def hits(self, found: Column, name: str, together: bool = False) -> Column:
        """The words of one list among those found, each once, in the list's order; ``together``: only
        those without white space within."""
        start = 0
        for other, words in self.lists:
            if other == name:
                break
            start += len(words)
        else:
            raise KeyError(name)
        inside = lambda x: x["word"].between(start, start + len(words) - 1)
        chosen = F.filter(found, (lambda x: inside(x) & ~x["apart"]) if together else inside)
        numbers = F.array_sort(F.array_distinct(F.transform(chosen, lambda x: x["word"])))
        return F.transform(numbers, lambda i: F.get(texts(words), i - start))


def texts(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")
