"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is cut where no piece can lie across (before a run of spaces, and around bytes that are in no
piece), so its lattice of pieces is a chain of small lattices. The forward pass sums the weights of
all paths to each place of a small lattice, once for each different cut of text; the backward pass
draws each occurrence's pieces from the end with probabilities that these sums give, which is an
exact draw among all segmentations. Draws come from a counter hashed with the row's key, so a row
has the same segmentation wherever and whenever it is encoded.

Texts are neither normalised nor given a leading space, a space is the piece character U+2581, and
what no piece covers is written in byte pieces, so decoding gives back every text exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from millrace.llm import words as W
from millrace.llm.shared import unpacked

U64 = np.uint64
SEED = 20
#: Weights of BPE pieces: their scores are ranks, and a piece of rank r is taken to have a
#: probability in proportion to (r + ZIPF_OFFSET) ** -sharpness.
ZIPF_OFFSET = 10.0
#: How much less than the rarest piece a byte piece weighs, as a natural logarithm.
BYTE_PENALTY = 5.0
#: Bytes of the lattices that a Python worker keeps; beyond them it starts anew.
KEPT_BYTES = 64 << 20
#: Bytes of text whose lattices are worked out together, and that are sampled together.
NEW_BYTES, SAMPLED_BYTES = 128 << 10, 256 << 10
#: A longer cut of text is drawn alone, in windows of so many bytes, and not kept.
LONG_CUT, WINDOW = 128, 32 << 10


@dataclass
class Pieces:
    """The vocabulary: for each length in bytes the sorted hashes of all beginnings of pieces of that
    length, with the id of the piece that is no longer (else -1); weights; bytes."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray]]
    weight: np.ndarray
    byte_ids: np.ndarray
    byte_weight: float
    flat: np.ndarray
    ptr: np.ndarray
    alone: np.ndarray
    name: str = ""


def load_pieces(model_file: str, sharpness: float = 1.0) -> Pieces:
    """Tables of a SentencePiece model; its file is read on the driver only."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    scores = np.array([model.get_score(i) for i in range(n)])
    ranked = np.all(scores == np.round(scores)) and scores.min() < -100  # BPE: minus the merge rank
    weight = -np.log(ZIPF_OFFSET - scores) * sharpness if ranked else scores * sharpness
    texts, byte_ids = [], np.full(256, -1, dtype=np.int32)
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            texts.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(b"")
        else:
            texts.append(piece.replace("▁", " ").encode())
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces, so decoding would not be lossless")
    plain = [i for i in range(n) if texts[i] and not model.is_byte(i)]
    if any(b" " in texts[i].lstrip(b" ") for i in plain):
        raise ValueError("a piece has a space after other characters")
    ptr = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    by_length, hashes = {}, W.Hashes(flat)
    lengths = np.array([len(texts[i]) for i in plain])
    for length in range(1, int(lengths.max()) + 1):
        ids = np.array(plain, dtype=np.int32)[lengths >= length]
        whole = lengths[lengths >= length] == length
        h = hashes.of(ptr[ids], ptr[ids] + length)
        # of equal beginnings the one that is a piece comes first
        order = np.lexsort((~whole, h))
        h, ids = h[order], np.where(whole, ids, -1)[order]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        by_length[length] = (h[first], ids[first])
    alone = np.ones(256, dtype=bool)
    for i in plain:
        alone[list(texts[i])] = False
    least = float(weight[plain].min())
    return Pieces(by_length, weight, byte_ids, least - BYTE_PENALTY, flat, ptr, alone, f"{model_file}|{sharpness}")


class Growing:
    """An array that grows at its end, by doubling."""

    def __init__(self, dtype):
        self.room, self.n = np.empty(1024, dtype=dtype), 0

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.room):
            more = np.empty(max(n, 2 * len(self.room)), dtype=self.room.dtype)
            more[: self.n] = self.room[: self.n]
            self.room = more
        self.room[self.n : n] = values
        self.n = n

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


class Lattices:
    """The lattices of different cuts of text. Cut c has the nodes ``base[c]`` (its start) to
    ``base[c] + length[c]``; the edges into node v are from ``ptr[v]`` on, and ``chance`` is their
    cumulative probability, so 1 for the last."""

    def __init__(self):
        self.known, self.which = np.empty(0, dtype=U64), np.empty(0, dtype=np.int32)
        self.base, self.length = Growing(np.int32), Growing(np.int32)
        self.ptr, self.source, self.piece = Growing(np.int32), Growing(np.int32), Growing(np.int32)
        self.chance = Growing(np.float64)

    def bytes(self) -> int:
        return 16 * self.chance.n + 4 * self.ptr.n + 20 * self.base.n

    def add(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, pieces: Pieces) -> None:
        """Adds the lattices of the cuts ``data[start:end]``, whose sorted hashes are not known yet."""
        edges, base, length = edges_of(data, W.Hashes(data), start, end, pieces)
        chance, source, target, piece = filtered(edges, base, length)
        first, nodes = self.base.n, self.ptr.n
        into = np.bincount(target, minlength=int((length + 1).sum()))
        self.ptr.add(self.chance.n + np.cumsum(into) - into)
        self.chance.add(chance)
        self.source.add(source + nodes)
        self.piece.add(piece)
        self.base.add(base + nodes)
        self.length.add(length)
        place = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, place, hashes)
        self.which = np.insert(self.which, place, np.arange(first, self.base.n, dtype=np.int32))


def edges_of(data: np.ndarray, all_hashes: W.Hashes, start: np.ndarray, end: np.ndarray, pieces: Pieces):
    """The edges of the cuts ``data[start:end]``: (source node, target node, piece, weight), with
    nodes counted through all cuts. Also the first node of each cut."""
    length = end - start
    base = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
    n = int(length.sum())
    cut = np.repeat(np.arange(len(start)), length)
    place = np.arange(n) - np.repeat(np.cumsum(length) - length, length)
    at = start[cut] + place
    left = length[cut] - place
    node = base[cut] + place
    lead = data[at]
    size = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0], [1, 0, 2, 3], 4)
    covered = np.zeros(n, dtype=bool)
    out = []
    open_ = np.flatnonzero(size > 0)  # where some piece may go on
    for width, (hashes, ids) in pieces.by_length.items():
        open_ = open_[left[open_] >= width]
        if not len(open_):
            break
        h = all_hashes.of(at[open_], at[open_] + width)
        near = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[near] == h
        open_, found = open_[hit], ids[near[hit]]
        is_piece = found >= 0
        fit, found = open_[is_piece], found[is_piece]
        covered[fit[size[fit] == width]] = True
        out.append((node[fit], node[fit] + width, found, pieces.weight[found]))
    # byte pieces for the bytes of characters that are no piece themselves
    first = np.maximum.accumulate(np.where(size > 0, np.arange(n), 0)) if n else np.empty(0, dtype=np.int64)
    bare = np.flatnonzero(~covered[first]) if n else first
    out.append((node[bare], node[bare] + 1, pieces.byte_ids[data[at[bare]]], np.full(len(bare), pieces.byte_weight)))
    return [np.concatenate(x) for x in zip(*out, strict=True)], base, length


def filtered(edges, base: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward filtering: the edges that lie on a path from their cut's start, sorted by target, as
    (chance, source, target, piece); chance is the cumulative probability of the target's edges."""
    source, target, piece, weight = edges
    nodes = int((length + 1).sum())
    place = np.arange(nodes) - np.repeat(base, length + 1)
    total = np.full(nodes, -np.inf)
    total[base] = 0.0
    order = np.lexsort((source, target, place[target]))
    source, target, piece, weight = source[order], target[order], piece[order], weight[order]
    level = place[target]
    cuts = np.searchsorted(level, np.arange(1, int(level.max(initial=0)) + 2))
    share = np.empty(len(source))
    for i in range(len(cuts) - 1):
        part = slice(cuts[i], cuts[i + 1])
        value = total[source[part]] + weight[part]
        if not len(value):
            continue
        to = target[part]
        head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        most = np.maximum.reduceat(value, head)
        group = np.cumsum(np.concatenate([[0], (to[1:] != to[:-1]).astype(np.int64)]))
        safe = np.where(np.isfinite(most), most, 0.0)
        mass = np.exp(value - safe[group])
        sums = np.add.reduceat(mass, head)
        with np.errstate(divide="ignore", invalid="ignore"):
            total[to[head]] = safe + np.log(sums)
            share[part] = np.where(sums[group] > 0, mass / sums[group], 0.0)
    order = np.argsort(target, kind="stable")
    source, target, piece, share = source[order], target[order], piece[order], share[order]
    live = share > 0
    source, target, piece, share = source[live], target[live], piece[live], share[live]
    if not len(source):
        return np.empty(0), source, target, piece
    upto = np.cumsum(share)
    head = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
    before = np.repeat(upto[head] - share[head], np.diff(np.append(head, len(target))))
    chance = np.minimum(upto - before, 1.0)
    chance[np.append(head[1:], len(target)) - 1] = 1.0
    return chance, source, target, piece


_KEPT: dict[str, Lattices] = {}


def _looked_up(data, start, end, pieces: Pieces) -> tuple[Lattices, np.ndarray]:
    """The lattices kept by this worker with those of the given cuts added, and each cut's."""
    kept = _KEPT.get(pieces.name)
    if kept is None or kept.bytes() > KEPT_BYTES:
        kept = _KEPT[pieces.name] = Lattices()
    unique, example, inverse = np.unique(W.Hashes(data).of(start, end), return_index=True, return_inverse=True)
    near = np.searchsorted(kept.known, unique)
    have = np.zeros(len(unique), dtype=bool)
    inside = near < len(kept.known)
    have[inside] = kept.known[near[inside]] == unique[inside]
    new = np.flatnonzero(~have)
    if len(new):
        low, high = start[example[new]], end[example[new]]
        turn = np.cumsum(high - low) // NEW_BYTES
        for part in np.split(np.arange(len(new)), np.flatnonzero(np.diff(turn)) + 1):
            kept.add(unique[new[part]], data, low[part], high[part], pieces)
        near = np.searchsorted(kept.known, unique)
    return kept, kept.which[near][inverse]


def _boundary(data: np.ndarray, at: int) -> int:
    """The last start of a character at or before ``at``."""
    while at > 0 and at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


class LongCut:
    """The lattice of one long cut, of which only a window is held at a time. The forward pass keeps
    the sums at the windows' starts; the backward pass makes each window's again from them. Sums
    are scaled in each window, which changes no probability."""

    def __init__(self, data: np.ndarray, pieces: Pieces):
        self.data, self.pieces = data, pieces
        self.reach = max(pieces.by_length)
        self.starts = [0]
        while self.starts[-1] + WINDOW < len(data):
            self.starts.append(_boundary(data, self.starts[-1] + WINDOW))
        self.ends = [*self.starts[1:], len(data)]
        self.sums: list[tuple[int, list[float]]] = []

    def window(self, k: int, low: int, before: list[float]):
        """The edges into the places of window ``k``, by place, with the mass of each (what it adds to
        its place's sum), and the sums from ``low`` on; ``before``: those up to the window's start."""
        first, last = self.starts[k], self.ends[k]
        part = self.data[low:last]
        edges, _, _ = edges_of(part, W.Hashes(part), np.array([0]), np.array([last - low]), self.pieces)
        source, target, piece, weight = edges
        late = target > first - low
        source, target, piece, mass = source[late], target[late], piece[late], np.exp(weight[late])
        order = np.lexsort((source, target))
        source, piece, mass = source[order].tolist(), piece[order].tolist(), mass[order].tolist()
        into = np.bincount(target, minlength=last - low + 1)
        ptr = np.concatenate([[0], np.cumsum(into)]).tolist()
        sums = before + [0.0] * (last - first)
        for v in range(first - low + 1, last - low + 1):
            total = 0.0
            for e in range(ptr[v], ptr[v + 1]):
                mass[e] *= sums[source[e]]
                total += mass[e]
            if 0.0 < total < 1e-200:  # what is behind the reach of a piece is never read again
                for u in range(max(0, v - self.reach), v):
                    sums[u] *= 1e150
                total *= 1e150
            sums[v] = total
        return ptr, source, piece, mass, sums

    def forward(self) -> None:
        low, before = 0, [1.0]
        for k, last in enumerate(self.ends):
            self.sums.append((low, before))
            if k + 1 < len(self.ends):
                sums = self.window(k, low, before)[-1]
                after = _boundary(self.data, max(0, last - self.reach))
                low, before = after, sums[after - low :]

    def drawn(self, seed: np.ndarray) -> list[int]:
        """The pieces of one segmentation, from the end, drawn from the hashes of ``seed``."""
        self.forward()
        out: list[int] = []
        at, draws = len(self.data), []
        for k in range(len(self.ends) - 1, -1, -1):
            low, before = self.sums[k]
            ptr, source, piece, mass, _ = self.window(k, low, before)
            while at > self.starts[k]:
                if len(out) == len(draws):
                    turns = np.arange(len(out), len(out) + 4096, dtype=U64)
                    draws += _draws(seed, turns).tolist()
                edges = range(ptr[at - low], ptr[at - low + 1])
                # masses of one place are of one scale; that of its sum may have changed since
                left, taken = draws[len(out)] * sum(mass[e] for e in edges), -1
                for e in edges:
                    if mass[e] > 0.0:
                        taken = e
                        left -= mass[e]
                        if left < 0.0:
                            break
                out.append(piece[taken])
                at = low + source[taken]
        return out


def _draws(seed: np.ndarray, turn) -> np.ndarray:
    """Numbers in [0, 1) for turns of draws."""
    mixed = W.mixed(seed ^ np.asarray(turn, dtype=U64) * U64(0xD1342543DE82EF95))
    return (mixed >> U64(12)).astype(np.float64) * 2.0**-52


def cuts_of(data: np.ndarray, offsets: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """The starts of the cuts of some rows."""
    n = len(data)
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets] = True
    space, single = data == 0x20, alone[data]
    begins[:n] |= single
    begins[1:n] |= space[1:] & ~space[:-1]
    begins[1:n] |= single[:-1]
    return np.flatnonzero(begins[:n])


def sampled(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of some rows, drawn by backward sampling, and the offsets of the rows in them.
    ``keys`` are 64-bit row keys."""
    start = cuts_of(data, offsets, pieces.alone)
    if not len(start):
        return np.empty(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
    end = np.append(start[1:], len(data))
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    ordinal = (np.arange(len(start)) - first[row]).astype(U64)
    seed = W.mixed(W.mixed(keys)[row] + ordinal * U64(0x9E3779B97F4A7C15))
    # long cuts come alone, others some at a time
    long = end - start > LONG_CUT
    turn = np.cumsum(end - start) // SAMPLED_BYTES
    new = (np.diff(turn) > 0) | long[1:] | long[:-1]
    out, count = [], []
    for part in np.split(np.arange(len(start)), np.flatnonzero(new) + 1):
        low, high = start[part[0]], end[part[-1]]
        if long[part[0]]:
            drawn = LongCut(data[low:high], pieces).drawn(seed[part])
            out.append(np.array(drawn[::-1], dtype=np.int32))
            count.append(np.array([len(drawn)]))
        else:
            for found, n in zip((out, count), _together(data[low:high], start[part] - low, end[part] - low, seed[part], pieces), strict=True):
                found.append(n)
    upto = np.concatenate([[0], np.cumsum(np.concatenate(count))])
    return np.concatenate(out), upto[first]


def _together(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of some cuts, and how many each has."""
    kept, which = _looked_up(data, start, end, pieces)
    ptr, chance, source, piece = kept.ptr.all, kept.chance.all, kept.source.all, kept.piece.all
    floor = kept.base.all[which].astype(np.int64)
    node = floor + kept.length.all[which]
    active = np.arange(len(start))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    count = np.zeros(len(start), dtype=np.int64)
    while len(active):
        drawn = _draws(seed[active], len(steps))
        edge = ptr[node[active]]
        behind = np.flatnonzero(chance[edge] <= drawn)
        while len(behind):  # a node has a few edges
            edge[behind] += 1
            behind = behind[chance[edge[behind]] <= drawn[behind]]
        steps.append((active, piece[edge]))
        count[active] += 1
        node[active] = source[edge]
        active = active[node[active] > floor[active]]
    upto = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(upto[-1], dtype=np.int32)
    for turn, (cut, taken) in enumerate(steps):
        out[upto[cut + 1] - 1 - turn] = taken
    return out, count


def decoded_bytes(ids: np.ndarray, offsets: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of rows of piece ids, and the offsets of the rows in them."""
    length = (pieces.ptr[1:] - pieces.ptr[:-1])[ids]
    upto = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(upto[-1]) + np.repeat(pieces.ptr[ids] - upto[:-1], length)
    return pieces.flat[at], upto[offsets]


def _token_lists(text: pa.Array, keys: np.ndarray, pieces: Pieces) -> tuple[pa.Array, pa.Array]:
    """The tokens of some texts (null for null), and whether each decodes to its text."""
    data, at = W.text_bytes(text)
    ids, offsets = sampled(data, at, keys, pieces)
    back, ends = decoded_bytes(ids, offsets, pieces)
    if len(back) == len(data) and (ends == at).all() and (back == data).all():
        lossless = np.ones(len(text), dtype=bool)
    else:
        lossless = np.array([back[ends[i] : ends[i + 1]].tobytes() == data[at[i] : at[i + 1]].tobytes() for i in range(len(text))])
    mask = text.is_null() if text.null_count else None
    tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()), mask=mask)
    return tokens, pa.array(lossless, mask=None if mask is None else mask.to_numpy(zero_copy_only=False))


def _encode(batches: Iterator[pa.RecordBatch], shared, seed: int, check: bool) -> Iterator[pa.RecordBatch]:
    """(row, key, text) to (row, tokens) or, with ``check``, to (row, tokens, lossless)."""
    pieces: Pieces = shared.value
    for batch in batches:
        keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(U64) ^ W.mixed(np.array([seed], U64))
        for first, n in W.slices(batch.column(2), SAMPLED_BYTES):
            tokens, lossless = _token_lists(batch.column(2).slice(first, n), keys[first : first + n], pieces)
            columns = {"row": batch.column(0).slice(first, n), "tokens": tokens, "lossless": lossless}
            names = list(columns) if check else ["row", "tokens"]
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)


def _decode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(row, tokens) to (row, decoded)."""
    pieces: Pieces = shared.value
    for batch in batches:
        step = 512
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            tokens = part.column(1)
            full = tokens.fill_null([]) if tokens.null_count else tokens
            offsets = np.asarray(full.offsets).astype(np.int64)
            ids = np.asarray(full.values)[offsets[0] : offsets[-1]]
            data, at = decoded_bytes(ids, offsets - offsets[0], pieces)
            text = pa.LargeStringArray.from_buffers(
                len(part), pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())
            ).cast(pa.string())
            if tokens.null_count:
                text = pa.array([x if ok else None for x, ok in zip(text.to_pylist(), tokens.is_valid().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), text], names=["row", "decoded"])


def share(spark: SparkSession, pieces: Pieces):
    return spark.sparkContext.broadcast(pieces)


def _encoded(df: DataFrame, pieces: Pieces, text_col: str, key_cols: tuple[str, ...], seed: int, carry: list[str] | None, check: bool) -> DataFrame:
    carry = df.columns if carry is None else carry
    shared = share(df.sparkSession, pieces)
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        F.xxhash64(*[F.col(f"`{c}`") for c in key_cols]).alias("key"),
        F.col(f"`{text_col}`").alias("text"),
    )
    schema = rows.select("row").schema.add("tokens", ArrayType(IntegerType()))
    added = ["tokens"]
    if check:
        schema, added = schema.add("lossless", "boolean"), ["tokens", "lossless"]
    return unpacked(rows.mapInArrow(lambda batches: _encode(batches, shared, seed, check), schema), carry, added)


def encode(
    df: DataFrame,
    pieces: Pieces,
    text_col: str = "text",
    key_cols: tuple[str, ...] = ("doc_id",),
    seed: int = SEED,
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns in ``carry`` (all) of ``df`` with ``tokens`` (array<int>), a segmentation drawn for
    the row's key. Rows of one key and text have equal tokens; a null text has null tokens, an
    empty one none. Null keys are keys as others. An empty table gives an empty result; an input
    column named tokens is replaced."""
    return _encoded(df, pieces, text_col, key_cols, seed, carry, False)


def encode_checked(
    df: DataFrame,
    pieces: Pieces,
    text_col: str = "text",
    key_cols: tuple[str, ...] = ("doc_id",),
    seed: int = SEED,
    carry: list[str] | None = None,
) -> DataFrame:
    """As ``encode``, with ``lossless`` added: whether the tokens decode to the text's bytes (null
    for a null text). Tokens are decoded where they are made, so no second Python worker and no
    second copy of the text is needed."""
    return _encoded(df, pieces, text_col, key_cols, seed, carry, True)


def decode(df: DataFrame, pieces: Pieces, tokens_col: str = "tokens", carry: list[str] | None = None) -> DataFrame:
    """The columns in ``carry`` (all) of ``df`` with ``decoded``, the text of its tokens; null for
    null. Control and unknown ids stand for no text."""
    carry = df.columns if carry is None else carry
    shared = share(df.sparkSession, pieces)
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{tokens_col}`").alias("tokens")
    )
    schema = rows.select("row").schema.add("decoded", "string")
    return unpacked(rows.mapInArrow(lambda batches: _decode(batches, shared), schema), carry, ["decoded"])
