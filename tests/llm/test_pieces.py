"""Sampled segmentations against enumeration, and long cuts against short ones."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import pieces, queries

U64 = np.uint64


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_pieces(queries.MODEL)


def tokens(texts, keys, vocabulary):
    out, lossless = pieces._token_lists(pa.array(texts, pa.string()), np.array(keys, dtype=U64), vocabulary)
    return out.to_pylist(), lossless.to_pylist()


def segmentations(text, vocabulary):
    """All segmentations of a text, with their weights, from the vocabulary's own strings."""
    named = {}
    for i in range(len(vocabulary.ptr) - 1):
        part = vocabulary.flat[vocabulary.ptr[i] : vocabulary.ptr[i + 1]].tobytes()
        if part and i not in set(vocabulary.byte_ids.tolist()):
            named.setdefault(part, i)
    data = text.encode()
    ways = [[] for _ in range(len(data) + 1)]
    ways[0] = [((), 0.0)]
    for end in range(1, len(data) + 1):
        for start in range(end):
            i = named.get(data[start:end])
            if i is not None:
                ways[end] += [((*w, i), x + vocabulary.weight[i]) for w, x in ways[start]]
    return dict(ways[-1])


@pytest.mark.parametrize("text", ["reader", " the"])
def test_draws_follow_the_enumerated_probabilities(vocabulary, text):
    ways = segmentations(text, vocabulary)
    total = sum(math.exp(x) for x in ways.values())
    n = 20_000
    drawn, _ = tokens([text] * n, range(n), vocabulary)
    seen = {}
    for t in drawn:
        seen[tuple(t)] = seen.get(tuple(t), 0) + 1
    assert set(seen) <= set(ways) and len(ways) > 3
    for way, x in ways.items():
        p = math.exp(x) / total
        assert abs(seen.get(way, 0) - n * p) <= 5 * math.sqrt(n * p * (1 - p)) + 1


def test_long_cuts_are_drawn_as_short_ones(vocabulary, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghijklmnoprstuäé日😀\x00") for _ in range(3000)) for _ in range(3)]
    texts += ["donaudampf" * 300, "日本語" * 500, "x" * 2000]
    monkeypatch.setattr(pieces, "LONG_CUT", 10**9)
    short = tokens(texts, range(len(texts)), vocabulary)
    monkeypatch.setattr(pieces, "LONG_CUT", 100)
    monkeypatch.setattr(pieces, "WINDOW", 500)
    assert tokens(texts, range(len(texts)), vocabulary) == short and all(short[1])


def test_kept_lattices_change_no_draw(vocabulary, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdest") for _ in range(rng.randrange(1, 9))) for _ in range(400)) for _ in range(60)]
    once = tokens(texts, range(60), vocabulary)
    monkeypatch.setattr(pieces, "KEPT_BYTES", 1000)
    monkeypatch.setattr(pieces, "NEW_BYTES", 300)
    monkeypatch.setattr(pieces, "SAMPLED_BYTES", 2000)
    pieces._KEPT.clear()
    parts = list(itertools.chain.from_iterable(tokens([t], [i], vocabulary)[0] for i, t in enumerate(texts)))
    assert parts == once[0]
    assert pieces._KEPT[vocabulary.name].bytes() < 200_000


def test_decoding_odd_tokens(spark, vocabulary):
    rows = [(1, None, "a"), (2, [], "b"), (None, [0, 1, 2], "c"), (3, vocabulary.byte_ids[list("é".encode())].tolist(), "d")]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<int>, decoded string")
    assert [(r.doc_id, r.decoded) for r in pieces.decode(df, vocabulary).collect()] == [(1, None), (2, ""), (None, ""), (3, "é")]
    assert pieces.decode(df.limit(0), vocabulary).collect() == []


def test_checked_tokens_of_odd_rows(spark, vocabulary):
    rows = [(1, None), (None, "a b"), (1, ""), (2, "ß😀\x00 日本"), (2, "ß😀\x00 日本")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'own' AS tokens", "'own' AS lossless", "'own' AS row")
    out = pieces.encode_checked(df, vocabulary).collect()
    plain = pieces.encode(df, vocabulary).collect()
    assert [r.tokens for r in out] == [r.tokens for r in plain] and out[0].tokens is None and out[2].tokens == []
    assert [r.lossless for r in out] == [None, True, True, True, True] and out[3].tokens == out[4].tokens and out[0].row == "own"
