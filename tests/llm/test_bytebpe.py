"""The tree of joins against the library that encodes whole words, and round trips."""

import hashlib
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bytebpe, queries

SF = "/root/testdata/sf0.001"
RANKS = bytebpe.load_ranks(queries.RANKS)
WHOLE = tiktoken.Encoding("own", pat_str=bytebpe.PATTERN, mergeable_ranks=RANKS.rank, special_tokens={})
PARTS = ["a", "b", "the", " ", "  ", "'", "ll", "s", "'re", "\n", "1", "23", ".", "!!", "é", "世界", "\xa0", "\t", "😀", "ing", "v", "e"]


@pytest.fixture
def small(monkeypatch):
    """Leaves so small that every text has many seams."""
    monkeypatch.setattr(bytebpe, "LEAF", 5)
    monkeypatch.setattr(bytebpe, "SHORT", 3)
    return bytebpe.Encoder(RANKS)


def test_the_pattern_is_the_vocabularys():
    public = pytest.importorskip("public_tokenizers")
    assert bytebpe.PATTERN == public.PATTERN


def test_seams_anywhere_change_nothing(small):
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS[: rng.choice([4, 8, 12, 22])]) for _ in range(rng.randrange(60)))
        assert small.text(text).tolist() == WHOLE.encode_ordinary(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_characters(text):
    encoder = bytebpe.Encoder(RANKS)
    assert encoder.text(text).tolist() == WHOLE.encode_ordinary(text)


def test_pairs_prove_an_encoding(small):
    rng = random.Random(6)
    for _ in range(300):
        data = "".join(rng.choice(PARTS) for _ in range(12)).encode()
        ids = small.merged(data)
        assert all(small.fit[pair] for pair in zip(ids, ids[1:]))
        cut = rng.randrange(len(data) + 1)
        assert small.joined(small.merged(data[:cut]), small.merged(data[cut:])) == ids


def test_both_ways_of_merging_agree():
    encoder, rng = bytebpe.Encoder(RANKS), random.Random(7)
    for _ in range(200):
        data = bytes(rng.choice(b"aabbcthe ") for _ in range(rng.randrange(1, 90)))
        assert encoder._merged_long(data) == encoder._merged_short(data)


@pytest.mark.parametrize(
    "text", ["a" * 200_001, " " * 100_000, "\n " * 50_000, "x" + "'ll" * 30_001, "é" * 60_000, "ab1 " * 50_000 + "<|endoftext|>"]
)
def test_very_long_texts(text):
    assert bytebpe.Encoder(RANKS).text(text).tolist() == WHOLE.encode_ordinary(text)


def test_a_vocabulary_with_a_token_that_nothing_makes_is_refused(tmp_path):
    import base64

    lines = [f"{base64.b64encode(bytes([b])).decode()} {b}" for b in range(256)] + [f"{base64.b64encode(b'abc').decode()} 256"]
    (tmp_path / "ranks").write_text("\n".join(lines))
    with pytest.raises(ValueError):
        bytebpe.load_ranks(str(tmp_path / "ranks"))


def test_rows_of_all_kinds(spark):
    texts = [None, "", "the same", "the same", "<|endoftext|>", "long " * 30_000, "世界 é 😀"]
    rows = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, tokens int")
    out = bytebpe.decode(bytebpe.encode(rows, RANKS), RANKS)
    assert out.columns == ["doc_id", "text", "tokens", "decoded"]
    for r in out.collect():
        text = texts[r["doc_id"]]
        assert r["tokens"] == (None if text is None else WHOLE.encode_ordinary(text))
        assert r["decoded"] == (None if text is None else text.encode())
    assert bytebpe.decode(bytebpe.encode(rows.limit(0), RANKS), RANKS).count() == 0


def test_the_query_against_the_library(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op13_byte_bpe(spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        ids = WHOLE.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
