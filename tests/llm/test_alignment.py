"""Groups, links, counts and scores against a version that goes through one text after the other."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import alignment, queries

SF = "/root/testdata/sf0.001"
A = Tokenizer.from_file(queries.ALIGNED[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=queries.ALIGNED[1])
LETTERS = alignment.byte_letters()
ENTRY = {i: bytes(LETTERS[c] for c in t) for t, i in A.get_vocab().items() if all(c in LETTERS for c in t)}


def piece(i):
    p = B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


def groups(text):
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    x, y = [ENTRY[i] for i in a], [piece(i) for i in b]
    if b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
        return []
    ends_a, ends_b = np.cumsum([*map(len, x)]).tolist(), np.cumsum([*map(len, y)]).tolist()
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
        out.append((a[i:k], b[j:m]))
        i, j = k, m
    return out


def brute(texts):
    found = [groups(t) for t in texts]
    links = [Counter((a, b) for g in gs for a in g[0] for b in g[1]) for gs in found]
    count = Counter(p for x in links for p in x)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for gs, x in zip(found, links):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out.append(
            (
                sum(len(a) for a, _ in gs),
                sum(len(b) for _, b in gs),
                len(gs),
                sum(x.values()),
                sum(n for p, n in x.items() if count[p] == best[p[0]]),
                sum(n * count[p] for p, n in x.items()),
                hashlib.sha256(said.encode()).hexdigest() if gs else "",
            )
        )
    return out


TEXTS = [
    None, "", " ", "a", "the same text", "the same text", "a  b   c \n d\n\n  e\t f ", "<|endoftext|> <s> </s> <unk> <0x41>", "▁odd ▁", "世界 é 😀 ﬁ ①",
    "it's they'll\n 'tis   x", "\x1c a\x85 b　 c", "x" * 3000, " " * 500 + "y", "don't " * 2000, "日本語" * 400, "\n \n \n", "0123456789 1 22 333",
]


@pytest.mark.parametrize("listed,gathered,held,kept", [(1 << 20, 4_000_000, 8_000_000, 6_000_000), (7, 5, 50, 10)])
def test_the_worker_against_brute_force(listed, gathered, held, kept, monkeypatch):
    """With bounds so small that groups, keys and chunks go in blocks, too."""
    import pyarrow as pa

    for name, value in (("LISTED_PAIRS", listed), ("GATHERED", gathered), ("HELD", held), ("KEPT_TOKENS", kept), ("SLICE_BYTES", 40)):
        monkeypatch.setattr(alignment, name, value)
    alignment._remembered.cache_clear()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], names=["row", "text"])
    linked = [b.select(["keys"]) for b in alignment._linked(iter([batch, batch.slice(0, 0)]), queries.ALIGNED)]
    alignment._remembered.cache_clear()
    want = Counter(p for t in TEXTS for p in {(a, b) for g in groups(t) for a in g[0] for b in g[1]})
    got = Counter()
    for out in alignment._counted(iter(linked), "<u4"):
        for key, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            got[divmod(key, 32000)] += n
    assert got == want


def test_chunks_are_encoded_as_in_the_text():
    tools = alignment.Tokenizers(*queries.ALIGNED)
    assert tools.cut
    for text in filter(None, TEXTS):
        chunks = tools.chunks(text)
        assert "".join(chunks) == " " + text
        ids = [*zip(*tools.encoded(chunks))]
        if all(a for a, _ in ids):
            assert sum((a for a, _ in ids), []) == A.encode(" " + text, add_special_tokens=False).ids
            assert sum((b for _, b in ids), []) == B.encode(text)


def test_scores_and_groups_of_all_kinds_of_texts(spark):
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a string").repartition(3)
    found = {r["doc_id"]: r for r in alignment.scored(rows, queries.ALIGNED).collect()}
    want = brute(TEXTS)
    for i in range(len(TEXTS)):
        assert tuple(found[i][c] for c in (*alignment.NUMBERS, "groups_sha256")) == want[i], TEXTS[i]
    for r in alignment.aligned(rows, queries.ALIGNED).collect():
        assert [(g["a"], g["b"]) for g in r["groups"]] == groups(r["text"])
    assert alignment.scored(rows.limit(0), queries.ALIGNED).count() == 0


def test_shards_hold_the_counts(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(4)
    shards = alignment.pair_counts(alignment.links(rows, queries.ALIGNED), queries.ALIGNED)
    want = Counter(p for t in TEXTS for p in {(a, b) for g in groups(t) for a in g[0] for b in g[1]})
    keys = np.sort(np.array([a * 32000 + b for a, b in want] + [0]))
    counts = alignment.looked_up(keys, shards.mapped())
    assert {divmod(k, 32000): n for k, n in zip(keys.tolist(), counts.tolist()) if n} == dict(want)
    assert len(shards.parts) > 1 and all(x[1] < y[0] for x, y in zip(shards.parts, shards.parts[1:]))


def test_the_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r["doc_id"]: r for r in queries.op12_token_alignment(spark, SF).collect()}
    for r, want in zip(docs, brute([r["text"] for r in docs])):
        assert tuple(found[r["doc_id"]][c] for c in (*alignment.NUMBERS, "groups_sha256")) == want
