"""Near-duplicates against brute force: families, repeated ids, blocks, and odd rows."""

import random
import re

import pytest

from millrace.llm import neardup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=3, percent=85):
    """(doc, text) rows to {doc: least doc reachable}; rows of one doc are one vertex."""
    sets = []
    for doc, text in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc, frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()))
    up = {doc: doc for doc, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, (a, x) in enumerate(sets):
        for b, y in sets[n + 1 :]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                i, j = sorted((top(a), top(b)))
                up[j] = i
    return {doc: top(doc) for doc in up}


def family(rng, n, changes, words=200):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_families_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(15)
    texts = family(rng, 40, 12) + family(rng, 40, 25) + [t for _ in range(20) for t in family(rng, 2, 6)] + ["", None, "a", "A", "a b"]
    # a family below the threshold that shares index entries, and exact copies
    texts += family(rng, 30, 60) + texts[:3] * 3
    rng.shuffle(texts)
    rows = [(i * 7 - 50, t) for i, t in enumerate(texts)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == brute(rows) and all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_ids_of_several_texts(spark, monkeypatch):
    rng = random.Random(16)
    rows = []
    for k in range(12):
        for t in family(rng, 6, 20):
            rows.append((rng.randrange(40), t))
    rows += rows[:5]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == brute(rows) and len(out) == len(rows)


def test_null_ids_and_own_columns(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'own' AS tie", "'own' AS id", "'own' AS sum", "'own' AS kept")
    out = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept, r.tie) for r in neardup.near_duplicates(df).collect())
    assert out == [(0, 0, None, True, "own"), (1, 2, 1, True, "own"), (2, 2, 1, False, "own"), (3, 0, 3, True, "own")]
    thin = neardup.near_duplicates(df.select("doc_id", "text"), carry=["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in thin) == [(0, None), (1, 1), (2, 1), (3, 3)]
