"""Repeated passages against brute force, by both sketches and with decisions in a task and between tasks."""

import random
import re

import pytest

from millrace.llm import passages

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    """(doc, text) rows with one id each to (n_words, n_removed, kept text)."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        w = WORDS.findall(text or "")
        cut = set()
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen:
                cut |= set(range(i, i + width))
            seen.add(key)
        out[doc] = (len(w), len(cut), " ".join(x for k, x in enumerate(w) if k not in cut))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(40) for _ in range(5)]
    out = []
    for i in range(300):
        text = prose(rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            text += "\n" + rng.choice(shared) + " " + prose(rng.randrange(30))
        if i % 7 == 0:
            text += " " + text  # within one document
        out.append((i * 3, text))
    out += [(1000 + i, out[5][1]) for i in range(40)] + [(2000, None), (2001, ""), (2002, " ".join(["same"] * 5000))]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("way", ["broadcast", "dealt", "shuffled", "hot"])
def test_against_brute_force(spark, rows, way, monkeypatch):
    if way in ("dealt", "shuffled"):
        monkeypatch.setattr(passages, "MAX_CELLS", 0)
        monkeypatch.setattr(passages, "RANGE", 500)
    if way == "shuffled":
        monkeypatch.setattr(passages, "BROADCAST_BYTES", 0)
    if way == "hot":
        monkeypatch.setattr(passages, "HOT_SHARE", 0.01)
        monkeypatch.setattr(passages, "TOGETHER_BYTES", 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    found = passages.deduplicated(df).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found} == brute(rows, 20) and len(found) == len(rows)


def test_hot_windows_are_decided_beside_a_broadcast(spark, monkeypatch):
    rows = [(7, -i, i, 0, k) for i in range(3000) for k in (0, 5)] + [(i, i, 1, 0, i) for i in range(100)]
    rows += [(8, 1, 5, 0, 3), (8, 1, 5, 0, 3), (8, 1, 6, 0, 0)]
    df = spark.createDataFrame(rows + [(1 << 60, 3, i, 0, 9) for i in range(2000)], "one long, two long, doc long, tie long, start int")
    found = sorted(tuple(r) for r in passages.later_windows(df).collect())
    firsts = {}
    for one, two, *place in df.collect():
        firsts[one, two] = min(firsts.get((one, two), place), place)
    assert found == sorted((r.doc, r.tie, r.start) for r in df.collect() if [r.doc, r.tie, r.start] != firsts[r.one, r.two])


def test_repeated_ids_and_null_ids(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, one), (1, one), (1, two), (None, two), (2, one + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'own' AS starts", "'own' AS copy", "'own' AS n_words")
    out = sorted(((r.doc_id or 0), r.text, r.n_removed, r.starts) for r in passages.deduplicated(df).collect())
    assert out == sorted([(1, one, 0, "own"), (1, one, 0, "own"), (1, two, 30, "own"), (0, two, 0, "own"), (2, one + " end", 30, "own")])
