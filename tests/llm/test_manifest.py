"""Blocks, paths and whole manifests against a tree that is built level by level."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        nodes = levels[-1]
        levels.append([manifest.hashed(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)])
    return levels


def way(levels, i):
    steps = []
    for nodes in levels[:-1]:
        beside = i ^ 1
        steps.append("" if beside >= len(nodes) else ("L" if i & 1 else "R") + nodes[beside])
        i >>= 1
    return steps


def leaf(row):
    told = []
    for c in FIELDS:
        data = None if row[c] is None else str(row[c]).encode()
        told.append(b"-" if data is None else str(len(data)).encode() + b":" + data)
    return hashlib.sha256(b"".join(told)).hexdigest()


def brute(rows):
    """(doc_id, leaf, subroot, root, steps) of all rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r["doc_id"]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, (g, t) in enumerate(zip(order, trees)):
        for i, x in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            out.append((x[3], x[2], t[-1][0], top[-1][0], tuple(way(t, i) + way(top, k))))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [*range(1, 35), 63, 64, 65])
def test_traversal_gives_every_path(n):
    leaves = [manifest.hashed(str(i)) for i in range(n)]
    levels = tree(leaves)
    assert manifest.root_of(leaves) == levels[-1][0]
    for height in ((n - 1).bit_length(), 7):
        got = list(manifest.paths(leaves, height))
        assert len(got) == n
        for i, path in enumerate(got):
            steps = ["" if s is None else ("L" if i >> h & 1 else "R") + s for h, s in enumerate(path)]
            assert steps == way(levels, i) + [""] * (height - len(levels) + 1)


def test_stacks_stay_logarithmic():
    most = 0

    class Watched(manifest.Treehash):
        def step(self, leaf):
            nonlocal most
            super().step(leaf)
            most = max(most, len(self.nodes))

    original, manifest.Treehash = manifest.Treehash, Watched
    try:
        assert sum(1 for _ in manifest.paths([manifest.hashed(str(i)) for i in range(512)], 9)) == 512
    finally:
        manifest.Treehash = original
    assert most <= 9


def rows_of(spark, n, langs, same=0):
    rows = [(i * 7 % 1000 if i % 11 else None, f"text {i}", langs[i % len(langs)], None if i % 5 == 0 else "web", i) for i in range(n)]
    rows += [(3, "copy", langs[0], "web", 1)] * same
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize("bits", [1, 2, 10])
@pytest.mark.parametrize("n,langs,same", [(0, ["en"], 0), (1, ["en"], 0), (1, [None], 0), (37, ["en", None, "é", "de", "z"], 9), (70, ["en"], 40)])
def test_whole_manifests(spark, monkeypatch, bits, n, langs, same):
    monkeypatch.setattr(manifest, "BLOCK_BITS", bits)
    monkeypatch.setattr(manifest, "_climb", _bound(manifest._climb, bits))
    monkeypatch.setattr(manifest, "_descend", _bound(manifest._descend, bits))
    df = rows_of(spark, n, langs, same)
    out = manifest.proved(df, FIELDS)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "leaf", "subroot", "root", "proof"]
    found = out.withColumn("folded", manifest.folded(F.col("leaf"), F.col("proof"))).collect()
    assert all(r["folded"] == r["root"] for r in found)
    got = sorted([(r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(r["proof"])) for r in found], key=str)
    assert got == brute([r.asDict() for r in df.collect()])


def _bound(f, bits):
    """The function in the workers, with blocks of the same size as here."""

    def run(*tables):
        from millrace.llm import manifest as there

        there.BLOCK_BITS = bits
        return getattr(there, f.__name__)(*tables)

    if f is manifest._climb:
        return lambda table: run(table)
    return lambda table, above: run(table, above)


def test_a_changed_row_leads_elsewhere(spark):
    df = rows_of(spark, 50, ["en", "fr"])
    out = manifest.proved(df, FIELDS, carry=FIELDS).withColumn(
        "other", manifest.leaf_of([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    )
    assert out.filter(manifest.folded(F.col("other"), F.col("proof")) == F.col("root")).count() == 0


def test_the_checksum_of_the_query(spark):
    ids = [0, 1, 7, 123456789, -5]
    found = spark.createDataFrame([(i,) for i in ids], "i long").select("i", F.crc32(F.encode(F.col("i").cast("string"), "UTF-8")).alias("c"))
    assert {r["i"]: r["c"] for r in found.collect()} == {i: zlib.crc32(str(i).encode()) for i in ids}
