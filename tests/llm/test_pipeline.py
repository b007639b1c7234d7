"""The pipeline's stages against brute force."""

import re

import pytest

import corpus_pipeline
from millrace.llm import queries

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append((name, docs))
    return dict(out)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    names = list(stages)
    for name in names[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_quality(spark, stages):
    kept = {r.doc_id for r in queries.QUERIES["op7_quality_votes"](spark, SF).filter("kept").collect()}
    assert set(texts(stages["quality_rules"])) == kept


def test_near_duplicates(stages):
    before, after = texts(stages["quality_rules"]), texts(stages["near_duplicates"])
    sets = {}
    for i, t in before.items():
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and both * 100 >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert set(after) == {i for i in ids if top(i) == i}


def test_decontamination(spark, stages):
    before, after = texts(stages["near_duplicates"]), texts(stages["benchmark_decontamination"])
    alnum = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: alnum.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    dirty = {i for i, t in before.items() for w in [words(t)] for n in sizes if any(tuple(w[k : k + n]) in windows for k in range(len(w) - n + 1))}
    assert set(after) == set(before) - dirty


def test_personal_data(stages):
    before, after = texts(stages["benchmark_decontamination"]), stages["personal_data"].collect()
    assert {r.doc_id for r in after} == set(before)
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for r in after:
        assert not mail.search(r.text) and r.n_chars == len(r.text)
        if "@" not in before[r.doc_id] and not re.search("[0-9]", before[r.doc_id]):
            assert r.text == before[r.doc_id]


def test_pieces(stages):
    rows = stages["sentence_pieces"].collect()
    assert {r.doc_id for r in rows} == set(texts(stages["personal_data"]))
    assert all(r.lossless and r.n_tokens == len(r.tokens) for r in rows)
