"""The pipeline's stages on odd rows, empty tables and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import shared

NAMES = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
PROSE = " ".join(f"{w} the {w}s of {w}ed and to {w}er is that{i}." for i, w in enumerate(NAMES))
ROWS = [
    (1, PROSE),
    (2, PROSE + " end"),
    (None, PROSE + " mail ann@example.org"),
    (3, None),
    (4, ""),
    (5, PROSE.replace("alpha", "leaked one two three four five six seven eight nine ten")),
    (6, PROSE.replace("beta", "call +1 (234) 555-0100 or 10.1.2.3") + " word" * 3),
    (6, PROSE.replace("beta", "call +1 (234) 555-0100 or 10.1.2.3") + " word" * 3),
    (7, "long " * 40_000),
]
OWN = ("row", "kept", "doc", "id", "n_shingles", "component_id", "tokens", "lossless", "base", "spans", "of", "pattern", "items")


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (None, None)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'en' AS lang", "null AS source", "cast(length(text) as long) AS n_chars")
    return df.withColumn("source", F.lit(None).cast("string")).withColumns({c: F.lit(f"own {c}") for c in OWN}), str(folder)


EXPECTED = {
    "quality_rules": [1, 2, None, 5, 6, 6],
    "near_duplicates": [1, None, 3, 4, 5, 6, 6, 7],
    "benchmark_decontamination": [1, 2, None, 3, 4, 6, 6, 7],
    "personal_data": [1, 2, None, 3, 4, 5, 6, 6, 7],
    "sentence_pieces": [1, 2, None, 3, 4, 5, 6, 6, 7],
}


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_odd_rows(spark, table, name, stage):
    df, folder = table
    out = stage(spark, df, folder).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(map(str, EXPECTED[name]))
    if name == "sentence_pieces":
        assert all(r.tokens is None and r.lossless is None if r.doc_id == 3 else r.lossless and r.n_tokens == len(r.tokens) for r in out)
        return
    before = {(r.doc_id, r.text): r for r in df.collect()}
    for r in out:
        assert all(r[c] == f"own {c}" for c in OWN)
        if name != "personal_data":
            assert before[r.doc_id, r.text] == r
    if name == "personal_data":
        texts = {r.doc_id: r.text for r in out}
        assert texts[3] is None and texts[4] == "" and texts[1] == PROSE and texts[None].endswith("mail [EMAIL]")
        assert "call [PHONE] or [IP]" in texts[6] and all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_empty_tables(spark, table, name, stage):
    df, folder = table
    out = stage(spark, df.limit(0), folder)
    assert out.collect() == [] and (name == "sentence_pieces" or out.columns == df.columns)


def test_a_scope_deletes_what_was_written_in_it(spark, tmp_path):
    with shared.scratch(spark):
        df = shared.written(spark.range(3), "some")
        path = df.inputFiles()[0].removeprefix("file://")
        df.write.parquet(str(tmp_path / "kept"))
    with pytest.raises(FileNotFoundError):
        open(path)
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 3
