"""The training-data pipeline: documents through five operators, each stage written and reread.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of its ``docs`` (those of
documents, and any others, whatever their names), the last one the token ids. A stage works on all
rows that the one before it kept. No stage fails on nulls, empty or very long texts, repeated rows or
empty tables; what becomes of them is said for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, neardup, pieces, pii, quality
from millrace.llm.queries import model_path
from millrace.llm.shared import scratch, shared_path, table

#: Five-word shingles, linked from a similarity of 0.8 on. Sets of that similarity exceed the
#: distances with a probability of about 1e-6 and 2e-7.
NEAR = neardup.Options(shingle=5, percent=80, distance=29, chunks=15, long_distance=85)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the votes find bad go. A null or empty text has no
    words, so it fails the base rules; null ids do not matter; repeated rows are judged alike."""
    return quality.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays. A null or empty text is
    linked with nothing, a row with a null id stays, and rows of one id are one document: all of them
    stay or go."""
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = neardup.near_duplicates(rows, options=NEAR, carry=["row", "doc_id"]).filter("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, with all rows of their id (rows without an
    id are judged as one document). A null or empty text holds none; without items all stay."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontamination.decontaminated(docs, items).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities and the terms that disclose them are replaced; n_chars follows the new text. All rows
    stay; a null text stays null, and n_chars is null with it."""
    return pii.sanitised(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled token ids of each document, and whether they decode to its text: (doc_id, n_tokens,
    tokens, lossless) for each row. A null text has null tokens; equal rows have equal ones."""
    tokens = pieces.encode_checked(docs, pieces.load_pieces(model_path(spark)), carry=["doc_id"])
    return tokens.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens", "lossless")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("sentence_pieces", sentence_pieces),
]

#: Votes, signatures and sampled pieces have no SQL form; the tests hold every stage against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written in the shared folder and reread. What
    a stage wrote on its way is deleted once its result is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
