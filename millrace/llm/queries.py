"""One query for each operator, over its whole table, and the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import alignment, bytebpe, decontamination, html, manifest, neardup, oracles, passages, pieces, pii, quality, sharding, urls, warc
from millrace.llm.shared import table


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32")
    )
    return sharding.sharded(docs, shards=16, carry=["doc_id", "text_crc32"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extracted(pages, carry=["page_id", "url"]).select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars")
    )


def op7_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs, carry=["doc_id"]).select("doc_id", *quality.FEATURES, "base_failed", "quality", "kept")


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages).select("page_id", "host", "path", "rule", "verdict")


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.deduplicated(docs, carry=["doc_id"]).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, carry=["doc_id"])


def op3_benchmark_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.matches(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return pii.with_spans(docs, carry=["doc_id"]).select(
        "doc_id",
        *[of(i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


#: The SentencePiece model of the queries where the session's setting ``spark.millrace.pieces.model``
#: names no other.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def model_path(spark: SparkSession) -> str:
    return spark.conf.get("spark.millrace.pieces.model", MODEL)


def op10_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = pieces.encode_checked(docs, pieces.load_pieces(model_path(spark)), carry=["doc_id"])
    return tokens.select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.xxhash64("tokens").alias("tokens_hash"), "lossless"
    )


#: The fields of a leaf, in their order.
LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Where this divides the checksum of an id, the verification is given a row that was tampered with.
TAMPER = 7


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*LEAF_FIELDS)
    tampered = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in LEAF_FIELDS]
    chosen = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % TAMPER == 0
    docs = docs.withColumn("tampered", F.when(chosen, manifest.leaf_of(tampered)))
    found = manifest.proved(docs, LEAF_FIELDS, carry=["doc_id", "tampered"])
    found = found.withColumn("folded_root", manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(manifest.siblings(F.col("proof")), ""), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: The two tokenizers whose tokens are aligned where ``spark.millrace.alignment.a`` and ``.b`` name no others.
ALIGNED = ("/opt/tokenizers/byte_bpe_50k.json", MODEL)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    paths = tuple(spark.conf.get(f"spark.millrace.alignment.{k}", p) for k, p in zip("ab", ALIGNED, strict=True))
    return alignment.scored(docs, paths, carry=["doc_id"])


#: The ranks of the byte-level vocabulary where ``spark.millrace.bytebpe.ranks`` names no others.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranks = bytebpe.load_ranks(spark.conf.get("spark.millrace.bytebpe.ranks", RANKS))
    tokens = bytebpe.encode(docs, ranks, carry=["doc_id"])
    return bytebpe.decode(tokens, ranks).select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_histogram_shards": op1_histogram_shards,
    "op2_main_text": op2_main_text,
    "op3_benchmark_phrases": op3_benchmark_phrases,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_disclosing_terms": op5_disclosing_terms,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_quality_votes": op7_quality_votes,
    "op8_url_templates": op8_url_templates,
    "op9_warc_round_trip": op9_warc_round_trip,
    "op10_sampled_pieces": op10_sampled_pieces,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_alignment": op12_token_alignment,
    "op13_byte_bpe": op13_byte_bpe,
}

#: Shards, votes, learnt templates, disclosing terms, wrappers and tokens have no SQL form.
ORACLES: dict[str, str] = {
    "op3_benchmark_phrases": oracles.OP3,
    "op4_near_duplicates": oracles.OP4,
    "op6_repeated_passages": oracles.OP6,
    "op9_warc_round_trip": oracles.OP9,
    "op11_merkle_manifest": oracles.OP11,
}
