"""The operators' queries over the test tables, and their SQL where SQL can say the same.

Each applies its operator, with production parameters, to a whole table. What nulls, empty and very long texts, ties,
repeated rows and empty tables give is the operator's and stated there; the queries choose columns only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_codec, host_rules, lm_scoring, mixing, piece_codec, secret_scan, spelling, sql, suffix_dedup, token_alignment, token_store, vector_join, weighted_minhash, wrapper_extract
from .common import documents


def op1_wrapper_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page ('' for null html), one row a row of pages."""
    return wrapper_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, epochs, block and copies of each document in the mixture."""
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source")).drop("text")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in each text; base_sha256 of no spans is that of the empty string."""
    found = secret_scan.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.joined(F.col("base_spans")), 256).alias("base_sha256"), secret_scan.joined(F.col("all_spans")).alias("spans"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and score of each document; null where there is no token."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    return lm_scoring.cross_entropy_difference(documents(spark, sf_dir), good)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's ids, read back from the files."""
    return token_store.stored_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of each text's piece ids, and of what they decode to."""
    return piece_codec.piece_digests(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), keep_text=False)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes and spans of each text, and the digest of what is kept."""
    found = suffix_dedup.suffix_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each vector; unusable ones have none and are their own."""
    found = vector_join.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of each document."""
    judged = host_rules.quality_rules(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and near-duplicate group of each document."""
    found = weighted_minhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "class_id", "component_id", "n_shingles", "kept")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of each text under two vocabularies, with the links' counts in all documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_byte_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of each text's byte-level ids, and of what they decode to."""
    return byte_codec.byte_digests(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), keep_text=False)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word with its near words' number, its form and its root."""
    return spelling.variants(documents(spark, sf_dir).select("doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict:
    return {f.__name__: f for f in (op1_wrapper_extract, op2_source_mixing, op3_secret_scan, op4_lm_scoring, op5_token_store, op6_piece_codec, op7_suffix_dedup, op8_vector_join, op9_host_rules, op10_weighted_minhash, op11_token_alignment, op12_byte_codec, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
