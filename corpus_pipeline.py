"""A corpus pipeline of five of the training-data operators: rules, near-duplicates, secrets, mixture, pieces.

STAGES lists (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.

Every stage takes documents with nulls in any column, empty and very long texts, repeated rows and further columns of any
name (which it drops), and gives an empty table for an empty one. Null texts count as empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import host_rules, mixing, piece_codec, secret_scan, weighted_minhash
from colloquy.llm.common import materialize

#: SQL has no tokenizers, Markov models or consistent sampling: the stages are tested against brute force instead.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


WORDS = 300_000  # words that a worker of the last stage remembers: the executor's heap has grown in the stages before
BATCH = 500  # rows of an Arrow batch: Spark bounds batches by rows only, and 10,000 whole texts may be large


def _documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents' own columns; the session's Arrow batches are made smaller, unless it has set a size itself."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return docs.select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or any rule in a bad host, go: null, empty and short texts with them. Null sources are
    one host. Repeated rows stay or go together."""
    return host_rules.quality_rules(_documents(spark, docs)).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least id, null ids last. Rows that repeat both id and text
    stay or go together; null and blank texts are like no other and stay."""
    return weighted_minhash.near_duplicates(_documents(spark, docs)).filter("kept").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; n_chars is the length of what is left in their place. Texts without secrets, null ones among
    them, keep text and n_chars as they are."""
    clean = secret_scan.redact(secret_scan.scan(_documents(spark, docs)))
    return clean.withColumn("n_chars", F.when(F.size("all_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources come more often, twice at most; no document goes. Null sources are one source; null texts have no tokens, and
    copies are repeated rows."""
    return mixing.realise(mixing.mix(_documents(spark, docs), repeats=2.0)).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the texts, with digests of them and of the decoded texts. Null and empty texts have the end id only."""
    done = piece_codec.piece_digests(_documents(spark, docs), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True, keep_text=False, words=WORDS)
    return done.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256", "piece_ids")


STAGES = [("quality rules", quality_rules), ("minhash near-dedup", near_dedup), ("secret scans", secrets), ("mixing sources", mixture), ("sentencepiece", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
