"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes every stage as Parquet to the shared folder and reads it
again.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sweeploom.llm import common, langid, minhash, mixing, pieces, suffixes

# Texts whose language is less certain are rejected, as are texts without letters.
LEAST_CERTAIN = 0.3

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language."""
    named = langid.predict(docs, langid.train(docs), docs.columns)
    kept = named.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates, of its smallest id."""
    return minhash.survivors(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove byte strings that occur elsewhere; documents with nothing left go."""
    cut = suffixes.remove_repeats(docs, keep=[c for c in docs.columns if c != "text"])
    left = cut.withColumnRenamed("kept_text", "text").filter(F.length("text") > 0)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(mixing.mix(docs), docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of the decoded text."""
    coded = pieces.encode(docs, keep=["doc_id", "source"])
    return coded.select("doc_id", "source", "ids", "n_pieces", "n_byte_pieces", "ids_sha256", "decoded_sha256", "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

# Networks, dictionaries and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
