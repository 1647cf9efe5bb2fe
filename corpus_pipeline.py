"""A corpus pipeline of five operators: raw documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stages before it kept.

Defined cases: documents whose text is null or has no letter go with the language stage; of equal texts the longest,
then the one of the smallest doc_id stays, of near copies the one of the smallest doc_id, of repeated rows one; texts
of any length are worked on whole; columns besides those of documents, whatever their names, are carried as far as
packing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common, exact_dedup, langid, ngram_join, packing, secrets


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters; those in several languages stay."""
    common.ship(spark)
    return langid.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the longest, then first, of texts that are equal but for white space."""
    common.ship(spark)
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group linked by a Jaccard similarity of 0.8 of five-word shingles."""
    common.ship(spark)
    return ngram_join.drop_near_copies(docs, words=5, num=80, den=100)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live-looking credentials; copied examples stay, and so do all documents."""
    common.ship(spark)
    cleaned = secrets.redact_secrets(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024. Other stages need the workers' memory, so their words go after each task."""
    import public_tokenizers

    common.ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_words=False)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with common.scratch() as keep:
            following = keep(common.stored(stage(spark, docs, sf_dir), "stage"))
        common.discard(docs)
        docs = following
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages learn models and tokenize, which SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL = None
