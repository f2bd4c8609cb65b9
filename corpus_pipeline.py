"""From raw documents to packed training sequences: one stage after the other, each over what the last one kept.

Every stage takes null, empty and very long texts, repeated rows, rows without an id, empty tables and further
columns of any name; what becomes of them stands with its operator. A repeated id is told apart by its text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, language_id, packing, secret_scan, simhash
from tidemark.llm.common import cut, drop, scratch

#: SQL can't express the recurrent network, the fingerprints or the packing.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no identifiable language go: null, without a letter, or all but even between the network's languages."""
    net = language_id.train(language_id.sample(docs, "doc_id", "text", "lang", 5, 0))
    return language_id.identified(docs, net)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (letters A-Z lower-cased) the largest id stays."""
    return exact_dedup.without_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies by five-word shingles at Jaccard similarity 0.8 or more, each link verified; the smallest id stays."""
    return simhash.without_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; a null text is empty."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage keeps is written once, and the next one reads it as often as it likes.

    Once a stage's table is written, its interim tables and the table before it are deleted.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    read = None
    for _, stage in before:
        with scratch(spark) as done:
            docs = done.keep(cut(stage(spark, docs, sf_dir)))
        if read:
            drop(spark, read)
        read = docs._written_at
    return last(spark, docs, sf_dir)
