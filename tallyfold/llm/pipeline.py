"""A corpus from documents to tokens, in stages that each work on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the docs of the next. All but the last return the columns of docs. Stages handle nulls, empty and repeated rows
as the operator that each calls says in its own docstring.
"""

from __future__ import annotations

import logging
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import bpe, exact_dedup, language, mixing, near_dedup
from tallyfold.llm.common import shared_folder

RANKS = "byte_bpe_50k.tiktoken"


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the network tells the language; those without a letter go, and those that score below language.least_score."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    return language.keep_known(docs, language.train(docs, ~held_out))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the smallest identifier."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the digest of what they decode to."""
    ranks = public_tokenizers.path(RANKS)
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", known_languages),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mixture),
    ("bpe", tokens),
]

#: The network of the first stage is beyond SQL; tests hold the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages in turn over documents; what lies between them is written to folder, and left there.

    Without a folder, one is made in the shared folder, and its name is logged.
    """
    folder = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    logging.getLogger(__name__).info("the stages' results are in %s", folder)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
