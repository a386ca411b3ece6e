"""Corpus pipeline: quality, near-duplicates, benchmark passages, personal data, token ids.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame;
``run`` writes each result as Parquet to the shared folder and reads it back as the next
one's documents. All stages but the last return the columns of documents. The jobs run
when ``run`` is called.

Nulls: a null text counts as an empty one and stays null until the last stage, where it has
no ids; rows with a null or shared doc_id are judged by their own texts and stay unless a
stage drops them. Repeated rows and groups of copies leave one row. Extra columns are kept by
all stages but the last; empty tables give an empty table. Texts may be of any length.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import bpe, common, decontaminate, pii, quality, simhash


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality model, fitted to the labels of these documents, rejects."""
    common.prepare(spark)
    return quality.keep_good(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-copies: the one with the least doc_id, nulls last."""
    common.prepare(spark)
    return simhash.keep_survivors(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark passages cover a twentieth or more."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the names of their kinds."""
    return pii.mask(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digest of the bytes they decode to."""
    out = bpe.decode(bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return out.select("doc_id", "n_tokens", "ids", F.sha2("text_bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_good_quality),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("token_ids", encode_tokens),
]

#: No SQL expresses the models and the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
