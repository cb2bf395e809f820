"""The corpus pipeline: STAGES in order, each of them one operator of ``duskrank.llm``.

A stage takes (spark, docs, sf_dir) and returns documents; ``run`` writes each stage's result as Parquet
and reads it as the next stage's documents. All stages but the last return the columns of ``documents``.
Null texts and rows without words fail the quality rules and go in the first stage; an empty table runs
through all stages. Other columns of the documents are kept up to the last stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskrank.llm import bpe, line_chunks, line_quality, mixing, probminhash
from duskrank.llm.common import table
from duskrank.session import cut, scratch_root

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

RANKS = "byte_bpe_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines go from the others."""
    return line_quality.apply(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines stay at their first occurrence only."""
    return line_chunks.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return probminhash.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.repeated(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and whether decoding gives the text's bytes back."""
    path = public_tokenizers.path(RANKS)
    # the text's hash goes along in place of the text, so a task holds no text beside its ids
    hashed = F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("text_hash")
    coded = bpe.encode(docs.select("doc_id", "source", "text", hashed), path, public_tokenizers.PATTERN)
    # written between the two, so that a task has one Python worker at a time and not two beside each other
    coded = cut(coded, "coded")
    whole = F.xxhash64("decoded") == F.col("text_hash")
    return bpe.decode(coded, path).select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("round_trip")
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{scratch_root(spark)}/duskrank/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs


# The last stage's ids come from a tokenizer's ranks and the near-duplicates from signatures: not SQL.
ORACLE_SQL = None
