"""The operators' registered queries: production parameters, whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskrank.llm import bpe, hnsw, line_chunks, line_quality, merkle, mixing, probminhash, secrets
from duskrank.llm import spelling, spherical_caps, token_files, toxicity, url_rules
from duskrank.llm.common import table
from duskrank.session import scratch_root

BYTE_RANKS = "byte_bpe_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_chunks.dedup_lines(docs, removed="n_removed_lines")


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_pages(table(spark, sf_dir, "pages"))


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/duskrank/{uuid.uuid4().hex}/tokens"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    token_files.write_token_files(docs, path, public_tokenizers.path(WORD_TOKENIZER), end_id=2)
    return token_files.with_crc(token_files.read_token_files(spark, path))


def byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, sf_dir, "documents"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(table(spark, sf_dir, "documents"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical_caps.near_vectors(table(spark, sf_dir, "embeddings"))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.without_newlines(docs))


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_chunks": line_dedup,
    "op2_url_rules": url_filter,
    "op3_hnsw": nearest_neighbours,
    "op4_toxicity": toxicity_scores,
    "op5_token_files": token_binary_output,
    "op6_byte_bpe": byte_level_bpe,
    "op7_probminhash": near_duplicates,
    "op8_line_quality": quality_rules,
    "op9_secret_scan": secret_scan,
    "op10_source_mix": source_mix,
    "op11_spherical_caps": embedding_near_duplicates,
    "op12_merkle_manifest": merkle_manifest,
    "op13_spelling_variants": spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_rules": url_rules.SQL,
    "op8_line_quality": line_quality.SQL,
    "op10_source_mix": mixing.SQL,
    "op11_spherical_caps": spherical_caps.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_spelling_variants": spelling.SQL,
}
