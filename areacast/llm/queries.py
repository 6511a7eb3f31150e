"""The operators' registered queries, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areacast.llm.alignment import align_tokenizers
from areacast.llm.jaccard import jaccard_components
from areacast.llm.langid import fit_languages, predict_languages
from areacast.llm.lm import score_texts
from areacast.llm.mixing import mix_sources
from areacast.llm.packing import pack_documents
from areacast.llm.phrases import collocations
from areacast.llm.quality import quality_rules
from areacast.llm.secretscan import scan_secrets, span_text
from areacast.llm.sharding import shard_documents
from areacast.llm.substring import remove_repeats
from areacast.llm.tokencount import token_counts
from areacast.llm.topk import scaled, top_k


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def held_out(id: str, parts: int) -> Column:
    """Whether the id's checksum leaves 2; a missing id counts as an empty one."""
    name = F.coalesce(F.col(id).cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % parts == 2


def ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(_documents(spark, folder))


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    model = fit_languages(docs.where(~held_out("doc_id", 4)))
    return predict_languages(docs, model).select(
        "doc_id",
        held_out("doc_id", 4).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )


def prefix_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(_documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


def threshold_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(_documents(spark, folder)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(_documents(spark, folder)).drop("kept_text", "text_hash")


def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(_documents(spark, folder)).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_repeats")).alias("taken"),
    )


def context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    return score_texts(docs, ~held_out("doc_id", 7)).select(
        "doc_id",
        (~F.col("learned")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        "bits_per_byte",
    )


def block_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select(
        "vec_id", scaled(F.col("embedding")).alias("embedding")
    )
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


def balanced_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(_documents(spark, folder)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(_documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


def zstd_novelty(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(_documents(spark, folder)).select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(span_text("base"), 256).alias("base_sha256"),
        span_text("spans").alias("spans"),
    )


def tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    documents, _ = align_tokenizers(
        _documents(spark, folder),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )
    return documents


def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(_documents(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": ngram_jaccard,
    "op2_language_id": language_id,
    "op3_prefix_token_counts": prefix_token_counts,
    "op4_threshold_rules": threshold_rules,
    "op5_substring_dedup": substring_dedup,
    "op6_source_mix": source_mix,
    "op7_context_mixing": context_mixing,
    "op8_block_top_k": block_top_k,
    "op9_balanced_shards": balanced_shards,
    "op10_best_fit_packing": best_fit_packing,
    "op11_zstd_novelty": zstd_novelty,
    "op12_tokenizer_alignment": tokenizer_alignment,
    "op13_phrase_collocations": phrase_collocations,
}
