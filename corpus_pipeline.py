"""A training corpus from raw documents: STAGES in order, each over all that is kept.

Stages but the last return the columns of ``documents``; a missing id, text, language
or source is handled as the stage's operator says, and empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from areacast.llm.jaccard import jaccard_components
from areacast.llm.langid import fit_languages, predict_languages
from areacast.llm.mixing import mix_sources, repeated
from areacast.llm.packing import pack_documents
from areacast.llm.substring import remove_repeats
from areacast.llm.text import unused
from areacast.sources.shared import settle

#: Below this raw score of the best language (ideally 1) a text is taken to be in none.
LEAST_LANGUAGE_SCORE = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those that resemble no learned language.

    Without any labelled row there is nothing to judge by, so all rows pass.
    """
    model = fit_languages(docs)
    if model is None:
        return docs
    rated = predict_languages(docs, model, raw=True)
    kept = (F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)
    return rated.where(kept).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked documents.

    Rows repeated with id and text count as one; rows without id are all kept.
    """
    groups = jaccard_components(docs, hashed=True)
    key, copy = unused("text_key", docs), unused("copy", docs)
    dropped = (
        groups.where("doc_id <> component_id").select("doc_id", F.col("text_hash").alias(key)).distinct()
    )
    order = W.partitionBy("doc_id", key).orderBy("source", "lang")
    keyed = docs.withColumn(key, F.xxhash64("text")).join(dropped, ["doc_id", key], "left_anti")
    # Rows without id are no copies of one another, and need not meet in a task.
    named = keyed.where("doc_id is not null").withColumn(copy, F.row_number().over(order))
    return (
        named.where(F.col(copy) == 1)
        .select(docs.columns)
        .unionByName(keyed.where("doc_id is null").select(docs.columns))
    )


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces texts by what is left of them without passages of earlier documents."""
    key, kept = unused("text_key", docs), unused("kept_text", docs)
    changed = (
        remove_repeats(docs)
        .where("n_removed > 0")
        .select("doc_id", F.col("text_hash").alias(key), F.col("kept_text").alias(kept))
        .dropDuplicates(["doc_id", key])
    )
    text = F.coalesce(kept, "text")
    length = F.when(F.col(kept).isNotNull(), F.char_length(kept).cast("long"))
    joined = docs.withColumn(key, F.xxhash64("text")).join(changed, ["doc_id", key], "left")
    return joined.withColumns(
        {"text": text, "n_chars": F.coalesce(length, F.col("n_chars"))}
    ).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their targets."""
    return repeated(mix_sources(docs)).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
