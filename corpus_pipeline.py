"""The corpus pipeline: quality, near-dedup, substring dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one reads back from Parquet. All but the
last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcegrain.llm import bpe, decontaminate, quality, simhash, substrings
from sourcegrain.session import small_batches, stored


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at the cut or above."""
    with small_batches(spark):
        rows = stored(quality.featured(docs))
    model = quality.train_featured(rows, _read(spark, sf_dir, "labels"))
    return quality.score_featured(rows, model).where(F.col("score") >= quality.CUT).select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near copies."""
    return simhash.keep_first(docs).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that also stand elsewhere; other texts unchanged."""
    kept = substrings.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("doc.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("doc.n_chars"))}
    return kept.select(*[new.get(c, F.col(f"doc.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.clean(docs, _read(spark, sf_dir, "benchmark")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of the documents that are left."""
    rows = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), output="digests")
    return rows.withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("substrings", substring_dedup),
          ("decontaminate", decontaminated), ("tokens", tokens)]

ORACLE_SQL = None  # classifier, SimHash components and BPE have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
