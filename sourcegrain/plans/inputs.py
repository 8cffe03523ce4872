"""Prepared inputs that several query families start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcegrain.sources import corpus
from sourcegrain.sources.listing import classify


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified code files with their lines."""
    return classify(corpus.with_lines(corpus.code_files(spark, sf_dir))).drop("content")


def next_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(corpus.with_lines(corpus.next_code_files(spark, sf_dir))).drop("content")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.with_lines(corpus.document_files(spark, sf_dir)).withColumn("tags", F.array().cast("array<string>"))


def next_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.with_lines(corpus.next_document_files(spark, sf_dir))


_FILE = ("repo_id", "path", "kind", "language", "lines", "sha256")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All files, code and texts, of the first and of the second snapshot."""
    return (code(spark, sf_dir).select(*_FILE).unionByName(docs(spark, sf_dir).select(*_FILE)),
            next_code(spark, sf_dir).select(*_FILE).unionByName(next_docs(spark, sf_dir).select(*_FILE)))
