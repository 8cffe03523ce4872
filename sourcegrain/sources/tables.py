"""Table maintenance: replace, upsert, list and diff, as joins over snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# File extensions and folders of generated output.
ARTIFACT_SUFFIXES = [".pyc", ".pyo", ".log", ".orig", ".rej"]
ARTIFACT_FOLDERS = ["__pycache__/", ".pytest_cache/", "node_modules/", "dist/", "build/", ".tox/", ".mypy_cache/",
                    ".ruff_cache/", "coverage/", ".coverage", "target/debug/", "target/release/"]


def replace_partitions(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of every key present in ``incoming`` are replaced by the incoming rows."""
    touched = incoming.select(*keys).distinct()
    return current.join(touched, list(keys), "left_anti").unionByName(incoming)


def drop_types(rows: DataFrame, types: Sequence[str], column: str = "memory_type") -> DataFrame:
    return rows.where(~F.col(column).isin(list(types)))


def upsert(current: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    return current.join(updates.select(*keys), list(keys), "left_anti").unionByName(updates)


def list_rows(df: DataFrame, where: Mapping[str, Sequence], order: Sequence[str], limit: int | None = None) -> DataFrame:
    for column, values in where.items():
        df = df.where(F.col(column).isin(list(values)))
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files of the new snapshot that are new or have another hash: all an incremental run must read."""
    return new.join(old, ["repo_id", "path", "sha256"], "left_anti")


def is_artifact(path):
    text = F.replace(path, F.lit("\\"), F.lit("/"))
    ends = text.rlike("(" + "|".join(s.replace(".", r"\.") for s in ARTIFACT_SUFFIXES) + ")$")
    inside = text.rlike("|".join(s.replace(".", r"\.") for s in ARTIFACT_FOLDERS))
    return ends | inside


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every path that was added, edited or deleted between two snapshots, generated output left out."""
    joined = (old.select("repo_id", "path", F.col("sha256").alias("old_sha"))
              .join(new.select("repo_id", "path", F.col("sha256").alias("new_sha")), ["repo_id", "path"], "full_outer"))
    change = (F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "deleted")
              .when(F.col("old_sha") != F.col("new_sha"), "edited"))
    return (joined.withColumn("change", change).where("change IS NOT NULL").where(~is_artifact(F.col("path")))
            .select("repo_id", "path", "change"))


