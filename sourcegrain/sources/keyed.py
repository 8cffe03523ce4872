"""A stored table of files and of what is derived from them that is brought up to date by its changes.

Each file has a head row (repo_id, path, sha256, no entry); each derived row of the file stands beside it as ``entry``. Rows lie in
buckets by a hash of repository and path, so no repository fills a bucket. A change writes a new version that holds the buckets of
changed files only; readers take the newest version of each bucket. A deleted file leaves its head with a null hash.

A version counts once its job has committed, so a reader never sees half a change. A change that is applied again finds all hashes equal
and writes nothing, which makes repeated batches of a stream safe. One writer at a time. Versions that no bucket needs any more can
be removed by age.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from sourcegrain.session import stored

Derive = Callable[[DataFrame], DataFrame]


class FileTable:
    """The table at ``path``. ``derive`` maps files (repo_id, path, language, kind, content) to rows (repo_id, path, and the fields of
    ``entry``); it must look at each file by itself. ``buckets`` must stay what it was at first: choose it so that a bucket
    is some hundred MB; rewriting one changed file costs its bucket."""

    def __init__(self, spark: SparkSession, path: str, derive: Derive, entry: StructType, buckets: int = 64):
        self.spark, self.path, self.derive, self.entry, self.buckets = spark, path.rstrip("/"), derive, entry, buckets

    def versions(self) -> list[int]:
        """Numbers of the committed versions."""
        marks = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/_SUCCESS")
        found = marks.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(marks)
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])

    def rows(self) -> DataFrame:
        """Heads and entries of the newest version of each bucket."""
        schema = (StructType().add("repo_id", StringType()).add("path", StringType()).add("sha256", StringType())
                  .add("entry", self.entry).add("bucket", IntegerType()).add("version", IntegerType()))
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], schema)
        rows = (self.spark.read.schema(schema).option("basePath", self.path)
                .parquet(*[f"{self.path}/version={v}" for v in versions]))
        if len(versions) == 1:
            return rows
        newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
        return rows.join(F.broadcast(newest), ["bucket", "version"])  # at most one row a bucket

    def heads(self) -> DataFrame:
        """repo_id, path, sha256 of every file ever seen; a null hash marks a deleted one."""
        return self.rows().where("entry IS NULL").select("repo_id", "path", "sha256")

    def entries(self) -> DataFrame:
        """repo_id, path and the derived fields of all present files."""
        return self.rows().where("entry IS NOT NULL").select("repo_id", "path", "entry.*")

    def apply(self, files: DataFrame, whole: bool) -> None:
        """Bring the table up to date with ``files`` (repo_id, path, language, kind, content).

        With ``whole`` the files are a full snapshot and those it lacks are deleted; else they are arrivals and the others stay. A null
        content deletes its file. Of several rows of one path the one of the greatest hash, language and kind counts. Nulls in
        repo_id or path are values like others. Only changed files are derived from; unchanged buckets are not read beyond
        their heads.
        """
        files = files.select("repo_id", "path", "language", "kind", F.col("content").cast("string").alias("content"))
        sha = F.sha2("content", 256)
        seen = files.groupBy("repo_id", "path").agg(F.max(sha).alias("sha256"))
        old = self.heads().toDF("old_repo", "old_path", "old_sha")
        same = F.col("old_repo").eqNullSafe(F.col("repo_id")) & F.col("old_path").eqNullSafe(F.col("path"))
        both = old.withColumn("known", F.lit(True)).join(seen.withColumn("given", F.lit(True)), same, "full_outer" if whole else "right_outer")
        key = [F.when(F.col("given"), F.col(n)).otherwise(F.col(o)).alias(n) for n, o in (("repo_id", "old_repo"), ("path", "old_path"))]
        changed = both.where(~F.col("old_sha").eqNullSafe(F.col("sha256"))).select(*key, "sha256")
        changed = stored(changed.withColumn("bucket", self._bucket()))
        touched = [r.bucket for r in changed.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        present = changed.where("sha256 IS NOT NULL").select("repo_id", "path", "sha256")
        arrived = _matching(files.withColumn("sha256", sha), present, ["repo_id", "path", "sha256"], "left_semi")
        arrived = (arrived.groupBy("repo_id", "path").agg(F.max(F.struct("language", "kind", "content")).alias("f"))
                   .select("repo_id", "path", "f.*"))
        fields = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.entry.fields])
        derived = self.derive(arrived).select("repo_id", "path", F.lit(None).cast("string").alias("sha256"), fields.alias("entry"))
        kept = _matching(self.rows().where(F.col("bucket").isin(touched)), changed, ["repo_id", "path"], "left_anti")
        columns = ["repo_id", "path", "sha256", "entry", "bucket"]
        rows = (kept.select(*columns)
                .unionByName(changed.withColumn("entry", F.lit(None).cast(self.entry)).select(*columns))
                .unionByName(derived.withColumn("bucket", self._bucket()).select(*columns)))
        version = max(self.versions(), default=0) + 1
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={version}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("repo_id", "path"), F.lit(self.buckets)).cast("int")


def _matching(rows: DataFrame, others: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join in which nulls equal each other."""
    right = others.select(*[F.col(k).alias(f"_{k}") for k in keys])
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(right, test, how)
