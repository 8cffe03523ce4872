"""Files as bytes: a folder read with the ``binaryFile`` source, or a table that already holds contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcegrain.functions import text as tx
from sourcegrain.sources import listing

MAX_BYTES = 512 * 1024


def _named_in(path: Column) -> Column:
    """Whether the name alone lets a file in: neither sensitive nor generated, of a known language, in no ignored folder."""
    name = tx.base_name(path)
    return ~listing.is_sensitive(name) & ~listing.is_generated(name) & listing.language_of(path).isNotNull() & ~listing.in_ignored_dir(path)


def folder_entries(spark: SparkSession, root: str) -> DataFrame:
    """repo_id, path, size of the files below ``root`` that Spark lists: the first folder names the repository. No file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return _relative(spark, files, root).select("repo_id", "path", F.col("length").alias("size"))


def read_folder(spark: SparkSession, root: str, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """repo_id, path, size, content (bytes) of the files that their name and size let in.

    Names are tested on the path and sizes on the length that the source lists, so refused files are never opened.
    A file straight below ``root`` has an empty repo_id. ``max_bytes`` None reads files of any size. Spark's file sources list no empty
    files and none with a name or folder that starts with a dot or an underscore (``__init__.py``): ``unlisted`` counts
    those; to scan them, bring the contents as a table.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.substring_index(F.col("_metadata.file_path"), _below(spark, root), -1)
    files = files.where(_named_in(below))
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    return _relative(spark, files, root).select("repo_id", "path", F.col("length").alias("size"), "content")


def unlisted(spark: SparkSession, root: str) -> int:
    """Number of files below ``root`` that Spark's file sources pass over; 0 means that ``read_folder`` sees the whole folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    total = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getFileCount()
    return total - folder_entries(spark, root).count()


def _below(spark: SparkSession, root: str) -> str:
    """The part of a file's address that all files of the folder share, without the scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.toUri().getPath().rstrip("/") + "/"


def _relative(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    inside = F.expr("substr(path, instr(path, '{0}') + length('{0}'))".format(_below(spark, root).replace("\\", "\\\\").replace("'", "\\'")))
    split = F.split("_inside", "/", 2)
    nested = F.size(split) > 1
    return (files.withColumn("_inside", inside)
            .withColumn("repo_id", F.when(nested, split[0]).otherwise(""))
            .withColumn("path", F.when(nested, split[1]).otherwise(F.col("_inside"))).drop("_inside"))


def scan(files: DataFrame, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """Text and facts of (repo_id, path, content as bytes).

    Returns repo_id, path, size, sha256 (of the bytes as they are), skip_reason and, for admitted files, content (text: byte
    order mark dropped, malformed UTF-8 replaced), lines and line_count, else null. The reason is the first of: ignored, sensitive,
    generated, unsupported, unreadable (null content), large, binary (a NUL byte in the first 8,192). Refused contents are not decoded.
    Empty files are admitted without lines. A null path is unsupported. Repeated rows stay; one narrow pass, no shuffle.
    """
    path, content = F.col("path"), F.col("content")
    name = tx.base_name(path)
    large = F.lit(False) if max_bytes is None else F.octet_length(content) > max_bytes
    reason = (F.when(path.isNull(), "unsupported").when(listing.in_ignored_dir(path), "ignored").when(listing.is_sensitive(name), "sensitive")
              .when(listing.is_generated(name), "generated").when(listing.language_of(path).isNull(), "unsupported")
              .when(content.isNull(), "unreadable").when(large, "large").when(tx.is_binary(content), "binary"))
    told = files.select("repo_id", "path", "content", F.octet_length(content).cast("long").alias("size"), F.sha2(content, 256).alias("sha256"),
                        F.explode(F.array(reason)).alias("skip_reason"))
    text = F.when(F.col("skip_reason").isNull(), tx.decode_source(content))
    told = told.select("repo_id", "path", "size", "sha256", "skip_reason", F.explode(F.array(text)).alias("content"))
    return told.withColumn("lines", tx.split_lines(F.col("content"))).withColumn(
        "line_count", F.when(F.col("content").isNotNull(), F.size("lines")))
